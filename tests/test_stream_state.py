"""The counter of a live log: it goes on after a stop, and keeps every row once."""

import datetime

from gleanery.streaming import traces as stream


def test_sessions_go_on_after_a_stop(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def add(name, rows):
        spark.createDataFrame(rows, "user string, event long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)

    def run():
        rows = stream.bucketed(stream.events(spark, folder), "user", "event", 5)
        stream.for_each_batch(rows, lambda b: b, out, check).awaitTermination()
        return spark.read.parquet(f"{out}/batch=*")

    at = datetime.datetime(2024, 1, 1)
    add("a", [("x", i, at) for i in range(7)] + [(None, 100, at)])
    first = run()
    assert sorted((r.user, r.pos, r.session) for r in first.where("user = 'x'").collect()) == [("x", i, f"s{i // 5:03d}") for i in range(7)]
    add("b", [("x", i, at) for i in range(7, 13)] + [("y", 50, at), (None, 101, at)])
    both = run().collect()
    assert run().count() == len(both) == 16
    assert sorted(r.id for r in both) == [*range(13), 50, 100, 101]
    assert sorted((r.pos, r.session) for r in both if r.user == "x") == [(i, f"s{i // 5:03d}") for i in range(13)]
    assert sorted(r.pos for r in both if r.user is None) == [0, 1]
    assert {r.id for r in both if r.user == "x" and r.pos >= 7} == set(range(7, 13))
