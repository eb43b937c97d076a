"""What SQL doesn't cover: folds over pages, sources and sinks, quantiles, replay, samples, clusters."""

import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import answer, chunking, cluster, evaluate, trace
from gleanery.plans import queries
from gleanery.sources import files
from gleanery.streaming import traces as stream


def loop_windows(parts, size, overlap):
    """The windows by a direct loop."""
    out, held, words = [], [], 0
    for i, p in enumerate(parts, 1):
        n = len(p.split())
        if held and words + n > size:
            out.append((held[0], held[-1]))
            tail, t = [], 0
            for j in reversed(held):
                if t + len(parts[j - 1].split()) > overlap:
                    break
                tail.insert(0, j)
                t += len(parts[j - 1].split())
            held, words = tail, t
        held.append(i)
        words += n
    return out + ([(held[0], held[-1])] if held else [])


def spans(texts, size, overlap, heads=None):
    counts = pa.array([None if t is None else [len(p.split()) for p in t] for t in texts], pa.list_(pa.int32()))
    return chunking.window_spans(counts, pa.array(heads or [[] for _ in texts], pa.list_(pa.int32())), size, overlap).to_pylist()


def test_sentence_windows():
    r = random.Random(1)
    for _ in range(300):
        texts = [[" ".join(["w"] * r.randrange(1, 9)) for _ in range(r.randrange(0, 15))] for _ in range(r.randrange(0, 6))]
        size = r.randrange(2, 12)
        overlap = r.randrange(0, size)
        heads = [sorted(r.sample(range(1, len(t) + 1), r.randrange(0, len(t) + 1))) for t in texts]
        got = spans(texts, size, overlap, heads)
        assert [[(w["first"], w["last"]) for w in own] for own in got] == [loop_windows(t, size, overlap) for t in texts]
        for own, t, h in zip(got, texts, heads, strict=True):
            assert [w["words"] for w in own] == [sum(len(p.split()) for p in t[w["first"] - 1 : w["last"]]) for w in own]
            assert [w["head"] for w in own] == [sum(x <= w["last"] + 1 for x in h) - 1 for w in own]


def test_windows_of_a_slice_and_of_a_long_text():
    counts, heads = pa.array([[9, 9], [1] * 200_000, [], [3, 3, 3]], pa.list_(pa.int32())), pa.array([[1, 2], [200_000], [], [2]], pa.list_(pa.int32()))
    got = chunking.window_spans(counts[1:], heads[1:], 5, 2).to_pylist()
    assert [w["first"] for w in got[0][:3]] == [1, 4, 7] and len(got[0]) == 66_666 and got[0][-1]["last"] == 200_000 and got[0][-1]["head"] == 0
    assert got[1] == [] and [(w["first"], w["last"], w["head"]) for w in got[2]] == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_headings(spark):
    said = ["## Next part", "##", "## ", "####### deep", "#x y", "# \u00a0wide\u00a0", "plain # no", "#\ttab"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, s string").select("i", chunking.strict_heading(F.col("s")).alias("a"), chunking.loose_heading(F.col("s")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == ["Next part", "", "", "", "", "wide", "", "tab"]
    assert [r.b for r in rows] == ["Next part", "", "", "deep", "x y", "wide", "", "tab"]


def test_window_ids_and_loose_headings(spark):
    docs = spark.createDataFrame([(1, "a b c.\n## Next part\nd e."), (2, "#\nx y. #loose\nz")], "doc_id long, text string")
    got = chunking.chunk_sentences(docs, 5, 0).orderBy("doc_id", "chunk_no").collect()
    assert [(r.chunk_uid, r.section) for r in got[:2]] == [("1::next-part::n0", "Next part"), ("1::next-part::n1", "Next part")]
    plain = chunking.chunk_documents(docs.selectExpr("doc_id as source", "concat('Title ', doc_id) as title", "text"), 5, 0).orderBy("source", "chunk_id").collect()
    assert [(r.source, r.title, r.section, r.chunk_id, r.text) for r in plain] == [
        (1, "Title 1", "Next part", 0, "a b c."), (1, "Title 1", "Next part", 1, "## Next part d e."), (2, "Title 2", "loose", 0, "# x y. #loose z"),
    ]


def test_strategies(spark):
    pages = chunking.parse_pages(queries.md_pages(spark, "/root/testdata/sf0.001")).where("size(missing) = 0")
    assert {n: chunking.make_chunks(pages, n).count() > 3 for n in ("structured", "naive", "large_windows")} == {"structured": True, "naive": True, "large_windows": True}
    with pytest.raises(ValueError):
        chunking.make_chunks(pages, "other")


def test_window_arguments(spark):
    with pytest.raises(ValueError):
        chunking.chunk_sentences(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 5, 5)


def test_structured_chunks():
    body = queries.MD_PAGES["good"].split("page_type: guide\n")[1].strip() + "\n"
    assert chunking.structured("v3-good", body) == [
        ("v3-good::start::0", "Start", "First line.\nSecond line."),
        ("v3-good::start::1-table", "Start", "| a | b |\n|---|---|\n| 1 | 2 |\n| c | d |"),
        ("v3-good::start::2", "Start", "After the tables."),
        ("v3-good::code::3-code", "Code", "```python\nx = 1\ny = 2\n```"),
        ("v3-good::code::4", "Code", "Done."),
    ]
    long = queries.MD_PAGES["long"].split("page_type: guide\n")[1]
    assert [len(t.split()) for _, _, t in chunking.structured("p", long)] == [100, 90, 200, 1]
    inner = chunking.structured("p", "## One\n```sh\n# comment\nrun it\n```\n")
    assert [(u, s) for u, s, _ in inner] == [("p::one::0-code", "One"), ("p::comment::1", "comment"), ("p::comment::2-code", "comment")]


def loop_blocks(text):
    """Blocks by a walk over the lines."""
    out, kind, held = [], "paragraph", []
    for line in [*text.split("\n"), None]:
        s = None if line is None else line.strip()
        start = s is not None and s.startswith("```")
        now = "fence" if kind == "fence" or start else kind if s in ("", None) else "table" if s[0] == "|" else "paragraph"
        if held and (line is None or now != kind or (start and kind != "fence") or (s == "" and kind == "paragraph")):
            out.append((kind, held))
            held = []
        was, kind = kind, now
        if s:
            held.append(line)
        if start and was == "fence":
            out.append((kind, held))
            held, kind = [], "paragraph"
    return out


def test_blocks():
    r = random.Random(2)
    for _ in range(3000):
        text = "\n".join(r.choice(["", " ", "| a", " | b", "text", "more ", "```", "``` sh", "# c"]) for _ in range(r.randrange(0, 14)))
        assert chunking.blocks(text) == loop_blocks(text), text


def test_blocks_open_fence():
    assert chunking.blocks("a\n```\nb\n\nc") == [("paragraph", ["a"]), ("fence", ["```", "b", "c"])]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "02_some_page.md").write_text("page_id: p\nsdk_version: v3\npage_type: x\nBody\n")
    (tmp_path / "in" / "skip.txt").write_text("no")
    pages = files.markdown(spark, str(tmp_path / "in")).collect()
    assert [(p.file, p.title) for p in pages] == [("02_some_page.md", "02 Some Page")]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.json_lines(spark, str(tmp_path / "t.jsonl"), "a int").where("a is not null").orderBy("a").collect()] == [1, 2]
    (tmp_path / "d.json").write_text('[\n{"symbol": "s"},\n{"symbol": "t"}]')
    assert files.json_document(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "p.txt").write_text("#! note\n#! fewshot_ids: a, b\nJudge {answer}\n\n")
    p = files.prompt_template(spark, str(tmp_path / "p.txt")).first()
    assert (p.prompt, p.fewshot_ids) == ("Judge {answer}\n", ["a", "b"])
    rows = spark.createDataFrame([("c", "u1", "x"), ("c", "u2", "y"), ("e", "u3", "z")], "collection string, chunk_uid string, text string")
    assert files.write_collection(rows, str(tmp_path / "col")) == 3
    assert files.write_collection(rows, str(tmp_path / "col")) == 3
    got = files.read_collection(spark, str(tmp_path / "col"), "c")
    new = files.update_metadata(got, spark.createDataFrame([("u1", 7)], "chunk_uid string, cluster_id int")).orderBy("chunk_uid").collect()
    assert [(r.chunk_uid, r.cluster_id) for r in new] == [("u1", 7), ("u2", None)]
    assert files.update_metadata(got, spark.createDataFrame([("u1", None)], "chunk_uid string, text string")).where("chunk_uid = 'u1'").first().text is None
    assert [r.text for r in files.get(spark, str(tmp_path / "col"), "c", ["u2", "u3"]).collect()] == ["y"]
    assert {(r.collection, r.rows) for r in files.collections(spark, str(tmp_path / "col")).collect()} == {("c", 2), ("e", 1)}
    files.write_report(rows.select("chunk_uid", "text").orderBy("chunk_uid"), str(tmp_path / "r.md"), "Rows")
    assert (tmp_path / "r.md").read_text() == "# Rows\n\n| chunk_uid | text |\n|---|---|\n| u1 | x |\n| u2 | y |\n| u3 | z |\n"


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 84])
def test_exclusive_quantile(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    r = evaluate.latency_quantiles(spark.createDataFrame([("k", v) for v in values], "k string, v double"), "k", "v").first()
    assert r.median == pytest.approx(statistics.median(values))
    assert r.p95 == pytest.approx(statistics.quantiles(values, n=20)[18] if n > 1 else values[0])


def test_code_check(spark):
    got = {r.case_id: r.status for r in evaluate.code_parses(spark.createDataFrame([(x[0], x[2]) for x in queries.CASES], "case_id string, answer string")).collect()}
    assert got == {"a1": "n/a", "a2": "n/a", "a3": "n/a", "a4": "n/a", "a5": "pass", "a6": "fail", "a7": "fail", "a8": "n/a", "a9": "fail", "b1": "n/a"}


def test_deprecations_of_many_symbols(spark, monkeypatch):
    from gleanery.operators import retrieve

    symbols = spark.range(1100).selectExpr("concat('old_', id) as symbol", "concat('old_', id, '$') as pattern")
    said = spark.range(1100).selectExpr("concat('c', id) as case_id", "concat('use old_', id) as answer")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 500)
    assert evaluate.deprecations(said, symbols).where("status = 'fail'").count() == 1100


def test_lock_check(spark):
    labels = spark.sql("select * from values ('a', 'PASS'), ('b', null) as t(id, label)")
    assert evaluate.lock_check(labels, "x", "x", "y", "y", 0, 2).first().reason == "incomplete labels"
    good = labels.where("label is not null")
    assert evaluate.lock_check(good, "x", "z", "y", "y", 0, 1).first().reason == "answers changed after the lock"
    assert evaluate.lock_check(good, "x", "x", "y", "y", 1, 1).first().valid is False


def test_answers_without_hits(spark):
    q = spark.createDataFrame([(1, "what is it"), (2, "find zebra")], "query_id long, question string")
    hits = spark.createDataFrame([(2, 1, 5, 0.9)], "query_id long, rank int, chunk_id long, final double")
    chunks = spark.createDataFrame([(5, "A zebra ran. It was fast\nfind it")], "chunk_id long, text string")
    got = {r.query_id: (r.gate, r.answer) for r in answer.answers(answer.hit_lists(q, hits, chunks), F.expr("cast(array() as array<string>)")).collect()}
    assert got[1] == ("score", answer.REFUSAL)
    assert got[2][0] == "open" and got[2][1].endswith("[chunk:5]")


def test_seeded_pick_is_repeatable():
    ids = [f"t{i}" for i in range(50)]
    assert trace.seeded_pick(ids, 3, 5) == trace.seeded_pick(list(reversed(ids)), 3, 5)


def test_clusters(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 5 + i * 0.001, 0.0]) for i in range(12)], "vec_id long, embedding array<double>")
    got, k, score = cluster.assign(rows, most_k=3, starts=2)
    assert k == 2 and score > 0.9
    assert len({r.cluster for r in got.where("id % 2 = 0").collect()}) == 1
    with pytest.raises(ValueError):
        cluster.assign(rows.limit(3))


def test_silhouette_in_blocks(spark, monkeypatch):
    from gleanery.operators import retrieve

    rows = spark.createDataFrame([(i, [float(i * i % 11), float(i % 3)], i % 4) for i in range(40)], "id long, v array<double>, cluster int")
    whole = cluster.silhouette(rows).first().silhouette
    monkeypatch.setattr(cluster, "MOST_FOR_SILHOUETTE", 10, raising=False)  # sizes over it had no result
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 9)
    assert cluster.silhouette(rows).first().silhouette == whole


def test_cluster_query_tries_as_much_as_the_reference(spark, monkeypatch):
    asked = {}
    rows = spark.createDataFrame([(1, 0)], "id long, cluster int")
    monkeypatch.setattr(cluster, "assign", lambda vectors, **limits: (asked.update(limits), (rows, 2, 0.5))[1])
    queries.cluster_assign(spark, "/root/testdata/sf0.001")
    assert asked == {"most_k": 8, "starts": 10}


def test_stream_batches(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    events = stream.events(spark, folder, "events.parquet")
    stream.for_each_batch(events, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 1000


def test_symbol_tokens(spark):
    df = spark.createDataFrame([("Set x-rate-limit to v1.2, a_b",)], "t string")
    assert df.select(T.tokens_symbol(F.col("t")).alias("w")).first().w == ["set", "x-rate-limit", "x", "rate", "limit", "to", "v1.2", "v1", "2", "a_b", "a", "b"]


def test_queries_in_blocks(spark, monkeypatch):
    from gleanery.operators import retrieve

    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "chunk_id long, embedding array<double>")
    asked = vectors.selectExpr("chunk_id as query_id", "embedding as query")
    whole = sorted(map(tuple, retrieve.dense_topk(vectors, asked, 3).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, retrieve.dense_topk(vectors, asked, 3).collect())) == whole and len(whole) == 120


def plain_bm25(texts, question, n_best):
    """BM25 by the formula, over a dict of texts."""
    import math
    import re

    def terms(t):
        out = []
        for w in re.findall(r"[a-z0-9_]+(?:[.\-][a-z0-9_]+)*", t.lower()):
            parts = [p for p in re.split(r"[._\-]", w) if p]
            out += [w, *parts] if len(parts) > 1 else [w]
        return out

    docs = {i: terms(t) for i, t in texts.items()}
    avg = sum(map(len, docs.values())) / len(docs)
    scores = {}
    for q in set(terms(question)):
        df = sum(q in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(q):
                scores[i] = scores.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return sorted(((-round(s, 9), i) for i, s in scores.items()))[:n_best]


def test_index(spark, monkeypatch):
    from gleanery.operators import retrieve

    r = random.Random(7)
    vocab = ["the", "a_b", "x-y", "v1.2", "ä", "Zed", *(f"w{i}" for i in range(40))]
    texts = {i: " ".join(r.choices(vocab, k=r.randrange(0, 30))) for i in range(120)} | {500: None, 501: ""}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    asked = [(i, " ".join(r.choices([*vocab, "unknown"], k=4))) for i in range(25)] + [(90, ""), (91, None)]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 10)
    for segments in (1, 3, 17):  # of 17 segments five are looked at first
        index = retrieve.Bm25Index.build(chunks, segments)
        for allowed in (None, chunks.where("chunk_id % 3 = 0")):
            got = {}
            for x in index.topk(questions, 5, allowed).orderBy("query_id", "rank").collect():
                got.setdefault(x.query_id, []).append((-round(x.score, 9), x.chunk_id))
            for i, q in asked:
                want = [x for x in plain_bm25({k: v or "" for k, v in texts.items()}, q or "", 500) if allowed is None or x[1] % 3 == 0][:5]
                assert [c for _, c in got.get(i, [])] == [c for _, c in want]
                assert [s for s, _ in got.get(i, [])] == pytest.approx([s for s, _ in want], abs=1e-8)
    assert index.scores(questions).groupBy("query_id").count().where("query_id = 0").first()[1] == len(plain_bm25({k: v or "" for k, v in texts.items()}, asked[0][1], 500))
    facts = [(i, [t[3:40]]) for i, t in texts.items() if t and len(t) > 60][:20] + [(200, ["w1"]), (201, ["w1", "w2"]), (202, [None]), (203, ["nothing of this is there"]), (204, ["ED W"]), (205, ["ä"]), (206, ["Z"]), (207, ["_b"]), (208, ["x-"]), (209, [""]), (210, []), (211, ["w1", "ä"]), (212, ["1 w"]), (213, ["zed"]), (214, ["b w3"])]
    for any_case in (False, True):
        low = (lambda t: t.lower()) if any_case else (lambda t: t)
        want = {(q, i) for q, f in facts for i, t in texts.items() if t is not None and all(x is not None and low(x) in low(t) for x in f)}
        out = index.holders(spark.createDataFrame(facts, "query_id long, facts array<string>"), chunks, any_case).collect()
        assert {tuple(x) for x in out} == want and len(out) == len(want)


def test_index_opens_few_blocks(spark):
    """A rare term's chunks settle the result: blocks of the common words beside it aren't opened."""
    from gleanery.operators import retrieve

    texts = [(i, "the of and " * 5 + f"w{i % 50} " + ("zebra quagga okapi " if i % 1000 < 4 else "")) for i in range(8000)]
    index = retrieve.Bm25Index.build(spark.createDataFrame(texts, "chunk_id long, text string"), 200)
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id long, question string")
    rare, common = index.opened(ask("the zebra quagga of okapi"), 5), index.opened(ask("the of and"), 5)
    assert rare[0] < 0.35 * rare[1] and common[0] == common[1] == 600
    assert [r.chunk_id for r in index.topk(ask("the zebra quagga of okapi"), 3).collect()] == [0, 1, 2]
    plan = index.of_terms(index.wanted(ask("zebra okapi")).collect())._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term,okapi)" in plan


def test_postings_in_pieces(spark, monkeypatch):
    """A block that fills a pack by itself, and one that a pack's end would cut."""
    from gleanery.operators import postings

    rows = [("a", 0, i) for i in range(25)] + [("b", s, i) for s in range(4) for i in range(3)]
    got = []
    made = spark.createDataFrame([(t, s, i, float(i)) for t, s, i in rows], "term string, seg bigint, chunk_id long, part double").coalesce(1).sortWithinPartitions("term", "seg")
    import pyarrow as pa

    for packs in (10, 7, 1000):
        monkeypatch.setattr(postings, "PACKED", packs)
        kept = {}
        monkeypatch.setattr(type(made), "mapInArrow", lambda self, f, schema, kept=kept: kept.update(f=f))
        postings.packed(made, made.schema["chunk_id"].dataType)
        monkeypatch.undo()
        monkeypatch.setattr(postings, "PACKED", packs)
        batches = pa.Table.from_pandas(made.toPandas()).to_batches(max_chunksize=4)
        out = [r for b in kept["f"](iter(batches)) for r in b.to_pylist()]
        got = [(r["term"], r["seg"], i) for r in out for i in r["ids"]]
        assert got == rows and all(r["n"] == len(r["ids"]) and r["top"] == max(r["parts"]) for r in out)


def test_vector_cells(spark):
    """Cells give what comparing everything gives, under filters, ties, odd lengths and missing values, and open a part of it."""
    from gleanery.operators import retrieve
    from gleanery.operators.vectors import VectorIndex

    r = random.Random(3)
    point = lambda n: [r.choice([0.0, 0.5, r.gauss(0, 1)]) for _ in range(n)]
    middle = [[r.gauss(0, 4) for _ in range(8)] for _ in range(12)]
    near = lambda: [m + r.gauss(0, 0.05) for m in r.choice(middle)]
    rows = [(i, near(), i % 4) for i in range(900)] + [(1000 + i, point(3), None) for i in range(50)] + [(2000 + i, middle[0], 1) for i in range(700)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [1.0, None], 1), (3003, [float("nan")] * 8, 1), (3004, [0.0] * 8, 2)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, kind int")
    index = VectorIndex.build(df, ("kind",))
    asked = [(i, v, k) for i, v, k in rows if i % 97 == 0 or i in (2000, 2001, 3000, 3004)]
    queries_ = spark.createDataFrame(asked, "query_id long, query array<double>, kind int")
    whole = [x for x in rows if x[1] and all(c is not None and c == c for c in x[1])]

    def want(k, keep):
        out = set()
        for q, v, kind in asked:
            if v:
                dots = [(-round(sum(a * b for a, b in zip(v, x, strict=True)), 9), i) for i, x, own in whole if i != q and len(x) == len(v) and keep(kind, own)]
                out |= {(q, n, i) for n, (_, i) in enumerate(sorted(dots)[:k], 1)}
        return out

    told = lambda df: {(x.query_id, x["rank"], x.chunk_id) for x in df.collect()}
    assert told(retrieve.dense_topk(index, queries_, 7)) == want(7, lambda a, b: True)
    assert told(retrieve.dense_topk(index, queries_, 7, where={"kind": 3})) == want(7, lambda a, b: b == 3)
    assert told(retrieve.dense_topk(index, queries_, 7, same=("kind",))) == want(7, lambda a, b: a == b)
    pairs = retrieve.dense_scores(index, queries_, where={"kind": 2})
    assert pairs.count() == len(want(10_000, lambda a, b: b == 2))
    opened = index.topk(queries_.where("query_id < 900"), 5)[1]
    assert opened["opened"] < 0.3 * opened["cells"]
    with pytest.raises(ValueError):
        index.topk(queries_, 3, where={"lang": "en"})
    assert retrieve.dense_topk(VectorIndex.build(df.where("false")), queries_, 3).count() == 0


def test_filters_in_retrieval(spark):
    """Every retriever gives what it would give had other chunks never been there, but for statistics over all chunks."""
    from gleanery.operators import retrieve

    r = random.Random(8)
    rows = [(i, " ".join(r.choices(["red", "fox", "dog", "sun", "sea"], k=6)), "en" if i % 3 else "fr", [r.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    chunks = spark.createDataFrame([x[:3] for x in rows], "chunk_id long, text string, lang string")
    vectors = spark.createDataFrame([(x[0], x[3]) for x in rows], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(900, "red sea", [1.0, 0.0, 0.5, 0.0]), (901, "dog", None)], "query_id long, question string, query array<double>")
    corpus = retrieve.Corpus(chunks, vectors, retrieve.Bm25Index.build(chunks))
    for name in retrieve.RETRIEVERS:
        got = [x for x in retrieve.retriever(name)(corpus, asked, 5, {"lang": "fr"}).collect()]
        assert got and all(x.chunk_id % 3 == 0 for x in got), name
        if name == "dense":
            best = sorted((-sum(a * b for a, b in zip(x[3], [1.0, 0.0, 0.5, 0.0], strict=True)), x[0]) for x in rows if x[2] == "fr")[:5]
            assert [x.chunk_id for x in sorted(got, key=lambda x: x["rank"])] == [i for _, i in best]
    assert retrieve.retriever("bm25")(corpus, asked, 5, {"lang": "xx"}).count() == 0
def test_hybrid_without_vectors(spark):
    from gleanery.operators import retrieve

    chunks = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green dog")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(7, "blue fox", None), (8, "red fox", [0.6, 0.8])], "query_id long, question string, query array<double>")
    corpus = retrieve.Corpus(chunks, vectors, retrieve.Bm25Index.build(chunks))
    got = {(r.query_id, r.chunk_id): (r.dense, round(r.final, 6)) for r in retrieve.retriever("hybrid")(corpus, questions, 3).collect()}
    assert got == {(7, 2): (None, 0.15), (7, 1): (None, 0.075), (8, 1): (0.6, 0.75), (8, 3): (0.8, 0.8), (8, 2): (None, 0.075)}
    assert {n: retrieve.retriever(n)(corpus, questions, 2).count() for n in ("dense", "baseline", "bm25")} == {"dense": 2, "baseline": 2, "bm25": 4}
    with pytest.raises(ValueError):
        retrieve.retriever("other")


def test_embedder(spark):
    from gleanery.operators import retrieve

    rows = spark.createDataFrame([(1, "a b a"), (2, "A, b; a!"), (3, ""), (4, "zebra")], "chunk_id long, text string")
    v = {r.chunk_id: r.embedding for r in retrieve.HashedWords(64).encode(rows).collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1) and not any(v[3])


def test_row_numbers(spark):
    rows = spark.range(997).selectExpr("id * 7919 % 997 as x")
    assert sorted((r.x, r.pos) for r in trace.row_numbers(rows, "x").collect()) == [(i, i) for i in range(997)]


def test_fingerprint_sees_swaps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "chunk_id long, text string")
    b = spark.createDataFrame([(2, "x"), (1, "y"), (3, None)], "chunk_id long, text string")
    of = lambda df: trace.corpus_fingerprint(df).first().digest
    assert of(a) == of(a.orderBy(F.desc("chunk_id"))) != of(b) and len(of(a)) == 12


def test_replay_takes_each_trace_by_its_own_limits(spark):
    hits = spark.createDataFrame([(1, 1, 5, 0.5), (2, 1, 5, 0.5)], "query_id long, rank int, chunk_id long, final double")
    chunks = spark.createDataFrame([(5, "A zebra ran.")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "find zebra"), (2, "find the zebra")], "query_id long, question string")
    none = F.expr("cast(array() as array<string>)")
    lists = answer.hit_lists(q, hits, chunks)
    made = [trace.build(answer.answers(lists.where(F.col("query_id") == i), none, t, 0.1), none, trace.Run(threshold=t, floor=0.1)) for i, t in ((1, 0.4), (2, 0.9))]
    log = made[0].unionByName(made[1])
    assert log.schema.simpleString() == spark.createDataFrame([], trace.SCHEMA).schema.simpleString()
    got = {r.raw_output == answer.REFUSAL: r.same for r in trace.replay(log).collect()}
    assert got == {True: True, False: True}


def test_reading_view(spark):
    run = trace.Run()
    lists = spark.sql("select 'q' as question, array(named_struct('rank', 1, 'chunk_id', 4L, 'final', 0.5D, 'text', 'body', 'dense', 0.25D)) as hits, 'out' as answer")
    view = trace.reading_view(trace.build(lists, F.expr("cast(array() as array<string>)"), run).withColumn("pos", F.lit(3))).first().view
    assert view.startswith("## 3. tr-") and "| 1 | 4 | - | 0.250 | 0.500 |" in view and view.endswith("### 1 4\nbody\n\nOutput: out")


def test_picked_keeps_the_order(spark):
    rows = spark.range(20).selectExpr("concat('t', id) as trace_id")
    ids = trace.seeded_pick([r.trace_id for r in rows.collect()], 5, 6)
    assert [r.trace_id for r in trace.picked(rows, ids).orderBy("pos").collect()] == ids


def test_judges():
    prompts = {"v1": "a", "v2": "b", "v10": "c"}
    assert evaluate.judge_version(prompts, True) == "v10" and evaluate.judge_version(prompts, False) is None
    assert evaluate.judge_version(prompts, False, "v1") == "v1" and evaluate.judge_version(prompts, True, "none") is None
    with pytest.raises(ValueError):
        evaluate.judge_version(prompts, True, "v3")


def test_cluster_fields_are_written_back(spark):
    chunks = spark.sql("select * from values ('u1', 'a'), ('u2', 'b'), ('u3', 'c') as t(chunk_uid, text)")
    members = spark.sql("select * from values ('u1', 0), ('u3', 1) as t(chunk_uid, cluster)")
    names = spark.sql("select * from values (0, 'c0-x'), (1, 'c1-y') as t(cluster, name)")
    got = cluster.write_back(chunks, members, names).orderBy("chunk_uid").collect()
    assert [(r.text, r.cluster_id, r.cluster_label) for r in got] == [("a", 0, "c0-x"), ("b", None, None), ("c", 1, "c1-y")]


@pytest.mark.parametrize("n", [201, 1000, 1999])
def test_quantiles_of_skewed_groups(spark, n):
    r = random.Random(n)
    values = {"even": [r.random() for _ in range(n)], "ties": [float(r.choice([1, 1, 1, 2, 9])) for _ in range(n)], "one": [4.0] * n}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("even", None), (None, 3.0)], "k string, v double")
    got = {x.k: (x.n, x.median, x.p95) for x in evaluate.latency_quantiles(rows, "k", "v", accuracy=100).collect()}
    for k, v in values.items():
        assert got[k] == (n, pytest.approx(statistics.median(v), abs=1e-6), pytest.approx(statistics.quantiles(v, n=20)[18], abs=1e-6))
    assert got[None] == (1, 3.0, 3.0)


def test_hashed_words_by_count(spark):
    import hashlib

    from gleanery.operators import retrieve

    texts = [(1, "a b a. c"), (2, ""), (3, None), (4, "word " * 5000), (1, "a b a. c")]
    got = [(r.chunk_id, r.embedding) for r in retrieve.HashedWords(16).encode(spark.createDataFrame(texts, "chunk_id long, text string")).collect()]
    for (i, text), (j, vector) in zip(texts, got, strict=True):
        want = [0.0] * 16
        for w in (text or "").replace(".", "").split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        norm = sum(x * x for x in want) ** 0.5
        assert i == j and vector == pytest.approx([x / norm if norm else 0.0 for x in want])


def test_embedded_search_with_a_filter(spark):
    from gleanery.operators import retrieve

    chunks = spark.createDataFrame([(1, "red fox", "en"), (2, "red wolf", "de"), (3, "", "en"), (4, None, "en")], "chunk_id long, text string, lang string")
    asked = spark.createDataFrame([(-1, "red wolf"), (-2, "")], "query_id long, question string")
    got = {(r.query_id, r["rank"]): (r.chunk_id, round(r.dense, 6)) for r in retrieve.embedded_topk(chunks, asked, retrieve.HashedWords(64), 2, {"lang": "en"}).collect()}
    assert got == {(-1, 1): (1, 0.5), (-1, 2): (3, 0.0), (-2, 1): (1, 0.0), (-2, 2): (3, 0.0)}


def test_replay_takes_each_trace_by_its_own_retriever(spark):
    """A log of two retrievers; the query's SQL follows the texts, and isn't settled beforehand."""
    import dataclasses

    from gleanery.operators import retrieve

    chunks = spark.createDataFrame([(1, "red fox"), (2, "blue fox runs"), (3, "green dog")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, "blue fox", [0.0, 1.0])], "query_id long, question string, query array<double>")
    corpus, none = retrieve.Corpus(chunks, vectors, retrieve.Bm25Index.build(chunks)), F.expr("cast(array() as array<string>)")
    run = trace.Run(pipeline="bm25", top_k=2, threshold=-9.0, floor=0.0)
    log = trace.ask(corpus, asked, none, run).unionByName(trace.ask(corpus, asked, none, dataclasses.replace(run, pipeline="dense"))).localCheckpoint()
    out = trace.replay_full(log, corpus, asked, run).collect()
    assert len(out) == 2 and all(r.same_hits and r.same_output for r in out)
    assert "FROM documents" in queries.ORACLES["trace_replay_full"] and "replayed" in queries.ORACLES["trace_replay_full"]


def test_texts_stay_where_they_are(spark):
    """The join of candidates with texts, and counts of words, move no text; vectors alone need no index of words."""
    from gleanery.operators import retrieve

    texts = spark.range(0, 4000, 1, 4).selectExpr("id as chunk_id", "concat('a_b fox ', id) as text")
    few = spark.createDataFrame([(1, 5), (2, 4000), (3, 7)], "query_id long, chunk_id long")
    out = retrieve.beside(few, texts)
    assert sorted((r.query_id, r.text) for r in out.collect()) == [(1, "a_b fox 5"), (3, "a_b fox 7")]
    counts = retrieve.term_freq(texts)
    for df in (out, counts):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, "fox", [0.0, 1.0])], "query_id long, question string, query array<double>")
    assert [r.chunk_id for r in retrieve.retriever("baseline")(retrieve.Corpus(texts, vectors, None), asked, 1).collect()] == [2]


def test_term_freq_of_repeated_ids(spark):
    from gleanery.operators import retrieve

    rows = [(1, "Fox fox v1.2"), (1, "fox"), (None, "a"), (None, "a"), (2, None), (3, ""), (4, "x-")]
    got = sorted(((r.chunk_id, r.term, r.tf) for r in retrieve.term_freq(spark.createDataFrame(rows, "chunk_id long, text string")).collect()), key=repr)
    assert got == [(1, "2", 1), (1, "fox", 3), (1, "v1", 1), (1, "v1.2", 1), (4, "x", 1), (None, "a", 2)]


def test_words_of_a_batch():
    import re

    from gleanery.operators import words

    r = random.Random(3)
    for _ in range(100):
        texts = ["".join(r.choices("ab1_.- \u00e9\n\tz", k=r.randrange(0, 40))) if r.random() > 0.1 else None for _ in range(r.randrange(0, 8))]
        column = pa.array(["x.y", *texts], pa.string())[1:]
        row, code, names = words.symbols(column)
        got = sorted((i, names[c].as_py()) for i, c in zip(row.tolist(), code.tolist(), strict=True))
        whole = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[a-z0-9_]+(?:[.\-][a-z0-9_]+)*", t or "")]
        parts = [(i, p) for i, w in whole if len(own := [x for x in re.split(r"[._\-]", w) if x]) > 1 for p in own]
        assert got == sorted(whole + parts)
        row, code, names = words.spaced(column)
        assert [(i, names[c].as_py()) for i, c in zip(row.tolist(), code.tolist(), strict=True)] == [(i, w) for i, t in enumerate(texts) for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w]


def test_index_in_pieces(spark, monkeypatch):
    """Segments that come in several rows, and an id's rows that a piece's end would part."""
    from gleanery.operators import retrieve, words

    rows = [(i // 2, f"fox w{i % 7} {'dog ' * (i % 5)}") for i in range(200)]
    chunks, asked = spark.createDataFrame(rows, "chunk_id long, text string"), spark.createDataFrame([(1, "dog w3")], "query_id long, question string")
    whole = [tuple(r) for r in retrieve.Bm25Index.build(chunks, 3).topk(asked, 9).orderBy("rank").collect()]
    monkeypatch.setattr(words, "PIECE", 60)
    assert [tuple(r) for r in retrieve.Bm25Index.build(chunks, 3).topk(asked, 9).orderBy("rank").collect()] == whole and len(whole) == 9


def test_best_overlap(spark, monkeypatch):
    """As by comparing everything; no row of a text and a question that share a word is made, and none moves."""
    from gleanery.operators import retrieve

    r = random.Random(4)
    rows = [(i % 20, i // 20, " ".join(r.choices(["Red", "fox", "dog-", "sun", "sea", "x.y"], k=r.randrange(0, 7)))) for i in range(160)] + [(99, 0, None)]
    asked = [(1, "red fox red"), (2, "sun, x"), (3, "none"), (4, ""), (5, None), (6, "sea dog fox sun")]
    monkeypatch.setattr(retrieve, "PAIRS", 30)
    out = retrieve.best_overlap(spark.createDataFrame(rows, "doc_id long, chunk_no int, text string"), spark.createDataFrame(asked, "query_id long, question string"), ("doc_id", "chunk_no"))
    import re

    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    want = []
    for q, t in asked:
        best = min(((-len(words(t) & words(x)), d, c) for d, c, x in rows), default=(0,))
        if best[0]:
            want.append((q, best[1], best[2], -best[0] / len(words(t))))
    assert sorted(tuple(x) for x in out.collect()) == want and len(want) == 3
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_windows_carry_no_document(spark):
    """A window's row has its own text: with all sentences of its document in each row a long document takes its square."""
    text = " ".join(f"Word {i} stands\u00a0here." for i in range(300)) + "\n## Head\u2003\nlast\x1cone."
    made = chunking.chunk_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), 12, 3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate posexplode" in x)
    assert "transform" in plan and "s#" not in generate.split("posexplode")[1].split("[")[-1]
    rows = made.collect()
    assert rows[-1].section == "Head" and all(r.words == len(r.text.split()) for r in rows) and len(rows) > 100


def test_silhouettes_of_several_clusterings(spark, monkeypatch):
    """One pass over the pairs, repeated ids and vectors of another length among them, gives each clustering's own value."""
    from gleanery.operators import retrieve, vectors

    r = random.Random(11)
    rows = [(i % 57, [r.gauss(i % 3, 1.0) for _ in range(3 if i % 9 else 2)], [i % 57 % 2, i % 57 % 5, 0]) for i in range(60)]
    import math

    want = []
    for which in range(3):
        per: dict = {}
        for i, v, own in rows:
            for j, w, other in rows:
                if i != j and len(v) == len(w):
                    per.setdefault((i, own[which]), {}).setdefault(other[which], []).append(math.dist(v, w))
        value = []
        for (_, c), of in per.items():
            mean = {k: sum(x) / len(x) for k, x in of.items()}
            a, b = mean.get(c), min((m for k, m in mean.items() if k != c), default=None)
            value.append(0.0 if a is None or b is None else (b - a) / max(a, b))
        want.append(round(sum(value) / len(value), 6))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "TILE", (4, 7))
    made = spark.createDataFrame(rows, "id long, v array<double>, clusters array<long>")
    calls = []
    monkeypatch.setattr(vectors, "by_length", lambda c, f=vectors.by_length: calls.append(1) or f(c))
    assert cluster.silhouettes(made).first()[0] == pytest.approx(want, abs=2e-6)


def test_labels_sort_no_words(spark):
    """Counts of a cluster's words take a hash table, and words as common and as early go by their places."""
    rows = [(1, "page", "delta gamma alpha", 5), (1, "page", "alpha gamma delta", 7), (2, "x", "set", 9), (1, "page", "omega", None)]
    made = spark.createDataFrame(rows, "cluster int, page string, section string, pos long")
    assert {(r.cluster, r.size, r.name) for r in cluster.labels(made).collect()} == {(1, 3, "c1-page-delta-gamma"), (2, 1, "c2-misc")}
