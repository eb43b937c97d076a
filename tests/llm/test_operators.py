"""Each operator against brute force, on texts with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import chat_format, components, decontaminate, jaccard_join, license_scan, packing, quality, shard, substring_dedup, topk, url_filter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "n long, key string, rep long, token long, size long, shard int, part int, low long, run long, edge long, n_words long, cuts string, tokens string, _row int"


def corpus() -> list[tuple]:
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ÄÖ", "The", "the", "naïve—x"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "a b"), (None, "a b c d"), (7, "x " * 40), (7, "x " * 40)]
    base = [" ".join(r.choices(vocab, k=n)) for n in (60, 120, 300)]
    passage = " ".join(r.choices(vocab, k=55))
    for i in range(10, 130):
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            t[r.randrange(len(t))] = r.choice(vocab)
        if r.random() < 0.2:
            t[5:5] = passage.split(" ")
        rows.append((i, " ".join(t)))
    rows += [(i, " ".join(r.choices(vocab, k=r.randrange(1, 80)))) for i in range(130, 170)]
    rows += [(170, " ".join(r.choices(vocab, k=20_000))), (171, passage.upper()), (172, "word\u00a0glued\x0bsplit  " + passage)]
    return rows


def frame(spark, rows, extra=CLASH):
    df = spark.createDataFrame([(a, b, "en", "s") for a, b in rows], "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *(f"cast(null as {c.split()[1]}) as `{c.split()[0]}`" for c in extra.split(", ")))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---------------------------------------------------------------- 1

def test_license_scan_of_many_hits(spark):
    """Tens of thousands of hits in a text: time grows with them, not with their square; blocks change nothing."""
    import time

    took = []
    for n in (2_000, 2_000, 24_000):
        rows = frame(spark, [(1, "licensed under the mit license x " * n)])
        began = time.perf_counter()
        out = license_scan.scan(rows).collect()
        took.append(time.perf_counter() - began)
        assert (out[0].labels, out[0].n_hits, out[0].n_words) == ("mit", 2 * n, 6 * n)
    assert took[2] < 30 * took[1] + 5
    few = [(i, " ".join(random.Random(i).choices(["licensed under the", "mit license", "x", "apache license version 2.0", "license", "gpl"], k=60))) for i in range(40)]
    whole = sorted(map(tuple, license_scan.scan(frame(spark, few)).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(license_scan, "FOLD", 3)
        assert sorted(map(tuple, license_scan.scan(frame(spark, few)).collect())) == whole


def test_license_scan(spark, docs, empty):
    rows = [
        (1, "Work (CC-BY 4.0), see. All rights\nreserved!"), (2, "GNU General Public License version 3 or cc by"), (3, None), (4, "xcc by, ccby and All Rights Reservedly"),
        (5, "Released under the MIT License."), (5, "Released under the MIT License."), (6, "all rights reserved " * 3000), (7, "SPDX-License-Identifier: Apache-2.0"), (8, "École cc by"),
    ]
    out = license_scan.scan(frame(spark, rows)).orderBy("doc_id").collect()
    phrases = {"cc-by": ["cc", "by"], "gpl": "general public license".split(), "reserved": "all rights reserved".split()}
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    for i, text in dict(rows).items():
        w, r = WORD.findall((text or "").translate(LOWER)), by[i][0]
        at = [(k, name) for name, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({n for _, n in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not at
        assert 0 <= r.score <= 1
    assert by[1][0].labels == "cc-by,cc-by-4.0,reserved"  # the longer name suppresses hints inside it
    assert by[2][0].labels == "cc-by,gpl,gpl-3.0"
    assert by[5][0].labels == "mit" and by[7][0].labels == "apache-2.0"
    assert license_scan.scan(empty).count() == 0
    assert license_scan.scan(docs).count() == len(corpus())
    assert len(license_scan.rules()) > 200
    for _, _, _, word, pattern in license_scan.rules():
        assert word in pattern and re.compile(pattern)


def test_license_names_inside_hints(spark):
    rows = [
        (1, "licensed under GPLv2"), (2, "licensed under the GPL"), (3, "Licensed under AGPLv3."), (4, "released under the ISC license"), (5, "licensed under foo"),
        (6, "licensed under foo, licensed under GPLv2"), (7, "you should have received a copy of the GNU General Public License"), (8, "psf license agreement"),
    ]
    got = {r.doc_id: (r.labels, r.score, r.n_hits) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(1, 5)] == [("gpl-2.0", 0.9, 1), ("gpl", 0.75, 1), ("agpl-3.0", 0.9, 1), ("isc", 0.75, 1)]
    assert got[5] == ("license", 0.3, 1) and got[6] == ("gpl-2.0,license", 0.9, 2)
    assert got[7][:2] == ("gpl", 0.75)  # the name has a better priority than the fragment around it
    assert got[8] == ("psf-2.0", 0.75, 1)


def test_license_gates_are_in_every_match():
    from gleanery.llm.license_rules import signatures

    def samples(pattern):
        """Some texts that a pattern matches: every branch of each group, with and without what may be left out."""
        if m := re.search(r"\(\?:([^()]*)\)(\?)?", pattern):
            for x in [*m[1].split("|"), *([""] if m[2] else [])]:
                yield from samples(pattern[: m.start()] + x + pattern[m.end() :])
        elif m := re.search(r"\[([^]]*)\]\+?", pattern):
            yield from samples(pattern[: m.start()] + m[1][0] + pattern[m.end() :])
        elif m := re.search(r"(.)\?", pattern):
            yield from samples(pattern[: m.start()] + pattern[m.end() :])
            yield from samples(pattern[: m.start()] + m[1] + pattern[m.end() :])
        else:
            yield pattern

    for _, _, _, word, pattern in signatures():
        for text in list(samples(pattern))[:200]:
            norm = " " + "  ".join(text.split(" ")) + " "
            assert re.search(license_scan.spaced(pattern), norm), (pattern, text)
            assert license_scan.gate(pattern) in norm and word in text, (pattern, text)


def test_license_sql_follows_priority(spark, tmp_path):
    import duckdb

    rows = [(1, "published under the isc license"), (2, "licensed under GPLv2"), (3, "licensed under foo, all rights reserved"), (4, "gnu general public license version 3 or later"), (5, "distributed under a postgresql license"), (6, None), (7, "..")]
    frame(spark, rows, "x long").createOrReplaceTempView("d")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    cur = con.execute(license_scan.oracle())
    cols = [c[0] for c in cur.description]
    got = license_scan.scan(spark.table("d")).select(*cols).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))
    assert {r.doc_id: r.labels for r in got}[1] == "isc"


# ---------------------------------------------------------------- 2

def test_url_filter(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "m.example.net", "/en/x"), ("allow", "m.example.net", "/"), ("block", "org", "/a"), ("allow", "org", "/a"), ("block", "x.org", "/")]
    r = random.Random(3)
    hosts = ["net", "example.net", "M.Example.NET", "a.m.example.net", "badexample.net", "x.org", "org", "y.x.org", "com", "net.com", "user@x.org:80", "", "."]
    urls = [f"{s}{h}{p}" for s in ("http://", "", "//", "a://b://") for h in hosts for p in ("", "/", "/en/", "/en/xy?q=/", "/a#/b", "?x", "/a b")]
    rows = [(i, u) for i, u in enumerate([*urls, None, ""])] + [(0, urls[0]), (None, "http://x.org/")]
    r.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as key", "2 as slice", "3 as host")
    out = url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules), slices=3).collect()
    assert len(out) == len(rows)

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h) + len(p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        top = max(fit, key=lambda x: (x[0], x[2] == "block"), default=None)
        return host, path, top and top[1], top[2] if top else ("allow" if host else "block")

    want = sorted(((i, *judge(u)) for i, u in rows), key=repr)
    assert sorted((tuple(x) for x in out), key=repr) == want
    assert url_filter.filter_urls(pages.where("false"), url_filter.rules_frame(spark, rules)).count() == 0
    assert {x.rule for x in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules).where("false")).collect()} == {None}


# ---------------------------------------------------------------- 3

def test_chat_format(spark):
    r = random.Random(4)
    rows = []
    for c in range(12):
        n = r.randrange(1, 30)
        for t in range(n):
            role = "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "a<b>%0A\n"])
            text = r.choice([None, "", "<turn x>", "</turn>\n", "<\\/turn> <\\\\turn", "### ok", "é—ß " * 50, "w " * r.randrange(300)])
            rows.append((c, t, role, text))
    rows += [(99, 1, None, "null role"), (99, None, "assistant", "null turn"), (99, 1, None, "null role"), (None, 0, "assistant", "no id"), (None, 1, "user", None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as span", "2 as idx", "3 as cid")
    made = chat_format.windows(conv, budget=200, history=2).collect()
    back = {x.conv_id: x for x in chat_format.read_back(chat_format.windows(conv, budget=200, history=2)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-(2**60) if t is None else t, role or "", text or ""))
    assert set(back) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        learned = "".join(b for _, a, b in turns if a == "assistant")
        x = back[c]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert x.formatted_chars == sum(len(w.formatted) for w in made if w.conv_id == c)
    for w in made:
        if w.window and w.conv_id is not None and w.conv_id < 12 and w.conv_id % 2:
            assert w.formatted.startswith("<turn system>")  # the system turn stays
    assert chat_format.windows(conv.where("false")).count() == 0
    short = spark.createDataFrame([(1, t, "user", "a b c d e f") for t in range(60)], "conv_id long, turn long, role string, text string")
    assert all(x.tokens <= 60 + 2 * 10 for x in chat_format.windows(short, budget=60, history=2).collect())
    plain = chat_format.read_back(chat_format.windows(short, budget=60, history=0)).first()
    assert plain.n_turns == 60


def test_chat_windows_hold_the_budget(spark):
    sizes = {1: [600] * 5, 2: [300, 30, 900, 1000, 40, 1300, 5], 3: [1500, 200, 400, 500, 30], 4: [5000, 10, 700, 700, 700], 5: [1000, 1000, 1000, 10] * 30}
    rows = [(c, t, "system" if t == 0 and c in (2, 3) else "assistant", "w " * (n - chat_format.OVERHEAD)) for c, v in sizes.items() for t, n in enumerate(v)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.windows(conv, budget=2048, history=2).collect()
    assert [w.tokens for w in made if w.tokens > 2048] == [5000]  # a single turn
    assert all(w.n_turns - w.n_repeated > 0 for w in made)
    assert all(w.formatted.startswith("<turn system>") for w in made if w.conv_id in (2, 3))
    for c, v in sizes.items():
        own = sorted((w.window, w.n_turns - w.n_repeated) for w in made if w.conv_id == c)
        assert len({w for w, _ in own}) == len(own) and sum(n for _, n in own) == len(v)
        learned = [w for w in made if w.conv_id == c for _ in w.loss]
        assert len(learned) == len(v) - (c in (2, 3))
    back = {x.conv_id: x.turns_sha256 for x in chat_format.read_back(chat_format.windows(conv, budget=2048, history=2)).collect()}
    for c in sizes:
        assert back[c] == hashlib.sha256("".join(f"{r}\n{x}\n" for k, _, r, x in rows if k == c).encode()).hexdigest()


def test_chat_sql_knows_the_budget(spark):
    import duckdb

    sizes = {1: [600] * 5, 2: [300, 30, 900, 1000, 40, 1300, 5], 3: [1500, 200, 400, 500, 30], 4: [5000, 10, 700, 700, 700], 5: [1000, 1000, 1000, 10] * 9, 6: [2100, 5, 5]}
    rows = [(c, t, "system" if t == 0 and c in (2, 3, 6) else "assistant" if t % 2 else "user", "w " * (n - 6) + "</turn>") for c, v in sizes.items() for t, n in enumerate(v)]
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = con.execute(chat_format.ORACLE)
    cols = [c[0] for c in cur.description]
    conv = chat_format.with_planted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_format.read_back(chat_format.windows(conv)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cur.fetchall())) and len(got) == 7


# ---------------------------------------------------------------- 4

def test_sharding(docs, empty):
    rows = corpus()
    out = shard.balanced_shards(docs, 7).collect()
    assert len(out) == len(rows)
    want = sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(x.doc_id), x.size, x.text_crc32) for x in out) == want
    shards = defaultdict(list)
    for x in out:
        shards[x.shard].append((x.slot, x.size))
    total, most = sum(x.size for x in out), max(x.size for x in out)
    for v in shards.values():
        assert sorted(s for s, _ in v) == list(range(len(v)))
        assert abs(sum(b for _, b in v) - total / 7) <= most
    assert shard.balanced_shards(empty, 7).count() == 0


def test_sharding_places_rows_by_prefix_sums(docs):
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(corpus(), key=lambda x: (hashlib.md5((x[1] or "").encode()).hexdigest(), x[0] is not None, x[0] or 0))
    total, before, slots, want = sum(size(t) for _, t in order), 0, defaultdict(int), []
    for i, t in order:
        k = min(6, before * 7 // total)
        want.append((repr(i), size(t), k, slots[k]))
        slots[k] += 1
        before += size(t)
    out = shard.balanced_shards(docs, 7).collect()
    assert sorted((repr(x.doc_id), x.size, x.shard, x.slot) for x in out) == sorted(want)  # equal texts follow each other


# ---------------------------------------------------------------- 5

@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, empty, k, num):
    rows = corpus()
    sets = defaultdict(list)
    for i, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets[i].append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    known = [i for i in sets if i is not None]
    links = [(a, b) for a in known for b in known if a < b for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= num * len(x | y)]
    assert len(links) > 100
    root = union_find(known, links)
    out = jaccard_join.jaccard_components(docs, k, num, 100).collect()
    assert sorted((repr(x.doc_id), x.n_shingles, x.component_id) for x in out) == sorted((repr(i), len(s), root.get(i)) for i, v in sets.items() for s in v)
    if k == 3:
        assert jaccard_join.jaccard_components(empty).count() == 0


def test_blocks_agree_with_sets():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 90, r.integers(1, 60)).astype(np.uint64)) for _ in range(20)]
    for a in range(20):
        assert jaccard_join.overlaps([sets[a]], sets).tolist()[0] == [len(np.intersect1d(sets[a], s)) for s in sets]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    nodes = {x for p in links for x in p}
    root = union_find(nodes, links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == root


# ---------------------------------------------------------------- 6

def test_substring_dedup(docs, empty):
    rows = corpus()
    first = {}
    for i, t in rows:
        w = SPACE.findall(t or "")
        if i is not None:
            for j in range(len(w) - 12):
                g = tuple(w[j : j + 13])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = {x for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((repr(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(x[2] for x in want) > 1000
    out = substring_dedup.dedup_report(docs).collect()
    assert sorted((repr(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in out) == sorted(want)
    assert substring_dedup.dedup_report(empty).count() == 0
    made = substring_dedup.remove_repeats(docs)
    assert made.columns == docs.columns
    untouched = {repr(i): t for (i, t), w in zip(rows, want, strict=True) if not w[2]}
    assert all(x.text == untouched[repr(x.doc_id)] for x in made.collect() if repr(x.doc_id) in untouched)


def test_removal_compares_words_with_the_source():
    texts = pa.array([" ".join(f"w{i}" for i in range(40)), "\n".join(f"w{i}" for i in range(5, 30)), None])
    _, run, own, where, size, _, raw, starts, ends, first, _ = substring_dedup.super_runs(texts, 13)
    words, cuts, wrong = substring_dedup.Words(raw, starts, ends), [[], [], None], [[], [], None]
    for j in range(len(run)):
        x, y = np.frombuffer(words.digest(int(where[j]), int(size[j]) + 12), np.int64).tolist()
        cuts[own[j]].append({"run": int(run[j].view(np.int64)), "cut": -1, "x": x, "y": y})
        wrong[own[j]].append({"run": int(run[j].view(np.int64)), "cut": -1, "x": x, "y": y ^ 1})
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("run", "cut", "x", "y")]))
    gone = lambda c: [int(g.sum()) for *_, g in substring_dedup._covered(pa.RecordBatch.from_arrays([texts, pa.array(c, kind)], names=["text", "cuts"]), 13)]
    assert gone(cuts) == [40, 25, 0] and gone(wrong) == [0, 0, 0]
    # the same words have the same digest whatever stands between them
    assert words.digest(5, 13) == words.digest(40, 13)
    assert words.digest(5, 13) != words.digest(6, 13)


def test_substring_dedup_of_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, "x " + a + " y"), (3, b[3:]), (4, a.split(" ", 3)[3] + " " + b.rsplit(" ", 9)[0])]
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.dedup_report(frame(spark, rows)).collect())
    assert got == [(1, 30, 0), (1, 30, 0), (2, 32, 30), (3, 29, 29), (4, 48, 48)]


# ---------------------------------------------------------------- 7

def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=6) * r.choice([0.01, 1, 30])).tolist()) for i in range(450)]
    rows += [(i, rows[100][1]) for i in range(500, 540)]  # ties
    rows += [(600, None), (700, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (800, [float("nan")] * 6), (801, [float("inf")] * 6), (900, [1.0, 2.0]), (901, [3.0, 4.0]), (None, [1.0] * 6), (902, []), (1000, [0.0] * 6)]
    rows += [(300, rows[300][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as norm", "2 as dim", "'a' as x")
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:10]
        want += [(q, k, i, -x) for k, (x, i) in enumerate(s, 1)]
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 1e17])]
    most = int(np.floor(np.sqrt(2.0**62 / 2)))
    ints = {i: [max(-most, min(most, int(np.floor(x * 1024)) if abs(x) < 1e15 else int(np.sign(x) * 2**62))) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(ints[0], ints[i], strict=True)), i) for i in (1, 2, 3, 4))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(-x.score, x.vec_id) for x in got] == want


def test_candidates_never_miss():
    r = np.random.default_rng(3)
    for _ in range(200):
        v = (r.normal(size=(60, 5)) * 100).astype(np.int64)
        q = (v[0] + r.normal(size=5) * 20).astype(np.int64)
        s = v @ q
        theta = float(np.sort(s)[-3])
        norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
        assert set(np.flatnonzero(s >= theta)) <= set(topk.candidates(v, norms, q, theta))


# ---------------------------------------------------------------- 8

def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    out = quality.classify(docs, labels.where(~odd)).join(labels.where(odd), "doc_id").select("quality", "toxic", "keep").collect()
    clean = [x.keep for x in out if (x.quality, x.toxic) == (1, 0)]
    bad = [x.keep for x in out if x.quality == 0]
    toxic = [x.keep for x in out if x.toxic == 1]
    assert sum(clean) / len(clean) > 0.95
    assert sum(bad) / len(bad) < 0.1 and sum(toxic) / len(toxic) < 0.4


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (10, None, 0), (11, 1, 0), (12, 0, 1), (12, 0, 1), (-5, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs.withColumn("source", F.when(F.col("doc_id") > 50, F.col("source"))), labels)
    assert out.count() == len(corpus())
    assert out.where("p_quality is null or p_toxic is null or keep is null").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(docs, labels.where("false")).where("not keep").count() == 0


def test_site_posteriors(spark):
    r = random.Random(9)
    rows = [(f"h{i % 7}" if i % 7 else None, f"p{i % 3}" if i % 11 else None, r.random() ** (1 + i % 7), r.random() * (i % 2)) for i in range(500)]
    rows += [("big", "p0", 0.25, 0.5)] * 300 + [("lone", "x", 1.0, 1.0)]

    def shrink(k):
        total = sum(x[k] for x in rows) / len(rows)

        def groups(key):
            out = defaultdict(list)
            for x in rows:
                out[key(x)].append(x[k])
            return out

        def strength(g):
            spread = sum(len(v) * (sum(v) / len(v) - total) ** 2 for v in g.values()) / len(rows) - total * (1 - total) * len(g) / len(rows)
            return min(max(total * (1 - total) / max(spread, 1e-6) - 1, 5.0), 1000.0)

        hosts, paths = groups(lambda x: x[0]), groups(lambda x: (x[0], x[1]))
        mean, several = {h: sum(v) / len(v) for h, v in hosts.items()}, {h for h in hosts if sum(own[0] == h for own in paths) > 1}
        gaps = sum(len(v) * (sum(v) / len(v) - mean[h]) ** 2 for (h, _), v in paths.items() if h in several)
        noise = sum(mean[h] * (1 - mean[h]) * (sum(own[0] == h for own in paths) - 1) for h in several)
        n, inside = sum(len(hosts[h]) for h in several), sum(len(hosts[h]) * mean[h] * (1 - mean[h]) for h in several)
        kh, kp = strength(hosts), min(max(inside / n / max((gaps - noise) / n, 1e-6) - 1, 5.0), 1000.0)
        host = {h: (kh * total + sum(v)) / (kh + len(v)) for h, v in hosts.items()}
        return {(h, p): (host[h], (kp * host[h] + sum(v)) / (kp + len(v)), total) for (h, p), v in paths.items()}

    good, bad = shrink(2), shrink(3)
    out = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, quality double, toxic double")).collect()
    assert len(out) == len(good)
    for x in out:
        assert (x.host_quality, x.site_quality, x.all_quality, x.host_toxic, x.site_toxic, x.all_toxic) == pytest.approx((*good[x.h, x.p], *bad[x.h, x.p]))
    one = next(x for x in out if x.h == "lone")
    assert abs(one.site_quality - one.all_quality) < abs(1.0 - one.site_quality)  # a sparse site stays near the prior
    assert quality.site_posteriors(spark.createDataFrame([], "host string, path string, quality double, toxic double")).count() == 0


def test_paths_are_pulled_to_their_own_host(spark):
    """Hosts far apart whose paths differ by noise alone: a path with a few odd rows stays with its host.  Where paths do differ
    within hosts, it goes its own way."""
    r = random.Random(1)
    row = lambda h, p, m: (h, p, float(r.random() < m), 0.0)
    same = [row(h, f"p{i}", m) for h, m in (("low", 0.1), ("high", 0.9)) for i in range(40) for _ in range(50)] + [("low", "odd", 1.0, 0.0)] * 5
    apart = [row(h, f"p{i}", (0.05, 0.95)[i % 2]) for h in ("low", "high") for i in range(40) for _ in range(50)] + [("low", "odd", 1.0, 0.0)] * 5
    of = lambda rows: next(x for x in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, quality double, toxic double")).collect() if x.p == "odd")
    assert of(same).site_quality < 0.15 and of(apart).site_quality > 0.7


def test_quality_moves_by_the_site(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(10, 60)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs.select("doc_id", "text", "source", "lang"), labels, keep_text=False)
    assert out.columns == ["doc_id", "source", "lang", *quality.RESULTS]
    named = docs.selectExpr("*", *(f"-1 as {c}" for c in ("keep", "p_toxic", "site_quality", "h", "p", "host", "quality", "y_toxic", "id_", "row")))
    same = quality.classify(named, labels)
    assert len(same.columns) == len(set(same.columns)) and set(quality.RESULTS) <= set(same.columns)
    both = [sorted((repr(x.doc_id), round(x.p_quality, 9), round(x.p_toxic, 9), x.keep) for x in o.collect()) for o in (out, same)]
    assert both[0] == both[1]
    stay = quality.kept(named, labels)
    assert stay.columns == named.columns and stay.where("keep <> -1 or h <> -1 or row <> -1").count() == 0


# ---------------------------------------------------------------- 9

def test_decontamination(spark, docs, empty):
    r = random.Random(6)
    texts = [t for _, t in corpus() if t and len(t) > 300]
    items = [" ".join(r.choice(texts).split()[a : a + n]) for a, n in ((3, 20), (0, 13), (5, 40), (2, 12), (7, 5), (1, 1), (4, 30))] + [None, "", "zzz yyy", "w1 w1 w1", "Été!"]
    items += [items[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = WORD.findall((t or "").translate(LOWER))
        n = min(len(w), 13)
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    want = []
    for i, t in corpus():
        w = WORD.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[j : j + n]))):
                    hit |= set(range(j, j + n))
                    names |= who
        want.append((repr(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))

    def rows(b):
        out = decontaminate.judge(decontaminate.find_hits(docs.select("doc_id", "text", "size"), b))
        return sorted((repr(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in out.collect())

    assert rows(bench) == sorted(want) and sum(x[5] for x in want) > 5
    old, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, 30
    try:
        assert rows(bench) == sorted(want)  # several blocks
    finally:
        decontaminate.BLOCK_WORDS = old
    assert not any(x[5] for x in rows(bench.where("false")))
    assert decontaminate.find_hits(empty, bench).count() == 0
    named = docs.selectExpr("*", *(f"-1 as {c}" for c in ("_hit", "n_hit", "n_items", "contaminated", "hit", "digest", "spans")))
    sure = {x[0] for x in want if x[5]}
    old, decontaminate.BLOCK_WORDS = decontaminate.BLOCK_WORDS, 30
    try:
        stay = decontaminate.clean(named, bench)
        assert stay.columns == named.columns
        got = stay.collect()
    finally:
        decontaminate.BLOCK_WORDS = old
    assert {(x.n_hit, x.contaminated, x.hit, x.digest) for x in got} == {(-1, -1, -1, -1)}
    assert sorted(repr(x.doc_id) for x in got) == sorted(repr(i) for i, _ in corpus() if repr(i) not in sure)
    cut = decontaminate.remove_passages(docs.select("doc_id", "text"), bench.where("item_id = 0"), most_words=12)
    assert all(x[3] == "0" or x[2] < 13 for x in ((r.doc_id, r.n_words, r.n_hit, str(r.n_items)) for r in decontaminate.judge(decontaminate.find_hits(cut, bench.where("item_id = 0"))).collect()))


def test_clean_cuts_long_spans_only(spark):
    item, short = " ".join(f"q{i}" for i in range(20)), "tiny item"
    bench = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    pad = " ".join(f"z{i}" for i in range(600))
    docs = spark.createDataFrame([(1, f"{pad} ({item.upper()}), {pad}"), (2, f"{pad} {short} {pad}"), (3, item + " " + pad[:200]), (4, None), (5, "")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in decontaminate.clean(docs, bench).collect()}
    assert got == {1: f"{pad} ({pad}", 2: f"{pad} {short} {pad}", 4: None, 5: ""}
    judged = {x.doc_id: (x.n_hit, x.n_cut) for x in decontaminate.judge(decontaminate.find_hits(docs, bench)).collect()}
    assert judged[1] == (20, 20) and judged[2] == (2, 0) and judged[3] == (20, judged[3][1]) and judged[3][1] > 20 and judged[4] == judged[5] == (0, 0)


# ---------------------------------------------------------------- 10

def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer())
    rows = corpus() + [(200, "<|endoftext|> tail, don't. <|STARTOFTEXT|>"), (201, "Straße's 'tis 12.5% — naïve...x\u2003y ΑΣ Σ. "), (202, "İstanbul İ 日本語 ﬁ ª ʰ ᾳ ſ 한 plain words")]
    out = packing.pack_texts(frame(docs.sparkSession, rows)).collect()
    want = sorted(([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows), key=len)
    have, seqs = defaultdict(list), defaultdict(list)
    for x in out:
        have[x.doc_id, x.doc_tokens].append((x.start, x.length, x.ids_crc32))
        seqs[x.sequence_id].append((x.offset, x.length))
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = have[i, len(ids)]
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in pieces)
        copies = sum(row == (i, text) for row in rows)  # repeated rows are packed each
        assert sorted(x for a, n, _ in pieces for x in range(a, a + n)) == sorted([*range(len(ids))] * copies)
    assert sum(x.length for x in out) == sum(map(len, want))
    for v in seqs.values():
        at = 0
        for a, n in sorted(v):
            assert a == at
            at += n
        assert at <= 2048
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack_texts(empty).count() == 0


def test_packing_limits_loss_tokens(spark):
    r = random.Random(11)
    rows = [(i, " ".join(r.choices(["one", "two", "three"], k=r.choice([0, 3, 40, 700, 5000]))), r.choice([None, 0.0, 0.2, 0.9, 1.0])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part double")
    share = {i: 1.0 if p is None else p for i, _, p in rows}
    out = packing.pack_texts(docs, loss=600, segments=5, loss_share=F.col("part")).collect()
    seqs, got = defaultdict(list), defaultdict(int)
    for x in out:
        seqs[x.sequence_id].append(x)
        got[x.doc_id] += x.length
    size = {x.doc_id: x.doc_tokens for x in out}
    assert got == size and len(size) == 300
    lost = lambda x: int(np.ceil(size[x.doc_id] * share[x.doc_id])) / size[x.doc_id] * x.length
    for v in seqs.values():
        assert sum(x.length for x in v) <= 2048 and len(v) <= 5 and sum(map(lost, v)) <= 600 + 1e-6
    full = [v for v in seqs.values() if sum(x.length for x in v) == 2048]
    assert len(full) > 20  # prompts fill what loss tokens leave


def test_packer_limits():
    r = random.Random(8)
    items = [(i, n, r.randrange(n + 1)) for i in range(400) for n in [r.choice([1, 3, 50, 400, 900])]]
    for cuts in (False, True):
        out = packing.pack(items, tokens=1000, segments=6, loss=500, cuts=cuts)
        seqs, got = defaultdict(list), defaultdict(int)
        for key, _, n, seq, _ in out:
            seqs[seq].append((key, n))
            got[key] += n
        assert got == {i: n for i, n, _ in items}
        assert all(sum(n for _, n in v) <= 1000 and len(v) <= 6 for v in seqs.values()) or cuts
        if not cuts:
            share = {i: (n, loss) for i, n, loss in items}
            assert all(sum(share[k][1] for k, _ in v) <= 500 or len(v) == 1 for v in seqs.values())


@pytest.mark.parametrize("items, limits", [([(i, 1, 1) for i in range(600)], {}), ([(0, 1100, 1100), (1, 300, 0), (2, 500, 499)], {"loss": 512})])
def test_last_sequences_hold_the_limits(items, limits):
    out = packing.pack(items, **limits)
    loss = {k: x / n for k, n, x in items}
    seqs, got = defaultdict(list), defaultdict(list)
    for key, start, n, seq, _ in out:
        seqs[seq].append((key, n))
        got[key] += range(start, start + n)
    assert all(sorted(got[k]) == list(range(n)) for k, n, _ in items)
    assert all(len(v) <= 256 and sum(loss[k] * n for k, n in v) <= limits.get("loss", 2048) + 1e-6 for v in seqs.values())
    assert all((n := sum(n for _, n in v)) & (n - 1) == 0 for v in seqs.values())
