"""Repeated passages and many patterns, against brute force."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import evaluate, patterns, runs


def brute_longest(w):
    for n in range(len(w) - 1, 0, -1):
        seen = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        for i, x in enumerate(seen):
            if x in seen[i + 1 :]:
                return n, i
    return 0, -1


def brute_again(w, n):
    seen = set()
    for i in range(len(w) - n + 1):
        x = tuple(w[i : i + n])
        if x in seen:
            return i
        seen.add(x)
    return -1


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 40])
def test_runs_by_brute_force(letters):
    rng = random.Random(letters)
    for size in (0, 1, 2, 3, 5, 9, 17, 30, 41):
        for _ in range(8):
            w = [rng.randrange(letters) for _ in range(size)]
            own = runs.Runs(np.array(w, np.int64))
            assert own.longest() == brute_longest(w), w
            for n in (1, 2, 3, 5, 8):
                assert own.first_again(n) == brute_again(w, n), (w, n)


@pytest.mark.parametrize("kind", ["one word", "no repeat", "two halves"])
def test_long_text_repeats(kind):
    n = 200_000
    words = {"one word": np.zeros(n, np.int64), "no repeat": np.arange(n), "two halves": np.tile(np.arange(n // 2), 2)}[kind]
    began = time.perf_counter()
    own = runs.Runs(words)
    got = own.longest(), own.first_again(8)
    assert time.perf_counter() - began < 30
    assert got == {"one word": ((n - 1, 0), 1), "no repeat": ((0, -1), -1), "two halves": ((n // 2, 0), n // 2)}[kind]


def test_repetition_edges(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(200_000))
    rows = [("none", None), ("empty", ""), ("short", "a b c"), ("said", "It is so. Then more words. it is so!"), ("long", long), ("twin", "x y"), ("twin", "x y")]
    got = sorted((r.case_id, r.status, r.detail) for r in evaluate.repetition(spark.createDataFrame(rows, "case_id string, answer string")).collect())
    first = "comes twice: " + " ".join(f"w{i}" for i in range(8))
    assert got == sorted([("none", "pass", "nothing comes twice"), ("empty", "pass", "nothing comes twice"), ("short", "pass", "nothing comes twice"), ("said", "fail", "comes twice: it is so"), ("long", "fail", first), ("twin", "pass", "nothing comes twice"), ("twin", "pass", "nothing comes twice")])


def test_longest_repeats_table(spark):
    rows = [(1, None), (2, ""), (3, "a b a b a"), (4, "p q r"), (4, "p q r")]
    df = spark.createDataFrame(rows, "case_id long, text string")
    got = sorted(tuple(r) for r in runs.longest_repeats(df, F.split("text", " ")).collect())
    assert got[0] == (1, 0, 0, None, None)
    assert (3, 5, 3, 0, "a b a") in got and got.count((4, 3, 0, None, None)) == 2
    assert runs.longest_repeats(df.where("false"), F.split("text", " ")).count() == 0


@pytest.mark.parametrize("pattern, run", [
    (r"\btimeout_s\b", "timeout_s"), (r"old_1$", "old_1"), (r"(?i)Client\.Send\(", "client.send("), (r"a|b", ""), (r"(a|b)cd", "cd"), (r"colou?r", "colo"),
    (r"ab+c", "ab"), (r"abc*", "ab"), (r"abc{0}d", "ab"), (r"[a-z]+", ""), (r"x[^]]y?zz", "zz"), (r"\Qa.b\E", ""), (r"\x41bc", ""), (r"\p{L}bc", ""), (r"(?<!x)pq(?!y)", "pq"),
    (r"(?x) a b", ""), (r"(?i:AB)cd", ""), (r"[a[b]]cd", ""), (r"(ab", ""), ("", ""), (r"É+t", "É"), (r"(a(b|c)\))*de", "de"), (r"[\]|]fg", "fg"),
])
def test_plain_run(pattern, run):
    assert patterns.plain_run(pattern) == run


def test_matches_by_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abAB.c ") for _ in range(rng.randrange(25)))) for i in range(150)] + [(150, None), (151, "")]
    made = [r"ab", r"(?i)ab", r"a\.b", r"ab?c", r"a|c", r"[ab]c+", r"(?i)BA[^a]", r"b{2}", r"^a", r"c$", r"(a|b)\.c", r"\bA\b", "ab", None, r"cab*", "b a+"]
    named = [(f"s{i % 15}", p, i) for i, p in enumerate(made)]
    got = patterns.matches(spark.createDataFrame(texts, "case_id long, body string"), spark.createDataFrame(named, "query_id string, pattern string, no int"))
    assert got.columns == ["case_id", "query_id", "pattern", "no"]
    want = [(i, q, p, n) for i, t in texts if t is not None for q, p, n in named if p is not None and re.search(p, t)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_patterns_make_no_nested_loop(spark):
    texts = spark.createDataFrame([(1, "use old_7 now")], "case_id long, answer string")
    symbols = spark.createDataFrame([("old_7", r"\bold_7\b"), ("old_8", r"\bold_8\b")], "symbol string, pattern string")
    out = evaluate.deprecations(texts, symbols)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().status == "fail"


def test_tried_are_few(spark):
    texts = spark.createDataFrame([(i, f"we call old_{i} here") for i in range(50)], "case_id long, body string")
    tried = patterns.candidates(texts, [patterns.plain_run(rf"\bold_{i}\b") for i in range(10, 60)]).selectExpr("sum(size(tried)) as n").first().n
    assert tried == 40  # of 2,500 pairs
