"""Benchmark decontamination: a generalised suffix automaton of normalised test items, run over every training text.

Normalisation: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  The automaton recognises every run of
words of every item.  Reading a text, it tracks the length of the longest run that ends at each word; a run of at least
``window`` words covers hit words, and its state names the items.  Items of fewer words count as one window of their own
length.  Words that no item has reset the automaton, so only runs of item words are walked.

The automaton is broadcast in blocks of at most BLOCK_WORDS item words (about 40 MB).  Each block but the last is a job of
its own over all texts: it writes the hits of those that have any to the shared folder, once for each text, by digest.  So
one automaton is live at a time, and the item set may grow without growing what is broadcast; it costs a reading of the
documents for each block.  These hits are joined to the documents when the last block reads them.

What becomes of hits: ``judge`` reports them, ``clean`` drops documents whose coverage is over the limit (hits are a
COVER-th of the words at least) and cuts the spans of at least ``longest`` words out of the others.

Results in special cases: a null text has no words; null or wordless items have no window; repeated documents are judged
each; rows that repeat an item_id are one item; an empty benchmark hits nothing; other columns pass through untouched, as they travel in
a struct of their own, and only ``find_hits`` and ``judge`` put results in place of columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
COVER = 20  # contaminated when COVER * hits >= words
BLOCK_WORDS = 200_000
_TABLE = bytes(32 if common.NON_WORD[i] else i for i in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items that each state's longest runs belong to."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str, int]] = []  # state after each item prefix, item, words so far
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            last = 0
            for n, w in enumerate(words, 1):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                if n >= window or n == len(words):
                    ends.append((last, name, n if n < window else window))
        # whole[v]: items with a window that is a suffix of v's runs, of a length that v's shortest run has anyway
        self.own: dict[int, set[tuple[int, str]]] = {}
        for state, name, n in ends:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            self.own.setdefault(state, set()).add((n, name))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def found(self, state: int, matched: int) -> tuple[int, list[str]]:
        """Longest window that ends here, and the items of all windows that end here."""
        most, names = 0, []
        while state > 0:
            for n, name in self.own.get(state, ()):
                if n <= matched:
                    most = max(most, n)
                    names.append(name)
            state = self.link[state]
        return most, names

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (start, end) and items of a run of word ids, all of them known."""
        nxt, link, length = self.next, self.link, self.length
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: dict[tuple[int, int], tuple[int, list[str]]] = {}
        v = m = 0
        for i, c in enumerate(words):
            while v and c not in nxt[v]:
                v = link[v]
                m = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                m += 1
            if m >= self.shortest:
                key = (v, min(m, self.window))
                if key not in seen:
                    seen[key] = self.found(*key)
                most, who = seen[key]
                if most:
                    spans.append((i + 1 - most, i + 1))
                    names.update(who)
        return spans, names


def build_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[SuffixAutomaton]:
    """Automata of at most BLOCK_WORDS words each (an item is never split); items stream through the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null").toLocalIterator():
        words = item_words(r.t)
        if block and size + len(words) > BLOCK_WORDS:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((r.i, words))
        size += len(words)
    if block:
        yield SuffixAutomaton(block, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


HIT = "struct<n_words: bigint, spans: array<bigint>, items: array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def hits_of(text: str | None, auto: SuffixAutomaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words, hit spans and items of one text."""
    words = (text or "").encode().lower().translate(_TABLE).split()
    spans: list[tuple[int, int]] = []
    names: set[str] = set()
    know, shortest = auto.ids, auto.shortest
    if len(words) >= shortest:
        ids = np.fromiter((know.get(w, -1) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([-1], np.minimum(ids, 0), [-1]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= shortest:
                found, who = auto.scan(ids[a:b].tolist())
                spans += [(a + x, a + y) for x, y in found]
                names |= who
    return len(words), spans, names


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns row (struct of the columns of ``docs``) and hit: struct of n_words, merged spans (flat starts and ends) and items."""
    spark = docs.sparkSession
    common.prepare(spark)
    row, at = common.packed(docs), docs.columns.index(text_col)
    digest = F.sha2(F.col(f"row.`{text_col}`"), 256)
    tables, last = [], None
    for auto in build_blocks(benchmark, item_col, item_text, window):
        if last is not None:
            tables.append(common.table(_block_hits(docs, last, text_col), "benchmark-hits"))
            last.unpersist()
        last = spark.sparkContext.broadcast(auto)
    last = last or spark.sparkContext.broadcast(SuffixAutomaton([], window))
    out = row
    if tables:
        found = tables[0]
        for t in tables[1:]:
            found = found.unionByName(t)
        earlier = found.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        earlier = common.table(earlier, "benchmark-found")
        out = row.join(earlier, digest == F.col("digest"), "left")
    spans, items = (F.col(c) if tables else F.expr(f"cast(null as array<{t}>)") for c, t in (("spans", "bigint"), ("items", "string")))
    out = out.select("row", F.struct(F.lit(0).cast("long").alias("n_words"), F.coalesce(spans, F.expr("cast(array() as array<bigint>)")).alias("spans"), F.coalesce(items, F.expr("cast(array() as array<string>)")).alias("items")).cast(HIT).alias("hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, old in zip(batch.column(0).field(at).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, spans, names = hits_of(text, last.value)
                spans += zip(old["spans"][::2], old["spans"][1::2], strict=True)
                rows.append({"n_words": n, "spans": [x for s in _merged(spans) for x in s], "items": sorted(names.union(old["items"]))})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _KIND)], names=["row", "hit"])

    return out.mapInArrow(common.frugal(run), out.schema)


def _block_hits(docs: DataFrame, sent, text_col: str) -> DataFrame:
    """digest, spans, items of the texts that one block's automaton finds something in; each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, [x for s in _merged(spans) for x in s], sorted(names)) for t, d in zip(*(c.to_pylist() for c in batch.columns), strict=True) for _, spans, names in [hits_of(t, sent.value)] if spans]
            d, s, i = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(s, pa.list_(pa.int64())), pa.array(i, pa.list_(pa.string()))], names=["digest", "spans", "items"])

    texts = docs.select(F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("digest")).where("text is not null")
    found = texts.mapInArrow(common.frugal(run), "digest string, spans array<bigint>, items array<string>")
    return found.dropDuplicates(["digest"])


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a column ``_hit``: struct of n_words, merged spans (flat starts and ends) and item ids."""
    return common.beside(with_hits(docs, benchmark, text_col, item_col, item_text, window), docs.columns, {"_hit": F.col("hit")})


def hit_words(hit: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.size(hit["spans"]) - 2, F.lit(2))
    return F.when(F.size(hit["spans"]) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(pairs, F.lit(0).cast("long"), lambda a, i: a + F.get(hit["spans"], i + 1) - F.get(hit["spans"], i))
    )


def contaminated(hit: Column) -> Column:
    return (hit_words(hit) > 0) & (hit_words(hit) * COVER >= hit["n_words"])


def cut_words(hit: Column, longest: int = WINDOW) -> Column:
    """Words that ``clean`` takes out: all of a contaminated document, else those of spans of ``longest`` words or more."""
    pairs = F.sequence(F.lit(0), F.size(hit["spans"]) - 2, F.lit(2))
    size = lambda i: F.get(hit["spans"], i + 1) - F.get(hit["spans"], i)
    long = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, i: a + F.when(size(i) >= longest, size(i)).otherwise(0))
    return F.when(F.size(hit["spans"]) == 0, F.lit(0).cast("long")).when(contaminated(hit), hit["n_words"]).otherwise(long)


def judge(hits: DataFrame) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and n_cut from ``_hit``."""
    hit = F.col("_hit")
    return hits.withColumns({
        "n_words": hit["n_words"], "n_hit": hit_words(hit), "n_items": F.size(hit["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(hit["items"], ","), 256), "contaminated": contaminated(hit), "n_cut": cut_words(hit),
    })


def cut_spans(text: str | None, spans: list[int]) -> str | None:
    """``text`` without the words in ``spans`` and the separators after them."""
    if not spans or text is None:
        return text
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, _, _ = common.word_bounds(raw, np.array([0, len(raw)]), common.NON_WORD_CASED)
    keep = np.ones(len(raw), bool)
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        keep[starts[a] : starts[b] if b < len(starts) else len(raw)] = False
    return raw[keep].tobytes().decode()


def _without_spans(hits: DataFrame, text_col: str, longest: int) -> DataFrame:
    """The rows of ``hits`` (row, hit), with spans of ``longest`` words or more cut out of the text."""
    at, names = hits.schema["row"].dataType.names.index(text_col), hits.schema["row"].dataType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(0).field(i) for i in range(len(names))]
            spans = [[x for a, b in zip(s[::2], s[1::2], strict=True) if b - a >= longest for x in (a, b)] for s in batch.column(1).field(1).to_pylist()]
            if any(spans):
                cols[at] = pa.array([cut_spans(t, s) for t, s in zip(cols[at].to_pylist(), spans, strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return hits.mapInArrow(common.frugal(run), hits.schema["row"].dataType)


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_words: int = 0) -> DataFrame:
    """``docs`` with every hit span longer than ``most_words`` words cut out of the text."""
    return _without_spans(with_hits(docs, benchmark, text_col), text_col, most_words + 1)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", longest: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, and without spans of ``longest`` words or more in the others."""
    hits = with_hits(docs, benchmark, text_col)
    return _without_spans(hits.where(~contaminated(F.col("hit"))), text_col, longest)
