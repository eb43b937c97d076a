"""Packing: vector bin packing of examples into sequences, under limits on tokens, segments and loss-bearing tokens.

Every task packs its own rows from a bounded pool, largest demand first in the sense of the dot-product heuristic: into
the open sequence goes the pool's example whose demands (tokens, one segment, loss tokens), each weighed by its mean in
the pool, have the largest dot product with what the sequence has left.  When nothing fits and cuts are allowed, the
example with the largest dot product is cut to fill the sequence.  An example longer than a sequence first gives whole
sequences.  What is left at a task's end is cut at powers of two, which need no padding; each is the largest one that
holds the limits.

Results in special cases: a null text counts as empty and gives its closing id alone; repeated rows are packed each;
ties go to the example read first; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TOKENS, SEGMENTS, POOL, CACHE = 2048, 256, 256, 600_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts as bytes (uint32).  This vocabulary's ids don't depend on neighbouring words, so words are cached.

    Texts are split at spaces and line feeds alone: every tokenizer split happens there too.  ASCII letters are
    lower-cased first, as the tokenizer does; texts that could hold a special token go to it whole.  New words are
    encoded many at a time.  A word of letters alone is one unit of the tokenizer, and the last id of each unit says that
    it is: such words need nothing but spaces between them, others a special token.  When the cache is full, its older
    half stays: common words come early.
    """

    def __init__(self, path: str, most: int = CACHE) -> None:
        import json

        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        by_word = d["model"].get("end_of_word_suffix") == "</w>" and any(n.get("type") == "Lowercase" for n in d["normalizer"]["normalizers"])
        special = [t for t in d["added_tokens"] if t["special"] and t["content"].startswith("<|")] if by_word else []
        self.whole, self.mark = not special, (special[0]["content"], special[0]["id"]) if special else ("", -1)
        last = [i for w, i in self.t.get_vocab().items() if w.endswith("</w>")] if by_word else []
        self.last = np.zeros(self.t.get_vocab_size(), bool)
        self.last[last] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.most = most

    def _direct(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word.  Every word has a unit at least, so as many units as words are one each."""
        letters = [w.isalpha() for w in words]
        by_letters = self._in_blocks([w for w, a in zip(words, letters, strict=True) if a], True)
        others = self._in_blocks([w for w, a in zip(words, letters, strict=True) if not a], False)
        return (next(by_letters if a else others) for a in letters)

    def _in_blocks(self, words: list[str], letters: bool) -> Iterator[bytes]:
        for i in range(0, len(words), 4096):
            block = words[i : i + 4096]
            ids = self._ids(" ".join(block)) if letters else np.empty(0, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            skip = 0
            if len(ends) != len(block):
                ids = self._ids(self.mark[0].join(block))
                ends = np.append(np.flatnonzero(ids == self.mark[1]), len(ids))
                skip = 4
            raw, at = ids.tobytes(), 0
            for e in (4 * ends).tolist():
                yield raw[at:e]
                at = e + skip

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null counts as empty.  Each distinct word is looked up once."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.whole:
            return [self._direct(t) for t in texts.to_pylist()]
        special = pc.match_substring(texts, "<|")
        plain = pc.replace_substring(pc.ascii_lower(pc.if_else(special, "", texts)), "\n", " ")
        # a letter ends a token and marks begin the next: without its marks a word is seen more often
        split = pc.split_pattern(pc.replace_substring_regex(plain, r"([a-z])([.,!?;:]+ )", r"\1 \2"), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.cache) > self.most:
            self.cache = dict(islice(self.cache.items(), self.most // 2))
        parts = list(map(self.cache.get, distinct))
        at = [i for i, p in enumerate(parts) if p is None]
        new = [distinct[i] for i in at]
        for i, w, p in zip(at, new, self._encode_words(new) if new else (), strict=True):
            parts[i] = self.cache[w] = p
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        blob, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        at = words.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        end = np.cumsum(n)
        ids = blob[np.arange(int(n.sum())) + np.repeat(first[at] - end + n, n)]
        bounds = np.concatenate(([0], end))[split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()]
        out = [ids[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._direct(texts[i].as_py())
        return out


_known: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str, most: int = CACHE) -> WordTokenizer:
    """The worker's tokenizer, kept with its cache from task to task."""
    if path not in _known:
        _known[path] = WordTokenizer(path)
    _known[path].most = most
    return _known[path]


class Packer:
    """Yields (item, start, length, sequence, offset) for items given as (key, tokens, loss tokens)."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, cuts: bool = True) -> None:
        self.limit = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.cuts, self.sequence = tokens, cuts, 0
        self.keys: list = []
        self.start: list[int] = []
        self.need = np.empty((0, 3))

    def add(self, items: list[tuple[object, int, int]]) -> Iterator[tuple]:
        keys, starts, need = [], [], []
        for key, n, loss in items:
            at = 0
            if self.cuts:
                while n - at >= self.tokens and min(loss, n) * self.tokens <= self.limit[2] * n:
                    yield key, at, self.tokens, self.sequence, 0
                    self.sequence += 1
                    at += self.tokens
            if n > at:
                keys.append(key)
                starts.append(at)
                need.append((n - at, 1, -(-loss * (n - at) // n)))
        if keys:
            self.keys += keys
            self.start += starts
            self.need = np.vstack([self.need, np.array(need, float)])

    def fill(self) -> Iterator[tuple]:
        """Closes one sequence with items of the pool."""
        left, offset, alive = self.limit.copy(), 0, np.ones(len(self.keys), bool)
        weight = 1.0 / np.maximum(self.need.mean(axis=0), 1e-9) ** 2
        fits = np.flatnonzero((self.need <= left).all(axis=1))
        while True:
            if len(fits):
                i = int(fits[np.argmax(self.need[fits] @ (left * weight))])
                n = int(self.need[i, 0])
                alive[i] = False
                yield self.keys[i], self.start[i], n, self.sequence, offset
                left -= self.need[i]
                offset += n
                # room only shrinks: what doesn't fit now won't later
                fits = fits[(fits != i) & (self.need[fits] <= left).all(axis=1)] if left[0] > 0 else fits[:0]
                continue
            open_ = np.flatnonzero(alive) if self.cuts and left[0] > 0 and left[1] >= 1 else fits
            if len(open_):
                share = self.need[open_, 2] / self.need[open_, 0]
                room = np.minimum(left[0], np.where(share > 0, left[2] / np.maximum(share, 1e-9), left[0])).astype(np.int64)
                room = np.minimum(room, self.need[open_, 0].astype(np.int64))
                j = int(np.argmax(room))
                n, i = int(room[j]), int(open_[j])
                if n > 0:
                    yield self.keys[i], self.start[i], n, self.sequence, offset
                    left -= (n, 1, min(left[2], -(-share[j] * n // 1)))
                    offset += n
                    self.need[i] -= (n, 0, min(self.need[i, 2], share[j] * n))
                    self.start[i] += n
                    if self.need[i, 0] <= 0:
                        alive[i] = False
                    if left[0] > 0:
                        fits = np.flatnonzero(alive & (self.need <= left).all(axis=1))
                        continue
            break
        if not offset and len(self.keys):  # an item beyond the limits on its own: a sequence to itself
            n = int(self.need[0, 0])
            yield self.keys[0], self.start[0], n, self.sequence, 0
            alive[0] = False
        self.sequence += 1
        for i in np.flatnonzero(~alive)[::-1].tolist():  # few
            del self.keys[i], self.start[i]
        self.need = self.need[alive]

    def held(self) -> int:
        return int(self.need[:, 0].sum())

    def _holds(self, size: int) -> bool:
        """Whether the pool's first ``size`` tokens hold the limits on segments and loss tokens."""
        before = np.cumsum(self.need[:, 0]) - self.need[:, 0]
        n = np.clip(size - before, 0, self.need[:, 0])
        loss = np.ceil(self.need[:, 2] / self.need[:, 0] * n - 1e-9).sum()
        return np.count_nonzero(n) <= self.limit[1] and loss <= self.limit[2]

    def rest(self) -> Iterator[tuple]:
        """All that is left; with cuts, a last part of a sequence goes out in lengths of powers of two."""
        while self.keys and (not self.cuts or self.held() >= self.tokens):
            yield from self.fill()
        left = self.held()
        while self.keys and left:
            size = 1 << (left.bit_length() - 1)
            while size > 1 and not self._holds(size):
                size >>= 1
            offset = 0
            while offset < size:
                n = min(size - offset, int(self.need[0, 0]))
                yield self.keys[0], self.start[0], n, self.sequence, offset
                offset += n
                self.start[0] += n
                self.need[0] -= (n, 0, self.need[0, 2] / self.need[0, 0] * n)
                if self.need[0, 0] <= 0:
                    self.keys.pop(0)
                    self.start.pop(0)
                    self.need = self.need[1:]
            self.sequence += 1
            left -= size


def pack(examples: Iterable[tuple[object, int, int]], **limits) -> list[tuple]:
    """All pieces of some examples (key, tokens, loss tokens), as one task packs them."""
    packer = Packer(**limits)
    out = list(packer.add(list(examples)))
    return out + list(packer.rest())


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together: more words repeat in them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, close: int = 1, tokens: int = TOKENS, segments: int = SEGMENTS, cache: int = CACHE, loss: int | None = None, loss_share: Column | None = None) -> DataFrame:
    """Pieces of all texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``loss_share`` is the share of an example's tokens that bear loss (instruction data: what isn't prompt), spread evenly
    over its pieces; null and by default all do.  ``loss`` limits them in a sequence, by default to ``tokens``.
    ``cache`` words are kept in each Python worker, at about 200 bytes each.
    """
    common.prepare(docs.sparkSession)
    path, end = tokenizer or public_tokenizer(), np.array([close], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = tokenizer_of(path, cache), Packer(tokens, segments, loss)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[object, bytes, int]] = {}
        serial = 0

        def emit(pieces: Iterable[tuple]) -> list[tuple]:
            rows = []
            for key, start, n, seq, offset in pieces:
                doc, ids, left = held[key]
                rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + seq, offset))
                held[key] = (doc, ids, left - n)
                if left == n:
                    del held[key]
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_kind[0]), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in _gathered(batches):
            arrow_kind[:] = [batch.schema.field(0).type]
            items = []
            for doc, ids, share in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                n = len(ids) // 4 + 1
                held[serial] = (doc, ids + end, n)
                items.append((serial, n, int(np.ceil(n * min(1.0, max(0.0, share))))))
                serial += 1
            rows = emit(packer.add(items))
            while len(packer.keys) > POOL and packer.held() >= tokens:
                rows += emit(packer.fill())
            yield batch_of(rows)
        if arrow_kind:
            yield batch_of(emit(packer.rest()))

    share = F.lit(1.0) if loss_share is None else F.coalesce(loss_share.cast("double"), F.lit(1.0))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), share.alias("share")).mapInArrow(common.frugal(run), f"doc_id {kind}, {PIECES}")

