"""Words of Arrow columns of texts, a batch at a time: runs of bytes of a class, and one dictionary for all of them.

The patterns are those of functions/text.py; texts come lower-cased by the JVM, so all that counts is ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; a longer text is taken by itself.
PIECE = 8 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


PLAIN = _class(b"abcdefghijklmnopqrstuvwxyz0123456789")
WORD, JOINS, SOLID = PLAIN | _class(b"_"), _class(b".-"), ~_class(b" \t\n\x0b\f\r")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE bytes of text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
            yield b.slice(at, upto - at)
            at = upto


def _runs(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, dictionary) of the runs of a class of bytes, in their order; runs of WORD go on over single JOINS between them."""
    texts = texts.fill_null("") if texts.null_count else texts
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = lambda x: np.concatenate([[False], x])[: len(raw)] & ~edge[:-1]
    after = lambda x: np.concatenate([x[1:], [False]])[: len(raw)] & ~edge[1:]
    inside = kind[raw]
    if kind is WORD:
        inside = inside | (JOINS[raw] & before(inside) & after(inside))
    first, last = np.flatnonzero(inside & ~before(inside)), np.flatnonzero(inside & ~after(inside))
    ends = np.concatenate([[0], np.cumsum(last + 1 - first)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    code = found.dictionary_encode()
    return np.searchsorted(off, first, "right") - 1, code.indices.to_numpy().astype(np.int64), code.dictionary


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, dictionary) of all that text.tokens_symbol finds, in no order."""
    row, code, names = _runs(texts, WORD)
    marked = np.flatnonzero(pc.match_substring_regex(names, "[._-]").to_numpy(zero_copy_only=False)) if len(names) else []
    if not len(marked):
        return row, code, names
    at = {w: i for i, w in enumerate(names.to_pylist())}
    listed = list(at)
    parts = {i: own for i in marked if len(own := [p for p in re.split(r"[._\-]", listed[i]) if p]) > 1}
    n = np.zeros(len(names), np.int64)
    n[list(parts)] = [len(own) for own in parts.values()]
    flat = np.array([at.setdefault(p, len(at)) for own in parts.values() for p in own], np.int64)
    begin = np.zeros(len(names), np.int64)
    begin[list(parts)] = np.concatenate([[0], np.cumsum([len(own) for own in parts.values()])])[:-1]
    has = np.flatnonzero(n[code] > 0)
    many = n[code[has]]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    more = flat[np.repeat(begin[code[has]], many) + step]
    return np.concatenate([row, np.repeat(row[has], many)]), np.concatenate([code, more]), pa.array(list(at), pa.string())


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, dictionary) of the runs of anything but white space, as text.tokens_space finds them."""
    return _runs(texts, SOLID)


def simple(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, dictionary) of the runs of letters and digits, as text.tokens_simple finds them."""
    return _runs(texts, PLAIN)


def counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct combinations of keys, in ascending order; how often each stands)."""
    if not len(keys[0]):
        return [k[:0] for k in keys], np.zeros(0, np.int64)
    whole, sizes = keys[0], []
    for k in keys[1:]:
        sizes.append(int(k.max()) + 1)
        whole = whole * sizes[-1] + k
    one, n = np.unique(whole, return_counts=True)
    out = []
    for size in reversed(sizes):
        out.append(one % size)
        one = one // size
    return [one, *reversed(out)], n
