"""Runs of words that come twice in a text: the first of a given length, and the longest.

Runs get numbers by doubling: the number of a run of 2w words is that of the pair of its halves, and a run of any length
between is the pair of its first and its last w words.  A length has a repeat only if all shorter ones have, so the longest
is found by halving.  Each length costs a sort of the text's words, so a text of n words costs n log n for each of about
log(longest) lengths, whatever it repeats, and no hash can be mistaken for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import prepare, root


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    distinct, number = np.unique(values, return_inverse=True)
    return number.astype(np.int64), len(distinct)


class Runs:
    """Numbers of the runs of a text whose words are given as numbers."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.levels: list[tuple[np.ndarray, int]] = []  # of runs of 1, 2, 4, ... words, as long as some come twice

    def _level(self, k: int) -> tuple[np.ndarray, int]:
        while len(self.levels) <= k:
            n = len(self.levels)
            self.levels.append(_numbered(self.words) if n == 0 else self._paired(n - 1, 1 << n))
        return self.levels[k]

    def _paired(self, k: int, length: int) -> tuple[np.ndarray, int]:
        number, distinct = self._level(k)
        many = len(self.words) - length + 1
        return _numbered(number[:many] * distinct + number[length - (1 << k) :])

    def of(self, length: int) -> tuple[np.ndarray, int]:
        """(number of the run of ``length`` words that starts at each place, how many different ones)."""
        k = length.bit_length() - 1
        return self._level(k) if length == 1 << k else self._paired(k, length)

    def repeats(self, length: int) -> bool:
        if not 0 < length < len(self.words):
            return False
        number, distinct = self.of(length)
        return distinct < len(number)

    def first_again(self, length: int) -> int:
        """The first place whose run of ``length`` words stands at an earlier place too; -1 without one."""
        if not self.repeats(length):
            return -1
        number, _ = self.of(length)
        first = np.unique(number, return_index=True)[1]
        return int(np.flatnonzero(first[number] < np.arange(len(number)))[0])

    def longest(self) -> tuple[int, int]:
        """(words, first place) of the longest run that comes twice, the earliest of several; (0, -1) if no word does."""
        if not self.repeats(1):
            return 0, -1
        low = 1
        while self.repeats(2 * low):
            low *= 2
        high = 2 * low  # has no repeat
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.repeats(mid) else (low, mid)
        number, _ = self.of(low)
        return low, int(np.flatnonzero(np.bincount(number)[number] > 1)[0])


def _codes(column: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
    """Of each list of strings the strings as numbers, and the strings; of null none."""
    for row in column:
        words = row.values if row.values is not None else pa.array([], pa.string())
        yield words.dictionary_encode().indices.to_numpy(zero_copy_only=False), words


def first_repeats(texts: DataFrame, words: Column, sentences: Column, n: int) -> DataFrame:
    """case_id, run, sentence: the first run of ``n`` words and the first sentence that come a second time, else null."""
    prepare(texts.sparkSession, root())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, said = [], []
            for codes, w in _codes(b.column("w")):
                at = Runs(codes).first_again(n)
                runs.append(None if at < 0 else " ".join(w[at : at + n].to_pylist()))
            for codes, s in _codes(b.column("s")):
                at = Runs(codes).first_again(1)
                said.append(None if at < 0 else s[at].as_py())
            yield pa.RecordBatch.from_arrays([b.column("case_id"), pa.array(runs, pa.string()), pa.array(said, pa.string())], names=["case_id", "run", "sentence"])

    kind = texts.schema["case_id"].dataType.simpleString()
    return texts.select("case_id", words.alias("w"), sentences.alias("s")).mapInArrow(run, f"case_id {kind}, run string, sentence string")


def longest_repeats(texts: DataFrame, words: Column) -> DataFrame:
    """case_id, n_words, longest, at, passage: the longest run of words that stands at two places of a text (which may
    overlap), its first place (from 0) and its words; 0, null and null where no word comes twice.  Null has no words."""
    prepare(texts.sparkSession, root())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for codes, w in _codes(b.column("w")):
                length, at = Runs(codes).longest()
                rows.append((len(w), length, None if at < 0 else at, None if at < 0 else " ".join(w[at : at + length].to_pylist())))
            n, length, at, passage = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = [pa.array(c, pa.int64()) for c in (n, length, at)]
            yield pa.RecordBatch.from_arrays([b.column("case_id"), *made, pa.array(passage, pa.string())], names=["case_id", "n_words", "longest", "at", "passage"])

    kind = texts.schema["case_id"].dataType.simpleString()
    return texts.select("case_id", words.alias("w")).mapInArrow(run, f"case_id {kind}, n_words long, longest long, at long, passage string")
