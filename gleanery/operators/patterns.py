"""Many patterns against many texts, without comparing each text with each pattern.

Every match of a pattern holds the pattern's plain characters.  The longest such run of each goes into one Aho-Corasick
automaton for a block of patterns; a text is read by it once, and only the patterns whose run it holds are tried.  Patterns
without a run that is sure to be there are tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.retrieve import by_block

FLAGS = re.compile(r"\(\?[ims]+\)")
GAPS = "dDwWsSbBAzZGRhHvVtnrfae"  # escapes of a letter that stand for one character, or for none


def _closing(pattern: str, at: int) -> int:
    """Where the group or the class that opens at ``at`` ends; -1 if that isn't sure."""
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] == "Q":
                return -1
            i += 1
        elif c == "[":
            end = re.compile(r"\[\^?\]?(?:[^\[\]\\&]|\\[^Q])*\]").match(pattern, i)  # no class inside a class
            if not end:
                return -1
            i = end.end() - 1
            if depth == 0:
                return i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def plain_run(pattern: str) -> str:
    """The longest run of characters that every match holds, A-Z lower-cased; empty where none is sure.

    Only what stands outside groups and classes counts, so the answer may be shorter than it could be, never wrong.
    """
    runs, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        flags = FLAGS.match(pattern, i)
        if flags:
            i = flags.end()
            continue
        if c == "|" or pattern.startswith("(?", i) and re.match(r"\(\?-?[a-zA-Z]", pattern[i:]):
            return ""  # alternatives, or flags that change how the rest is read
        if c in "([":
            i = _closing(pattern, i)
            if i < 0:
                return ""
            runs.append("")
        elif c == "\\":
            i += 1
            after = pattern[i : i + 1]
            if not after or (after.isalnum() and after not in GAPS):
                return ""
            runs += [""] if after.isalnum() else [runs.pop() + after]
        elif c in "*?{":
            runs[-1] = runs[-1][:-1]
            runs.append("")
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return ""
        elif c in "+.^$":
            runs.append("")
        else:
            runs[-1] += c
        i += 1
    return _low(max(runs, key=len))


def _low(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A-Z only


def candidates(texts: DataFrame, runs: list[str]) -> DataFrame:
    """``texts`` (case_id, body) with ``tried``: the places in ``runs`` of those that a body holds, any case of A-Z."""
    kind = texts.schema["case_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        always = [i for i, r in enumerate(runs) if not r]
        held: dict[str, list[int]] = {}
        for i, r in enumerate(runs):
            if r:
                held.setdefault(r, []).append(i)
        words = ahocorasick.Automaton()
        for r, at in held.items():
            words.add_word(r, at)
        if held:
            words.make_automaton()
        for b in batches:
            tried = []
            for body in b.column("body").to_pylist():
                found = {at[0]: at for _, at in words.iter(_low(body))} if held and body else {}
                tried.append(sorted([*always, *(i for at in found.values() for i in at)]))
            yield pa.RecordBatch.from_arrays([b.column("case_id"), b.column("body"), pa.array(tried, pa.list_(pa.int32()))], names=["case_id", "body", "tried"])

    return texts.select("case_id", "body").mapInArrow(read, f"case_id {kind}, body string, tried array<int>")


def matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """case_id and the columns of ``patterns`` (query_id, pattern and more) for every body (case_id, body) that a pattern
    is found in.  Null bodies and null patterns match nothing; each row of ``patterns`` counts for itself."""

    def block(some: DataFrame) -> DataFrame:
        rows = some.where("pattern is not null").collect()  # a block of patterns
        own = texts.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_at int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema))
        hits = candidates(texts, [plain_run(r["pattern"]) for r in rows])
        tried = hits.where("size(tried) > 0").select("case_id", "body", F.explode("tried").alias("_at")).join(F.broadcast(own), "_at")
        return tried.where(F.expr("body rlike pattern")).select("case_id", *some.columns)

    return by_block(patterns, block)
