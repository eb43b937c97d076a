"""License scans: ordered signature rules over words, gated by keywords, resolved by priority and containment.

A text is lower-cased (A-Z) and brought to words, each between single spaces, so a pattern sees whole words only.  Which
keywords occur is found on the raw text first; only texts with one are normalised, and only the rules of those keywords
run, if the longest run of plain characters that their pattern asks for is there as well.  A match is an interval of words.  In the order (start, longest first, priority, rule) an interval inside an earlier
one of equal or better priority is suppressed, and a hint (priority 5) gives way to a name (1 to 3) inside it.  The base
phrases take part like rules, but any interval around one suppresses it, and their labels always stay.

Everything happens within a row, by DataFrame functions: no shuffle, no Python.

Results in special cases: a null or empty text has 0 words, 0 base places, null first and last word, empty labels and
score 0; repeated rows are judged each; equal intervals keep the label of the better priority, then of the earlier rule;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import signatures
from .url_filter import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "reserved", "all rights reserved"))
WEIGHT = {0: 0.5, 1: 1.0, 2: 0.9, 3: 0.75, 4: 0.6, 5: 0.3}
HINT = 5
#: Hits that one array is grown over.
FOLD = 128


def spaced(pattern: str) -> str:
    """A pattern over words with one space between them, for text with each word between its own spaces."""
    return " (?:" + pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + ") "


def rules() -> list[tuple[int, int, str, str, str]]:
    """(number, priority, label, keyword, pattern as it runs); priority 0 marks the base phrases."""
    base = [(-len(BASE) + i, 0, label, word, spaced(phrase)) for i, (label, word, phrase) in enumerate(BASE)]
    return base + [(n, p, label, word, spaced(pattern)) for n, p, label, word, pattern in signatures()]


def gate(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern (as written) has, as it stands in normalised text."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|" and not depth:
            return ""
        if c == "[":
            i = pattern.index("]", i)
        depth += (c == "(") - (c == ")")
        plain = not depth and (c.isalnum() or c == " ") and pattern[i + 1 : i + 2] not in ("?", "*", "+")
        if plain:
            run += (" " if i == 0 else "") + ("  " if c == " " else c)
        else:
            runs.append(run)
            run = ""
        i += 1
    return max(*runs, run + " " * (run != ""), "", key=len)


def _rule_array() -> Column:
    written = [*(x[2] for x in BASE), *(x[4] for x in signatures())]
    rows = (
        f"named_struct('no', {n}, 'prio', {p}, 'label', '{label}', 'word', '{w}', 'gate', '{gate(own)}', 're', '{x}', 'weight', {WEIGHT[p]}D)"
        for (n, p, label, w, x), own in zip(rules(), written, strict=True)
    )
    return F.expr(f"array({', '.join(rows)})")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _places(norm: Column, rule: Column) -> Column:
    """(start, -end, priority, rule, label, weight) of each match, in words."""
    marked = F.regexp_replace(norm, rule["re"], F.lit(" \u0001 $0 \u0002 "))
    tokens = F.filter(F.split(marked, " "), lambda w: w != "")
    at = lambda mark: F.filter(F.transform(tokens, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())
    starts = F.transform(at("\u0001"), lambda p, k: p - 2 * k)
    ends = F.transform(at("\u0002"), lambda q, k: q - 2 * k - 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(
        a.alias("start"), (-b).alias("neg_end"), rule["prio"].alias("prio"), rule["no"].alias("no"), rule["label"].alias("label"), rule["weight"].alias("weight"),
    ))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` and its lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_hints_around_names(hits: Column) -> Column:
    """Hits in order, without the hints that a name lies in.

    Goes from the end in blocks, as growing an array copies it: ``least`` is where the first name ends, in the blocks after
    this one to begin with.
    """
    far = F.lit(2**31 - 1)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / FOLD).cast("int")), lambda b: F.slice(hits, b * FOLD + 1, FOLD))
    ends = lambda block: F.coalesce(F.array_min(F.transform(F.filter(block, lambda h: h["prio"].between(1, 3)), lambda h: -h["neg_end"])), far)
    later = lambda e: F.transform(e, lambda x, i: F.coalesce(F.array_min(F.slice(e, i + 2, F.size(e))), far))

    def back(acc: Column, h: Column) -> Column:
        end = -h["neg_end"]
        return F.struct(
            F.when(h["prio"].between(1, 3), F.least(acc["least"], end)).otherwise(acc["least"]).alias("least"),
            F.when((h["prio"] == HINT) & (acc["least"] <= end), acc["kept"]).otherwise(F.array_append(acc["kept"], h)).alias("kept"),
        )

    fold = lambda block, least: F.aggregate(F.reverse(block), F.struct(least.alias("least"), F.slice(block, 1, 0).alias("kept")), back, lambda a: F.reverse(a["kept"]))
    kept = _let(cut, lambda blocks: F.flatten(F.zip_with(blocks, _let(F.transform(blocks, ends), later), fold)))
    return F.when(F.exists(hits, lambda h: h["prio"] == HINT), kept).otherwise(hits)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_hits (kept intervals)."""
    low = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("low"))
    words = sorted({r[3] for r in rules()})
    found = F.filter(F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")"), lambda w: F.contains(F.col("low"), w))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", OTHER, "  ")), F.lit(" "))
    gated = low.select("doc_id", found.alias("found"), norm.alias("norm"))
    # each word stands between two spaces of its own
    n_words = F.when(F.col("norm") == "  ", 0).otherwise((F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))) / 2).cast("long")
    fits = lambda r: F.array_contains(F.col("found"), r["word"]) & F.contains(F.col("norm"), r["gate"]) & F.rlike(F.col("norm"), r["re"])
    own = F.when(F.size("found") > 0, F.filter(_rule_array(), fits))
    matched = gated.select("doc_id", n_words.alias("n_words"), "norm", own.alias("own"))
    hits = matched.withColumn("hits", F.when(F.size("own") > 0, F.array_sort(F.flatten(F.transform("own", lambda r: _places(F.col("norm"), r))))))
    hits = hits.select("doc_id", "n_words", _without_hints_around_names(F.col("hits")).alias("hits"), F.filter("hits", lambda h: h["prio"] == 0).alias("base"))
    # reach: for each priority, how far intervals of this or a better one go
    zero = F.expr(f"named_struct('reach', array_repeat(0, {len(WEIGHT)}), 'labels', cast(array() as array<string>), 'n', 0L, 'score', 0D)")

    def keep(acc: Column, h: Column) -> Column:
        free = -h["neg_end"] > F.get(acc["reach"], F.when(h["prio"] == 0, HINT).otherwise(h["prio"]))
        stays = free | (h["prio"] == 0)
        grown = F.when(F.array_contains(acc["labels"], h["label"]) | ~stays, acc["labels"]).otherwise(F.array_append(acc["labels"], h["label"]))
        return F.struct(
            F.transform(acc["reach"], lambda r, p: F.when(p >= h["prio"], F.greatest(r, -h["neg_end"])).otherwise(r)).alias("reach"), grown.alias("labels"), (acc["n"] + free.cast("long")).alias("n"),
            F.greatest(acc["score"], F.when(free, h["weight"]).otherwise(F.lit(0.0))).alias("score"),
        )

    out = hits.withColumn("kept", F.aggregate("hits", zero, keep))
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda h: h["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda h: h["start"])).cast("long").alias("last_word"),
        F.coalesce(names(F.transform("base", lambda h: h["label"])), F.lit("")).alias("base_labels"),
        F.coalesce(names(F.col("kept.labels")), F.lit("")).alias("labels"),
        F.coalesce("kept.score", F.lit(0.0)).alias("score"),
        F.coalesce("kept.n", F.lit(0).cast("long")).alias("n_hits"),
    )


def oracle() -> str:
    values = ",\n".join(f"({n}, {p}, '{label}', '{w}', '{x}', {WEIGHT[p]}::DOUBLE)" for n, p, label, w, x in rules())
    return f"""
WITH r(no, prio, label, word, re, weight) AS (VALUES {values}),
d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents
), n AS (
  SELECT doc_id, low, regexp_replace(low, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g') AS sp FROM d
), w AS (
  SELECT doc_id, low, ' ' || trim(sp, ' ') || ' ' AS norm, len(list_filter(string_split(sp, ' '), lambda x: x <> '')) AS n_words FROM n
), m AS (
  SELECT doc_id, no, prio, label, weight, string_split_regex(norm, re) AS gaps, regexp_extract_all(norm, re) AS hits
  FROM w JOIN r ON contains(low, word) AND regexp_matches(norm, re)
), c AS (
  SELECT doc_id, no, prio, label, weight,
         list_transform(gaps, lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> ''))) AS g,
         list_transform(hits, lambda s: len(list_filter(string_split(s, ' '), lambda x: x <> ''))) AS h
  FROM m
), i AS (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM c),
p AS (
  SELECT doc_id, no, prio, label, weight, list_sum(g[1:k]) + coalesce(list_sum(h[1:k - 1]), 0) AS a, h[k] AS n FROM i
), e AS (  -- hints give way to names inside them
  SELECT * FROM p WHERE prio <> 5 OR NOT EXISTS (FROM p b WHERE b.doc_id = p.doc_id AND b.prio BETWEEN 1 AND 3 AND b.a >= p.a AND b.a + b.n <= p.a + p.n)
), o AS (  -- how far earlier intervals of each priority or a better one go
  SELECT *, max(CASE WHEN prio <= 1 THEN a + n END) OVER o AS r1, max(CASE WHEN prio <= 2 THEN a + n END) OVER o AS r2, max(CASE WHEN prio <= 3 THEN a + n END) OVER o AS r3, max(CASE WHEN prio <= 4 THEN a + n END) OVER o AS r4, max(CASE WHEN prio <= 5 THEN a + n END) OVER o AS r5
  FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY a, -(a + n), prio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), q AS (
  SELECT *, coalesce(CASE prio WHEN 1 THEN r1 WHEN 2 THEN r2 WHEN 3 THEN r3 WHEN 4 THEN r4 ELSE r5 END, 0) AS reach FROM o
), s AS (
  SELECT doc_id, count(*) FILTER (WHERE prio = 0) AS n_base, min(a) FILTER (WHERE prio = 0) AS first_word, max(a) FILTER (WHERE prio = 0) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE prio = 0) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE prio = 0 OR a + n > reach) AS labels,
         max(weight) FILTER (WHERE a + n > reach) AS score, count(*) FILTER (WHERE a + n > reach) AS n_hits
  FROM q GROUP BY doc_id
)
SELECT w.doc_id, w.n_words::BIGINT AS n_words, coalesce(s.n_base, 0)::BIGINT AS n_base, s.first_word::BIGINT AS first_word, s.last_word::BIGINT AS last_word,
       coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, coalesce(s.score, 0)::DOUBLE AS score, coalesce(s.n_hits, 0)::BIGINT AS n_hits
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
