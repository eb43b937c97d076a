"""Chat formatting: conversations as budgeted windows of whole turns, with a loss mask.

Template.  A turn is ``<turn ROLE>\\nTEXT</turn>\\n``.  Only control strings are escaped: ``<turn`` and ``</turn`` inside
a text (with any backslashes already after the ``<``) get one more backslash after the ``<``; reading takes one away.
In a role, ``%``, ``<``, ``>`` and line feeds are percent-encoded.

Windows.  Turns have token counts (words and marks, plus the markers).  Prefix sums of these over a conversation choose
spans: a turn belongs to the span in which its running total ends, spans ending at multiples of half the budget, or of
what the system turn leaves if that is less.  So spans are aligned to turns.  A turn that begins before its span and
could make it too long is a span of its own.  A window is the conversation's system turn (its first turn, if of that
role), the last ``history`` turns before the span, as many of them as the budget has room for, then the span.  Turns
stay whole, so a window passes the budget only if the system turn and a single turn do; ``tokens`` says what it takes.
Loss falls on assistant texts of the span only: each assistant text once, repeats masked.

Prefix sums run in two levels, within blocks of turns and over blocks, so that a conversation with a third of all rows
is spread over tasks.  DataFrame functions only.

Results in special cases: null texts and roles count as empty; turns sort by (turn, role, text), null turns first;
repeated rows are turns of their own; a null conversation is one conversation; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, OVERHEAD, BLOCK = 2048, 2, 4, 64
CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("%0A", "\n"), ("%3E", ">"), ("%3C", "<"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def positions(turns: DataFrame) -> DataFrame:
    """Adds idx (from 0), total (tokens up to and with the turn) and sys (tokens of the system turn), by conversation; two
    levels of prefix sums."""
    # a block is a run of turn numbers; rows of equal turn stay together
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    inside = Window.partitionBy("cid", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = turns.withColumns({"idx": F.count(F.lit(1)).over(inside) - 1, "total": F.sum("tok").over(inside)})
    system = F.max(F.when((F.col("idx") == 0) & (F.col("role") == "system"), F.col("tok")))
    sums = local.groupBy("cid", "block").agg(F.sum("tok").alias("btok"), F.count(F.lit(1)).alias("bn"), system.alias("bsys"))
    over = Window.partitionBy("cid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("bsys").over(Window.partitionBy("cid").orderBy("block"))
    base = sums.select("cid", "block", F.coalesce(F.sum("btok").over(over), F.lit(0)).alias("base_tok"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("base_n"), F.coalesce(first, F.lit(0)).alias("sys"))
    both = local.join(base.withColumnsRenamed({"cid": "cid_", "block": "block_"}), F.col("cid").eqNullSafe(F.col("cid_")) & (F.col("block") == F.col("block_")))
    return both.select("cid", "turn", "role", "text", "tok", (F.col("idx") + F.col("base_n")).alias("idx"), (F.col("total") + F.col("base_tok")).alias("total"), "sys")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: conv_id, window, formatted, n_repeated (turns at its start that an earlier window has),
    loss (array of start and length in code points), tokens, n_turns."""
    turns = conversations.select(
        F.col("conv_id").alias("cid"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = positions(turns.withColumn("tok", token_count(F.col("text")) + OVERHEAD))
    is_system = (F.col("idx") == 0) & (F.col("role") == "system")
    room = F.greatest(F.lit(1), F.least(F.lit(budget // 2), budget - F.col("sys")))
    part = F.floor((F.col("total") - 1) / room).cast("long")
    # tokens of a turn that lie before its part; with them the span may not fit
    early = part * room - (F.col("total") - F.col("tok"))
    alone = (early > 0) & (F.col("sys") + room + early > budget)
    turns = turns.withColumn("is_system", is_system).withColumn("span", 2 * part - alone.cast("long"))
    # where spans begin, and for each its repeated turns: the history before it and the system turn
    begins = turns.groupBy("cid", "span").agg(F.min("idx").alias("first"), F.min(F.col("total") - F.col("tok")).alias("begin"), F.max("total").alias("end")).where("first > 0")
    back = F.sequence(F.greatest(F.col("first") - history, F.lit(0)), F.col("first") - 1) if history else F.expr("cast(array() as array<bigint>)")
    wanted = begins.select(F.col("cid").alias("cid_"), F.col("span").alias("span_"), F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), back))).alias("idx_"), "first", "begin", "end")
    repeated = turns.drop("span").join(wanted, F.col("cid").eqNullSafe(F.col("cid_")) & (F.col("idx") == F.col("idx_")))
    # from the turn to the end of the span is what history and span take
    fits = F.col("sys") + F.col("end") - (F.col("total") - F.col("tok")) <= budget
    repeated = repeated.where(F.col("is_system") | ((F.col("idx") >= F.col("first") - history) & fits))
    cols = ["cid", "span", "idx", "role", "text", "tok"]
    placed = turns.select(*cols, F.lit(True).alias("own")).unionByName(
        repeated.select("cid", F.col("span_").alias("span"), "idx", "role", "text", "tok", F.lit(False).alias("own"))
    )
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">\n"))
    made = placed.select("cid", "span", "idx", "own", "tok", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("own") & (F.col("role") == "assistant")).alias("learn"))
    grouped = made.groupBy("cid", "span").agg(F.sort_array(F.collect_list(F.struct("idx", "own", "learn", "head", "body", "tok"))).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    step = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)
    zero = F.expr("named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,length:int>>))")
    masks = F.aggregate("t", zero, lambda a, x: F.struct(
        (a["at"] + step(x)).alias("at"),
        F.when(x["learn"], F.array_append(a["loss"], F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length")))).otherwise(a["loss"]).alias("loss"),
    ), lambda a: a["loss"])
    return grouped.select(
        F.col("cid").alias("conv_id"), F.col("span").alias("window"), formatted.alias("formatted"),
        F.size(F.filter("t", lambda x: ~x["own"])).alias("n_repeated"), masks.alias("loss"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["tok"]).alias("tokens"), F.size("t").alias("n_turns"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Conversations again, from formatted text and mask only: the digest columns of each."""
    parts = F.slice(F.split("formatted", CLOSE), F.col("n_repeated") + 1, F.greatest(F.col("n_turns") - F.col("n_repeated"), F.lit(0)))
    said = F.transform(parts, lambda p: F.concat(
        unescape_role(F.regexp_extract(p, r"(?s)^<turn ([^>]*)>\n(.*)$", 1)), F.lit("\n"), unescape(F.regexp_extract(p, r"(?s)^<turn ([^>]*)>\n(.*)$", 2)), F.lit("\n"),
    ))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    rows = made.select("conv_id", F.struct(
        "window", F.array_join(said, "").alias("said"), F.array_join(learned, "").alias("learned"), F.size(parts).alias("n"), F.length("formatted").alias("chars"),
    ).alias("w"))
    # a digest needs its conversation's text in one row
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    learned = F.array_join(F.transform("w", lambda w: w["learned"]), "")
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w[name])
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(F.array_join(F.transform("w", lambda w: w["said"]), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


PLANTED = "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts look like markers."""
    spark = conversations.sparkSession
    rows = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w - 1 AS idx, sum(tok) OVER (w ROWS UNBOUNDED PRECEDING) AS total,
         length('<turn ' || replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') || '>') + 1
           + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + 8 AS chars
  FROM (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')) + 4 AS tok FROM c) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), y AS (
  SELECT *, max(CASE WHEN idx = 0 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM o
), m AS (SELECT *, greatest(1, least(1024, 2048 - sys)) AS room FROM y),
t AS (SELECT *, (total - 1) // room AS part FROM m),
s AS (  -- a turn that begins before its part and could make it too long is alone
  SELECT *, 2 * part - CASE WHEN part * room > total - tok AND sys + room + part * room - (total - tok) > 2048 THEN 1 ELSE 0 END AS span FROM t
), b AS (SELECT conv_id, span, min(idx) AS first, max(total) AS until FROM s GROUP BY ALL HAVING min(idx) > 0),
r AS (
  SELECT s.conv_id, sum(s.chars) AS chars
  FROM b JOIN s ON s.conv_id = b.conv_id AND s.idx < b.first AND ((s.idx = 0 AND s.role = 'system') OR (s.idx >= b.first - 2 AND s.sys + b.until - (s.total - s.tok) <= 2048))
  GROUP BY ALL
), g AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx) AS said,
         coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS learned
  FROM s GROUP BY conv_id
)
SELECT g.conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
       (g.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN r USING (conv_id)
"""
