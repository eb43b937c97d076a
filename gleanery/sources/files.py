"""Sources and sinks: markdown folders, JSON lines, commented lines, prompt templates, collections, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each ``*.md`` file below a folder: path, file, title, raw."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), F.col("_metadata.file_name").alias("file"), T.page_title(path).alias("title"), F.col("value").alias("raw"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def commented_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor start with ``#``, trimmed."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).where((line != "") & ~F.startswith("value", F.lit("#"))).select(line.alias("line"))


def prompt_template(spark: SparkSession, path: str) -> DataFrame:
    """One row: prompt without its ``#!`` lines, and the ids that a ``#! fewshot_ids:`` line lists."""
    lines = F.split("value", r"\r\n|\n")
    text = F.array_join(F.filter(lines, lambda x: ~F.startswith(x, F.lit("#!"))), "\n")
    ids = F.regexp_extract("value", r"(?m)^#!\s*fewshot_ids:\s*(.+)$", 1)
    listed = F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n")).alias("prompt"), listed.alias("fewshot_ids"))


def write_collection(chunks: DataFrame, path: str) -> int:
    """Drops and writes a collection again, one folder for each ``collection`` value; returns its rows."""
    chunks.write.mode("overwrite").partitionBy("collection").parquet(path)
    return chunks.sparkSession.read.parquet(path).count()


def read_collection(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("collection") == collection)


def get(spark: SparkSession, path: str, collection: str, ids: list[str], key: str = "chunk_uid") -> DataFrame:
    """The rows of some ids of a collection; partition and ids reach the scan as filters."""
    return read_collection(spark, path, collection).where(F.col(key).isin(ids))


def collections(spark: SparkSession, path: str) -> DataFrame:
    """collection and rows of each that is there."""
    return spark.read.parquet(path).groupBy("collection").agg(F.count(F.lit(1)).alias("rows"))


def append_traces(traces: DataFrame, path: str, fresh: bool = False) -> None:
    """One JSON line for each trace, null fields included; ``fresh`` removes what is there."""
    traces.write.mode("overwrite" if fresh else "append").option("ignoreNullFields", False).json(path)


def update_metadata(collection: DataFrame, changes: DataFrame, key: str = "chunk_uid") -> DataFrame:
    """A collection with the columns of ``changes`` set for the rows it names, to null where ``changes`` says null."""
    new = [c for c in changes.columns if c != key]
    given = changes.select(F.col(key).alias("_id"), F.struct(*(F.col(c) for c in new)).alias("_new"))
    joined = collection.join(given, F.col(key) == F.col("_id"), "left")
    named = F.col("_id").isNotNull()
    value = lambda c: F.when(named, F.col(f"_new.{c}")).otherwise(F.col(c)) if c in collection.columns else F.col(f"_new.{c}")
    kept = [c for c in collection.columns if c not in new]
    return joined.select(*kept, *(value(c).alias(c) for c in new))


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON string."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def report_markdown(rows: DataFrame) -> DataFrame:
    """Each row as one line of a markdown table; ``markdown_head`` gives the lines above."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in rows.columns)), F.lit(" |")).alias("line"))


def markdown_head(rows: DataFrame) -> str:
    return "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A small report as one markdown file; what is large belongs in a table."""
    spark = rows.sparkSession
    body = [r.line for r in report_markdown(rows).collect()]
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray("\n".join([f"# {title}", "", markdown_head(rows), *body, ""]).encode()))
    out.close()
