"""Text sources with explicit row numbers, and format detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content, size): whole files as bytes, directories flat, in the order of their paths."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content", F.col("length").alias("size")).orderBy("path")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, line): the lines of text files in order, split at newlines only; blank lines keep their number.

    Numbers are dense and follow the files' names, whatever the order and the tasks in which Spark reads
    them: a piece of a file is read by one task, line by line, and its first number comes from a summary
    with one row for each piece.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("wl_path"), F.col("_metadata.file_block_start").alias("wl_start"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("wl_path", "wl_start").agg(F.count("*").alias("n"), F.min("at").alias("wl_first"))
    before = F.sum("n").over(Window.orderBy("wl_path", "wl_start").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("wl_path", "wl_start", (F.coalesce(before, F.lit(0)) - F.col("wl_first")).alias("wl_base"))
    return rows.join(F.broadcast(base), ["wl_path", "wl_start"]).select((F.col("wl_base") + F.col("at")).alias("row_id"), "line")  # a row for each piece


def dense_rows(df: DataFrame, at: str) -> DataFrame:
    """Replaces monotonically increasing ids by dense row numbers in their order."""
    part = F.shiftright(F.col(at), 33)
    sizes = df.groupBy(part.alias("wl_part")).agg(F.count("*").alias("n"))
    base = sizes.select("wl_part", F.coalesce(F.sum("n").over(Window.orderBy("wl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("wl_base"))
    rows = df.withColumn("wl_part", part).join(F.broadcast(base), "wl_part")  # a row for each partition
    return rows.select((F.col("wl_base") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias("row_id"), *[c for c in df.columns if c != at])


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files, in the order of row_id."""
    lines.orderBy("row_id").select(F.col("line").alias("value")).write.option("lineSep", "\n").text(path)


_LEAD = r"^[ \t\n\f\r]*"


def detect_format(text: Column) -> Column:
    """generic, json or ndjson for a whole text: ndjson needs two lines or more, over 80 % with a brace first."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _LEAD, "")), lambda x: x != "")
    braces = F.size(F.filter(lines, lambda x: F.substring(x, 1, 1) == "{"))
    opens = F.substring(F.regexp_replace(text, _LEAD, ""), 1, 1).isin("{", "[")
    return F.when(F.coalesce(opens, F.lit(False)), F.when((F.size(lines) >= 2) & (braces > 0.8 * F.size(lines)), "ndjson").otherwise("json")).otherwise("generic")


def detect_by_line(lines: DataFrame, key: str) -> DataFrame:
    """(key, lines, json_lines, format) for documents given as lines (key, row_id, line)."""
    bare = F.regexp_replace("line", _LEAD, "")
    per = lines.groupBy(key).agg(F.count(F.when(bare != "", 1)).alias("lines"), F.count(F.when(F.substring(bare, 1, 1) == "{", 1)).alias("json_lines"), F.min(F.when(bare != "", F.struct("row_id", F.substring(bare, 1, 1).alias("c"))))["c"].alias("first"))
    kind = F.when(F.col("first").isin("{", "["), F.when((F.col("lines") >= 2) & (F.col("json_lines") > 0.8 * F.col("lines")), "ndjson").otherwise("json")).otherwise("generic")
    return per.select(key, "lines", "json_lines", kind.alias("format"))


def detect_by_name(path: Column) -> Column:
    """The format that a file's extension names, or null."""
    ext = F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1))
    return F.when(ext == "json", "json").when(ext.isin("ndjson", "jsonl"), "ndjson")
