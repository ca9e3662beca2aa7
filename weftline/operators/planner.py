"""Choosing encodings from measured costs, and the smallest of several candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_long, octets, varint_len


def encoding_of(col_type: Column, quoted: Column) -> Column:
    """The encoding that a column's type asks for; ``quoted``: all its strings are quoted."""
    return (
        F.when(col_type == "Integer", "delta_varint").when(col_type == "Boolean", "bitmap").when(col_type == "Iso8601", "timestamp")
        .when(col_type == "Enum", F.when(quoted, "enum").otherwise("raw")).when(col_type == "Uuid", "uuid").when(col_type == "String", F.when(quoted, "string").otherwise("raw")).otherwise("raw")
    )


def column_costs(deltas: DataFrame) -> DataFrame:
    """Exact sizes of every encoding for (col_id, raw, delta); delta is null where none applies.

    raw_bytes has the separators of the columnar text; the others are the encoders' layouts.
    """
    n, size = F.count("*"), octets(F.col("raw"))
    tokens = deltas.groupBy("col_id", "raw").agg(F.count("*").alias("c"))
    entries = tokens.groupBy("col_id").agg(F.sum(octets(F.col("raw")) + 4).alias("entries"), F.count("*").alias("k"))
    per = deltas.groupBy("col_id").agg(n.alias("n"), F.sum(size).alias("text"), F.sum(varint_len(F.col("delta")).cast("long")).alias("varint"), F.bool_and(F.col("raw").rlike('(?s)^".*"$')).alias("quoted"))
    return per.join(entries, "col_id").select(
        "col_id", "quoted", (F.col("text") + F.col("n") - 1).alias("raw_bytes"), F.col("varint").alias("delta_varint"), (F.col("varint") + 16).alias("timestamp"),
        (4 + F.ceil(F.col("n") / 8)).cast("long").alias("bitmap"), (5 + F.col("entries") + F.col("n")).alias("enum"), (4 + F.col("text") + 2 * F.col("n")).alias("string"), (4 + 16 * F.col("n")).alias("uuid"),
    )


def encoding_plan(schema: DataFrame, costs: DataFrame) -> DataFrame:
    """(col_id, col_type, encoding, raw_bytes, encoded_bytes), one row for each column."""
    both = schema.select("col_id", "col_type", "cardinality").join(costs, "col_id")
    chosen = encoding_of(F.col("col_type"), F.col("quoted"))
    chosen = F.when((chosen == "enum") & (F.col("cardinality") > 255), "string").otherwise(chosen)
    names = ("delta_varint", "timestamp", "bitmap", "enum", "string", "uuid")
    size = F.coalesce(*[F.when(F.col("encoding") == k, F.col(k)) for k in names], F.col("raw_bytes"))
    return both.withColumn("encoding", chosen).select("col_id", "col_type", "encoding", "raw_bytes", size.cast("long").alias("encoded_bytes"))


def smallest(candidates: DataFrame, key: str = "block_id") -> DataFrame:
    """(key, path, size): the smallest candidate of each block, ties by path name."""
    return candidates.groupBy(key).agg(F.min(F.struct("size", "path")).alias("x")).select(key, "x.path", "x.size")


def lossless(df: DataFrame, original: str, rebuilt: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ok): whether every row came back byte by byte; a transform is used only where ok."""
    return df.groupBy(*keys).agg(F.bool_and(F.col(original).eqNullSafe(F.col(rebuilt))).alias("ok"))


def integer_deltas(long: DataFrame, block_rows: int) -> DataFrame:
    """(col_id, row_id, raw, delta): deltas of long tokens within blocks of rows, whole at a block's start."""
    from pyspark.sql import Window

    w = Window.partitionBy("col_id", F.floor(F.col("row_id") / block_rows)).orderBy("row_id")
    value = as_long(F.col("raw"))
    return long.select("*", value.alias("v")).withColumn("delta", F.coalesce(F.col("v") - F.lag("v").over(w), F.col("v"))).drop("v")
