"""Schema inference: rows to long form, token kinds, and one type for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_long, classify

ENUM_LIMIT = 256


def unpivot(df: DataFrame, row_id: str, tokens: dict[str, Column]) -> DataFrame:
    """(row_id, col_id, raw): one row per row and column, in one pass over the input."""
    cells = F.array(*[F.struct(F.lit(name).alias("col_id"), token.alias("raw")) for name, token in tokens.items()])
    return df.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("x")).select("row_id", "x.col_id", "x.raw")


def pivot(long: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of :func:`unpivot`, one column per name; the names are known, so no job finds them."""
    return long.groupBy("row_id").agg(*[F.max(F.when(F.col("col_id") == c, F.col("raw"))).alias(c) for c in columns])


def token_counts(long: DataFrame, keys: tuple[str, ...] = ("col_id",)) -> DataFrame:
    """Distinct tokens with their count and kind; combines before its exchange."""
    return long.groupBy(*keys, "raw").agg(F.count("*").alias("n")).withColumn("vtype", classify(F.col("raw")))


def type_of() -> Column:
    """The type cascade over the counts that :func:`infer_schema` makes; the first match wins."""
    whole = lambda *kinds: sum((F.col(f"n_{k}") for k in kinds), F.lit(0)) == F.col("total_count") - F.col("null_count")
    return (
        F.when(F.col("total_count") == F.col("null_count"), "Null").when(whole("bool"), "Boolean").when(whole("int"), "Integer").when(whole("int", "float"), "Float")
        .when(whole("iso"), "Iso8601").when(whole("epoch_s"), "EpochSeconds").when(whole("epoch_s", "epoch_ms"), "EpochMillis")
        .when(whole("int", "epoch_s", "epoch_ms"), "Integer").when(whole("uuid"), "Uuid")
        .when(whole("text") & (F.col("cardinality") <= ENUM_LIMIT), "Enum").otherwise("String")
    )


def infer_schema(long: DataFrame, keys: tuple[str, ...] = ("col_id",)) -> DataFrame:
    """keys, col_type, nullable, null_count, total_count, min_val, max_val, cardinality.

    Distinct counts are exact. min_val and max_val are given for Integer columns.
    """
    counts = token_counts(long, keys)
    number, real = as_long(F.col("raw")), F.col("vtype") != "null"
    sums = [F.coalesce(F.sum(F.when(F.col("vtype") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("bool", "int", "epoch_s", "epoch_ms", "float", "iso", "uuid", "text")]
    per = counts.groupBy(*keys).agg(
        F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.when(real, 1)).alias("cardinality"), F.min(number).alias("lo"), F.max(number).alias("hi"), *sums,
    )
    per = per.withColumn("col_type", type_of())
    whole = F.col("col_type") == "Integer"
    return per.select(
        *keys, "col_type", (F.col("null_count") > 0).alias("nullable"), "null_count", "total_count",
        F.when(whole, F.col("lo")).alias("min_val"), F.when(whole, F.col("hi")).alias("max_val"), "cardinality",
    )
