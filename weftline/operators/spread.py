"""Dealing rows over tasks: inputs of few files, and keys that most rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows above which a key's rows don't meet in one task; there is at most one such key for as many rows of a table.
HOT_ROWS = 100_000
#: Bytes of a table that a task is dealt.
DEALT_BYTES = 32 << 20
#: Groups that are broadcast whole.
FEW_GROUPS = 10_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys``, before a step that takes far longer than an exchange.

    A task reads up to 128 MB of a file, millions of narrow rows. Dealt, there is a task for each
    ``DEALT_BYTES`` that Spark expects of the table, and one for each core at least.
    """
    expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    spark = df.sparkSession
    # a table that isn't read from files has no size that Spark knows, nor one that a product of such sizes tells
    tasks = -(-expected // DEALT_BYTES) if expected < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, tasks), *keys)


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (null where no group has the key) and wl_in, no key in one task.

    ``groups`` has one row a key, ``size`` being the number of rows with that key, or more; it is computed
    once, at once. Up to ``FEW_GROUPS`` groups are broadcast. Of more, those of keys with more than
    ``HOT_ROWS`` rows are, a row for each ``HOT_ROWS`` rows at most; their rows, and those without a key,
    are dealt by their place, all others by the key.
    """
    groups = groups.persist()
    values = [c for c in groups.columns if c not in (*keys, size)]
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(F.lit(True).alias("wl_in"), *values).alias(name))
    on = lambda name: [F.col(k) == F.col(f"{name}_{k}") for k in keys]
    if groups.count() <= FEW_GROUPS:
        both, found = rows.join(F.broadcast(side(groups, "wl_hot")), on("wl_hot"), "left"), F.col("wl_hot")
    else:
        hot = F.broadcast(side(groups.filter(F.col(size) > HOT_ROWS), "wl_hot"))
        rest = side(groups.filter(F.col(size) <= HOT_ROWS), "wl_rest").withColumn("wl_turn", F.xxhash64(*[f"wl_rest_{k}" for k in keys]))
        alone = F.col("wl_hot").isNotNull()
        for k in keys:
            alone = alone | F.col(k).isNull()
        placed = rows.join(hot, on("wl_hot"), "left").withColumn("wl_deal", F.when(alone, F.monotonically_increasing_id()).otherwise(F.xxhash64(*keys)))
        both, found = placed.join(rest, [*on("wl_rest"), F.col("wl_deal") == F.col("wl_turn")], "left"), F.coalesce("wl_hot", "wl_rest")
    both = both.select(*rows.columns, found.alias("wl_found"))
    return both.select(*rows.columns, *[F.col(f"wl_found.{c}").alias(c) for c in values], F.coalesce("wl_found.wl_in", F.lit(False)).alias("wl_in"))
