"""Shared plumbing: the shared folder, written intermediate tables, and table access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shared_folder, ship  # noqa: F401

#: ASCII white space as the contracts of this subpackage define it.
SPACE = r"[\x20\x09-\x0D]"


#: Spark deletes a query's shuffle files when it ends, if this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; this cuts its lineage.

    The shuffle files of the write go at once, as nothing can need them any more.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._weftline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut into smaller ones, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; also makes this package importable on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for work columns that clash with no column of ``df`` (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


#: Keys that :func:`spread_join` broadcasts at most.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (null where no group has the key), no key in one task.

    ``groups`` has one row a key, ``size`` being the number of rows with that key, or more, and
    ``total`` the sum of all sizes, or more. A key with more than ``total / HOT_KEYS`` rows is hot;
    as there are fewer than ``HOT_KEYS`` of them, hot groups are broadcast, and their rows are dealt
    by their place. The rows of all other keys, few of each, are dealt by the key.
    """
    values = [c for c in groups.columns if c not in keys]
    limit = max(1, total // HOT_KEYS)
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*values).alias(name))
    hot = F.broadcast(side(groups.filter(F.col(size) > limit), "wl_hot"))
    rest = side(groups.filter(F.col(size) <= limit), "wl_rest").withColumn("wl_turn", F.xxhash64(*[f"wl_rest_{k}" for k in keys]))
    found = rows.join(hot, [F.col(k) == F.col(f"wl_hot_{k}") for k in keys], "left")
    dealt = found.withColumn("wl_deal", F.when(F.col("wl_hot").isNotNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(*keys)))
    both = dealt.join(rest, [F.col(k) == F.col(f"wl_rest_{k}") for k in keys] + [F.col("wl_deal") == F.col("wl_turn")], "left")
    return both.select(*rows.columns, F.coalesce("wl_hot", "wl_rest").alias("wl_found")).select(*rows.columns, *[F.col(f"wl_found.{c}").alias(c) for c in values])
