"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame operations only).

Every input partition becomes a run of digests. In each round, ``fan_in`` neighbouring runs become
one: a task sorts the digests it holds of a run and keeps one row of each (the sort and the partial
sort-aggregate before the exchange), the tasks exchange their sorted pieces, and a piece of the new
run is the merge of all that arrive (the sort and the final sort-aggregate after it). What is kept of
a digest is the best identifier, and the copies are added up. The new runs are written, sorted, to
the shared folder, which cuts the lineage. After the last round one logical run is left; it is dealt
by digest like all others, so no round puts a run into one task, and a task sends at most one row
of a digest, however many copies there are.

Verified: rows meet only if digest, normalised length and an independent second hash all agree,
at every level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, spread_join, written

KEY = ("sha", "chk", "nlen")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, row number, run number, length, the verified digest key and ``carry``."""
    norm = F.encode(F.col("wl_n"), "UTF-8")
    return (
        docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("len"), normalised(F.col(text_col)).alias("wl_n"), *carry)
        .select(
            "id", "len", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"),
            F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("chk"), F.octet_length("wl_n").cast("long").alias("nlen"), *carry,
        )
    )


def merge_round(state: DataFrame, fan_in: int) -> DataFrame:
    """Merge every ``fan_in`` neighbouring sorted runs (run, digest key, best, copies) into one sorted run."""
    merged = state.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
    return merged.sortWithinPartitions("run", *KEY)


def tree_merge(digests: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """Merge sorted digest runs in rounds; returns one row per distinct text with its best row.

    The best row has the most code points, then the smallest id (null ids last), then the
    smallest row number, which only decides between repeated rows.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    best = F.struct((-F.col("len")).alias("neg_len"), F.col("id").isNull().alias("no_id"), "id", "row")
    state = digests.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("copies"))
    while True:
        state, runs = written(merge_round(state, fan_in), "runs"), -(-runs // fan_in)
        if runs <= 1:
            return state.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row of ``docs``: which row of its group of equal texts stays.

    Texts are equal if identical after deleting ASCII white space. Returns, for each input row,
    ``id_col``, keep_id, group_size, kept, text_sha256, n_code_points, and the columns ``carry`` of
    ``docs`` (whose names must differ from all these). Null and empty texts and texts of white space
    only form one group; very long texts are digested whole; of repeated rows (same id and text) one
    is kept; an empty table gives an empty result. Other columns of ``docs`` are ignored, whatever
    their names. Without a ``fan_in`` it is 8, or more where three rounds would not do.
    """
    digests = written(digest_table(docs, id_col, text_col, carry), "digests")
    runs, total = _runs(digests)
    groups = tree_merge(digests, runs, fan_in or max(8, math.ceil(runs ** (1 / 3))))
    found = spread_join(digests, groups.filter("copies > 1"), list(KEY), "copies", total)
    alone = F.col("copies").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("copies", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"), F.col("sha").alias("text_sha256"), F.col("len").alias("n_code_points"), *carry,
    )


def _runs(digests: DataFrame) -> tuple[int, int]:
    """The number of runs and of rows."""
    top, total = digests.agg(F.max("run"), F.count("*")).first()
    return (1 if top is None else int(top) + 1), total
