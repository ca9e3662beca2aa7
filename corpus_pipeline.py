"""The corpus pipeline: from the raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``docs``. A row is known by 128 bits of a hash of all its columns, so that
rows that share an id or a text are told apart; rows that agree in every column are interchangeable.

In every stage null ids, sources and other columns are values like any other, a null text counts as
empty, very long texts count whole, repeated rows are rows of their own, an empty table gives an
empty one, and columns may have any further names; where ids tie, the hash decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, mixing, packing, quality_pu, simhash
from weftline.llm.common import discard, fresh, table, written
from weftline.llm.token_ids import vocabulary

#: DuckDB SQL can't express the classifier, the fingerprints, the draws or the token ids.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with two columns that name a row by all its columns, and their names."""
    names = tuple(fresh(docs, "wl_key", "wl_more"))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    keys = [F.xxhash64(F.lit(seed), *[c.isNull() for c in columns], *columns) for seed in (1, 2)]
    return docs.withColumns(dict(zip(names, keys, strict=True))), names


def _chosen(docs: DataFrame, keys: tuple[str, str], chosen: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` names by ``keys``, each once or ``copies`` times, without the keys.

    ``chosen`` names a row once. Rows that agree in all columns are cut down to one before the exchange.
    """
    plain = [c for c in docs.columns if c not in keys]
    turn, n = fresh(docs, "wl_turn", "wl_copies")
    first = docs.withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).filter(F.col(turn) == 1).drop(turn)
    side = chosen.select(*keys, (F.col(copies) if copies else F.lit(1)).cast("int").alias(n))
    rows = first.join(side, list(keys))
    if copies:
        rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return rows.select(plain)


def _lowest(rows: DataFrame, group: str, keys: tuple[str, str], id_col: str = "doc_id") -> DataFrame:
    """The keys of the row with the smallest id of each group, null ids last."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *keys)).alias("x")
    return rows.groupBy(group).agg(first).select(*[F.col(f"x.{k}").alias(k) for k in keys])


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_pu.accept(docs, quality_pu.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest as written, then the one with the smallest id."""
    docs, keys = _keyed(docs)
    return _chosen(docs, keys, exact_dedup.exact_dedup(docs, carry=keys).filter("kept").select(*keys))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component by op5's rule (4 of 64 bits) stays, the one with the smallest id; not a stage, see drop_similar."""
    docs, keys = _keyed(docs)
    return _chosen(docs, keys, _lowest(simhash.near_duplicates(docs, with_root=True, carry=keys), "root", keys))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard similarity 0.8 or more stays, the one with the smallest id."""
    docs, keys = _keyed(docs)
    return _chosen(docs, keys, _lowest(simhash.similar(docs, carry=keys), "root", keys))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    docs, keys = _keyed(docs)
    return _chosen(docs, keys, mixing.mix(docs, carry=keys).filter("repeats > 0").groupBy(*keys).agg(F.sum("repeats").alias("n")), "n")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed in sequences."""
    return packing.pack(packing.tokenised(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_similar),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; a stage's table goes once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if last is not None:
                discard(last)
            last = docs
    return docs
