"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup as _exact
from . import mixing as _mixing
from . import packing as _packing
from . import plane_store as _planes
from . import quality_pu as _quality
from . import simhash as _simhash
from . import suffix_dedup as _suffix
from . import surrogates as _surrogates
from . import token_count as _count
from . import vector_file as _vectors
from .common import table
from .token_ids import vocabulary


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
  WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, CAST(n AS BIGINT) AS n_code_points FROM r
"""

def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_packing.tokenised(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planes.read_token_files(_planes.write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _quality.score(docs, _quality.train(docs, table(spark, sf_dir, "labels")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _surrogates.replace_personal_data(docs, key=spark.conf.get("weftline.surrogate.key", "weftline"))  # set a secret of your own


def op9_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return _vectors.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_cube_mixing": op4_cube_mixing,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_surrogates": op8_surrogates,
    "op9_vector_file": op9_vector_file,
    "op10_token_planes": op10_token_planes,
}
SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op9_vector_file": OP9_SQL}
