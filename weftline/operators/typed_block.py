"""Typed blocks: every column of every block of rows encoded to bytes, in parallel, and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import decode_tokens, encode_tokens

SCHEMA = "block_id long, col_id string, encoding string, n long, payload binary"


def encode_blocks(long: DataFrame, block_rows: int = 65536, plan: DataFrame | None = None) -> DataFrame:
    """(block_id, col_id, encoding, n, payload) of (row_id, col_id, raw).

    A group is one column of one block, so its size is bounded by ``block_rows``. ``plan`` gives the
    encoding of each column (col_id, encoding); without it each block takes the smallest that fits.
    """
    rows = long.withColumn("block_id", F.floor(F.col("row_id") / block_rows).cast("long"))
    rows = rows.join(F.broadcast(plan.select("col_id", "encoding")), "col_id", "left") if plan is not None else rows.withColumn("encoding", F.lit(None).cast("string"))

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tokens = [t for _, t in sorted(zip(group.column("row_id").to_pylist(), group.column("raw").to_pylist(), strict=True))]
        kind, payload = encode_tokens(tokens, group.column("encoding")[0].as_py())
        return pa.table({"block_id": [key[0].as_py()], "col_id": [key[1].as_py()], "encoding": [kind], "n": [len(tokens)], "payload": pa.array([payload], pa.binary())})

    return rows.select("block_id", "col_id", "row_id", "raw", "encoding").groupBy("block_id", "col_id").applyInArrow(run, SCHEMA)


def gate(blocks: DataFrame, raw: DataFrame) -> DataFrame:
    """(block_id, col_id, encoding, n, payload_bytes, use_typed): a block is kept typed if all its columns together are smaller.

    ``raw`` has (block_id, col_id, raw_bytes).
    """
    sized = blocks.select("block_id", "col_id", "encoding", "n", F.octet_length("payload").cast("long").alias("payload_bytes")).join(raw, ["block_id", "col_id"])
    per = sized.groupBy("block_id").agg((F.sum("payload_bytes") < F.sum("raw_bytes")).alias("use_typed"))
    return sized.join(per, "block_id").select("block_id", "col_id", "encoding", "n", "payload_bytes", "use_typed")


def decode_blocks(blocks: DataFrame, block_rows: int = 65536) -> DataFrame:
    """(row_id, col_id, raw) of :func:`encode_blocks`' rows, for dense row numbers."""

    def run(batches):
        for batch in batches:
            for block, col, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = decode_tokens(kind, payload)
                base = block * block_rows
                yield pa.RecordBatch.from_pydict({"row_id": pa.array(range(base, base + len(tokens)), pa.int64()), "col_id": pa.array([col] * len(tokens), pa.string()), "raw": pa.array(tokens, pa.string())})

    return blocks.select("block_id", "col_id", "encoding", "payload").mapInArrow(run, "row_id long, col_id string, raw string")
