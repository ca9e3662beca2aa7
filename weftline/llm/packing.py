"""Cost-balanced packing of tokenised documents into sequences of a fixed capacity.

The cost of a sequence is estimated as ``linear * tokens + quadratic * sum of squared piece
lengths`` (attention is within a piece). Documents are dealt into bins by a hash of their id and place; a bin
holds a bounded amount of text, whatever the size of the corpus and however often a row or an id
repeats, and is packed by one task:

1. every full capacity's worth of a document becomes a sequence of its own;
2. the rests, in descending order, each go to the sequence of lowest cost with room for the whole;
3. a rest that fits nowhere is cut over the sequences with most room.

A bin opens just as many sequences as its tokens need, so it wastes less than one sequence.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .token_ids import encoder

#: UTF-8 bytes of text in a bin, about; a bin is one task's group.
BIN_BYTES = 4 << 20
#: Bins that one task packs, one after the other, where there are more bins than tasks.
TASK_BINS = 16


def plan(lengths: np.ndarray, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths."""
    out, n_seq = [], 0
    rests = lengths % capacity
    for d in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[d] - rests[d]), capacity):
            out.append((int(d), start, capacity, n_seq, 0))
            n_seq += 1
    n = -(-int(rests.sum()) // capacity)
    cost, room = np.zeros(n), np.full(n, capacity)

    def put(d: int, start: int, length: int, k: int) -> None:
        out.append((d, start, length, n_seq + k, capacity - int(room[k])))
        room[k] -= length
        cost[k] += linear * length + quadratic * length * length

    for d in np.lexsort((np.arange(len(rests)), -rests)):
        need, start = int(rests[d]), int(lengths[d] - rests[d])
        if not need:
            break
        open_to = np.where(room >= need, cost, np.inf)
        k = int(open_to.argmin())
        if open_to[k] < np.inf:
            put(int(d), start, need, k)
            continue
        while need:
            k = int(room.argmax())
            part = min(need, int(room[k]))
            put(int(d), start, part, k)
            start, need = start + part, need - part
    return out


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """doc_id, bin, and the ids of each whole text (little-endian 32-bit binary), ended by ``end_id``, dealt by bin.

    A null text counts as empty, an empty one has the end id only; very long texts are encoded whole;
    repeated rows and null ids are rows like any other; an empty table gives an empty result. Other
    columns of ``docs`` are ignored, whatever their names.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches):
        ids_of = encoder("byte_level", vocabulary)
        for batch in slices(batches):
            ids = pa.array([ids_of(t or "") + end for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids], names=["doc_id", "bin", "ids"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    bins = max(1, -(-size // BIN_BYTES))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()), F.lit(bins)).alias("bin"))
    tasks = min(bins, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bins // TASK_BINS)))
    return keyed.mapInArrow(encode, "doc_id long, bin long, ids binary").repartition(tasks, "bin")


def pack(ids: DataFrame, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, with_ids: bool = False) -> DataFrame:
    """Pack the result of :func:`tokenised`; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids
    if asked for. Rows with equal ids are packed as separate documents, in the order of their
    tokens; documents without an id come last in their bin; one longer than the capacity fills
    sequences of its own first; an empty table has no sequences.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        held = sorted(zip(group.column("doc_id").to_pylist(), group.column("ids").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0], x[1]) if x[0] is not None else (True, 0, x[1]))
        rows = []
        for d, start, length, seq, offset in plan(np.array([len(x) // 4 for _, x in held], np.int64), capacity, linear, quadratic):
            doc_id, all_ids = held[d]
            piece = memoryview(all_ids)[4 * start : 4 * (start + length)]
            rows.append((doc_id, start, length, zlib.crc32(piece), len(all_ids) // 4, (key[0].as_py() << 32) + seq, offset) + ((np.frombuffer(piece, "<u4").astype(np.int32),) if with_ids else ()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names + ["ids"] * with_ids)

    return ids.groupBy("bin").applyInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids)
