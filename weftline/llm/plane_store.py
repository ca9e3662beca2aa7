"""Token-id files of bit or byte planes, each compressed with zstandard, with a chunk index.

A file holds documents in ascending order of their ids. All ids of the file form one stream that
is cut into blocks of a fixed number of ids; a block is transposed into planes (32 bit planes or 4
byte planes of its 32-bit ids), and each plane is compressed on its own, so that planes that are
all zero cost a few bytes. Document ids and lengths go the same way, in blocks of their own.

    file   := MAGIC block* index footer
    block  := zstd(plane) * planes
    index  := zstd(JSON {"planes": "bit" or "byte", "ids": [entry...], "docs": [entry...]})
    entry  := [offset, items, [length of each plane], crc32 of the ids as little-endian 32-bit]
    footer := length of the index (8 bytes, little-endian) MAGIC

Executors write and read files directly in the shared folder, through Arrow's file systems, so the
folder may be local, HDFS or an object store. A task that is run again writes another file; only
the files that the manifest names count.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .token_ids import encoder

MAGIC = b"WEFTPLN1"
#: Ids in a block; a multiple of 8.
BLOCK = 1 << 16
#: UTF-8 bytes of text in a file: at most, about, and at least where there are fewer files than tasks.
FILE_BYTES, SMALL_BYTES = 256 << 20, 4 << 20
DOC = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("n", "<u4")])


def to_planes(block: np.ndarray, kind: str) -> list[bytes]:
    """The planes of an array of little-endian 32-bit ids, most significant last."""
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _open(uri: str, mode: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    if mode == "r":
        return fs.open_input_file(path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


class PlaneWriter:
    """Writes one file block by block; memory holds one block."""

    def __init__(self, uri: str, kind: str = "byte", level: int = 3):
        import zstandard

        if kind not in ("bit", "byte"):
            raise ValueError("kind is bit or byte")
        self.kind, self.zip, self.out, self.at = kind, zstandard.ZstdCompressor(level=level), _open(uri, "w"), 0
        self.index = {"planes": kind, "ids": [], "docs": []}
        self.ids, self.held, self.docs, self.n_docs, self.n_ids = [], 0, [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, what: str, words: np.ndarray, items: int) -> None:
        at = self.at
        sizes = [self._put(self.zip.compress(p)) for p in to_planes(words, self.kind)]
        self.index[what].append([at, items, sizes, zlib.crc32(words.astype("<u4").tobytes())])

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document whose ids are little-endian 32-bit."""
        words = np.frombuffer(ids, "<u4")
        self.docs.append((doc_id or 0, doc_id is None, len(words)))
        self.n_docs += 1
        self.n_ids += len(words)
        if len(self.docs) * 4 >= BLOCK:
            self._flush_docs()
        self.ids.append(words)
        self.held += len(words)
        if self.held >= BLOCK:
            all_ids = np.concatenate(self.ids)
            whole = len(all_ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block("ids", all_ids[k : k + BLOCK], BLOCK)
            self.ids, self.held = [all_ids[whole:].copy()], len(all_ids) - whole

    def _flush_docs(self) -> None:
        if self.docs:
            self._block("docs", np.array(self.docs, DOC).view("<u4"), len(self.docs))
            self.docs = []

    def close(self) -> None:
        if self.held:
            self._block("ids", np.concatenate(self.ids), self.held)
        self._flush_docs()
        size = self._put(self.zip.compress(json.dumps(self.index).encode()))
        self._put(size.to_bytes(8, "little") + MAGIC)
        self.out.close()


def read_planes(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids) of each document of a file, in order; raises if a block is damaged."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    with _open(uri, "r") as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if f.read_at(8, 0) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a plane file")
        n = int.from_bytes(tail[:8], "little")
        index = json.loads(unzip.decompress(f.read_at(n, size - 16 - n)))
        kind = index["planes"]

        def block(entry: list, words: int) -> np.ndarray:
            at, _, sizes, crc = entry
            planes = []
            for k in sizes:
                planes.append(unzip.decompress(f.read_at(k, at)))
                at += k
            out = from_planes(planes, words, kind)
            if zlib.crc32(out.tobytes()) != crc:
                raise ValueError(f"{uri}: a block's check sum differs")
            return out

        blocks = iter(index["ids"])
        held = np.empty(0, "<u4")
        for d in index["docs"]:
            for doc_id, null, n_ids in block(d, d[1] * 4).view(DOC).tolist():
                parts, need = [], n_ids
                while need > len(held):
                    parts.append(held)
                    need -= len(held)
                    entry = next(blocks)
                    held = block(entry, entry[1])
                parts.append(held[:need])
                held = held[need:]
                yield (None if null else doc_id), (np.concatenate(parts) if len(parts) > 1 else parts[0])


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, kind: str = "byte", level: int = 3
) -> DataFrame:
    """Encode every whole text and write plane files in ascending order of ``id_col``.

    Returns the manifest, written to the shared folder: part, uri, n_docs, n_ids. ``vocabulary`` is
    a file of the word-level kind on every executor. ``end_id`` follows each document's ids. A null
    text counts as empty; very long texts are encoded whole. Rows with a null id come first; rows with
    equal ids stand together, in the order of a hash of their text, so that reruns agree and an id that
    many rows share may span files. An empty table gives an empty manifest. Other columns of ``docs``
    are ignored, whatever their names.
    """
    folder = folder or scratch(docs.sparkSession, "planes")

    def write(batches):
        encode, writer, uri = encoder("words", vocabulary), None, f"{folder}/{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.planes"
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                writer = writer or PlaneWriter(uri, kind, level)
                writer.add(doc_id.as_py(), encode(text.as_py() or "") + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "uri": [uri], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}, schema=pa.schema([("part", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, -(-size // FILE_BYTES), min(tasks, -(-size // SMALL_BYTES)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    ordered = rows.repartitionByRange(files, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    # a row for each file: one task writes them all, as each file that a JVM writes to a local folder costs it a process
    return written(ordered.mapInArrow(write, "part long, uri string, n_docs long, n_ids long").repartition(1), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read plane files back: doc_id, start, n_tokens, ids_crc32, and the ids if asked for.

    ``start`` counts the ids of all documents before, over all files in their order.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, ids in read_planes(uri):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int32),) if with_ids else ()))
                    start += len(ids)
                    held += len(ids) if with_ids else 1
                    if held >= 1 << (20 if with_ids else 14):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
