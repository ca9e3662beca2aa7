"""Frames: independent chunks of rows, compressed on their own, with integrity checks.

A frame is one row of a table (frame_id, rows, format, coder, level, original, compressed, crc32,
payload), written as Parquet; frames can be decoded alone and joined in the order of their ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "frame_id long, rows long, coder string, level int, original long, compressed long, crc32 long, payload binary"
_FIELDS = pa.schema([("frame_id", pa.int64()), ("rows", pa.int64()), ("coder", pa.string()), ("level", pa.int32()), ("original", pa.int64()), ("compressed", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary())])


#: Frames that a worker holds as Python objects at a time, texts and payloads.
HELD = 16


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``HELD`` frames: small payloads fill a batch with thousands, whose texts are far larger."""
    for batch in batches:
        for k in range(0, batch.num_rows, HELD):
            yield batch.slice(k, HELD)


def frame_chunks(lines: DataFrame, rows: int = 1000) -> DataFrame:
    """(frame_id, rows, bytes): frames of ``rows`` lines; bytes count a newline for each line."""
    return lines.groupBy(F.floor(F.col("row_id") / rows).alias("frame_id")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"))


def frame_texts(lines: DataFrame, rows: int = 1000) -> DataFrame:
    """(frame_id, rows, text): each frame's lines joined by newlines, in their order."""
    return lines.groupBy(F.floor(F.col("row_id") / rows).alias("frame_id")).agg(F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def level_for(size: int) -> int:
    return 19 if size <= 1 << 20 else 13 if size <= 10 << 20 else 9


#: The level of the plain zstandard that a mode is compared with.
COMPARED = {"fast": 3, "balanced": 19, "max": 22}
#: Bytes that a frame needs to have a dictionary of its own, and samples to train it on.
TRAINED_BYTES, TRAINED_SAMPLES = 8192, 5


def trained(body: bytes, level: int) -> bytes | None:
    """The frame as chunks of whole lines compressed with a dictionary trained on them, the dictionary in front; None if too small."""
    import zstandard

    if len(body) < TRAINED_BYTES:
        return None
    lines, chunks, held = body.split(b"\n"), [], b""
    for k, line in enumerate(lines):
        held += line + (b"\n" if k < len(lines) - 1 else b"")
        if len(held) >= 4096:
            chunks.append(held)
            held = b""
    chunks += [held] if held else []
    if len(lines) < TRAINED_SAMPLES or len(chunks) < 2:
        return None
    try:
        d = zstandard.train_dictionary(max(256, min(65536, len(body) // 16)), [x for x in lines if x])
    except zstandard.ZstdError:
        return None
    zip_ = zstandard.ZstdCompressor(level=level, dict_data=d)
    head = zstandard.ZstdCompressor(level=level).compress(d.as_bytes())
    packed = [zip_.compress(c) for c in chunks]
    return struct.pack("<II", len(head), len(packed)) + head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def untrained(payload: bytes) -> bytes:
    """The inverse of :func:`trained`."""
    import zstandard

    head, n = struct.unpack_from("<II", payload)
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(payload[8 : 8 + head])))
    sizes, at, out = struct.unpack_from(f"<{n}I", payload, 8 + head), 8 + head + 4 * n, []
    for size in sizes:
        out.append(unzip.decompress(payload[at : at + size]))
        at += size
    return b"".join(out)


def candidates(body: bytes, level: int | None = None, dictionary: bytes | None = None) -> list[tuple[str, int, bytes]]:
    """(coder, level, payload) of every coder that can take a frame."""
    import zstandard

    n = level if level is not None else level_for(len(body))
    out = [("raw", 0, body), ("zlib", 9, zlib.compress(body, 9)), ("zstd", n, zstandard.ZstdCompressor(level=n).compress(body))]
    if (own := trained(body, n)) is not None:
        out.append(("zstd_trained", n, own))
    if dictionary:
        out.append(("zstd_dict", n, zstandard.ZstdCompressor(level=n, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(body)))
    return out


def decoded(coder: str, payload: bytes, dictionary: bytes | None = None) -> bytes:
    import zstandard

    if coder == "raw":
        return payload
    if coder == "zlib":
        return zlib.decompress(payload)
    if coder == "zstd":
        return zstandard.ZstdDecompressor().decompress(payload)
    if coder == "zstd_dict":
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary or b"")).decompress(payload)
    if coder == "zstd_trained":
        return untrained(payload)
    raise ValueError(f"unknown coder {coder}")


def compress_frames(texts: DataFrame, level: int | None = None, coder: str | None = None, dictionary: bytes | None = None) -> DataFrame:
    """Frames of a table (frame_id, rows, text): the smallest candidate of each, ties by coder."""

    def run(batches):
        for batch in few(batches):
            out = []
            for frame_id, rows, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (text or "").encode()
                best = min((c for c in candidates(body, level, dictionary) if coder in (None, c[0])), key=lambda c: (len(c[2]), c[0]))
                out.append((frame_id, rows, best[0], best[1], len(body), len(best[2]), zlib.crc32(body), best[2]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_FIELDS), _FIELDS, strict=True)], schema=_FIELDS)

    return texts.select(F.col("frame_id").cast("long"), F.col("rows").cast("long"), "text").mapInArrow(run, SCHEMA)


def decompress_frames(frames: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """(frame_id, rows, text, ok); ok is false where size or check sum differ or decoding fails."""
    fields = pa.schema([("frame_id", pa.int64()), ("rows", pa.int64()), ("text", pa.string()), ("ok", pa.bool_())])

    def run(batches):
        for batch in few(batches):
            out = []
            for frame_id, rows, coder, size, crc, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    body = decoded(coder, payload, dictionary)
                    ok = len(body) == size and zlib.crc32(body) == crc
                except Exception:  # a damaged payload is reported, not fatal
                    body, ok = b"", False
                out.append((frame_id, rows, body.decode() if ok else None, ok))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 4, fields, strict=True)], schema=fields)

    return frames.select("frame_id", "rows", "coder", "original", "crc32", "payload").mapInArrow(run, "frame_id long, rows long, text string, ok boolean")


def verified(frames: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """(frame_id, rows, text); raises on the first damaged frame."""
    out = decompress_frames(frames, dictionary)
    return out.select("frame_id", "rows", F.when(F.col("ok"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("damaged frame "), F.col("frame_id").cast("string")))).alias("text"))


def frame_lines(texts: DataFrame, rows: int = 1000) -> DataFrame:
    """(row_id, line): the inverse of :func:`frame_texts`."""
    return texts.select((F.col("frame_id") * rows).alias("base"), F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).select((F.col("base") + F.col("k")).alias("row_id"), "line")


def train_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A dictionary from bounded samples, on the driver: lines if there are five or more, else blocks."""
    import zstandard

    parts = [x for s in samples for x in s.split(b"\n") if x]
    if len(parts) < 5:
        parts = [s[k : k + 4096] for s in samples for k in range(0, len(s), 4096)]
    return zstandard.train_dictionary(size, parts).as_bytes()


def info(frames: DataFrame) -> DataFrame:
    """The header of every frame, without its payload."""
    ratio = F.when(F.col("compressed") > 0, F.round(F.col("original") / F.col("compressed"), 6)).otherwise(0.0)
    return frames.select("frame_id", "rows", "coder", "level", "original", "compressed", "crc32", ratio.alias("ratio"))


def chained(texts: DataFrame, format: str = "ndjson") -> DataFrame:
    """(frame_id, chain, bytes, back): every chain of steps that a frame can take, with the length of its outcome and the inverse."""

    def run(batches):
        from ..api import _inverse, chains

        for batch in few(batches):
            out = []
            for frame_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for steps, body in chains((text or "").encode(), format):
                    out.append((frame_id, ",".join(s["x"] for s in steps), len(body), _inverse(steps, body).decode()))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["frame_id", "chain", "bytes", "back"])

    return texts.select(F.col("frame_id").cast("long"), "text").mapInArrow(run, "frame_id long, chain string, bytes long, back string")


@F.pandas_udf(T.BinaryType())
def mixed(text: pd.Series) -> pd.Series:
    """Texts by the context-mixing coder; slow, for frames of some KB."""
    from ..functions.context_coder import cm_encode

    return text.map(lambda t: cm_encode(t.encode()))


@F.pandas_udf(T.BinaryType())
def unmixed(payload: pd.Series) -> pd.Series:
    from ..functions.context_coder import cm_decode

    return payload.map(cm_decode)
