"""Removal of repeated substrings by bucket-pointer refinement over content-defined suffixes.

A byte is removed if some string of ``length`` bytes covers it that also starts anywhere else in the
corpus. Two equal strings of that length are suffixes that share a bucket down to that depth, so it
is enough to refine suffix buckets to depth ``length`` and see which have more than one member.

Buckets. The initial bucket of a suffix is its 8-gram. A bucket at depth 2h is the pair of bucket
identifiers at offsets 0 and h, both of depth h: each refinement reuses the updated identifiers of
the one before, down to depth q (a power of two) and to ``length``. An identifier is 64 bits made
of the pair, the same in every task, so refining needs no exchange.

Which suffixes. Of the q-gram buckets that start within a window of ``length`` bytes, the one with
the lowest identifier is the window's anchor: equal windows have anchors with equal buckets at
equal offsets. Neighbouring windows share anchors, about one anchor for 60 bytes, and only anchors
are exchanged, each with the extent of its windows (their first and last bucket at full depth).

1. q-gram buckets are counted; anchors alone in theirs are settled: their windows are unique.
2. Within the other buckets, anchors with equal extents settle each other: all windows repeat.
3. One anchor of each extent left in a mixed bucket is refined to full depth, and the identifiers
   of its windows are compared within the q-gram bucket. A bucket with many different extents is
   dealt into parts of bounded size. What repeats within a part is settled there; a part then sends
   each of its identifiers once, and those that two parts have in common are settled too. So a
   passage in any number of surroundings costs a task one part, or one row a part.

Counts combine before their exchanges, joins keep hot keys out of single tasks, texts travel
compressed, and intermediate tables go as soon as nothing reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes handled at once, and windows of a long text handled at once.
CHUNK, SEGMENT = 1 << 20, 1 << 19
#: Different extents of one q-gram bucket that are compared at once, about; some 600 bytes each.
REFINED = 1 << 15
#: Rows that a task recalls as sent.
SENT = 1 << 20
_POSITION = np.uint64((1 << 21) - 1)


def refine(bucket: np.ndarray, h: int) -> np.ndarray:
    """Buckets at depth d + h from those at depth d >= h: the pairs at offsets 0 and h."""
    x, y = bucket[:-h] * _A, bucket[h:] * _B
    x ^= x >> np.uint64(32)
    y ^= y >> np.uint64(29)
    x += y
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def depth_of(length: int) -> int:
    """The depth q of the buckets that anchors are chosen by."""
    if length < 32:
        raise ValueError("length must be at least 32")
    return 1 << (length.bit_length() - 2)


def buckets(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers at depth q and at full depth, for every place of at least ``length`` bytes."""
    now = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw).data, 0, (1,)).astype(np.uint64)
    depth, q = 8, depth_of(length)
    at_q = now
    while depth * 2 <= length:
        now = refine(now, depth)
        depth *= 2
        if depth == q:
            at_q = now
    return at_q, refine(now, length - depth) if length > depth else now


def anchors(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, bucket, extent) of each anchor of the pieces [begin, end) of ``raw``."""
    at_q, full = buckets(raw, length)
    n, width = len(full), length - depth_of(length) + 1
    low, step = (at_q & ~_POSITION) | np.arange(len(at_q), dtype=np.uint64), 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n], low[width - step : width - step + n])
    anchor = (low & _POSITION).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:n]))
    if not len(windows):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    piece = np.searchsorted(begin, windows, side="right") - 1
    a = anchor[windows]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1])])
    first = windows[new]
    last = windows[np.concatenate([np.flatnonzero(new)[1:], [len(windows)]]) - 1]
    extent = (full[first] * _A) ^ ((full[last] + np.uint64(1)) * _B) ^ (last - first).astype(np.uint64)
    return piece[new], first - begin[piece[new]], last - first + 1, at_q[a[new]], extent


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def _scan(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes_of(batch.column(2))
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            pieces: list[tuple[int, int, int, int]] = []  # row, offset in its text, begin, end
            for row in np.flatnonzero(np.diff(offsets) >= length).tolist():
                s, e = int(offsets[row]), int(offsets[row + 1])
                pieces += [(row, at, s + at, min(e, s + at + SEGMENT + length - 1)) for at in range(0, e - s - length + 1, SEGMENT)]
            k = 0
            while k < len(pieces):
                j = k + 1
                while j < len(pieces) and pieces[j][3] - pieces[k][2] <= CHUNK and pieces[j][2] >= pieces[j - 1][3]:
                    j += 1
                row, at, begin, end = (np.array(x, np.int64) for x in zip(*pieces[k:j], strict=True))
                piece, first, n, bucket, extent = anchors(raw[begin[0] : end[-1]], begin - begin[0], end - begin[0], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(extent.view(np.int64)), pa.array(ids[row[piece]]), pa.array(marks[row[piece]]), pa.array((at[piece] + first) << 16 | n)],
                    names=["b", "e", "id", "mark", "at"],
                )
                k = j

    return run


def _pack(once: bool):
    """Rows (id, mark, none, body) with the body compressed; a task sends a row but once if ``once``, as far as it recalls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, sent = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            if once:
                keep = []
                for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keep.append(key not in sent)
                    sent.add(key)
                if len(sent) > SENT:
                    sent = set()
                batch = batch.filter(pa.array(keep, pa.bool_()))
            body = pa.array([zip_.compress(x.as_buffer()) for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], body], names=["id", "mark", "none", "packed"])

    return run


def _refined(length: int):
    """Rows (id, mark, packed, todo) to one row for each anchor, with the identifiers of its windows."""
    names = ["b", "part", "parts", "id", "mark", "first", "needed", "full"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()

        def flush(parts: list, rows: list) -> pa.RecordBatch:
            _, full = buckets(np.concatenate(parts), length)
            out, begin = [], 0
            for (doc_id, mark, t), piece in zip(rows, parts, strict=True):
                own = full[begin : begin + (t["at"] & 0xFFFF)]
                begin += len(piece)
                out.append((t["b"], t["part"], t["parts"], doc_id, mark, t["at"] >> 16, t["needed"], own.astype("<u8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            parts, held, rows = [], 0, []
            for doc_id, mark, packed_, todo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(unzip.decompress(packed_), np.uint8)
                for t in todo:
                    first, n = t["at"] >> 16, t["at"] & 0xFFFF
                    parts.append(raw[first : first + n + length - 1])
                    rows.append((doc_id, mark, t))
                    held += len(parts[-1])
                    if held >= CHUNK:
                        yield flush(parts, rows)
                        parts, held, rows = [], 0, []
            if rows:
                yield flush(parts, rows)

    return run, ", ".join(f"{n} {k}" for n, k in zip(names, ("long", "long", "long", "long", "long", "long", "boolean", "binary"), strict=True))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, part) to rows (b, w, id, mark, at).

    Without a w: windows of needed anchors that another anchor of the part has too. With a w: an
    identifier of a part that is not alone, and where it is, if only one needed anchor has it.
    """
    B, W, ID, MARK, AT = [], [], [], [], []

    def settle(group: list[tuple]) -> None:
        bucket, _, parts = group[0][:3]
        if len(group) < 2 and parts < 2:
            return
        full = [np.frombuffer(r[7], "<u8") for r in group]
        value, at, back, count = np.unique(np.concatenate(full), return_index=True, return_inverse=True, return_counts=True)
        repeated, k, owners = count[back] > 1, 0, []
        for r, own in zip(group, full, strict=True):
            hits = np.flatnonzero(repeated[k : k + len(own)])
            owners += [(r, k)]
            k += len(own)
            if r[6] and len(hits):
                for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
                    put(bucket, None, r[3], r[4], (r[5] + int(run[0])) << 16 | len(run))
        if parts > 1:
            place = np.searchsorted([b for _, b in owners], at, side="right") - 1
            for w, a, n, p in zip(value.view(np.int64).tolist(), at.tolist(), count.tolist(), place.tolist(), strict=True):
                r, begin = owners[p]
                put(bucket, w, *((r[3], r[4], (r[5] + a - begin) << 16 | 1) if n == 1 and r[6] else (None, None, None)))

    def put(b: int, w: int | None, doc_id: int | None, mark: int | None, at: int | None) -> None:
        B.append(b), W.append(w), ID.append(doc_id), MARK.append(mark), AT.append(at)

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (B, W, ID, MARK, AT)], names=["b", "w", "id", "mark", "at"])
        for c in (B, W, ID, MARK, AT):
            c.clear()
        return out

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:2] != row[:2]:
                settle(group)
                group = []
            group.append(row)
        if W:
            yield flush()
    if group:
        settle(group)
    yield flush()


def repeated_windows(docs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Runs of repeated windows: id, mark, at (first window times 65536 plus their number), n; and the tables they are read from.

    ``docs`` has id, mark (64 bits that tell the texts of one id apart), none (the id is null) and
    body (bytes). Rows that agree in all four share their runs; n is at least their number, or null.
    """
    found = docs.select("id", "mark", "body").mapInArrow(_scan(length), "b long, e long, id long, mark long, at long")
    found = written(found, "anchors")
    shared = found.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(spread_join(found, shared, ["b"], "n", found.count()).filter("n is not null").drop("n"), "members")
    discard(found)
    total = members.count()
    extents = written(members.groupBy("b", "e").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "at")).alias("one")), "extents")
    settled = spread_join(members, extents.filter("n > 1").select("b", "e", "n"), ["b", "e"], "n", total).filter("n is not null")
    # an anchor of a repeated extent has as many rows here as its text has copies
    settled = settled.groupBy("id", "mark", "at").agg(F.count("*").alias("n"))
    mixed = extents.groupBy("b").agg(F.count("*").alias("k")).filter("k > 1")
    todo = spread_join(extents, mixed, ["b"], "k", total).filter("k is not null")
    parts = F.ceil(F.col("k") / REFINED).cast("long")
    todo = todo.select("one.id", "one.mark", F.struct(F.col("one.at").alias("at"), "b", F.pmod("e", parts).alias("part"), parts.alias("parts"), (F.col("n") == 1).alias("needed")).alias("t"))
    todo = todo.groupBy("id", "mark").agg(F.collect_list("t").alias("todo"))
    texts = packed(docs, once=True).join(todo, ["id", "mark"]).select("id", "mark", "packed", "todo").dropDuplicates(["id", "mark"])
    run, schema = _refined(length)
    compared = texts.mapInArrow(run, schema).repartition("b", "part").sortWithinPartitions("b", "part").mapInArrow(_compared, "b long, w long, id long, mark long, at long")
    compared = written(compared, "compared")
    across = compared.filter("w is not null")
    common = across.groupBy("b", "w").agg(F.count("*").alias("k")).filter("k > 1")
    late = across.filter("at is not null").join(common, ["b", "w"], "left_semi")
    none = F.lit(None).cast("long").alias("n")
    found = settled.unionByName(compared.filter("w is null").select("id", "mark", "at", none)).unionByName(late.select("id", "mark", "at", none))
    return found, [members, extents, compared]


def packed(docs: DataFrame, once: bool = False) -> DataFrame:
    return docs.select("id", "mark", "none", "body").mapInArrow(_pack(once), "id long, mark long, none boolean, packed binary")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Every row with what is left of its text once all repeated strings of ``length`` bytes are gone.

    Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the
    bytes left (``kept``) if asked for. Texts are judged as UTF-8 bytes, a null text as empty; no
    string crosses two texts. Copies of a row count as other places, so repeated rows of at least
    ``length`` bytes lose everything. Texts shorter than that keep everything, very long ones are cut
    into overlapping segments; null ids are rows like any other; an empty table gives an empty result.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = F.col(id_col).cast("long")
    # the hash skips a null id, so that it tells null from the id in its place
    keyed = docs.select(F.coalesce(own, F.lit(-(2**63))).alias("id"), F.xxhash64(own, text_col).alias("mark"), own.isNull().alias("none"), body.alias("body"))
    # a run counts once, however many copies of its row there are
    found, tables = repeated_windows(keyed, length)
    runs = found.groupBy("id", "mark", "at").agg(F.max("n").alias("n"))
    runs = written(runs.groupBy("id", "mark").agg(F.collect_list("at").alias("runs"), F.coalesce(F.max("n"), F.lit(1)).alias("n")), "runs")
    discard(*tables)
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, none, packed_, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unzip.decompress(packed_)
                spans: list[list[int]] = []
                for a in sorted(at or ()):
                    begin, end = a >> 16, (a >> 16) + (a & 0xFFFF) + length - 1
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([begin, end])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if none else doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) + ((kept,) if with_kept else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], names=names)

    # a hot text has many copies, so that the runs of all hot ones are no larger than HOT_KEYS texts of mean size
    texts = spread_join(packed(keyed), runs, ["id", "mark"], "n", docs.count()).select("id", "none", "packed", "runs")
    done = texts.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    return done.withColumnRenamed("id", id_col)
