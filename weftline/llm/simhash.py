"""Near-duplicates by SimHash, compared bit-sliced.

Fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of any disjoint
blocks of their bits. With b blocks there is a table for each choice of b - radius blocks, keyed by
those blocks' bits; any pair within the radius meets in at least one table. b grows with the number
of distinct fingerprints so that a bucket stays small; every choice finds every pair.

A bucket is compared bit-sliced: plane i holds bit i of all members, 64 members to a word. The
differing bits of one member against all others are added, plane by plane, into bit-sliced
counters, and a block of members is abandoned once every count exceeds the radius. Of the pairs
found only a spanning forest leaves the task. A bucket above ``TILE`` members is cut by the blocks of
its other bits, and what is still above is dealt into tiles, each pair of which becomes a task's
group, so no bucket has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spread_join, written
from .components import connected_components

TILE = 1024
#: Members that a bucket should have on average, about.
BUCKET = 1024
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit majority fingerprint of a text's word shingles, as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    for k in range(0, n, 1 << 15):
        h = np.array([hash_of(joined[a:b], 42) for a, b in zip(first[k : k + (1 << 15)], last[k : k + (1 << 15)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The 64-bit majority fingerprint of distinct shingle hashes, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, mark (a hash of the text), the long columns ``carry`` and fp (the fingerprint's bits as a signed long) of every row."""
    names = ["doc_id", "mark", *carry, "fp"]

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, width) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), *carry, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def blocks_for(n: int, radius: int) -> list[list[int]]:
    """Masks' bit lists: one per table, enough bits for buckets of about ``BUCKET`` members."""
    b = radius + 1
    while b < radius + 6 and n / 2 ** (64 * (b - radius) // b) > BUCKET:
        b += 1
    edges = [round(64 * k / b) for k in range(b + 1)]
    parts = [list(range(edges[k], edges[k + 1])) for k in range(b)]
    return [sum((parts[k] for k in chosen), []) for chosen in combinations(range(b), b - radius)]


def within(members: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix of members (rows) against members (bits): set where they differ in at most radius bits."""
    n = len(members)
    words = -(-n // 64)
    bits = np.unpackbits(members.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    own = np.where(bits.T.astype(bool), _ONES, np.uint64(0))
    telling = np.flatnonzero((bits != bits[:1]).any(axis=0)).tolist()  # a plane on which all agree adds nothing
    levels = max(1, (radius + 1).bit_length())
    out = np.zeros((n, words), np.uint64)
    tail = np.full(words, _ONES)
    if n % 64:
        tail[-1] = np.uint64((1 << (n % 64)) - 1)
    place = np.arange(n)
    itself = np.uint64(1) << (place & 63).astype(np.uint64)
    for at in range(0, n, 256):
        mine, rows = own[:, at : at + 256], np.arange(min(256, n - at))
        shape = (len(rows), words)
        counter = [np.zeros(shape, np.uint64) for _ in range(levels)]
        # counts beyond the counters, unused places, and a member itself, which must not keep its block alive
        over = np.broadcast_to(~tail, shape).copy()
        over[rows, (at + rows) >> 6] |= itself[at + rows]
        for step, k in enumerate(telling, 1):
            carry = planes[k][None, :] ^ mine[k][:, None]
            for c in range(levels):
                counter[c], carry = counter[c] ^ carry, counter[c] & carry
            over |= carry
            if step % 8 == 0 and (over | _exceeds(counter, radius) == _ONES).all():
                break
        else:
            out[at : at + 256] = ~(over | _exceeds(counter, radius))
    out[place, place >> 6] |= itself
    return out


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the bit-sliced count is above the radius."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for c in reversed(range(len(counter))):
        if radius >> c & 1:
            equal &= counter[c]
        else:
            above |= equal & counter[c]
            equal &= ~counter[c]
    return above


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the pairs within the radius."""
    near = within(members, radius)
    degree = np.bitwise_count(near).sum(axis=1)
    rest = np.full(near.shape[1], _ONES)
    out = []
    for i in np.flatnonzero(degree > 1).tolist():
        if not int(rest[i >> 6]) >> (i & 63) & 1:
            continue
        rest[i >> 6] &= ~np.uint64(1 << (i & 63))
        stack = [i]
        while stack:
            new = near[stack.pop()] & rest
            if new.any():
                rest &= ~new
                found = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist()
                out += [(i, j) for j in found]
                stack += found
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Last columns of runs of rows that agree in the first ``keys`` columns; rows come sorted."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        cuts = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        begin = 0
        for end in cuts.tolist():
            if end - begin > 1:
                yield rows[begin:end, -1]
            begin = end
        held = rows[begin:]
    if held is not None and len(held) > 1:
        yield held[:, -1]


def _rest_masks(bits: list[int], radius: int) -> list[int]:
    """The bits outside a table's key, cut into radius + 1 blocks: members within the radius agree in one."""
    rest = [k for k in range(64) if k not in set(bits)]
    edges = [round(len(rest) * k / (radius + 1)) for k in range(radius + 2)]
    return [_signed(rest[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(bits: list[int]) -> int:
    return np.uint64(sum(1 << b for b in bits)).astype(np.int64).item()


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that join all fingerprints within the radius; ``fps`` holds distinct longs fp.

    A bucket above ``TILE`` members is cut into smaller ones by the blocks of its remaining bits; what is
    still above is dealt into tiles, each pair of tiles being a group.
    """
    n = fps.count()
    tables = blocks_for(n, radius)
    keys = [F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(bits))).alias("k")) for t, bits in enumerate(tables)]
    rows = fps.select(F.explode(F.array(*keys)).alias("x"), "fp").select("x.t", "x.k", "fp")
    hot = rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    marked = spread_join(rows, hot, ["t", "k"], "n", n * len(tables))
    masks = F.element_at(F.array(*[F.array(*[F.lit(m) for m in _rest_masks(bits, radius)]) for bits in tables]), (F.col("t") + 1).cast("int"))
    finer = F.transform(masks, lambda m, s: F.struct(s.cast("long").alias("s"), F.col("fp").bitwiseAND(m).alias("k2")))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("k2")))
    cut = marked.withColumn("x", F.explode(F.when(F.col("n").isNull(), whole).otherwise(finer))).select("t", "k", "x.s", "x.k2", "fp")
    large = cut.filter("s >= 0").groupBy("t", "k", "s", "k2").agg(F.count("*").alias("n")).filter(F.col("n") > TILE)
    dealt = spread_join(cut, large, ["t", "k", "s", "k2"], "n", n * len(tables) * (radius + 1)).withColumn("tiles", F.coalesce(F.ceil(F.col("n") / TILE).cast("long"), F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles"))).withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    names = ["t", "k", "s", "k2", "i", "j"]
    grouped = dealt.select(*names[:4], F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def run(batches):
        a, b = [], []
        for fp in _groups(batches, 6):
            fp = np.ascontiguousarray(fp)
            for i, j in forest(fp.view(np.uint64), radius):
                a.append(int(fp[i]))
                b.append(int(fp[j]))
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return grouped.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, with_root: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every row: its fingerprint and its component of near-duplicates.

    Returns ``id_col``, fingerprint (16 lower-case hex digits), component_id (the smallest id that
    can be reached over links of at most ``radius`` differing bits, itself included), and text_mark
    (a 64-bit hash that tells rows of one id apart), and the long columns ``carry`` of ``docs``; if asked
    for, also root (the component's smallest fingerprint, which names it where all its ids are null). Null and empty texts have
    fingerprint zero and link like any other; very long texts count whole. Rows with equal
    fingerprints are one node, so groups of copies and repeated rows cost no more than one text. Null
    ids have no part in the smallest id; an empty table gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    own = written(fingerprints(docs, id_col, text_col, width, carry), "fingerprints")
    total = own.count()
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root")), "roots")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(rooted, lowest, ["root"], "n", total).select("fp", "component_id", "root", "copies")
    found = spread_join(own, named, ["fp"], "copies", total)
    return found.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("mark").alias("text_mark"), *["root"] * with_root, *carry)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Near-duplicates by a similarity in place of a radius: see :mod:`.shingle_near`, which compares fingerprints by :func:`within`."""
    from .shingle_near import near_roots

    return near_roots(docs, id_col, text_col, least, width, carry)
