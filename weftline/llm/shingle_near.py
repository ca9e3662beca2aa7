"""Near-duplicates by word shingles: rows whose shingle sets have a Jaccard similarity of ``least`` or more.

This is the SimHash operator's way to a similarity that no radius of its pigeonhole tables reaches alone: at
0.8 two fingerprints differ in 9.7 of 64 bits on average (deviation 2.9), so that a radius would have
to be about 24, whose blocks of two bits or three select nothing. It therefore takes two steps:

* the operator's own, at the radius ``SLICED``: the fingerprints within it are found bit-sliced in pigeonhole
  buckets (:func:`.simhash.links`), and each component of theirs is a bucket; what lies within the radius
  shares one;
* for pairs beyond it, ``BANDS`` tables keyed by ``ROWS`` minhashes each; two sets of similarity s meet in
  none of them with chance (1 - s ** ROWS) ** BANDS: 1.2e-7 at 0.8 and less above.

Within a bucket of either kind fingerprints are compared bit-sliced, and every link is checked on the two
sets themselves, so nothing below ``least`` is linked.

A bucket whose members are in one component already has nothing to add, so the work goes in rounds,
with components in between: the buckets by fingerprints, those of a few tables, then those of the others, each
bucket above ``TILE`` members in tiles by a hash, and at last all pairs of tiles of the large buckets that are still mixed.
A task that holds a group compares what isn't linked yet and sends the links it needs, never pairs.

Rows with equal shingle sets are one node, so copies cost no more than one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, spread_join, written
from .components import connected_components
from .simhash import links, majority, within

BANDS, ROWS = 40, 5
#: Tables of the first round by minhashes.
FIRST = 4
#: Differing bits up to which fingerprints meet by pigeonhole: eight blocks of eight bits, a table each (more blocks and tables where there are more texts).
SLICED = 7
#: Members of a group, about; groups of two tiles have twice as many.
TILE = 512
#: Shingle hashes that a task keeps at once, about.
HELD = 1 << 22
#: Five deviations above the mean at a similarity of 0.8.
RADIUS = 24
_A = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> bytes:
    """A text's words by single blanks; only A-Z are lowered, only ASCII space splits."""
    return b" ".join((text or "").encode().lower().split())


def shingles(joined: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    import xxhash

    if not joined:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(ends) - width + 1)
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(width, len(ends)) - 1 :].tolist(), strict=True)], np.uint64))


def minhashes(own: np.ndarray) -> np.ndarray:
    low = np.full(len(_A), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(own), 1 << 10):
        np.minimum(low, (own[None, k : k + (1 << 10)] * _A[:, None]).min(axis=1), out=low)
    return low


def _described(width: int, carry: tuple[str, ...]):
    names = ["doc_id", *carry, "node", "n", "fp", "keys", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        for batch in slices(batches):
            node, n, fp, keys, packed = [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                joined = words_of(text)
                own = shingles(joined, width)
                low = minhashes(own)
                node.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                n.append(len(own))
                fp.append(majority(own))
                keys.append(signed([xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)] if len(own) else []))
                packed.append(zip_.compress(joined))
            columns = [pa.array(signed(node)), pa.array(n, pa.int32()), pa.array(signed(fp)), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    return run


def _settled(least: float, width: int):
    """Rows (k, i, j, own, node, root, n, fp, packed), sorted by the first three, to links (a, b) that join components.

    Of a group of two tiles only pairs across them are compared.
    """

    def settle(group: list[tuple], out: list[tuple[int, int]]) -> None:
        import zstandard

        unzip, m = zstandard.ZstdDecompressor(), len(group)
        own, n, fp = (np.array([r[c] for r in group], np.int64) for c in (3, 6, 7))
        bits = fp.view(np.uint64)
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS if m <= 32 else np.unpackbits(within(bits, RADIUS).view(np.uint8), axis=1, bitorder="little")[:, :m].astype(bool)
        near &= np.minimum(n[:, None], n[None, :]) >= least * np.maximum(n[:, None], n[None, :])
        if group[0][1] != group[0][2]:
            near &= own[:, None] != own[None, :]
        label = np.unique([r[5] for r in group], return_inverse=True)[1]
        sets: dict[int, np.ndarray] = {}

        def of(k: int) -> np.ndarray:
            if k not in sets:
                if sum(map(len, sets.values())) + n[k] > HELD:
                    sets.clear()
                sets[k] = shingles(unzip.decompress(group[k][8]), width)
            return sets[k]

        for a in range(m - 1):
            for b in (np.flatnonzero(near[a, a + 1 :] & (label[a + 1 :] != label[a])) + a + 1).tolist():
                if label[a] == label[b]:
                    continue
                p, q = of(a), of(b)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= least * (len(p) + len(q) - both):
                    out.append((group[a][4], group[b][4]))
                    label[label == label[b]] = label[a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    settle(group, out)
                    group = []
                group.append(row)
            yield flush()
        if group:
            settle(group, out)
        yield flush()

    return run


def _links(members: DataFrame, texts: DataFrame, total: int, least: float, width: int, across: bool) -> DataFrame:
    """Links of members (k, node, root) of buckets with several roots: within tiles, or ``across`` pairs of tiles."""
    mixed = members.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).filter("x < y").select("k", "m")
    if across:
        mixed = mixed.filter(F.col("m") > TILE)
    held = spread_join(members, mixed, ["k"], "m", total).filter("m is not null").join(texts, "node")
    held = held.withColumn("tiles", F.ceil(F.col("m") / TILE).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    held = held.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")) if across else F.col("own"))
    if across:
        held = held.filter("own <> other")
    keys = ["k", "i", "j"]
    held = held.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n", "fp", "packed")
    return held.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_settled(least, width), "a long, b long")


def _pigeonholed(own: DataFrame, total: int) -> DataFrame:
    """Members (band -1, k, node): nodes whose fingerprints are joined by steps of at most ``SLICED`` bits have one k."""
    nodes = own.filter("n > 0").groupBy("node").agg(F.min("fp").alias("fp"))
    prints = written(nodes.groupBy("fp").agg(F.count("*").alias("copies")), "prints")
    roots = connected_components(links(prints.select("fp"), SLICED)).withColumnRenamed("node", "fp")
    named = prints.join(roots, "fp", "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"))
    found = spread_join(nodes, named, ["fp"], "copies", total)
    return found.select(F.lit(-1).alias("band"), F.xxhash64(F.lit(-1), "root").alias("k"), "node")


def near_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns ``carry`` of ``docs``, and root of every row; rows of one component share the root.

    Null and empty texts have no shingles and are one component; a text of fewer words than ``width``
    is one shingle; very long texts count whole; a null id is an id like any other; repeated rows are
    in one component; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    schema = "doc_id long, " + "".join(f"{c} long, " for c in carry) + "node long, n int, fp long, keys array<long>, packed binary"
    own = written(rows.mapInArrow(_described(width, carry), schema), "shingles")
    total = own.count()
    members = own.select(F.posexplode("keys").alias("band", "k"), "node").unionByName(_pigeonholed(own, total))
    buckets = members.groupBy("k").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("m")).filter("low < high").select("k", "m")
    shared = spread_join(members, buckets, ["k"], "m", (BANDS + 1) * total).filter("m is not null").select("band", "k", "node").distinct()
    shared = written(shared, "members")
    # one text for each node that any bucket shares; copies combine before the exchange
    texts = own.select("node", "n", "fp", "packed").dropDuplicates(["node"]).join(shared.select("node").distinct(), "node", "left_semi")
    texts = written(texts, "texts")
    large = shared.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    roots, edges = None, None
    for first, end, across in ((-1, 0, False), (0, FIRST, False), (FIRST, BANDS, False), (-1, BANDS, True)):
        if across and large <= TILE:
            break
        tables = shared.filter(F.col("band").between(first, end - 1))
        placed = tables.withColumn("root", F.col("node")) if roots is None else tables.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = written(_links(placed.select("k", "node", "root"), texts, (BANDS + 1) * total, least, width, across), "links")
        if roots is None or not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            roots = connected_components(edges)
    discard(shared, texts)
    copies = own.groupBy("node").agg(F.count("*").alias("copies"))
    named = roots.join(copies, "node")
    found = spread_join(own.select("doc_id", *carry, "node"), named, ["node"], "copies", total)
    return found.select("doc_id", *carry, F.coalesce("root", "node").alias("root"))
