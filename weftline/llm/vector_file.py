"""Exact top-k search by inner product with a vector-approximation file.

Components are quantised to whole numbers, floor(scale * x). The rows are written once, in blocks:
the exact vectors to files of fixed-size records, and beside them the approximations, for which every
dimension of a block is cut into cells and a row keeps its cell numbers, eight bits a dimension or fewer.

Queries are taken in chunks of bounded size. A chunk scans the approximations only, all blocks in
parallel and without a shuffle, and gets a lower and an upper bound of each row's score. The k-th best
lower bound of a query, over all blocks, rules out all rows whose upper bound is below it. The rest
come sorted by upper bound, and exact vectors are read from the files in that order until no unread
bound reaches the k-th best exact score.

Rows with equal quantised vectors have equal scores, so of these only those with the k + 1 smallest
ids can be an answer (one may be the query's own); the others aren't written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join, written

#: Rows of a block, and queries of a chunk.
ROWS, QUERIES = 4096, 16384


def quantised(vectors: list[np.ndarray], dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) as whole numbers; short vectors are padded with zeros."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    out = np.floor(out * scale)
    if len(out) and np.abs(out).max(initial=0) >= 2**26:
        return np.array([[int(x) for x in row] for row in out], object).reshape(len(vectors), dims)
    return out.astype(np.int64)


class Approximations:
    """Cell numbers of a block's rows, and the middle and half width of every cell."""

    def __init__(self, rows: np.ndarray, bits: int = 8):
        n, dims = rows.shape
        cells, values = 1 << bits, rows.astype(float)
        cuts = np.quantile(values, np.linspace(0, 1, cells + 1)[1:-1], axis=0) if n else np.zeros((cells - 1, dims))
        self.cell = np.stack([np.searchsorted(cuts[:, d], values[:, d], side="right") for d in range(dims)], axis=1).astype(np.uint8) if dims else np.zeros((n, 0), np.uint8)
        low, high = np.full((dims, cells), np.inf), np.full((dims, cells), -np.inf)
        at = np.broadcast_to(np.arange(dims), (n, dims))
        np.minimum.at(low, (at, self.cell), values)
        np.maximum.at(high, (at, self.cell), values)
        used = low <= high
        self.middle, self.half = np.where(used, low / 2 + high / 2, 0.0), np.where(used, high / 2 - low / 2, 0.0)

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """The cells, two in a byte where four bits are enough, and the tables."""
        c = self.cell.ravel()
        if self.middle.shape[1] <= 16:
            c = np.append(c, np.zeros(len(c) % 2, np.uint8))
            c = c[::2] | c[1::2] << 4
        return c.tobytes(), self.middle.tobytes(), self.half.tobytes()

    @classmethod
    def unpack(cls, n: int, dims: int, cells: bytes, middle: bytes, half: bytes) -> Approximations:
        out = cls.__new__(cls)
        out.middle, out.half = (np.frombuffer(x).reshape(dims, -1) if dims else np.zeros((0, 1)) for x in (middle, half))
        c = np.frombuffer(cells, np.uint8)
        if out.middle.shape[1] <= 16:
            c = np.stack([c & 15, c >> 4], axis=1).ravel()[: n * dims]
        out.cell = c.reshape(n, dims)
        return out

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, queries by rows."""
        d = np.arange(self.cell.shape[1])
        middle, half = self.middle[d, self.cell], self.half[d, self.cell]
        q = queries.astype(float)
        centre, reach = q @ middle.T, np.abs(q) @ half.T
        reach = reach + 1e-12 * (np.abs(q) @ (np.abs(middle) + half).T) + 1e-6  # rounding, below 1 for usual sizes
        return centre - reach, centre + reach


def _open(uri: str, write: bool = False):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    if not write:
        return fs.open_input_file(path)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


_APPROX = "uri string, begin long, n int, dims int, ids binary, alone binary, cells binary, middle binary, half binary"


def _writer(folder: str, scale: float, bits: int):
    """Rows (id, v, alone) to blocks: exact vectors to a file of the task's own, approximations to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, begin = f"{folder}/{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.vectors", None, 0
        held: list[tuple[int, list[float], bool]] = []

        def block(rows: list[tuple[int, list[float], bool]]) -> pa.RecordBatch:
            nonlocal out, begin
            out = out or _open(uri, write=True)
            dims = max(len(v) for _, v, _ in rows)
            exact = np.zeros((len(rows), dims), "<f8")
            for k, (_, v, _) in enumerate(rows):
                exact[k, : len(v)] = v
            out.write(exact.tobytes())
            file = Approximations(quantised(list(exact), dims, scale), bits)
            cells, middle, half = file.pack()
            ids, alone = np.array([i for i, _, _ in rows], "<i8").tobytes(), np.array([a for _, _, a in rows], np.uint8).tobytes()
            row = [pa.array([uri]), pa.array([begin]), pa.array([len(rows)], pa.int32()), pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, alone, cells, middle, half))]
            begin += exact.nbytes
            return pa.RecordBatch.from_arrays(row, names=["uri", "begin", "n", "dims", "ids", "alone", "cells", "middle", "half"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= ROWS:
                yield block(held[:ROWS])
                held = held[ROWS:]
        if held:
            yield block(held)
        if out:
            out.close()

    return run


_FOUND = "q int, vec_id long, low double, high double, alone boolean, uri string, at long, dims int"


def _scanner(ids: np.ndarray, queries: np.ndarray, k: int):
    """Blocks of approximations to the rows that may be among a query's k best, as far as the task knows."""
    fields = ["q", "vec_id", "low", "high", "alone", "uri", "at", "dims"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), -np.inf)
        for batch in batches:
            for uri, begin, n, dims, row_ids, flags, cells, middle, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, own = Approximations.unpack(n, dims, cells, middle, half), np.frombuffer(row_ids, "<i8")
                alone = np.frombuffer(flags, np.uint8).astype(bool)
                wide = min(dims, queries.shape[1])
                file.cell, file.middle, file.half = file.cell[:, :wide], file.middle[:wide], file.half[:wide]
                for a in range(0, len(queries), 256):
                    z = min(a + 256, len(queries))
                    low, high = file.bounds(queries[a:z, :wide])
                    mine = own[None, :] == ids[a:z, None]
                    low[mine], high[mine] = -np.inf, -np.inf
                    known = np.concatenate([best[a:z], np.where(alone[None, :], low, -np.inf)], axis=1)
                    best[a:z] = np.partition(known, known.shape[1] - k, axis=1)[:, -k:]
                    q, r = np.nonzero((high >= best[a:z].min(axis=1)[:, None]) & ~mine)
                    if len(q):
                        columns = [pa.array((q + a).astype(np.int32)), pa.array(own[r]), pa.array(low[q, r]), pa.array(high[q, r]), pa.array(alone[r]), pa.array([uri]).take(pa.array(np.zeros(len(q), np.int32))), pa.array(begin + r * dims * 8), pa.array(np.full(len(q), dims, np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, names=fields)

    return run


def _reader(ids: np.ndarray, queries: np.ndarray, k: int, scale: float, step: int = 32):
    """Rows (q, high, vec_id, uri, at, dims), a query's together and from its highest bound down, to exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        state: dict = {"q": None, "best": {}, "todo": [], "over": False}
        out: list[tuple[int, int, int]] = []

        def vector(uri: str, at: int, dims: int) -> np.ndarray:
            if uri not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                files[uri] = _open(uri)
            return np.frombuffer(files[uri].read_at(dims * 8, at), "<f8")

        def certain(high: float) -> bool:
            return len(state["best"]) >= k and high < sorted(state["best"].values())[-k]

        def read() -> None:
            todo, state["todo"] = state["todo"], []
            if not todo:
                return
            mine = queries[state["q"]]
            dims = max(len(mine), max(d for *_, d in todo))
            rows = quantised([vector(u, at, d) for _, _, u, at, d in todo] + [np.zeros(dims)], dims, scale)[:-1]
            own = np.append(mine, np.zeros(dims - len(mine), mine.dtype))
            if rows.dtype == object or own.dtype == object or float(np.abs(own).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dims >= 2**62:
                rows, own = rows.astype(object), own.astype(object)
            for (_, vec_id, *_), s in zip(todo, rows @ own if dims else [0] * len(todo), strict=True):
                state["best"][vec_id] = max(int(s), state["best"].get(vec_id, int(s)))

        def close() -> None:
            if state["q"] is not None:
                read()
                query_id = int(ids[state["q"]])
                out.extend((query_id, i, min(max(s, -(2**63)), 2**63 - 1)) for i, s in sorted(state["best"].items(), key=lambda x: (-x[1], x[0]))[:k])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, high = row[0], row[1]
                if q != state["q"]:
                    close()
                    state.update(q=q, best={}, todo=[], over=False)
                if state["over"]:
                    continue
                state["todo"].append(row[1:])
                if len(state["todo"]) >= step:
                    read()
                    state["over"] = certain(high)
            if out:
                yield _scores(out)
                out.clear()
        close()
        for f in files.values():
            f.close()
        yield _scores(out)

    return run


def _scores(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _valid(df: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    x = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast("double")).alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < F.lit(float("inf"))))
    return x.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).dropDuplicates(["id", "v"])


def write_vectors(vectors: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 8) -> DataFrame:
    """Write the vector-approximation file for searches of up to ``k`` answers; one row for each block.

    ``bits`` is 8 at most. Four leave a third of all rows open on embeddings of 64 dimensions.
    """
    rows = _valid(vectors, scale, id_col, vector_col)
    exact = F.forall("v", lambda x: F.abs(x * scale) < 2.0**53)
    same = Window.partitionBy(F.when(exact, F.transform("v", lambda x: F.floor(x * scale))), F.when(~exact, F.col("v"))).orderBy("id")
    kept = written(rows.withColumn("turn", F.dense_rank().over(same)).filter(F.col("turn") <= k + 1).select("id", "v"), "vectors")
    several = kept.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    # an id with several vectors is one answer, and may not count for several when bounds are ranked
    flagged = kept.withColumn("alone", F.lit(True)) if several.isEmpty() else spread_join(kept, several, ["id"], "n", kept.count()).select("id", "v", F.col("n").isNull().alias("alone"))
    folder = scratch(vectors.sparkSession, "vector-files")
    file = written(flagged.mapInArrow(_writer(folder, scale, bits), _APPROX), "approximations")
    discard(kept)
    return file


def search(file: DataFrame, queries: DataFrame, k: int, scale: float, id_col: str, vector_col: str) -> list[DataFrame]:
    """Tables (query_id, vec_id, score) with the k best of each query vector, one table for each chunk of queries."""
    spark = file.sparkSession
    asked = _valid(queries, scale, id_col, vector_col)
    n = -(-asked.count() // QUERIES)
    asked = written(asked.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n)))), "queries")
    tasks, out = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    for chunk in range(n):  # each is one pass over the approximations
        rows = sorted((r["id"], tuple(r["v"])) for r in asked.filter(F.col("chunk") == chunk).select("id", "v").collect())
        if not rows:
            continue
        dims = max(len(v) for _, v in rows)
        ids, mine = np.array([i for i, _ in rows], np.int64), quantised([np.array(v) for _, v in rows], dims, scale)
        found = written(file.mapInArrow(_scanner(ids, mine.astype(float), k), _FOUND), "found")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
        least = found.filter("alone").withColumn("place", place).filter(F.col("place") <= k).groupBy("q").agg(F.when(F.count("*") == k, F.min("low")).alias("least"))
        rest = found.join(least, "q", "left").filter("least is null or high >= least").select("q", "high", "vec_id", "uri", "at", "dims")
        exact = rest.repartition(tasks, "q").sortWithinPartitions("q", F.desc("high")).mapInArrow(_reader(ids, mine, k, scale), "query_id long, vec_id long, score long")
        out.append(written(exact, "scores"))
        discard(found)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 8) -> DataFrame:
    """The k rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller id; a row is no answer
    to a query of its own id. Rows with a null id, a null vector, or null or non-finite components
    (also once scaled) take no part; vectors of unequal length count as padded with zeros; empty
    vectors score 0. An id that several rows have is one query and one answer, with the best score
    of its vectors, so no id is listed twice. Scores beyond 64 bits are held at its limits. Empty
    tables give an empty result. Other columns are ignored, whatever their names.
    """
    file = write_vectors(vectors, k, scale, id_col, vector_col, bits)
    tables = search(file, queries, k, scale, id_col, vector_col)
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score long"
    scores = spark.read.schema(schema).parquet(*[t._weftline_path for t in tables]) if tables else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
