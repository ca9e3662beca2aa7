"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target of words; target over size is the rate at which its documents are
taken. The whole part of the rate is taken of each document, and the fractional part is a document's
inclusion probability. The cube method's flight moves these probabilities, three documents at a
time, along the null space of two constraints (the source's words and its documents), until each is
0 or 1 but for two at most. A source is dealt into blocks of bounded size by a hash, the flight runs
in each, and what is left over of all blocks meets in the next round; the rounds end when a
source's rest fits one block. The last flight spares a few documents of different sizes; these and
what it leaves are a small landing problem, solved by trying all its outcomes.

The draws come from a keyed hash of the documents, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of a source that one task holds in a round, about.
BLOCK = 4096
#: Documents of a source that its landing problem has, besides the two that the flight leaves.
LANDING = 12


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target for a table (source, size).

    Sources in order of code points, null last, have the weights in turn. ``share`` of all sizes is
    dealt by weight; no target is above ``most`` times its source's size, and the excess goes to
    the others by weight. With sources in order of cap over weight, the capped ones are a prefix;
    the first source whose share of what remains stays below its cap ends it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = by.withColumn("level", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("rate", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("none"), "source", F.col("level").alias("rate")))).over(every)["rate"])
    return by.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("rate") * F.col("weight"), F.col("cap"))).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move p towards 0 and 1, keeping sum(size * p) and sum(p), until at most two are between."""
    p = p.astype(float).copy()
    open_ = [k for k in range(len(p)) if 0 < p[k] < 1]
    s, q, u = size.tolist(), p.tolist(), draw.tolist()
    held: list[int] = []
    at = 0
    while True:
        while len(held) < 3 and at < len(open_):
            held.append(open_[at])
            at += 1
        same = next(((a, b) for i, a in enumerate(held) for b in held[i + 1 :] if s[a] == s[b]), None)
        if same:
            step = [(same[0], 1.0), (same[1], -1.0)]
        elif len(held) == 3:
            a, b, c = held
            scale = max(abs(s[b] - s[c]), abs(s[c] - s[a]), abs(s[a] - s[b]))
            step = [(a, (s[b] - s[c]) / scale), (b, (s[c] - s[a]) / scale), (c, (s[a] - s[b]) / scale)]
        else:
            break
        up = min((1 - q[k]) / d if d > 0 else q[k] / -d for k, d in step)
        down = min(q[k] / d if d > 0 else (1 - q[k]) / -d for k, d in step)
        move = up if u[step[0][0]] * (up + down) < down else -down
        for k, d in step:
            v = q[k] + move * d
            q[k] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        held = [k for k in held if 0 < q[k] < 1]
    return np.array(q)


def reserve(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Open places that the last flight leaves to the landing: ``LANDING`` of them, spread over the sizes."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(size[open_], kind="stable")]
    return open_[np.unique(np.linspace(0, len(open_) - 1, LANDING).astype(int))] if len(open_) else open_


def landing(size: np.ndarray, p: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """The 0/1 outcome for the open places that comes nearest to their expected words, then documents."""
    p = p.copy()
    if len(open_):
        outcome = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(float)
        words_off = np.abs(outcome @ size[open_] - (size[open_] * p[open_]).sum())
        docs_off = np.abs(outcome.sum(axis=1) - p[open_].sum())
        p[open_] = outcome[np.lexsort((docs_off, np.round(words_off)))[0]]
    return p


def _mover(last: bool):
    """One round's work on a block; the last round also lands."""

    def run(group: pa.Table) -> pa.Table:
        size, p, draw = (group.column(c).to_numpy() for c in ("size", "p", "draw"))
        order = np.lexsort((p, size, group.column("doc_id").fill_null(-1).to_numpy(), draw))
        u = ((draw[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53
        size, p = size[order].astype(float), p[order]
        if last:
            kept = reserve(size, p)
            free = np.setdiff1d(np.arange(len(p)), kept)
            q = p.copy()
            q[free] = flight(size[free], p[free], u[free])
            q = landing(size, q, np.flatnonzero((q > 0) & (q < 1)))
        else:
            q = flight(size, p, u)
        out = group.take(pa.array(order))
        return out.set_column(out.schema.get_field_index("p"), "p", pa.array(q))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each row is taken so that sources meet their targets.

    Returns ``id_col``, source, size, source_size, target, repeats, taken (size times repeats),
    text_mark (a 64-bit hash that tells rows of one id apart) and the long columns ``carry`` of
    ``docs`` for every row. Null and empty texts have size 0 and take nothing; very long texts are
    rows like any other; a null source is a source of its own; repeated rows are rows of their own,
    interchangeable ones; an empty table gives an empty result. Other columns are ignored.

    The whole part of a rate and the flight's inclusion probabilities are kept; of each source, up to
    ``LANDING`` + 2 documents are settled by the landing instead, which takes the outcome nearest to
    their expected words, so that their own probabilities aren't kept.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"), *carry)
    own = written(own, "sizes")
    goal = written(targets(own, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = F.broadcast(goal) if goal.count() <= 10_000 else goal
    rows = own.join(known, own["source"].eqNullSafe(known["source"])).select(
        "doc_id", "mark", own["source"], "size", "source_size", "target", F.floor(rate).cast("long").alias("base"), (rate - F.floor(rate)).alias("p"),
        F.ceil(F.col("n_docs") / BLOCK).cast("long").alias("blocks"), F.xxhash64(F.lit(seed), "doc_id", "mark", *carry).alias("draw"), *carry,
    )
    schema, settled = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), None
    state = rows.withColumn("p", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("p")))
    most_blocks = rows.agg(F.max("blocks")).first()[0] or 1
    while True:
        last = most_blocks <= 1
        block = F.pmod(F.xxhash64("draw", F.lit(most_blocks)), F.col("blocks")).alias("block")
        moved = written(state.groupBy("source", block).applyInArrow(_mover(last), schema), "flight")
        done = moved.filter("p = 0 or p = 1")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        # a block leaves two documents at most, so a source's rest shrinks to 2 / BLOCK in a round
        state = moved.filter("p > 0 and p < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 4 / BLOCK)).cast("long"))
        most_blocks = state.agg(F.max("blocks")).first()[0] or 1
    repeats = F.col("base") + F.col("p").cast("long")
    return settled.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), F.col("mark").alias("text_mark"), *carry)
