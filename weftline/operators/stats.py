"""Statistics that sequential context models are built on, as aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stretch
from .tokens import strings


#: Characters that a task counts at once.
PIECE = 1 << 20


def _counter(back: tuple[int, ...], piece: int):
    """Texts to counts of (the characters ``back`` places before, the character), each within a text."""
    widest = max(back, default=0)

    def count(pieces: list[str]) -> pa.RecordBatch:
        symbols, coded = np.unique(np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
        size = np.array([len(p) for p in pieces], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(len(coded)) - np.repeat(begin, size)
        at = np.flatnonzero(at >= widest)
        parts, keys, base = [*back, 0], np.zeros(len(at), np.int64), max(1, len(symbols))
        # as many characters in a number as it holds; further ones are told apart by the numbers met so far
        room = 1
        for k in parts:
            if room > (1 << 62) // base:
                known, keys = np.unique(keys, return_inverse=True)
                room = max(1, len(known))
            keys, room = keys * base + coded[at - k], room * base
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        letters = np.array([chr(c) for c in symbols] or [""], object)
        chars = [letters[coded[at[first] - k]] for k in parts]
        ctx = ["".join(x) for x in zip(*chars[:-1], strict=True)] if back else [""] * len(n)
        return pa.RecordBatch.from_arrays([pa.array(ctx, pa.string()), pa.array(chars[-1], pa.string()), pa.array(n, pa.int64())], names=["ctx", "next", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k in range(0, len(text or ""), piece):
                    # a piece begins with the characters that its first contexts need
                    held.append(text[max(0, k - widest) : k + piece])
                    n += len(held[-1])
                    if n >= piece:
                        yield count(held)
                        held, n = [], 0
        if held:
            yield count(held)

    return run


def grams(df: DataFrame, back: tuple[int, ...], text: str = "text") -> DataFrame:
    """(ctx, next, n): each character with those ``back`` places before it, furthest first, within a text.

    One pass over the texts counts within each task; only distinct grams are exchanged.
    """
    return df.select(text).mapInArrow(_counter(back, PIECE), "ctx string, next string, n long").groupBy("ctx", "next").agg(F.sum("n").alias("n"))


def characters(df: DataFrame, text: str = "text") -> DataFrame:
    """(c, n): every character with its count."""
    return grams(df, (), text).select(F.col("next").alias("c"), "n")


def byte_values(df: DataFrame, text: str = "text") -> DataFrame:
    """(b, n): byte values of the UTF-8 form; bytes are taken from the distinct characters."""
    h = F.hex(F.encode("c", "UTF-8"))
    one = F.explode(F.sequence(F.lit(1), F.length(h), F.lit(2))).alias("at")
    return characters(df, text).select("n", h.alias("h"), one).select("n", F.conv(F.substring("h", F.col("at"), F.lit(2)), 16, 10).cast("int").alias("b")).groupBy("b").agg(F.sum("n").alias("n"))


def char_grams(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(ctx, next, n): each run of k characters with the character after it, within a text."""
    return grams(df, tuple(range(k, 0, -1)), text)


def skip_grams(df: DataFrame, text: str = "text", back: tuple[int, ...] = (2,)) -> DataFrame:
    """(c2, next, n): each character with the one two places before; for other gaps the context is named ``c`` and the gaps."""
    return grams(df, back, text).withColumnRenamed("ctx", "c" + "".join(map(str, back)))


def escapes(grams: DataFrame) -> DataFrame:
    """(contexts, symbols, singletons, total) of (ctx, next, n): what the escape of a back-off model is estimated from."""
    per = grams.groupBy("ctx").agg(F.count("*").alias("symbols"), F.count(F.when(F.col("n") == 1, 1)).alias("ones"), F.sum("n").alias("total"))
    return per.agg(F.count("*").alias("contexts"), F.sum("symbols").alias("symbols"), F.sum("ones").alias("singletons"), F.sum("total").alias("total"))


def matches(df: DataFrame, length: int, text: str = "text") -> DataFrame:
    """(distinct, repeated, positions): runs of ``length`` characters, those that occur again, and all their places."""
    grams = char_grams(df, length - 1, text)
    return grams.agg(F.count("*").alias("distinct"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("positions"))


def calibration(df: DataFrame, context: Column, hit: Column, bins: int = 33) -> DataFrame:
    """(bin, contexts, n, hits): how often a context's estimate, by bins of its stretch, comes true."""
    per = df.groupBy(context.alias("ctx")).agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))
    p = (F.col("hits") + 0.5) / (F.col("n") + 1.0)
    at = F.least(F.greatest(F.floor((stretch(p) + 8) * (bins - 1) / 16), F.lit(0)), F.lit(bins - 1)).cast("int")
    return per.groupBy(at.alias("bin")).agg(F.count("*").alias("contexts"), F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def json_states(df: DataFrame, text: str) -> DataFrame:
    """(state, n): characters of JSON texts inside keys, inside other strings, and outside strings."""
    every = strings(text)
    within = F.aggregate(F.transform(every, lambda t: F.length(t)), F.lit(0), lambda a, x: a + x)
    keys = F.aggregate(F.transform(F.filter(every, lambda t: t.endswith(":")), lambda t: F.length(t)), F.lit(0), lambda a, x: a + x)
    per = df.select(F.length(text).alias("all"), within.alias("within"), keys.alias("keys")).agg(F.sum("all").alias("all"), F.sum("within").alias("within"), F.sum("keys").alias("keys"))
    cells = F.array(F.struct(F.lit("key").alias("state"), F.col("keys").alias("n")), F.struct(F.lit("string").alias("state"), (F.col("within") - F.col("keys")).alias("n")), F.struct(F.lit("outside").alias("state"), (F.col("all") - F.col("within")).alias("n")))
    return per.select(F.explode(cells).alias("x")).select("x.state", "x.n")


def conditional_entropy(grams: DataFrame) -> DataFrame:
    """(contexts, entropy): bits per symbol given its context, of (ctx, next, n)."""
    totals = grams.groupBy("ctx").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return totals.agg(F.count("*").alias("contexts"), F.round((F.sum(F.col("m") * F.log2(F.col("m").cast("double"))) - F.sum("s")) / F.sum("m"), 6).alias("entropy"))


def modes(grams: DataFrame) -> DataFrame:
    """(ctx, next, n): the symbol most often seen after each context, ties to the smaller."""
    best = grams.groupBy("ctx").agg(F.min(F.struct((-F.col("n")).alias("m"), "next")).alias("x"))
    return best.select("ctx", "x.next", (-F.col("x.m")).alias("n"))


def word_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """(w1, w2, n): neighbouring lower-cased words within a text."""
    words = df.select(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 1)
    at = words.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i"))
    return at.select(F.get("w", F.col("i")).alias("w1"), F.get("w", F.col("i") + 1).alias("w2")).groupBy("w1", "w2").agg(F.count("*").alias("n"))


def run_lengths(df: DataFrame, order: str, value: Column, block_rows: int = 1 << 16) -> DataFrame:
    """(run_len, n): lengths of runs of equal values along the order.

    Runs are found within blocks; runs that touch a block's edge are joined with their neighbours
    over a summary of each block's edge runs, cut into blocks in the same way.
    """
    rows = df.select(F.col(order).alias("o"), value.alias("v"), F.floor(F.col(order) / block_rows).alias("b"))
    w = Window.partitionBy("b").orderBy("o")
    new = (~F.col("v").eqNullSafe(F.lag("v").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = rows.withColumn("new", new).withColumn("r", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("b", "r").agg(F.first("v").alias("v"), F.count("*").alias("len"))
    edge = Window.partitionBy("b")
    runs = runs.withColumn("inner", (F.col("r") > 1) & (F.col("r") < F.max("r").over(edge)))
    if block_rows <= 2:
        raise ValueError("a block has more than two rows")
    # of a block only its edge runs matter further: they are the rows of the next level, until one block holds all
    done = runs.filter("inner").select("len")
    rest = runs.filter("not inner").select("b", "r", "v", "len")
    size = block_rows
    while True:
        top = rest.agg(F.max("b")).first()[0]
        wide = Window.partitionBy("g").orderBy("b", "r")
        rest = rest.withColumn("g", F.floor(F.col("b") / size))
        rest = rest.withColumn("new", (~F.col("v").eqNullSafe(F.lag("v").over(wide)) | (F.lag("b").over(wide) == F.col("b")) | (F.row_number().over(wide) == 1)).cast("int"))
        rest = rest.withColumn("s", F.sum("new").over(wide.rowsBetween(Window.unboundedPreceding, 0)))
        rest = rest.groupBy("g", "s").agg(F.first("v").alias("v"), F.sum("len").alias("len"))
        if top is None or top < size:
            return done.unionByName(rest.select("len")).groupBy(F.col("len").alias("run_len")).agg(F.count("*").alias("n"))
        rest = rest.withColumn("inner", (F.col("s") > 1) & (F.col("s") < F.max("s").over(Window.partitionBy("g"))))
        done = done.unionByName(rest.filter("inner").select("len"))
        rest = rest.filter("not inner").select(F.col("g").alias("b"), F.col("s").alias("r"), "v", "len")
