"""Column encoders and their inverses as DataFrame plans.

Order is a dense row number. Deltas and running sums are windows within blocks of rows; a block's
first value is joined to the last value of the block before it, over a summary with one row for
each block. That summary is itself cut into blocks of blocks, so that no window spans more rows
than a block has, but for one over a row for each ``BLOCK_ROWS ** 2`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import octets, varint_len

BLOCK_ROWS = 1 << 16
#: A code is one byte and the dictionary's size is stored in one, too.
ENUM_CODES, DICT_CODES = 255, 253


def _blocked(df: DataFrame, order: str, block_rows: int) -> DataFrame:
    return df.withColumn("wl_block", F.floor(F.col(order) / block_rows))


def previous(summary: DataFrame, block: str, value: str, out: str, over: int = BLOCK_ROWS) -> DataFrame:
    """(block, out): the value of the block before, over a row for each block."""
    rows = summary.select(block, value, F.floor(F.col(block) / over).alias("wl_super"))
    ends = rows.groupBy("wl_super").agg(F.max_by(value, block).alias("wl_last"))
    ends = ends.select("wl_super", F.lag("wl_last").over(Window.orderBy("wl_super")).alias("wl_from"))  # a row for each block of blocks
    within = F.lag(value).over(Window.partitionBy("wl_super").orderBy(block))
    first = F.row_number().over(Window.partitionBy("wl_super").orderBy(block)) == 1
    return rows.withColumn("wl_within", within).withColumn("wl_first", first).join(ends, "wl_super").select(block, F.when(F.col("wl_first"), F.col("wl_from")).otherwise(F.col("wl_within")).alias(out))


def sum_before(summary: DataFrame, block: str, value: str, out: str, over: int = BLOCK_ROWS) -> DataFrame:
    """(block, out): the sum of the values of all blocks before, over a row for each block."""
    rows = summary.select(block, value, F.floor(F.col(block) / over).alias("wl_super"))
    sums = rows.groupBy("wl_super").agg(F.sum(value).alias("wl_sum_of"))
    all_before = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("wl_super", all_before("wl_sum_of", Window.orderBy("wl_super")).alias("wl_from"))  # a row for each block of blocks
    return rows.withColumn("wl_within", all_before(value, Window.partitionBy("wl_super").orderBy(block))).join(sums, "wl_super").select(block, (F.col("wl_within") + F.col("wl_from")).alias(out))


def delta_encode(df: DataFrame, order: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds delta (the first row has its value) and varint_len."""
    rows = _blocked(df, order, block_rows)
    before = previous(rows.groupBy("wl_block").agg(F.max_by(value, order).alias("wl_end")), "wl_block", "wl_end", "wl_before")
    prev = F.coalesce(F.lag(value).over(Window.partitionBy("wl_block").orderBy(order)), "wl_before")
    out = rows.join(before, "wl_block").withColumn("delta", F.coalesce(F.col(value) - prev, F.col(value)))
    return out.withColumn("varint_len", varint_len(F.col("delta"))).drop("wl_block", "wl_before")


def delta_decode(df: DataFrame, order: str, delta: str = "delta", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds decoded, the running sum of the deltas."""
    rows = _blocked(df, order, block_rows)
    base = sum_before(rows.groupBy("wl_block").agg(F.sum(delta).alias("wl_sum")), "wl_block", "wl_sum", "wl_base")
    within = F.sum(delta).over(Window.partitionBy("wl_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(base, "wl_block").withColumn("decoded", (within + F.col("wl_base")).cast("long")).drop("wl_block", "wl_base")


def bitmap_pack(df: DataFrame, order: str, flag: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, byte_id, byte): flags of eight rows in a byte, lowest bit first."""
    rows = df.select(*keys, F.floor(F.col(order) / 8).alias("byte_id"), F.pmod(F.col(order), F.lit(8)).cast("int").alias("k"), flag.alias("f"))
    return rows.groupBy(*keys, "byte_id").agg(F.sum(F.when(F.col("f"), F.expr("shiftleft(1L, k)")).otherwise(F.lit(0))).alias("byte"))


def bitmap_unpack(packed: DataFrame, rows: int) -> DataFrame:
    """(row_id, flag) for the first ``rows`` places."""
    bits = packed.select("byte", (F.col("byte_id") * 8).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return bits.select((F.col("base") + F.col("k")).alias("row_id"), (F.expr("shiftright(byte, k)").bitwiseAND(F.lit(1)) == 1).alias("flag")).filter(F.col("row_id") < rows)


def dictionary(df: DataFrame, value: str, keys: tuple[str, ...] = (), cap: int | None = ENUM_CODES) -> DataFrame:
    """(keys, value, freq, code): the ``cap`` most frequent distinct values, ties by value; codes from 0; null has none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("freq"))
    w = Window.partitionBy(*keys).orderBy(F.desc("freq"), F.asc(value))
    out = counts.select(*keys, F.col(value).alias("value"), "freq", F.row_number().over(w).alias("wl_rank"))
    out = out.filter(F.col("wl_rank") <= cap) if cap else out  # known to the window, which then keeps that many rows only
    return out.select(*keys, "value", "freq", (F.col("wl_rank") - 1).alias("code"))


def dict_encode(df: DataFrame, value: str, codes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every row with code, null where its value has none, and literal, the value where that is so.

    Without keys a dictionary has ``ENUM_CODES`` entries at most, hence the broadcast. A null value has
    neither a code nor a literal, and null keys have no dictionary.
    """
    entries = codes.filter(F.col("code") < ENUM_CODES).select(*keys, F.col("value").alias(value), "code")
    out = df.join(F.broadcast(entries) if not keys else entries, [*keys, value], "left")
    return out.withColumn("literal", F.when(F.col("code").isNull(), F.col(value)))


def dict_decode(df: DataFrame, codes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The inverse of :func:`dict_encode`: every row with value."""
    entries = codes.filter(F.col("code") < ENUM_CODES).select(*keys, "code", "value")
    out = df.join(F.broadcast(entries) if not keys else entries, [*keys, "code"], "left")
    return out.withColumn("value", F.coalesce("value", "literal"))


def string_cost(long: DataFrame) -> DataFrame:
    """(col_id, raw_bytes, encoded_bytes): quoted tokens against the length-prefixed form."""
    n = octets(F.col("raw"))
    return long.filter("raw is not null").groupBy("col_id").agg(F.sum(n).alias("raw_bytes"), (F.sum(n + 2) + 4).alias("encoded_bytes"))


def quoting(long: DataFrame) -> DataFrame:
    """(col_id, mixed, all_unquoted, encoding) of string-like columns, nulls apart."""
    quoted = F.col("raw").rlike('(?s)^".*"$')
    per = long.filter("raw <> 'null'").groupBy("col_id").agg(F.bool_or(quoted).alias("some"), F.bool_and(quoted).alias("every"))
    per = per.select("col_id", (F.col("some") & ~F.col("every")).alias("mixed"), (~F.col("some")).alias("all_unquoted"))
    return per.withColumn("encoding", F.when(F.col("mixed") | F.col("all_unquoted"), "raw").otherwise("string"))


def dict_decision(long: DataFrame) -> DataFrame:
    """(col_id, n, cardinality, current_size, dict_total, should_dict) of the value dictionary."""
    size = octets(F.col("raw"))
    distinct = long.groupBy("col_id", "raw").agg(F.count("*").alias("c")).withColumn("b", size)
    per = distinct.groupBy("col_id").agg(F.sum("c").alias("n"), F.count("*").alias("cardinality"), F.sum(F.col("c") * F.col("b")).alias("text"), F.sum(F.col("b") + 4).alias("entries"))
    per = per.select("col_id", "n", "cardinality", (F.col("text") + F.col("n") - 1).alias("current_size"), (2 * F.col("n") - 1 + 1 + F.col("entries")).alias("dict_total"))
    small = F.col("current_size") > F.col("dict_total") + F.floor(F.col("current_size") / 10)
    return per.withColumn("should_dict", (F.col("cardinality") <= DICT_CODES) & small)
