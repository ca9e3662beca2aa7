"""Rows to templates and columns, and back, byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import dealt, with_groups
from .tokens import STRING, array_parts, key_list, key_of, object_parts, row_tokens, strings

#: Rows that a template needs to become a group: of lines, and of array elements.
MIN_ROWS, MIN_ELEMENTS = 5, 3
#: Elements that an array needs to be turned to columns.
MIN_ARRAY = 5
#: Keys that an interned key's number of two bytes can name.
MAX_INTERNED = 65535


def template_id(template: Column) -> Column:
    return F.sha2(F.array_join(template, "\x01"), 256)


def tokenised_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds template, vals and template_id; all null where a line is no object."""
    lines = dealt(lines, "row_id") if "row_id" in lines.columns and not lines.isStreaming else lines
    out = lines.withColumn("x", row_tokens(line)).select("*", "x.template", "x.vals").drop("x")
    return out.withColumn("template_id", template_id(F.col("template")))


def template_groups(rows: DataFrame, min_rows: int = MIN_ROWS, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, template_id, cols, rows, first_row, qualifies) of every template."""
    per = rows.filter("template is not null").groupBy(*keys, "template_id").agg(F.first(F.size("vals")).alias("cols"), F.count("*").alias("rows"), F.min("row_id").alias("first_row"))
    return per.withColumn("qualifies", F.col("rows") >= min_rows)


def ordered_groups(groups: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Qualifying groups with group_id, their place in the order of their first rows."""
    w = Window.partitionBy(*keys).orderBy("first_row")  # a row for each template of enough rows
    return groups.filter("qualifies").withColumn("group_id", F.row_number().over(w) - 1)


def strategy(rows: DataFrame, min_rows: int = MIN_ROWS, keys: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(keys, rows, templates, strategy): uniform if one template covers all rows, grouped if one has enough, else none."""
    groups = template_groups(rows, min_rows, keys).groupBy(*keys).agg(F.count("*").alias("templates"), F.sum("rows").alias("parsed"), F.bool_or("qualifies").alias("some"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    both = total.join(groups, list(keys), "left") if keys else total.join(groups, F.lit(True), "left")
    kind = F.when(F.col("rows") < least, "none").when((F.col("templates") == 1) & (F.col("parsed") == F.col("rows")) & F.col("some"), "uniform").when(F.col("some"), "grouped").otherwise("none")
    return both.select(*keys, "rows", F.coalesce("templates", F.lit(0)).alias("templates"), F.coalesce(kind, F.lit("none")).alias("strategy"))


def split_groups(rows: DataFrame, min_rows: int = MIN_ROWS, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows of templates with enough rows, residual rows)."""
    good = template_groups(rows, min_rows, keys).filter("qualifies").select(*keys, "template_id", "rows")
    both = with_groups(rows, good, [*keys, "template_id"], "rows")
    return both.filter("wl_in").drop("wl_in"), both.filter("not wl_in").drop("wl_in")


def columns_of(grouped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, template_id, row_id, col_id, raw): the columns of each group."""
    return grouped.select(*keys, "template_id", "row_id", F.posexplode("vals").alias("col_id", "raw"))


def rebuild(template: Column, values: Column) -> Column:
    """The line of a template and its values."""
    return F.array_join(F.flatten(F.zip_with(template, F.concat(values, F.array(F.lit(""))), lambda p, v: F.array(p, v))), "")


def reassemble(columns: DataFrame, templates: DataFrame, residual: DataFrame, line: str = "line", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row_id, line) from the columns of groups, their templates and the residual lines."""
    values = columns.groupBy(*keys, "template_id", "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "raw"))), lambda x: x["raw"]).alias("vals"))
    built = with_groups(values, templates, ["template_id"], "rows").filter("wl_in").select(*keys, "row_id", rebuild(F.col("template"), F.col("vals")).alias("line"))
    return built.unionByName(residual.select(*keys, "row_id", F.col(line).alias("line")))


def templates_of(grouped: DataFrame) -> DataFrame:
    """(template_id, template, rows), one row for each template."""
    return grouped.groupBy("template_id").agg(F.first("template").alias("template"), F.count("*").alias("rows"))


def taken_apart(df: DataFrame, token: str) -> DataFrame:
    """Adds parts (template, keys, vals) of object tokens, and literal, the token where there are none.

    Parts are null unless they give the token back byte by byte: for null, ``{}``, what is no object.
    """
    out = df.withColumn("wl_parts", object_parts(token))
    back = rebuild(F.col("wl_parts.template"), F.col("wl_parts.vals")).eqNullSafe(F.col(token)) & F.col(token).isNotNull()
    return out.withColumn("parts", F.when(back, F.col("wl_parts"))).withColumn("literal", F.when(~back, F.col(token))).drop("wl_parts")


def nested_cells(apart: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keys, pos, sub_key, value): the members that the objects of :func:`taken_apart` have, repeated keys too."""
    cells = apart.filter("parts is not null").select(*keys, F.posexplode(F.arrays_zip("parts.keys", "parts.vals")).alias("pos", "x"))
    return cells.select(*keys, "pos", F.col("x.keys").alias("sub_key"), F.col("x.vals").alias("value"))


def nested_shells(apart: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keys, template, literal): what rebuilding an object column needs beside its values."""
    return apart.select(*keys, F.col("parts.template").alias("template"), "literal")


def rebuild_objects(cells: DataFrame, shells: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keys, rebuilt): the inverse, for every row of ``shells``."""
    values = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vals"))
    return shells.join(values, list(keys), "left").select(*keys, F.when(F.col("template").isNotNull(), rebuild(F.col("template"), F.col("vals"))).otherwise(F.col("literal")).alias("rebuilt"))


def flatten_objects(df: DataFrame, row_id: str, token: str) -> DataFrame:
    """(row_id, sub_key, value, present): one level of an object column as sub-columns, one cell for each row and key.

    The sub-keys are all that occur; they are names, and stay in a table. A null row is null in every
    sub-column, which is not absent; of a repeated key the last value counts, and what is no object
    has no cells present. See :func:`nested_cells` for the form that keeps everything.
    """
    apart = taken_apart(df.select(F.col(row_id).alias("row_id"), F.col(token).alias("token")), "token")
    names = nested_cells(apart).select("sub_key").distinct().agg(F.array_sort(F.collect_list("sub_key")))
    rows = apart.select("row_id", "token", "parts", F.explode(names.scalar()).alias("sub_key"))
    at = F.array_position(F.reverse("parts.keys"), F.col("sub_key"))
    null_row = F.coalesce(F.col("token") == "null", F.lit(False))
    value = F.when(null_row, "null").when(at > 0, F.try_element_at(F.reverse("parts.vals"), F.when(at > 0, at).otherwise(1).cast("int")))
    return rows.select("row_id", "sub_key", value.alias("value"), (null_row | F.coalesce(at > 0, F.lit(False))).alias("present"))


def flattenable(columns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, template_id, col_id, rows) of the group columns whose tokens are objects or null, with an object among them."""
    begins = F.col("raw").startswith("{")
    per = columns.groupBy(*keys, "template_id", "col_id").agg(F.bool_and(begins | (F.col("raw") == "null")).alias("every"), F.bool_or(begins).alias("some"), F.count("*").alias("rows"))
    return per.filter("every and some").select(*keys, "template_id", "col_id", "rows")


def flatten_group(columns: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, shells, other columns) of the columns of groups, flattened within each group.

    Only columns with :func:`flattenable` tokens go through the tokeniser. One with a token that is
    empty or doesn't come back byte by byte is given up as a whole, and is among the other columns.
    """
    place = [*keys, "template_id", "col_id"]
    some = with_groups(columns, flattenable(columns, keys), place, "rows").filter("wl_in").drop("wl_in")
    apart = taken_apart(some, "raw")
    good = apart.groupBy(*place).agg(F.bool_and(F.col("parts").isNotNull() | (F.col("raw") == "null")).alias("ok"), F.count("*").alias("rows")).filter("ok").select(*place, "rows")
    flat = with_groups(apart, good, place, "rows").filter("wl_in").drop("wl_in")
    row = (*place, "row_id")
    return nested_cells(flat, row), nested_shells(flat, row), with_groups(columns, good, place, "rows").filter("not wl_in").drop("wl_in")


def unflatten_group(cells: DataFrame, shells: DataFrame, others: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns that :func:`flatten_group` was given."""
    row = (*keys, "template_id", "col_id", "row_id")
    return others.unionByName(rebuild_objects(cells, shells, row).withColumnRenamed("rebuilt", "raw").select(*others.columns))


def key_dictionary(df: DataFrame, text: str) -> DataFrame:
    """(key, freq, idx): the keys that occur more than once, by frequency, ties by key."""
    from .encode import dictionary

    keys = df.select(F.explode(key_list(text)).alias("key"))
    return dictionary(keys, "key", cap=MAX_INTERNED).filter("freq > 1").select(F.col("value").alias("key"), "freq", F.col("code").alias("idx"))


def intern_keys(df: DataFrame, text: str, keys: DataFrame, out: str = "interned") -> DataFrame:
    """Adds ``out``: the text with every key of the dictionary ``keys`` replaced by its number between two marks.

    A text with a mark of its own stays as it is; so does a key without a number. The dictionary has
    ``MAX_INTERNED`` keys at most and is one value of the plan.
    """
    number = keys.filter(F.col("idx") < MAX_INTERNED).agg(F.map_from_entries(F.collect_list(F.struct("key", "idx")))).scalar()
    known = df.withColumn("wl_number", number)
    swap = lambda t: F.coalesce(F.concat(F.lit("\x01"), F.try_element_at("wl_number", key_of(t)).cast("string"), F.lit("\x02"), F.regexp_extract(t, r'([ \t\r\n]*:)$', 1)), t)
    body = F.flatten(F.zip_with(F.split(F.col(text), STRING, -1), F.transform(strings(text), swap), lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    return known.withColumn(out, F.when(F.col(text).rlike("[\x01\x02]"), F.col(text)).otherwise(F.array_join(body, ""))).drop("wl_number")


def extern_keys(df: DataFrame, interned: str, keys: DataFrame, out: str = "text") -> DataFrame:
    """The inverse of :func:`intern_keys`: adds ``out``; a text without a whole marked number stays as it is."""
    name = keys.agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("string"), F.col("key"))))).scalar()
    known, mark = df.withColumn("wl_name", name), "\x01([0-9]+)\x02"
    numbers = F.regexp_extract_all(F.col(interned), F.lit(mark), F.lit(1))
    swap = lambda n: F.coalesce(F.concat(F.lit('"'), F.try_element_at("wl_name", n), F.lit('"')), F.concat(F.lit("\x01"), n, F.lit("\x02")))
    body = F.flatten(F.zip_with(F.split(F.col(interned), mark, -1), F.transform(numbers, swap), lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    return known.withColumn(out, F.array_join(body, "")).drop("wl_name")


def array_elements(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, elem_id, elem), (doc_id, prefix, separators, suffix)) of each largest object array."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), array_parts(text).alias("x")).filter("x.elements is not null")
    return rows.select("doc_id", F.posexplode("x.elements").alias("elem_id", "elem")), rows.select("doc_id", "x.prefix", "x.separators", "x.suffix")


def join_elements(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """(doc_id, text): the inverse of :func:`array_elements`."""
    per = elements.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("elem_id", "elem"))), lambda x: x["elem"]).alias("e"))
    body = F.array_join(F.flatten(F.zip_with("e", F.concat("separators", F.array(F.lit(""))), lambda e, s: F.array(e, s))), "")
    return per.join(frames, "doc_id").select("doc_id", F.concat("prefix", body, "suffix").alias("text"))


def tokenised_elements(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Elements (doc_id, row_id, elem, template, vals, template_id) of arrays of enough elements, and the arrays' shells.

    Arrays of fewer than ``MIN_ARRAY`` elements have neither: such texts stay whole.
    """
    elements, shells = array_elements(docs, doc_id, text)
    enough = F.size("separators") >= MIN_ARRAY - 1
    kept = shells.filter(enough)
    rows = elements.withColumnRenamed("elem_id", "row_id").join(kept.select("doc_id"), "doc_id", "left_semi")
    return tokenised_rows(rows, "elem"), kept


def array_to_columns(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, templates, residual elements) of :func:`tokenised_elements`' rows, each array on its own."""
    grouped, rest = split_groups(rows, MIN_ELEMENTS, ("doc_id",))
    return columns_of(grouped, ("doc_id",)), templates_of(grouped), rest


def columns_to_array(columns: DataFrame, templates: DataFrame, residual: DataFrame, shells: DataFrame) -> DataFrame:
    """(doc_id, text): the inverse of :func:`array_to_columns` and :func:`tokenised_elements`."""
    elements = reassemble(columns, templates, residual, "elem", ("doc_id",))
    return join_elements(elements.select("doc_id", F.col("row_id").alias("elem_id"), F.col("line").alias("elem")), shells)
