"""The queries of the reference's operators, each with the SQL of an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import encode, planner, profile, reshape, stats, typed_block
from ..session import scratch, ship
from ..sources import frames, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rows in a frame or an encoder's block in these queries.
FRAME = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# Tokens of the tables' columns: kind of column, by table. Money has two places, so that its text is the same anywhere.
COLUMNS = {
    "events": ("event_id", {"event_id": "int", "ts": "ts", "user_id": "int", "event_type": "str", "value": "dec", "props": "json"}),
    "orders": ("o_orderkey", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "dec", "o_orderdate": "ts", "o_orderpriority": "str"}),
    "customer": ("c_custkey", {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "dec", "c_mktsegment": "str"}),
    "part": ("p_partkey", {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "dec"}),
    "lineitem": ("l_orderkey", {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "dec", "l_extendedprice": "dec", "l_discount": "dec", "l_tax": "dec", "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "ts"}),
}


def _token(name: str, kind: str) -> Column:
    c = F.col(name)
    return {"int": c.cast("string"), "dec": c.cast("decimal(18,2)").cast("string"), "str": F.concat(F.lit('"'), c, F.lit('"')), "ts": F.concat(F.lit('"'), S.iso_text(c), F.lit('"')), "json": c}[kind]


def _sql_token(name: str, kind: str) -> str:
    return {"int": f"CAST({name} AS VARCHAR)", "dec": f"CAST(CAST({name} AS DECIMAL(18,2)) AS VARCHAR)", "str": f"'\"' || {name} || '\"'", "ts": f"'\"' || strftime({name}, '%Y-%m-%dT%H:%M:%S.%f') || '\"'", "json": name}[kind]


def long_form(spark: SparkSession, d: str, name: str, nulls: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """The long form of a table; ``nulls`` makes every seventh row's user_id and every fifth's value null."""
    key, kinds = COLUMNS[name]
    tokens = {c: _token(c, k) for c, k in kinds.items() if not only or k in only}
    if nulls:
        for c, every in (("user_id", 7), ("value", 5)):
            tokens[c] = F.when(F.col(key) % every == 0, "null").otherwise(tokens[c])
    return profile.unpivot(tab(spark, d, name), key, tokens)


def long_sql(name: str, nulls: bool = False, only: tuple[str, ...] = ()) -> str:
    key, kinds = COLUMNS[name]
    parts = []
    for c, k in kinds.items():
        if only and k not in only:
            continue
        t = _sql_token(c, k)
        every = {"user_id": 7, "value": 5}.get(c) if nulls else None
        parts.append(f"SELECT {key} AS row_id, '{c}' AS col_id, {f'CASE WHEN {key} % {every} = 0 THEN ' + chr(39) + 'null' + chr(39) + f' ELSE {t} END' if every else t} AS raw FROM {name}")
    return " UNION ALL ".join(parts)


CLASSIFY_SQL = f"""CASE WHEN raw IS NULL OR raw = 'null' THEN 'null' WHEN raw IN ('true', 'false') THEN 'bool'
  WHEN regexp_matches(raw, '{S.INT}') AND TRY_CAST(raw AS BIGINT) BETWEEN {S.EPOCH[0]} AND {S.EPOCH[1]} THEN 'epoch_s'
  WHEN regexp_matches(raw, '{S.INT}') AND TRY_CAST(raw AS BIGINT) BETWEEN {S.EPOCH[0]}000 AND {S.EPOCH[1]}000 THEN 'epoch_ms'
  WHEN regexp_matches(raw, '{S.INT}') AND TRY_CAST(raw AS BIGINT) IS NOT NULL THEN 'int'
  WHEN regexp_matches(raw, '[.eE]') AND regexp_matches(raw, '{S.FLOAT}') THEN 'float'
  WHEN regexp_matches(raw, '{S.ISO}') THEN 'iso' WHEN regexp_matches(raw, '{S.UUID}') THEN 'uuid' ELSE 'text' END"""


def infer_sql(long: str, key: str = "col_id") -> str:
    return f"""WITH l AS ({long}), k AS (SELECT *, {CLASSIFY_SQL} AS v, CASE WHEN regexp_matches(raw, '{S.INT}') THEN TRY_CAST(raw AS BIGINT) END AS num FROM l),
p AS (SELECT {key}, count(*) AS total_count, count(*) FILTER (v = 'null') AS null_count, count(*) FILTER (v <> 'null') AS nn, count(DISTINCT raw) FILTER (v <> 'null') AS cardinality,
  min(num) AS lo, max(num) AS hi, count(*) FILTER (v = 'bool') AS b, count(*) FILTER (v = 'int') AS i, count(*) FILTER (v = 'float') AS f, count(*) FILTER (v = 'iso') AS iso,
  count(*) FILTER (v = 'epoch_s') AS es, count(*) FILTER (v = 'epoch_ms') AS em, count(*) FILTER (v = 'uuid') AS u, count(*) FILTER (v = 'text') AS t FROM k GROUP BY {key}),
q AS (SELECT *, CASE WHEN nn = 0 THEN 'Null' WHEN b = nn THEN 'Boolean' WHEN i = nn THEN 'Integer' WHEN i + f = nn THEN 'Float' WHEN iso = nn THEN 'Iso8601' WHEN es = nn THEN 'EpochSeconds'
  WHEN es + em = nn THEN 'EpochMillis' WHEN i + es + em = nn THEN 'Integer' WHEN u = nn THEN 'Uuid' WHEN t = nn AND cardinality <= 256 THEN 'Enum' ELSE 'String' END AS col_type FROM p)
SELECT {key}, col_type, null_count > 0 AS nullable, null_count, total_count, CASE WHEN col_type = 'Integer' THEN lo END AS min_val, CASE WHEN col_type = 'Integer' THEN hi END AS max_val, cardinality FROM q"""


# ---- detection and profiling


@query(r"""SELECT CASE WHEN NOT regexp_matches(text, '^[ \t\n\f\r]*[{\[]') THEN 'generic' WHEN len(l) >= 2 AND len(list_filter(l, lambda x: x[1] = '{')) > 0.8 * len(l) THEN 'ndjson' ELSE 'json' END AS format, count(*) AS n
FROM (SELECT text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\f\r]*', '')), lambda x: x <> '') AS l FROM documents) GROUP BY 1""")
def detect_format_documents(spark, d):
    return tab(spark, d, "documents").groupBy(lines.detect_format(F.col("text")).alias("format")).agg(F.count("*").alias("n"))


#: The events as lines of three shapes, a few of a rare shape, and one that is no object.
LINE_SQL = """SELECT event_id AS row_id, CASE WHEN event_id = 11 THEN 'not an object'
 WHEN event_id IN (7, 8, 9) THEN '{"event_id": ' || event_id || ', "x": ' || user_id || '}'
 WHEN event_id % 3 = 0 THEN '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ',"props":' || props || '}'
 WHEN event_id % 3 = 1 THEN '{"event_id":' || event_id || ', "event_type":"' || event_type || '","props":' || props || ' }'
 ELSE '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' END AS line FROM events"""


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    q, t = (lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])), (lambda c: F.col(c).cast("string"))
    e = F.col("event_id")
    line = (
        F.when(e == 11, "not an object").when(e.isin(7, 8, 9), q('{"event_id": ', t("event_id"), ', "x": ', t("user_id"), "}"))
        .when(e % 3 == 0, q('{"event_id":', t("event_id"), ',"ts":"', S.iso_text(F.col("ts")), '","user_id":', t("user_id"), ',"event_type":"', t("event_type"), '","value":', F.col("value").cast("decimal(18,2)").cast("string"), ',"props":', t("props"), "}"))
        .when(e % 3 == 1, q('{"event_id":', t("event_id"), ', "event_type":"', t("event_type"), '","props":', t("props"), " }"))
        .otherwise(q('{"event_id":', t("event_id"), ',"user_id":', t("user_id"), ',"event_type":"', t("event_type"), '"}'))
    )
    return tab(spark, d, "events").select(e.alias("row_id"), line.alias("line"))


@query(f"WITH l AS ({LINE_SQL}) SELECT row_id // {FRAME} AS frame_id, count(*) AS lines, count(*) FILTER (line[1] = '{{') AS json_lines, CASE WHEN arg_min(line[1], row_id) NOT IN ('{{', '[') THEN 'generic' WHEN count(*) >= 2 AND count(*) FILTER (line[1] = '{{') > 0.8 * count(*) THEN 'ndjson' ELSE 'json' END AS format FROM l GROUP BY 1")
def detect_format_frames(spark, d):
    return lines.detect_by_line(event_lines(spark, d).withColumn("frame_id", F.floor(F.col("row_id") / FRAME)), "frame_id")


@query("SELECT lower(regexp_extract(url, '[.]([^./]+)$', 1)) = 'json' AS is_json, count(*) AS n FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'a/' || page_id || '.JSON' ELSE 'b.x/' || page_id END AS url FROM pages) GROUP BY 1")
def detect_extension(spark, d):
    p = tab(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a/"), "page_id", F.lit(".JSON"))).otherwise(F.concat(F.lit("b.x/"), "page_id")).alias("url"))
    return p.groupBy(F.coalesce(lines.detect_by_name(F.col("url")) == "json", F.lit(False)).alias("is_json")).agg(F.count("*").alias("n"))


@query(f"SELECT col_id, {CLASSIFY_SQL} AS vtype, count(*) AS n FROM ({long_sql('events', True)}) GROUP BY 1, 2")
def classify_values_events(spark, d):
    return profile.token_counts(long_form(spark, d, "events", True)).groupBy("col_id", "vtype").agg(F.sum("n").alias("n"))


def _infer(name: str) -> None:
    def f(spark, d):
        schema = profile.infer_schema(long_form(spark, d, name, name == "events"))
        return schema.withColumns({c: F.col(c).cast("string") for c in ("min_val", "max_val")})  # nullable numbers as text

    f.__name__ = f"infer_schema_{name}"
    query(f"SELECT * REPLACE (CAST(min_val AS VARCHAR) AS min_val, CAST(max_val AS VARCHAR) AS max_val) FROM ({infer_sql(long_sql(name, name == 'events'))})")(f)


for _name in COLUMNS:
    _infer(_name)

#: Cases of the type rules: tokens of a column each.
EDGE = {
    "demoted": ["1", "1500000000"], "seconds": ["1500000000", "946684800"], "millis_mix": ["1500000000", "1500000000123"], "overflow": ["9223372036854775808", "1"],
    "epoch_float": ["1500000000", "1.5"], "iso_text": ['"2020-01-01T00:00:00Z"', '"x"'], "iso": ['"2020-01-01T00:00:00.123+02:00"', "null"], "bool": ["true", "false", "null"], "bool_case": ["True", "false"],
    "all_null": ["null", "null"], "int_float": ["1", "-2.5e3"], "uuid": ['"123e4567-e89b-12d3-a456-426614174000"'], "uuid_text": ['"123e4567-e89b-12d3-a456-426614174000"', '"x"'], "enum": ['"a"', '"b"', '"a"'],
    "objects": ['{"a":1}', "[1]"], "negative": ["-5", "-1500000000"], "minus_zero": ["-0", "0"], "bare_e": ["e", "1"], "point": [".5", "5."],
}
_EDGE_ROWS = [(k, t) for k, ts in EDGE.items() for t in ts]


@query(f"SELECT case_id, col_type FROM ({infer_sql('SELECT * FROM (VALUES ' + ', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{t}{chr(39)})' for k, t in _EDGE_ROWS) + ') v(case_id, raw)', 'case_id')})")
def infer_rules_edge(spark, d):
    return profile.infer_schema(spark.createDataFrame(_EDGE_ROWS, "case_id string, raw string"), ("case_id",)).select("case_id", "col_type")


@query(f"SELECT col_id, count(*) FILTER (raw = 'null') AS nulls, count(*) FILTER (raw <> 'null') AS present FROM ({long_sql('events', True)}) GROUP BY 1")
def null_profile_events(spark, d):
    n = F.col("raw") == "null"
    return long_form(spark, d, "events", True).groupBy("col_id").agg(F.count(F.when(n, 1)).alias("nulls"), F.count(F.when(~n, 1)).alias("present"))


# ---- integers, bitmaps, nulls

VARINT_SQL = "CASE " + " ".join(f"WHEN delta BETWEEN {-(1 << (7 * k - 1))} AND {(1 << (7 * k - 1)) - 1} THEN {k}" for k in range(1, 10)) + " ELSE 10 END"


@query(f"SELECT o_orderkey, delta, CAST({VARINT_SQL} AS INTEGER) AS varint_len FROM (SELECT o_orderkey, o_custkey - lag(o_custkey, 1, 0) OVER (ORDER BY o_orderkey) AS delta FROM orders)")
def delta_encode_orders(spark, d):
    return encode.delta_encode(tab(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 4096).drop("o_custkey")


@query("SELECT o_orderkey, o_custkey AS decoded FROM orders")
def delta_decode_orders(spark, d):
    coded = encode.delta_encode(tab(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 4096).select("o_orderkey", "delta")
    return encode.delta_decode(coded, "o_orderkey", block_rows=4096).select("o_orderkey", "decoded")


_INTS = (("orders", "o_orderkey", ("o_orderkey", "o_custkey")), ("events", "event_id", ("event_id", "user_id")), ("part", "p_partkey", ("p_partkey", "p_size")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS col_id, CAST(sum({VARINT_SQL}) AS BIGINT) AS bytes FROM (SELECT CAST({c} AS BIGINT) - lag(CAST({c} AS BIGINT), 1, 0) OVER (ORDER BY {k}) AS delta FROM {t})" for t, k, cs in _INTS for c in cs))
def varint_cost_by_column(spark, d):
    out = None
    for t, key, cols in _INTS:
        for c in cols:
            rows = tab(spark, d, t).select(F.col(key).alias("k"), F.col(c).cast("long").alias("v"))
            one = encode.delta_encode(rows, "k", "v").agg(F.sum(F.col("varint_len").cast("long")).alias("bytes")).select(F.lit(c).alias("col_id"), "bytes")
            out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, CASE WHEN user_id >= 50 THEN 2 * (user_id - 50) ELSE 2 * (50 - user_id) - 1 END AS z, user_id - 50 AS back FROM events")
def zigzag_events(spark, d):
    v = F.col("user_id") - 50
    return tab(spark, d, "events").select("user_id", S.zigzag(v).alias("z"), S.unzigzag(S.zigzag(v)).alias("back"))


@query("SELECT o_orderkey // 8 AS byte_id, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 << (o_orderkey % 8)::INT ELSE 0 END) AS BIGINT) AS byte FROM orders GROUP BY 1")
def bitmap_pack_orders(spark, d):
    return encode.bitmap_pack(tab(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F")


@query("SELECT o_orderkey AS row_id, o_orderstatus = 'F' AS flag FROM orders")
def bitmap_unpack_orders(spark, d):
    o = tab(spark, d, "orders")
    return encode.bitmap_unpack(encode.bitmap_pack(o, "o_orderkey", F.col("o_orderstatus") == "F"), o.count())


@query(f"SELECT col_id, row_id // 8 AS byte_id, CAST(sum(CASE WHEN raw <> 'null' THEN 1 << (row_id % 8)::INT ELSE 0 END) AS BIGINT) AS byte, count(*) FILTER (raw <> 'null') AS present FROM ({long_sql('events', True)}) WHERE col_id IN ('user_id', 'value') GROUP BY 1, 2")
def null_bitmap_split(spark, d):
    rows = long_form(spark, d, "events", True).filter(F.col("col_id").isin("user_id", "value"))
    packed = encode.bitmap_pack(rows, "row_id", F.col("raw") != "null", ("col_id",))
    return packed.withColumn("present", F.bit_count("byte").cast("long"))


@query(f"SELECT row_id, raw AS value FROM ({long_sql('events', True)}) WHERE col_id = 'user_id'")
def null_interleave(spark, d):
    return null_roundtrip(long_form(spark, d, "events", True).filter("col_id = 'user_id'"))


def null_roundtrip(rows: DataFrame, block_rows: int = 4096) -> DataFrame:
    """(row_id, value): values stored without nulls, ranked within blocks, and set back by the bitmap's ranks."""
    from pyspark.sql import Window

    w = Window.partitionBy("b").orderBy("row_id")
    flagged = rows.select("row_id", F.floor(F.col("row_id") / block_rows).alias("b"), "raw", (F.col("raw") != "null").alias("p"))
    dense = flagged.filter("p").select("b", F.row_number().over(w).alias("r"), F.col("raw").alias("value"))
    places = flagged.select("row_id", "b", "p", F.sum(F.col("p").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r"))
    return places.join(dense, ["b", "r"], "left").select("row_id", F.when(F.col("p"), F.col("value")).otherwise("null").alias("value"))


# ---- timestamps, dictionaries, strings, uuids


@query(f"SELECT event_id, us, delta, CAST({VARINT_SQL} AS INTEGER) AS varint_len FROM (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts), 1, 0) OVER (ORDER BY event_id) AS delta FROM events)")
def ts_delta_events(spark, d):
    return encode.delta_encode(tab(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "event_id", "us", 4096)


@query("SELECT event_id, '\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z\"' AS rebuilt FROM events")
def ts_roundtrip_events(spark, d):
    rows = tab(spark, d, "events").select("event_id", F.concat(F.lit('"'), S.iso_text(F.col("ts")), F.lit('Z"')).alias("raw"))
    return rows.select("event_id", S.iso_from_parts(*S.iso_parts(F.col("raw"))).alias("rebuilt"))


_STAMPS = [("a", '"2020-01-01T00:00:00Z"'), ("a", '"2020-01-01T00:00:01Z"'), ("b", '"2020-01-01T00:00:00.123+02:00"'), ("b", '"2020-01-01T00:00:00.12+02:00"'), ("c", '"2020-01-01T00:00:00"'), ("c", '"2020-01-01T05:00:00-05:30"'), ("d", '"2020-01-01T05:00:00.5-05:30"')]


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _STAMPS)}) v(col_id, raw)), s AS (SELECT *, regexp_extract(raw, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})?"$', 1) AS z FROM v),
p AS (SELECT col_id, CASE z WHEN '' THEN 'none' WHEN 'Z' THEN 'zulu' ELSE 'offset' END AS fmt, CASE WHEN z IN ('', 'Z') THEN 0 ELSE CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (CAST(z[2:3] AS INT) * 60 + CAST(z[5:6] AS INT)) END AS tz_min, length(regexp_extract(raw, '[.]([0-9]+)', 1)) AS frac_digits FROM s)
SELECT col_id, fmt, CAST(tz_min AS INTEGER) AS tz_min, CAST(frac_digits AS INTEGER) AS frac_digits, count(*) AS n, count(*) OVER (PARTITION BY col_id) = 1 AND max(frac_digits) <= 6 AS eligible FROM p GROUP BY col_id, fmt, tz_min, frac_digits""")
def ts_format_uniform(spark, d):
    from pyspark.sql import Window

    style, offset, digits, _ = S.iso_parts(F.col("raw"))
    per = spark.createDataFrame(_STAMPS, "col_id string, raw string").groupBy("col_id", style.alias("fmt"), offset.alias("tz_min"), digits.alias("frac_digits")).agg(F.count("*").alias("n"))
    return per.withColumn("eligible", (F.count("*").over(Window.partitionBy("col_id")) == 1) & (F.col("frac_digits") <= 6))


def _dict_sql(source: str, cols: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col_id, {c} AS value, count(*) AS freq, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS INTEGER) AS code FROM {source} GROUP BY {c}" for c in cols)


def _dicts(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_id"), F.col(c).alias("v")) for c in cols])).alias("x")).select("x.col_id", "x.v")
    return encode.dictionary(long, "v", ("col_id",))


@query(_dict_sql("events", ("event_type",)))
def enum_dict_events(spark, d):
    return _dicts(tab(spark, d, "events"), ("event_type",))


@query(_dict_sql("part", ("p_brand", "p_type")))
def enum_dict_parts(spark, d):
    return _dicts(tab(spark, d, "part"), ("p_brand", "p_type"))


@query("WITH k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS INTEGER) AS code FROM events GROUP BY 1) SELECT event_id, code FROM events JOIN k USING (event_type)")
def enum_encode_events(spark, d):
    e = tab(spark, d, "events").select("event_id", "event_type")
    return encode.dict_encode(e, "event_type", encode.dictionary(e, "event_type")).select("event_id", "code")


@query("SELECT event_id, event_type AS value FROM events")
def enum_decode_events(spark, d):
    e = tab(spark, d, "events").select("event_id", "event_type")
    codes = encode.dictionary(e, "event_type")
    return encode.dict_decode(encode.dict_encode(e, "event_type", codes).select("event_id", "code", "literal"), codes).select("event_id", "value")


_STRINGS = (("customer", ("c_name", "c_mktsegment")), ("part", ("p_name", "p_brand", "p_type")), ("documents", ("text", "lang", "source")))


def _strings(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, cols in _STRINGS:
        one = profile.unpivot(tab(spark, d, t).withColumn("r", F.lit(0)), "r", {c: F.concat(F.lit('"'), F.col(c), F.lit('"')) for c in cols})
        out = one if out is None else out.unionByName(one)
    return out


_STRINGS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS col_id, '\"' || {c} || '\"' AS raw FROM {t}" for t, cs in _STRINGS for c in cs)


@query(f"SELECT col_id, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS raw_bytes, CAST(sum(octet_length(encode(raw)) + 2) + 4 AS BIGINT) AS encoded_bytes FROM ({_STRINGS_SQL}) GROUP BY 1")
def string_cost_by_column(spark, d):
    return encode.string_cost(_strings(spark, d))


_UUID_SQL = "'\"' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '\"'"


@query(f"SELECT event_id, h AS packed_hex, {_UUID_SQL} AS unpacked FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events)")
def uuid_pack(spark, d):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    packed = S.uuid_pack(S.uuid_unpack(F.unhex(h)))
    return tab(spark, d, "events").select("event_id", F.lower(F.hex(packed)).alias("packed_hex"), S.uuid_unpack(packed).alias("unpacked"))


_QUOTES = [("a", '"x"'), ("a", '"y"'), ("b", '"x"'), ("b", "[1]"), ("c", "[1]"), ("c", '{"k":2}'), ("d", '"x"'), ("d", "null")]


@query(f"WITH v AS (SELECT col_id, raw LIKE '\"%\"' AS q FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in _QUOTES)}) v(col_id, raw) WHERE raw <> 'null') SELECT col_id, bool_or(q) AND NOT bool_and(q) AS mixed, NOT bool_or(q) AS all_unquoted, CASE WHEN bool_and(q) THEN 'string' ELSE 'raw' END AS encoding FROM v GROUP BY 1")
def quoting_guard(spark, d):
    return encode.quoting(spark.createDataFrame(_QUOTES, "col_id string, raw string"))


#: Every string column of the tables.
_EVERY = (*((t, c) for t, cs in _STRINGS for c in cs), ("supplier", "s_name"), ("nation", "n_name"), ("region", "r_name"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("lineitem", "l_returnflag"),
          ("lineitem", "l_linestatus"), ("events", "event_type"), ("events", "props"), ("pages", "url"), ("pages", "html"), ("benchmark", "text"), ("conversations", "role"), ("conversations", "text"))
_EVERY_SQL = " UNION ALL ".join(f"SELECT '{t}.{c}' AS col_id, '\"' || {c} || '\"' AS raw FROM {t}" for t, c in _EVERY)


def _every_string(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in dict.fromkeys(t for t, _ in _EVERY):
        cells = {f"{t}.{c}": F.concat(F.lit('"'), F.col(c), F.lit('"')) for u, c in _EVERY if u == t}
        one = profile.unpivot(tab(spark, d, t).withColumn("r", F.lit(0)), "r", cells)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH c AS (SELECT col_id, raw, count(*) AS c, octet_length(encode(raw)) AS b FROM ({_EVERY_SQL}) GROUP BY ALL), p AS (SELECT col_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS cardinality, CAST(sum(c * b) + sum(c) - 1 AS BIGINT) AS current_size, CAST(2 * sum(c) + sum(b + 4) AS BIGINT) AS dict_total FROM c GROUP BY 1)
SELECT *, cardinality <= 253 AND current_size > dict_total + current_size // 10 AS should_dict FROM p""")
def value_dict_decision(spark, d):
    return encode.dict_decision(_every_string(spark, d))


_NAMES = (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("part", "p_partkey", "p_type"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, key, c in _NAMES:
        one = tab(spark, d, t).select(F.lit(c).alias("col_id"), F.col(key).cast("long").alias("row_id"), F.col(c).alias("raw"))
        out = one if out is None else out.unionByName(one)
    return out


_NAMES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS col_id, CAST({k} AS BIGINT) AS row_id, {c} AS raw FROM {t}" for t, k, c in _NAMES)


@query(f"WITH v AS ({_NAMES_SQL}), k AS (SELECT col_id, raw, CAST(row_number() OVER (PARTITION BY col_id ORDER BY count(*) DESC, raw) - 1 AS INTEGER) AS code FROM v GROUP BY 1, 2) SELECT col_id, row_id, code FROM v JOIN k USING (col_id, raw)")
def value_dict_encode(spark, d):
    v = _names(spark, d)
    return encode.dict_encode(v, "raw", encode.dictionary(v, "raw", ("col_id",), encode.DICT_CODES), ("col_id",)).select("col_id", "row_id", "code")


#: Names with far more values than codes, and some without a value.
_CLERKS_SQL = "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'c' || (c_custkey % 40) ELSE c_name END AS v FROM customer"


def _clerks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return tab(spark, d, "customer").select(k.alias("row_id"), F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat(F.lit("c"), (k % 40).cast("string"))).otherwise(F.col("c_name")).alias("v"))


@query(f"WITH v AS ({_CLERKS_SQL}), k AS (SELECT v, CAST(row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS INTEGER) AS code FROM v WHERE v IS NOT NULL GROUP BY 1) SELECT row_id, CASE WHEN code < 255 THEN code END AS code, CASE WHEN code >= 255 THEN v.v END AS literal FROM v LEFT JOIN k ON v.v = k.v")
def enum_overflow_encode(spark, d):
    v = _clerks(spark, d)
    return encode.dict_encode(v, "v", encode.dictionary(v, "v")).select("row_id", "code", "literal")


@query(f"SELECT row_id, v AS value FROM ({_CLERKS_SQL})")
def enum_overflow_decode(spark, d):
    v = _clerks(spark, d)
    codes = encode.dictionary(v, "v")
    return encode.dict_decode(encode.dict_encode(v, "v", codes).select("row_id", "code", "literal"), codes).select("row_id", "value")


@query(f"""WITH v AS ({_STRINGS_SQL}), c AS (SELECT col_id, raw, count(*) AS c, octet_length(encode(raw)) AS b FROM v GROUP BY ALL), p AS (SELECT col_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, sum(c * b) + sum(c) - 1 AS cur, 2 * sum(c) + sum(b + 4) AS dict FROM c GROUP BY 1),
f AS (SELECT col_id FROM p WHERE k <= 253 AND cur > dict + cur // 10), r AS (SELECT col_id, raw, c, row_number() OVER (PARTITION BY col_id ORDER BY c DESC, raw) - 1 AS code FROM c)
SELECT col_id, CAST(CASE WHEN f.col_id IS NOT NULL THEN code END AS INTEGER) AS code, CAST(sum(c) AS BIGINT) AS n FROM r LEFT JOIN f USING (col_id) GROUP BY 1, 2""")
def value_dict_applied(spark, d):
    """Codes of the columns that the decision takes; all others stay literal."""
    v = _strings(spark, d).select("col_id", "raw")
    good = encode.dict_decision(v).filter("should_dict").select("col_id")
    codes = encode.dictionary(v, "raw", ("col_id",), encode.DICT_CODES).join(good, "col_id", "left_semi")
    return encode.dict_encode(v, "raw", codes, ("col_id",)).groupBy("col_id", "code").agg(F.count("*").alias("n"))


@query(f"SELECT col_id, row_id, raw AS value FROM ({_NAMES_SQL})")
def value_dict_decode(spark, d):
    v = _names(spark, d)
    codes = encode.dictionary(v, "raw", ("col_id",), encode.DICT_CODES)
    coded = encode.dict_encode(v, "raw", codes, ("col_id",)).select("col_id", "row_id", "code", "literal")
    return encode.dict_decode(coded, codes, ("col_id",)).select("col_id", "row_id", "value")


# ---- reshaping


@query(long_sql("events"))
def unpivot_events(spark, d):
    return long_form(spark, d, "events")


@query("SELECT event_id AS row_id, " + ", ".join(f"{_sql_token(c, k)} AS {c}" for c, k in COLUMNS["events"][1].items()) + " FROM events")
def pivot_events(spark, d):
    return profile.pivot(long_form(spark, d, "events"), list(COLUMNS["events"][1]))


#: The template of each shape of event line, its parts joined by \x01, and its number of values.
_SHAPES = {
    "rare": (['{"event_id": ', ', "x": ', "}"], "event_id IN (7, 8, 9)"),
    "full": (['{"event_id":', ',"ts":', ',"user_id":', ',"event_type":', ',"value":', ',"props":', "}"], "event_id % 3 = 0 AND event_id NOT IN (7, 8, 9)"),
    "some": (['{"event_id":', ', "event_type":', ',"props":', " }"], "event_id % 3 = 1 AND event_id NOT IN (7, 8, 9)"),
    "few": (['{"event_id":', ',"user_id":', ',"event_type":', "}"], "event_id % 3 = 2 AND event_id NOT IN (7, 8, 9, 11)"),
}


@query(" UNION ALL ".join(f"SELECT sha256({' || chr(1) || '.join(chr(39) + p + chr(39) for p in parts)}) AS template_id, {len(parts) - 1} AS cols, count(*) AS rows, min(event_id) AS first_row, count(*) >= 5 AS qualifies FROM events WHERE {where} HAVING count(*) > 0" for parts, where in _SHAPES.values()))
def template_groups(spark, d):
    return reshape.template_groups(reshape.tokenised_rows(event_lines(spark, d)))


@query("SELECT event_id AS row_id FROM events WHERE event_id IN (7, 8, 9, 11)")
def residual_rows(spark, d):
    return reshape.split_groups(reshape.tokenised_rows(event_lines(spark, d)))[1].select("row_id")


@query(f"SELECT row_id, md5(line) AS line_md5 FROM ({LINE_SQL})")
def reassemble_rows(spark, d):
    rows = reshape.tokenised_rows(event_lines(spark, d)).persist()  # read four times, tokenised once
    grouped, rest = reshape.split_groups(rows)
    return reshape.reassemble(reshape.columns_of(grouped), reshape.templates_of(grouped), rest).select("row_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


_PROPS_SQL = """SELECT event_id AS row_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k": null, "e": "' || event_type || '"}' WHEN 2 THEN '{"e": "' || event_type || '", "u": ' || user_id || '}' ELSE 'null' END AS j FROM events"""


def _props(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 4
    j = F.when(e == 0, F.col("props")).when(e == 1, F.concat(F.lit('{"k": null, "e": "'), "event_type", F.lit('"}'))).when(e == 2, F.concat(F.lit('{"e": "'), "event_type", F.lit('", "u": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise("null")
    return tab(spark, d, "events").select(F.col("event_id").alias("row_id"), j.alias("j"))


@query(f"SELECT row_id, sub_key, CASE WHEN j = 'null' THEN 'null' WHEN list_contains(json_keys(j), sub_key) THEN CAST(json_extract(j, '$.' || sub_key) AS VARCHAR) END AS value, j = 'null' OR list_contains(json_keys(j), sub_key) AS present FROM ({_PROPS_SQL}) CROSS JOIN (VALUES ('e'), ('k'), ('u')) v(sub_key)")
def nested_flatten_props(spark, d):
    return reshape.flatten_objects(_props(spark, d), "row_id", "j")


def _nested_roundtrip(rows: DataFrame) -> DataFrame:
    apart = reshape.taken_apart(rows, "j")
    return reshape.rebuild_objects(reshape.nested_cells(apart), reshape.nested_shells(apart))


@query(f"SELECT row_id, j AS rebuilt FROM ({_PROPS_SQL})")
def nested_unflatten_props(spark, d):
    return _nested_roundtrip(_props(spark, d))


#: Tokens that aren't plain objects: repeated keys, nothing inside, other kinds, blanks, cut short, no value at all.
_ODD = ['{"a": 1, "a": 2}', "{}", "[1]", "null", ' {"a":1}', '{"a":1} ', '{"a": {"a": [1, {"b": "}"}]}, "c":"x\\\\y\\"z"}', '{"a":', '"text"', "", '{"": 0}', '{"b" : -0.0 , "b":1E5}', None]
_ODD_SQL = "SELECT event_id AS row_id, CASE event_id % 13 " + " ".join(f"WHEN {k} THEN " + ("NULL" if t is None else "'" + t.replace("'", "''") + "'") for k, t in enumerate(_ODD)) + " END AS j FROM events"


def _odd(spark: SparkSession, d: str) -> DataFrame:
    k, j = F.col("event_id") % 13, F.lit(None).cast("string")
    for n, t in enumerate(_ODD):
        j = F.when(k == n, F.lit(t)).otherwise(j)
    return tab(spark, d, "events").select(F.col("event_id").alias("row_id"), j.alias("j"))


@query(f"SELECT row_id, j AS rebuilt FROM ({_ODD_SQL})")
def nested_odd_roundtrip(spark, d):
    return _nested_roundtrip(_odd(spark, d))


_ODD_CELLS = [(0, 0, "a", "1"), (0, 1, "a", "2"), (4, 0, "a", "1"), (6, 0, "a", '{"a": [1, {"b": "}"}]}'), (6, 1, "c", '"x\\\\y\\"z"'), (10, 0, "", "0"), (11, 0, "b", "-0.0"), (11, 1, "b", "1E5")]


@query("SELECT event_id AS row_id, pos, sub_key, v.value FROM events JOIN (VALUES " + ", ".join(f"({a}, {b}, '{c}', '{v}')" for a, b, c, v in _ODD_CELLS) + ") v(m, pos, sub_key, value) ON event_id % 13 = m")
def nested_odd_cells(spark, d):
    return reshape.nested_cells(reshape.taken_apart(_odd(spark, d), "j"))


_ABSENT = [(1, '{"a": 1, "b": null}'), (2, '{"b": 2}'), (3, "null"), (4, '{"a": null}'), (5, '{"a": "null", "b": {"c": 1}}')]


@query(f"""SELECT row_id, key, CASE WHEN j = 'null' THEN 'null' WHEN NOT list_contains(json_keys(j), key) THEN 'absent' WHEN json_type(j, '$.' || key) = 'NULL' THEN 'null' ELSE 'value' END AS state
FROM (VALUES {", ".join(f"(CAST({i} AS BIGINT), '{j}')" for i, j in _ABSENT)}) v(row_id, j) CROSS JOIN (VALUES ('a'), ('b')) k(key)""")
def absence_vs_null(spark, d):
    cells = reshape.flatten_objects(spark.createDataFrame(_ABSENT, "row_id long, j string"), "row_id", "j")
    return cells.select("row_id", F.col("sub_key").alias("key"), F.when(~F.col("present"), "absent").when(F.col("value") == "null", "null").otherwise("value").alias("state"))


@query(f"""WITH l AS ({LINE_SQL}), o AS (SELECT line FROM l WHERE line[1] = '{{'), k AS (SELECT unnest(json_keys(line)) AS key FROM o UNION ALL SELECT unnest(json_keys(line, '$.props')) FROM o WHERE list_contains(json_keys(line), 'props'))
SELECT key, count(*) AS freq, CAST(row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS INTEGER) AS idx FROM k GROUP BY key HAVING count(*) > 1""")
def key_intern_dict(spark, d):
    return reshape.key_dictionary(event_lines(spark, d), "line")


_CONV = """SELECT conv_id, '{"conv": ' || conv_id || ', "turns": [' || string_agg('{"turn": ' || turn || ', "role": "' || role || '"}', ', ' ORDER BY turn) || ']}' AS j, count(*) AS n FROM conversations GROUP BY conv_id"""


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    turn = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "role": "'), "role", F.lit('"}'))
    per = tab(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), ", ").alias("b"))
    return per.select("conv_id", F.concat(F.lit('{"conv": '), F.col("conv_id").cast("string"), F.lit(', "turns": ['), "b", F.lit("]}")).alias("j"))


@query(f"SELECT conv_id, n AS elements FROM ({_CONV}) ORDER BY n DESC, conv_id LIMIT 1")
def largest_array(spark, d):
    elements, _ = reshape.array_elements(_conversations(spark, d), "conv_id", "j")
    return elements.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("elements")).orderBy(F.desc("elements"), "conv_id").limit(1)


@query(f"SELECT conv_id, md5(j) AS text_md5 FROM ({_CONV})")
def array_roundtrip(spark, d):
    text = reshape.join_elements(*reshape.array_elements(_conversations(spark, d), "conv_id", "j"))
    return text.select(F.col("doc_id").alias("conv_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: The turns as arrays whose elements have two shapes, and one that is unlike all others.
_CONV2 = """SELECT conv_id, '[' || string_agg(CASE WHEN turn % 3 = 2 THEN '{"turn": ' || turn || ', "n": ' || length(text) || '}' ELSE '{"turn": ' || turn || ', "role": "' || role || '"}' END, ',' ORDER BY turn) || ']' AS j, count(*) AS n, count(*) FILTER (turn % 3 = 2) AS odd FROM conversations GROUP BY conv_id"""


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn").cast("string")
    e = F.when(F.col("turn") % 3 == 2, F.concat(F.lit('{"turn": '), t, F.lit(', "n": '), F.length("text").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"turn": '), t, F.lit(', "role": "'), "role", F.lit('"}')))
    per = tab(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", e.alias("e")))), lambda x: x["e"]), ",").alias("b"))
    return per.select("conv_id", F.concat(F.lit("["), "b", F.lit("]")).alias("j"))


@query(f"SELECT conv_id, n AS rows, CAST(least(odd, 1) + least(n - odd, 1) AS BIGINT) AS templates, CASE WHEN odd = 0 OR odd = n THEN 'uniform' WHEN greatest(odd, n - odd) >= 3 THEN 'grouped' ELSE 'none' END AS strategy FROM ({_CONV2}) WHERE n >= 5")
def array_strategy(spark, d):
    rows, _ = reshape.tokenised_elements(_arrays(spark, d), "conv_id", "j")
    return reshape.strategy(rows, reshape.MIN_ELEMENTS, ("doc_id",)).withColumnRenamed("doc_id", "conv_id")


@query(f"""WITH a AS ({_CONV2}), t AS (SELECT c.conv_id, c.turn, role, length(text) AS m, c.turn % 3 = 2 AS o, CASE WHEN c.turn % 3 = 2 THEN odd ELSE n - odd END AS g, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS row_id FROM conversations c JOIN a ON a.conv_id = c.conv_id WHERE n >= 5)
SELECT conv_id, row_id, CAST(0 AS INTEGER) AS col_id, CAST(turn AS VARCHAR) AS raw FROM t WHERE g >= 3 UNION ALL SELECT conv_id, row_id, CAST(1 AS INTEGER), CASE WHEN o THEN CAST(m AS VARCHAR) ELSE '"' || role || '"' END FROM t WHERE g >= 3""")
def array_columns(spark, d):
    rows, _ = reshape.tokenised_elements(_arrays(spark, d), "conv_id", "j")
    return reshape.array_to_columns(rows)[0].select(F.col("doc_id").alias("conv_id"), F.col("row_id").cast("long").alias("row_id"), "col_id", "raw")


@query(f"SELECT conv_id, md5(j) AS text_md5 FROM ({_CONV2}) WHERE n >= 5")
def array_columns_roundtrip(spark, d):
    rows, shells = reshape.tokenised_elements(_arrays(spark, d), "conv_id", "j")
    rows = rows.persist()
    return reshape.columns_to_array(*reshape.array_to_columns(rows), shells).select(F.col("doc_id").alias("conv_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(" UNION ALL ".join(f"SELECT sha256({' || chr(1) || '.join(chr(39) + p + chr(39) for p in parts)}) AS template_id, count(*) AS rows, CAST({{}} AS INTEGER) AS group_id FROM events WHERE {where} HAVING count(*) >= 5".replace("{}", str(k)) for k, (parts, where) in enumerate(_SHAPES[n] for n in ("full", "some", "few"))))
def template_order(spark, d):
    groups = reshape.template_groups(reshape.tokenised_rows(event_lines(spark, d)))
    return reshape.ordered_groups(groups).select("template_id", "rows", "group_id")


@query(f"""WITH l AS ({LINE_SQL}) SELECT row_id, key, value FROM (SELECT row_id, unnest(json_keys(line, '$.props')) AS key, line FROM l WHERE line[1] = '{{' AND list_contains(json_keys(line), 'props')) t, LATERAL (SELECT CAST(json_extract(line, '$.props.' || key) AS VARCHAR) AS value)""")
def group_flatten_events(spark, d):
    grouped, _ = reshape.split_groups(reshape.tokenised_rows(event_lines(spark, d)).persist())
    cells, _, _ = reshape.flatten_group(reshape.columns_of(grouped))
    return cells.select("row_id", F.col("sub_key").alias("key"), "value")


@query(f"SELECT row_id, md5(line) AS line_md5 FROM ({LINE_SQL})")
def group_unflatten_events(spark, d):
    rows = reshape.tokenised_rows(event_lines(spark, d)).persist()
    grouped, rest = reshape.split_groups(rows)
    back = reshape.unflatten_group(*reshape.flatten_group(reshape.columns_of(grouped)))
    return reshape.reassemble(back, reshape.templates_of(grouped), rest).select("row_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


_INTERN_SQL = f"""WITH l AS ({LINE_SQL}), o AS (SELECT line FROM l WHERE line[1] = chr(123)), k AS (SELECT unnest(json_keys(line)) AS key FROM o UNION ALL SELECT unnest(json_keys(line, '$.props')) FROM o WHERE list_contains(json_keys(line), 'props')),
i AS (SELECT key, row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS idx FROM k GROUP BY key HAVING count(*) > 1)
"""
_SWAPS = "line"
for _name in ("event_id", "ts", "user_id", "event_type", "value", "props", "k", "x"):
    _SWAPS = f"""replace({_SWAPS}, '"{_name}":', chr(1) || (SELECT idx FROM i WHERE key = '{_name}') || chr(2) || ':')"""


@query("SELECT row_id, md5(x) AS interned_md5, CAST(octet_length(encode(x)) AS BIGINT) AS bytes FROM (" + _INTERN_SQL + "SELECT row_id, " + _SWAPS + " AS x FROM l)")
def key_intern_encode(spark, d):
    lines_ = event_lines(spark, d)
    out = reshape.intern_keys(lines_, "line", reshape.key_dictionary(lines_, "line"))
    return out.select("row_id", F.md5(F.col("interned").cast("binary")).alias("interned_md5"), F.octet_length("interned").cast("long").alias("bytes"))


@query(f"SELECT row_id, line AS text FROM ({LINE_SQL})")
def key_intern_decode(spark, d):
    lines_ = event_lines(spark, d)
    keys = reshape.key_dictionary(lines_, "line")
    return reshape.extern_keys(reshape.intern_keys(lines_, "line", keys).select("row_id", "interned"), "interned", keys).select("row_id", "text")


# ---- plans and frames


def _costs(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    long = long_form(spark, d, name)
    deltas = planner.integer_deltas(long, FRAME)
    stamps = F.when(F.col("raw").rlike(S.ISO), S.iso_parts(F.col("raw"))[3])
    from pyspark.sql import Window

    w = Window.partitionBy("col_id", F.floor(F.col("row_id") / FRAME)).orderBy("row_id")
    deltas = deltas.withColumn("us", stamps).withColumn("delta", F.coalesce("delta", F.col("us") - F.lag("us").over(w), "us")).drop("us")
    return profile.infer_schema(long), planner.column_costs(deltas)


def _plan_sql(name: str) -> str:
    long = long_sql(name)
    return f"""WITH l AS ({long}), v AS (SELECT *, CASE WHEN regexp_matches(raw, '{S.INT}') THEN TRY_CAST(raw AS BIGINT) WHEN regexp_matches(raw, '{S.ISO}') THEN epoch_us(CAST(raw[2:length(raw) - 1] AS TIMESTAMP)) END AS x FROM l),
dl AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY col_id, row_id // {FRAME} ORDER BY row_id), x) AS delta FROM v),
c AS (SELECT col_id, count(*) AS n, sum(octet_length(encode(raw))) AS t, sum(CASE WHEN delta IS NOT NULL THEN {VARINT_SQL} END) AS vi, bool_and(raw LIKE '"%"') AS q FROM dl GROUP BY 1),
e AS (SELECT col_id, sum(b + 4) AS entries, count(*) AS k FROM (SELECT DISTINCT col_id, raw, octet_length(encode(raw)) AS b FROM l) GROUP BY 1),
s AS ({infer_sql(long)}),
j AS (SELECT s.col_id, s.col_type, CASE s.col_type WHEN 'Integer' THEN 'delta_varint' WHEN 'Boolean' THEN 'bitmap' WHEN 'Iso8601' THEN 'timestamp' WHEN 'Uuid' THEN 'uuid'
  WHEN 'Enum' THEN CASE WHEN NOT q THEN 'raw' WHEN s.cardinality > 255 THEN 'string' ELSE 'enum' END WHEN 'String' THEN CASE WHEN q THEN 'string' ELSE 'raw' END ELSE 'raw' END AS encoding, n, t, vi, entries FROM s JOIN c USING (col_id) JOIN e USING (col_id))
SELECT col_id, col_type, encoding, CAST(t + n - 1 AS BIGINT) AS raw_bytes, CAST(CASE encoding WHEN 'delta_varint' THEN vi WHEN 'timestamp' THEN vi + 16 WHEN 'bitmap' THEN 4 + (n + 7) // 8 WHEN 'enum' THEN 5 + entries + n WHEN 'string' THEN 4 + t + 2 * n WHEN 'uuid' THEN 4 + 16 * n ELSE t + n - 1 END AS BIGINT) AS encoded_bytes FROM j"""


def _plan(name: str) -> None:
    def f(spark, d):
        return planner.encoding_plan(*_costs(spark, d, name))

    f.__name__ = f"encoding_plan_{name}"
    query(_plan_sql(name))(f)


_plan("events")
_plan("orders")


@query(f"""WITH l AS ({long_sql("part", only=("str",))}), c AS (SELECT row_id // {FRAME} AS block_id, count(*) AS n, sum(octet_length(encode(raw))) AS t FROM l GROUP BY 1), e AS (SELECT block_id, sum(b + 4) AS entries FROM (SELECT DISTINCT row_id // {FRAME} AS block_id, raw, octet_length(encode(raw)) AS b FROM l) GROUP BY 1),
x AS (SELECT block_id, 'raw' AS path, CAST(t + n - 1 AS BIGINT) AS size FROM c UNION ALL SELECT block_id, 'string', CAST(4 + t + 2 * n AS BIGINT) FROM c UNION ALL SELECT block_id, 'enum', CAST(5 + entries + n AS BIGINT) FROM c JOIN e USING (block_id))
SELECT block_id, arg_min(path, (size, path)) AS path, min(size) AS size FROM x GROUP BY 1""")
def candidate_argmin(spark, d):
    size = S.octets(F.col("raw"))
    long = long_form(spark, d, "part", only=("str",)).withColumn("block_id", F.floor(F.col("row_id") / FRAME))
    distinct = long.groupBy("block_id", "raw").agg(F.count("*").alias("c"))
    per = distinct.groupBy("block_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * size).alias("t"), F.sum(size + 4).alias("entries"))
    paths = {"raw": F.col("t") + F.col("n") - 1, "string": 4 + F.col("t") + 2 * F.col("n"), "enum": 5 + F.col("entries") + F.col("n")}
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), s.alias("size")) for p, s in paths.items()])).alias("x")
    return planner.smallest(per.select("block_id", cells).select("block_id", "x.path", "x.size"))


_FRAMES_SQL = f"SELECT row_id // {FRAME} AS frame_id, count(*) AS rows, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM ({LINE_SQL}) GROUP BY 1"


@query(f"SELECT frame_id, bytes, CASE WHEN bytes <= 1048576 THEN 19 WHEN bytes <= 10485760 THEN 13 ELSE 9 END AS level FROM (SELECT frame_id, bytes * 97 * (frame_id % 3) AS bytes FROM ({_FRAMES_SQL}))")
def adaptive_level(spark, d):
    sizes = frames.frame_chunks(event_lines(spark, d), FRAME).select("frame_id", (F.col("bytes") * 97 * (F.col("frame_id") % 3)).alias("bytes"))
    return sizes.withColumn("level", S.zstd_level(F.col("bytes")))


@query(_FRAMES_SQL)
def frame_chunks(spark, d):
    return frames.frame_chunks(event_lines(spark, d), FRAME)


@query(f"SELECT row_id // {FRAME} AS frame_id, count(*) AS rows, md5(string_agg(line, chr(10) ORDER BY row_id)) AS md5 FROM ({LINE_SQL}) GROUP BY 1")
def frame_digest(spark, d):
    return frames.frame_texts(event_lines(spark, d), FRAME).select("frame_id", "rows", F.md5(F.col("text").cast("binary")).alias("md5"))


#: The check sum of a frame of ASCII lines, byte by byte over a table of 256 values made by the polynomial's rule.
_CRC_SQL = f"""WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
f AS (SELECT row_id // 10 AS frame_id, string_agg(line, chr(10) ORDER BY row_id) AS text FROM ({LINE_SQL}) GROUP BY 1), b AS (SELECT frame_id, list_transform(string_split(text, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM f)
SELECT frame_id, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295) AS crc32 FROM b, t"""


@query(_CRC_SQL)
def frame_crc(spark, d):
    return frames.frame_texts(event_lines(spark, d), 10).select("frame_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


def _packed(spark: SparkSession, d: str, **how) -> DataFrame:
    """(frame_id, rows, original, level, coder, smaller, md5 of what comes back) of the event frames."""
    packed = frames.compress_frames(frames.frame_texts(event_lines(spark, d), FRAME), **how)
    back = frames.verified(packed).select("frame_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return packed.select("frame_id", "rows", "original", "level", "coder", (F.col("compressed") < F.col("original") / 2).alias("smaller")).join(back, "frame_id")


_PACKED_SQL = f"SELECT row_id // {FRAME} AS frame_id, count(*) AS rows, CAST(sum(octet_length(encode(line)) + 1) - 1 AS BIGINT) AS original, TRUE AS smaller, md5(string_agg(line, chr(10) ORDER BY row_id)) AS md5 FROM ({LINE_SQL}) GROUP BY 1"


@query(f"SELECT *, 'zstd' AS coder, CAST(CASE WHEN original <= 1048576 THEN 19 WHEN original <= 10485760 THEN 13 ELSE 9 END AS INTEGER) AS level FROM ({_PACKED_SQL})")
def frame_zstd(spark, d):
    return _packed(spark, d, coder="zstd")


@query(_PACKED_SQL)
def frame_race(spark, d):
    return _packed(spark, d).drop("coder", "level")


@query(f"SELECT *, 'zstd_trained' AS coder FROM ({_PACKED_SQL}) WHERE original >= 8192")
def frame_trained(spark, d):
    texts = frames.frame_texts(event_lines(spark, d), FRAME).filter(F.octet_length("text") >= frames.TRAINED_BYTES)
    packed = frames.compress_frames(texts, coder="zstd_trained")
    back = frames.verified(packed).select("frame_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return packed.select("frame_id", "rows", "original", "coder", (F.col("compressed") < F.col("original") / 2).alias("smaller")).join(back, "frame_id")


#: Blocks of orders, column by column: the bytes of each encoding, and whether the block as a whole is smaller than its text.
_BLOCK_SQL = f"""WITH l AS (SELECT row_id // {FRAME} AS block_id, * FROM ({long_sql("orders")})), v AS (SELECT *, CASE WHEN regexp_matches(raw, '{S.INT}') THEN TRY_CAST(raw AS BIGINT) WHEN regexp_matches(raw, '{S.ISO}') THEN epoch_us(CAST(raw[2:length(raw) - 1] AS TIMESTAMP)) END AS x FROM l),
dl AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY col_id, block_id ORDER BY row_id), x) AS delta FROM v),
c AS (SELECT block_id, col_id, count(*) AS n, sum(octet_length(encode(raw))) AS t, sum(CASE WHEN delta IS NOT NULL THEN {VARINT_SQL} END) AS vi FROM dl GROUP BY 1, 2),
e AS (SELECT block_id, col_id, sum(b + 4) AS entries FROM (SELECT DISTINCT block_id, col_id, raw, octet_length(encode(raw)) AS b FROM l) GROUP BY 1, 2),
p AS (SELECT col_id, encoding FROM ({_plan_sql("orders")})),
z AS (SELECT block_id, col_id, encoding, n, t + n - 1 AS raw_bytes, CASE encoding WHEN 'delta_varint' THEN vi WHEN 'timestamp' THEN vi + 16 WHEN 'enum' THEN 5 + entries + n ELSE 4 + t + n - 1 END AS payload_bytes FROM c JOIN e USING (block_id, col_id) JOIN p USING (col_id))
SELECT block_id, col_id, encoding, n, CAST(payload_bytes AS BIGINT) AS payload_bytes, sum(payload_bytes) OVER w < sum(raw_bytes) OVER w AS use_typed FROM z WINDOW w AS (PARTITION BY block_id)"""


@query(_BLOCK_SQL)
def typed_block_gate(spark, d):
    long = long_form(spark, d, "orders")
    blocks = typed_block.encode_blocks(long, FRAME, planner.encoding_plan(*_costs(spark, d, "orders")))
    raw = long.groupBy(F.floor(F.col("row_id") / FRAME).alias("block_id"), "col_id").agg((F.sum(S.octets(F.col("raw"))) + F.count("*") - 1).alias("raw_bytes"))
    return typed_block.gate(blocks, raw)


@query(long_sql("orders"))
def typed_block_decode(spark, d):
    blocks = typed_block.encode_blocks(long_form(spark, d, "orders"), FRAME, planner.encoding_plan(*_costs(spark, d, "orders")))
    return typed_block.decode_blocks(blocks, FRAME)


@query(f"SELECT DISTINCT row_id // {FRAME} AS frame_id, TRUE AS ok FROM ({LINE_SQL})")
def frame_zstd_roundtrip(spark, d):
    texts = frames.frame_texts(event_lines(spark, d), FRAME)
    back = frames.decompress_frames(frames.compress_frames(texts))
    return back.withColumnRenamed("text", "back").join(texts, "frame_id").select("frame_id", (F.col("ok") & F.col("back").eqNullSafe(F.col("text"))).alias("ok"))


@query(f"SELECT row_id, md5(line) AS line_md5 FROM ({LINE_SQL})")
def frame_lines(spark, d):
    back = frames.verified(frames.compress_frames(frames.frame_texts(event_lines(spark, d), FRAME)))
    return frames.frame_lines(back, FRAME).select("row_id", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"""WITH p AS (SELECT 'events' AS file, * FROM ({_plan_sql("events")}) UNION ALL SELECT 'orders', * FROM ({_plan_sql("orders")})), f AS (SELECT coalesce(file, 'TOTAL') AS file, CAST(sum(raw_bytes) AS BIGINT) AS original, CAST(sum(encoded_bytes) AS BIGINT) AS encoded FROM p GROUP BY ROLLUP (file))
SELECT *, round(encoded * 8.0::DOUBLE / original, 6) AS bpb, round((1 - encoded::DOUBLE / original) * 100.0, 6) AS improvement_pct FROM f""")
def bench_report(spark, d):
    both = [planner.encoding_plan(*_costs(spark, d, n)).select(F.lit(n).alias("file"), "raw_bytes", "encoded_bytes") for n in ("events", "orders")]
    per = both[0].unionByName(both[1]).rollup("file").agg(F.sum("raw_bytes").alias("original"), F.sum("encoded_bytes").alias("encoded"))
    o, e = F.col("original"), F.col("encoded")
    return per.select(F.coalesce("file", F.lit("TOTAL")).alias("file"), "original", "encoded", F.round(S.bits_per_byte(e, o), 6).alias("bpb"), F.round(S.improvement(e, o), 6).alias("improvement_pct"))


@query(f"SELECT row_id, line FROM ({LINE_SQL})")
def lines_roundtrip(spark, d):
    """Lines written as text files and read back with their numbers."""
    path = scratch(spark, "lines")
    lines.write_lines(event_lines(spark, d), path)
    return lines.read_lines(spark, path)


@query(f"SELECT CAST(row_id // {FRAME} AS BIGINT) AS frame_id, row_number() OVER (ORDER BY row_id // {FRAME}) - 1 AS place, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS size, md5(string_agg(line || chr(10), '' ORDER BY row_id)) AS md5 FROM ({LINE_SQL}) GROUP BY row_id // {FRAME}")
def directory_scan(spark, d):
    """A folder with a file for each frame, read as whole files in the order of their names."""
    path = scratch(spark, "files")
    texts = frames.frame_texts(event_lines(spark, d), FRAME).select(F.col("frame_id").cast("long").alias("frame_id"), F.col("text").alias("value"))
    texts.repartition(4).write.option("lineSep", "\n").partitionBy("frame_id").text(path)
    files = lines.read_documents(spark, f"{path}/*", "*.txt").withColumn("place", F.monotonically_increasing_id())
    number = F.regexp_extract("path", "frame_id=([0-9]+)", 1).cast("long")
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("frame_id")) - 1  # a row for each file
    return files.select(number.alias("frame_id"), "size", F.md5("content").alias("md5")).withColumn("place", place)


def _frame_files(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.frame_files import FrameFiles

    spark.dataSource.register(FrameFiles)
    path = scratch(spark, "frames").removeprefix("file://")
    frames.frame_texts(event_lines(spark, d), FRAME).select("frame_id", "text").write.format("weftline").mode("append").save(path)
    return spark.read.format("weftline").load(path)


@query(f"SELECT md5(string_agg(line, chr(10) ORDER BY row_id)) AS md5, CAST(sum(octet_length(encode(line)) + 1) - 1 AS BIGINT) AS original, 'fast' AS mode, 'ndjson' AS format, TRUE AS smaller FROM ({LINE_SQL}) GROUP BY row_id // {FRAME}")
def frame_files_roundtrip(spark, d):
    """Headers and texts of files of frames, written by the sink and read by the source."""
    return _frame_files(spark, d).select(F.md5(F.col("text").cast("binary")).alias("md5"), "original", "mode", "format", (F.col("compressed") < F.col("original") / 4).alias("smaller"))


@query(f"SELECT row_id // {FRAME} AS frame_id, chain, md5(string_agg(line, chr(10) ORDER BY row_id)) AS back_md5 FROM ({LINE_SQL}), (VALUES (''), ('lines'), ('keys')) c(chain) GROUP BY 1, 2")
def transform_chains(spark, d):
    out = frames.chained(frames.frame_texts(event_lines(spark, d), FRAME))
    return out.select("frame_id", "chain", F.md5(F.col("back").cast("binary")).alias("back_md5"))


@query(f"SELECT row_id // {FRAME} AS frame_id, 'zstd_dict' AS coder, md5(string_agg(line, chr(10) ORDER BY row_id)) AS md5 FROM ({LINE_SQL}) GROUP BY 1")
def train_dict_roundtrip(spark, d):
    """A dictionary trained on a bounded sample, and all frames coded with it."""
    texts = frames.frame_texts(event_lines(spark, d), FRAME)
    sample = [r["text"].encode() for r in texts.orderBy("frame_id").limit(2).collect()]
    known = frames.train_dictionary(sample, 16384)
    packed = frames.compress_frames(texts, coder="zstd_dict", dictionary=known)
    back = frames.verified(packed, known).select("frame_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return packed.select("frame_id", "coder").join(back, "frame_id")


@query(f"SELECT row_id // 10 AS frame_id, TRUE AS smaller, md5(string_agg(line, chr(10) ORDER BY row_id)) AS md5 FROM ({LINE_SQL}) WHERE row_id < 160 GROUP BY 1")
def frame_balanced(spark, d):
    """Frames of a few lines by the context-mixing coder, against their length, and what comes back."""
    texts = frames.frame_texts(event_lines(spark, d).filter("row_id < 160"), 10).repartition(8, "frame_id")
    packed = texts.select("frame_id", F.octet_length("text").alias("n"), frames.mixed("text").alias("p"))
    return packed.select("frame_id", (F.octet_length("p") < F.col("n") / 2).alias("smaller"), F.md5(frames.unmixed("p")).alias("md5"))


@query(f"SELECT row_id // {FRAME} AS frame_id, count(*) AS rows, md5(string_agg(line, chr(10) ORDER BY row_id)) AS md5 FROM ({LINE_SQL}) GROUP BY 1")
def stream_frames(spark, d):
    """Lines read as a stream and written as frames, batch by batch."""
    from ..streaming.frames import read_line_stream, write_frames

    source, out, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    texts = frames.frame_texts(event_lines(spark, d), FRAME).withColumnRenamed("text", "value")
    texts.repartition(1).sortWithinPartitions("frame_id").select("value").write.option("lineSep", "\n").text(source)
    write_frames(read_line_stream(spark, source, 1), out, state, FRAME).awaitTermination()
    back = frames.verified(spark.read.parquet(out))
    return back.select("frame_id", "rows", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("""WITH f AS (SELECT event_id // 1000 AS frame_id, event_id, event_id // 1000 % 2 = 1 AS one FROM events), k AS (SELECT frame_id, CASE WHEN event_id = 11 THEN NULL WHEN event_id IN (7, 8, 9) THEN 9 ELSE event_id % 3 END AS shape, event_id FROM f WHERE NOT one OR event_id % 3 = 0),
g AS (SELECT frame_id, shape, count(*) AS n FROM k WHERE shape IS NOT NULL GROUP BY 1, 2)
SELECT k.frame_id, any_value(r) AS rows, count(*) AS templates, CASE WHEN count(*) = 1 AND sum(n) = any_value(r) THEN 'uniform' WHEN max(n) >= 5 THEN 'grouped' ELSE 'none' END AS strategy FROM g k JOIN (SELECT frame_id, count(*) AS r FROM k GROUP BY 1) t ON t.frame_id = k.frame_id GROUP BY k.frame_id""")
def ndjson_strategy(spark, d):
    """Frames of lines: uniform, grouped or left alone; every second frame has one shape only."""
    rows = reshape.tokenised_rows(event_lines(spark, d)).withColumn("frame_id", F.floor(F.col("row_id") / FRAME))
    return reshape.strategy(rows.filter("frame_id % 2 = 0 or row_id % 3 = 0"), keys=("frame_id",))


@query("SELECT o_orderkey, hex, CAST(length(hex) // 2 AS BIGINT) AS len FROM (SELECT o_orderkey, " + " || ".join(f"CASE WHEN {k} = 0 OR (z >> {7 * k}) <> 0 THEN printf('%02X', ((z >> {7 * k}) & 127) + CASE WHEN (z >> {7 * k + 7}) <> 0 THEN 128 ELSE 0 END) ELSE '' END" for k in range(9)) + " AS hex FROM (SELECT o_orderkey, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z FROM (SELECT o_orderkey, (o_custkey - 700) * o_orderkey * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 99999999 END) AS v FROM orders)))")
def varint_bytes(spark, d):
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731 - the product leaves 64 bits where keys are large
    v = wide(F.col("o_custkey") - 700) * wide(F.col("o_orderkey")) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(99999999).cast("decimal(20,0)")
    rows = tab(spark, d, "orders").select("o_orderkey", v.cast("decimal(38,0)").alias("v"))
    return rows.select("o_orderkey", S.wide_varint_hex(F.col("v")).alias("hex"), S.wide_varint_len(F.col("v")).cast("long").alias("len"))


# ---- statistics

CLASS_SQL = "CASE " + " ".join(f"WHEN b <= {u} THEN {k}" for u, k in S.BYTE_CLASSES) + " END"


@query(f"""WITH c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1), h AS (SELECT n, hex(encode(c)) AS h FROM c),
b AS (SELECT n, CAST('0x' || h[i:i + 1] AS INTEGER) AS b FROM (SELECT n, h, unnest(range(1, length(h), 2)) AS i FROM h)) SELECT {CLASS_SQL} AS class, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1""")
def byte_class_histogram(spark, d):
    return stats.byte_values(tab(spark, d, "documents")).groupBy(S.byte_class(F.col("b")).alias("class")).agg(F.sum("n").alias("n"))


def _grams_sql(k: int) -> str:
    ctx = " || ".join(f"c[i + {j}]" for j in range(k)) or "''"
    return f"SELECT {ctx} AS ctx, c[i + {k}] AS next, count(*) AS n FROM (SELECT c, unnest(range(1, len(c) - {k} + 1)) AS i FROM (SELECT list_filter(string_split(text, ''), lambda x: x <> '') AS c FROM documents)) GROUP BY 1, 2"


def _entropy(k: int) -> None:
    def f(spark, d):
        return stats.conditional_entropy(stats.char_grams(tab(spark, d, "documents"), k)).withColumn("k", F.lit(k))

    f.__name__ = f"char_entropy_order{k}"
    query(f"WITH g AS ({_grams_sql(k)}), t AS (SELECT ctx, sum(n) AS m, sum(n * log2(n)) AS s FROM g GROUP BY 1) SELECT {k} AS k, count(*) AS contexts, round((sum(m * log2(m)) - sum(s)) / sum(m), 6) AS entropy FROM t")(f)


for _k in range(5):
    _entropy(_k)


@query("""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents) SELECT w1, w2, count(*) AS n FROM (SELECT w[i] AS w1, w[i + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY 1, 2 ORDER BY n DESC, w1, w2 LIMIT 50""")
def word_bigram_topk(spark, d):
    return stats.word_pairs(tab(spark, d, "documents")).orderBy(F.desc("n"), "w1", "w2").limit(50)


@query("WITH r AS (SELECT event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g, event_type FROM events) SELECT run_len, count(*) AS n FROM (SELECT count(*) AS run_len FROM r GROUP BY g, event_type) GROUP BY 1")
def run_length_histogram(spark, d):
    return stats.run_lengths(tab(spark, d, "events"), "event_id", F.col("event_type"), 512)


@query("SELECT c[i] AS c2, c[i + 2] AS next, count(*) AS n FROM (SELECT c, unnest(range(1, len(c) - 1)) AS i FROM (SELECT list_filter(string_split(text, ''), lambda x: x <> '') AS c FROM documents)) GROUP BY 1, 2")
def skip_context_counts(spark, d):
    return stats.skip_grams(tab(spark, d, "documents"))


@query(f"WITH g AS ({_grams_sql(3)}) SELECT ctx AS trigram, arg_min(next, (-n, next)) AS next, max(n) AS n FROM g GROUP BY 1")
def next_char_mode(spark, d):
    return stats.modes(stats.char_grams(tab(spark, d, "documents"), 3)).withColumnRenamed("ctx", "trigram")


@query(f"WITH g AS (SELECT col_id, raw, count(*) AS n FROM ({long_sql('events', True)}) GROUP BY 1, 2) SELECT col_id, round((sum(n) * log2(sum(n)) - sum(n * log2(n))) / sum(n), 6) + 0.0 AS entropy FROM g GROUP BY 1")
def key_conditional_entropy(spark, d):
    g = long_form(spark, d, "events", True).groupBy("col_id", "raw").agg(F.count("*").alias("n"))
    total, own = F.sum("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    return g.groupBy("col_id").agg((F.round((total * F.log2(total.cast("double")) - own) / total, 6) + F.lit(0.0)).alias("entropy"))


@query("SELECT c[i - 3] || c[i - 1] AS c31, c[i] AS next, count(*) AS n FROM (SELECT c, unnest(range(4, len(c) + 1)) AS i FROM (SELECT list_filter(string_split(text, ''), lambda x: x <> '') AS c FROM documents)) GROUP BY 1, 2")
def skip_context_pairs(spark, d):
    return stats.skip_grams(tab(spark, d, "documents"), back=(3, 1))


@query(" UNION ALL ".join(f"SELECT {k} AS k, count(*) AS contexts, CAST(sum(s) AS BIGINT) AS symbols, CAST(sum(o) AS BIGINT) AS singletons, CAST(sum(t) AS BIGINT) AS total FROM (SELECT count(*) AS s, count(*) FILTER (n = 1) AS o, sum(n) AS t FROM ({_grams_sql(k)}) GROUP BY ctx)" for k in range(4)))
def backoff_escapes(spark, d):
    docs, out = tab(spark, d, "documents"), None
    for k in range(4):
        one = stats.escapes(stats.char_grams(docs, k)).select(F.lit(k).alias("k"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL ".join(f"SELECT {k} AS length, count(*) AS \"distinct\", count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS positions FROM ({_grams_sql(k - 1)})" for k in (3, 4, 5)))
def match_lengths(spark, d):
    docs, out = tab(spark, d, "documents"), None
    for k in (3, 4, 5):
        one = stats.matches(docs, k).select(F.lit(k).alias("length"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH c AS (SELECT user_id, count(*) AS n, CAST(sum((event_type < 'm')::INT) AS BIGINT) AS hits FROM events GROUP BY 1), p AS (SELECT *, (hits + 0.5::DOUBLE) / (n + 1.0::DOUBLE) AS p FROM c) SELECT CAST(least(greatest(floor((ln(p / (1 - p)) + 8) * 32 / 16), 0), 32) AS INTEGER) AS bin, count(*) AS contexts, CAST(sum(n) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits FROM p GROUP BY 1")
def calibration_table(spark, d):
    return stats.calibration(tab(spark, d, "events"), F.col("user_id"), F.col("event_type") < "m")


@query(f"""WITH l AS ({LINE_SQL}), s AS (SELECT length(line) AS a, list_transform(regexp_extract_all(line, '"[^"]*"(:)?'), lambda x: length(x)) AS w, list_transform(regexp_extract_all(line, '"[^"]*":'), lambda x: length(x)) AS k FROM l), t AS (SELECT sum(a) AS a, sum(coalesce(list_sum(w), 0)) AS w, sum(coalesce(list_sum(k), 0)) AS k FROM s)
SELECT 'key' AS state, CAST(k AS BIGINT) AS n FROM t UNION ALL SELECT 'string', CAST(w - k AS BIGINT) FROM t UNION ALL SELECT 'outside', CAST(a - w AS BIGINT) FROM t""")
def json_state_counts(spark, d):
    return stats.json_states(event_lines(spark, d), "line")


@query("SELECT event_id, round(1 / (1 + exp(-(value % 10 - 5))), 9) AS p, round(ln((1 / (1 + exp(-(value % 10 - 5)))) / (1 - 1 / (1 + exp(-(value % 10 - 5))))), 6) + 0.0 AS back FROM events")
def squash_stretch(spark, d):
    p = S.squash(F.col("value") % 10 - 5)
    return tab(spark, d, "events").select("event_id", F.round(p, 9).alias("p"), (F.round(S.stretch(p), 6) + F.lit(0.0)).alias("back"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) ELSE printf('%.1f MB', round(b / 1048576.0, 1)) END AS size FROM (SELECT doc_id, octet_length(encode(text)) * 37 AS b FROM documents)")
def human_sizes(spark, d):
    return tab(spark, d, "documents").select("doc_id", S.human_size(F.octet_length("text").cast("long") * 37).alias("size"))
