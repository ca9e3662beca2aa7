"""Small cases of the third round's findings."""

from helpers import SF  # noqa: F401
from pyspark.sql import functions as F

from weftline.functions import scalar as S
from weftline.plans import catalogue
from weftline.sources import frames, lines


def leb128(v: int) -> str:
    z, out = 2 * v if v >= 0 else -2 * v - 1, []
    while True:
        out.append(z & 127 | (128 if z >> 7 else 0))
        z >>= 7
        if not z:
            return bytes(out).hex().upper()


def test_varints_beyond_64_bits(spark, tmp_path):
    edges = [s * ((1 << b) + d) for b in (0, 6, 13, 55, 56, 61, 62, 63, 64, 69, 76, 111, 112, 118, 124) for d in (-1, 0, 1) for s in (1, -1)]
    n = F.col("v").cast("decimal(38,0)")
    for r in spark.createDataFrame([(str(v),) for v in edges], "v string").select("v", S.wide_varint_hex(n).alias("h"), S.wide_varint_len(n).alias("n")).collect():
        assert (r["h"], r["n"]) == (leb128(int(r["v"])), len(leb128(int(r["v"]))) // 2)
    spark.createDataFrame([(8_999_999, 899_999), (3, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: (r["hex"], r["len"]) for r in catalogue.varint_bytes(spark, str(tmp_path)).collect()}
    assert got == {k: (h := leb128((c - 700) * k * 99999999), len(h) // 2) for k, c in ((8_999_999, 899_999), (3, 5))}


def test_lines_are_numbered_by_files_not_by_sizes(spark, tmp_path):
    want, folder = [], tmp_path / "in"
    folder.mkdir()
    for k in range(12):  # Spark reads the largest file first
        part = [f"{k} {j} {'x' * (97 * k)}" for j in range(3 + k)]
        (folder / f"part-{k:05d}.txt").write_text("\n".join(part) + "\n")
        want += part
    assert [tuple(r) for r in sorted(lines.read_lines(spark, str(folder)).collect())] == list(enumerate(want))


def test_frames_come_back_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    caught = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: caught.append(f) or df)
    spark_frames = spark.createDataFrame([(0, 1, "a")], "frame_id long, rows long, text string")
    frames.compress_frames(spark_frames)
    packed = list(caught[0](iter([pa.RecordBatch.from_pydict({"frame_id": pa.array(range(50), pa.int64()), "rows": pa.array([1] * 50, pa.int64()), "text": ["x" * 5000] * 50})])))
    assert max(b.num_rows for b in packed) <= frames.HELD and sum(b.num_rows for b in packed) == 50
    whole = pa.Table.from_batches(packed).combine_chunks().to_batches()[0]
    frames.decompress_frames(spark_frames.selectExpr("frame_id", "rows", "'' coder", "0L original", "0L crc32", "binary('') payload"))
    back = list(caught[1](iter([whole.select(["frame_id", "rows", "coder", "original", "crc32", "payload"])])))
    assert max(b.num_rows for b in back) <= frames.HELD
    assert [t for b in back for t in b.column("text").to_pylist()] == ["x" * 5000] * 50 and all(all(b.column("ok").to_pylist()) for b in back)


def test_template_joins_leave_no_key_in_one_task(spark, monkeypatch):
    from weftline.operators import reshape, spread

    made = [(k, '{"a":%d,"p":{"k": %d}}' % (k, k) if k % 4 else '{"b":%d}' % k if k % 8 else "no object") for k in range(4000)]
    rows = spark.createDataFrame(made, "row_id long, line string").coalesce(1)
    for few, hot in ((spread.FEW_GROUPS, spread.HOT_ROWS), (0, 100), (0, 10**9)):
        monkeypatch.setattr(spread, "FEW_GROUPS", few)
        monkeypatch.setattr(spread, "HOT_ROWS", hot)
        parsed = reshape.tokenised_rows(rows)
        per = parsed.groupBy(F.spark_partition_id().alias("t")).count().collect()
        assert len(per) > 1 and max(r["count"] for r in per) < 2000  # dealt, though they come in one task
        grouped, rest = reshape.split_groups(parsed)
        back = reshape.unflatten_group(*reshape.flatten_group(reshape.columns_of(grouped)))
        assert sorted(map(tuple, reshape.reassemble(back, reshape.templates_of(grouped), rest).collect())) == made
        if hot == 100:
            tasks = grouped.groupBy(F.spark_partition_id().alias("t")).count().collect()
            assert max(r["count"] for r in tasks) < 2000  # 3,000 rows have one template


def test_simple_members_are_scanned_as_all_others():
    from weftline.operators import tokens as T

    for s in ('{"a":1}', ' { "a" : "x\\"}" , "b":{"k": "}"} } z', '{"a":{"b":{}}}', '{"a":1,}', '{"a" 1}', '{"a":1 2}', "{}", '{"a":"b"c}', '{"a":[1]}', '{"a":{]}}', "", "x", '{"a":1'):
        flat = T._flat_members(s)
        assert T.scan_members(s) == T._scanned_members(s) and (flat is None or flat == T._scanned_members(s))
    assert T._flat_members('{"a":{"k": 1},"b":-0.5}') is not None
