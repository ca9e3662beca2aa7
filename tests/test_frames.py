"""Typed blocks, frames, sources and the streaming writer."""

from helpers import SF
from pyspark.sql import functions as F

from weftline.operators import planner, profile, reshape
from weftline.operators.typed_block import decode_blocks, encode_blocks
from weftline.plans import catalogue
from weftline.sources import frames, lines


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_typed_blocks_come_back(spark):
    long = catalogue.long_form(spark, SF, "events", True)
    plan = planner.encoding_plan(*catalogue._costs(spark, SF, "events"))
    for p in (None, plan):
        blocks = encode_blocks(long, 128, p)
        assert rows(decode_blocks(blocks, 128).select("row_id", "col_id", "raw")) == rows(long)
    kinds = {r["col_id"]: r["encoding"] for r in encode_blocks(long, 4096, plan).collect()}
    assert kinds["event_id"] == "delta_varint" and kinds["ts"] == "timestamp" and kinds["user_id"] == "nulls"


def test_damaged_frames_are_reported(spark):
    packed = frames.compress_frames(frames.frame_texts(catalogue.event_lines(spark, SF), 100))
    bad = packed.withColumn("crc32", F.col("crc32") + F.when(F.col("frame_id") == 3, 1).otherwise(0))
    assert [r["frame_id"] for r in frames.decompress_frames(bad).filter("not ok").collect()] == [3]
    try:
        frames.verified(bad).collect()
        raise AssertionError("a damaged frame went unnoticed")
    except Exception as e:
        assert "damaged frame 3" in str(e)


def test_dictionary_frames(spark):
    texts = frames.frame_texts(catalogue.event_lines(spark, SF), 20)
    d = frames.train_dictionary([r["text"].encode() for r in texts.limit(50).collect()], 4096)
    back = frames.decompress_frames(frames.compress_frames(texts, coder="zstd_dict", dictionary=d), d)
    assert rows(back.select("frame_id", "text")) == rows(texts.select("frame_id", "text"))


def test_lines_keep_their_order(spark, tmp_path):
    path = tmp_path / "x.txt"
    path.write_text("\n".join(["a", "", "c\r", "d"] * 50) + "\n")
    got = sorted(lines.read_lines(spark, str(path)).collect())
    assert [r["row_id"] for r in got] == list(range(200)) and [r["line"] for r in got[:4]] == ["a", "", "c\r", "d"]
    lines.write_lines(lines.read_lines(spark, str(path)), str(tmp_path / "out"))
    assert sorted(lines.read_lines(spark, str(tmp_path / "out")).collect()) == got
    assert lines.read_documents(spark, str(path)).first()["size"] == path.stat().st_size


def test_stream_equals_batch(spark, tmp_path):
    from weftline.streaming.frames import read_line_stream, template_counts, write_frames

    folder = tmp_path / "in"
    folder.mkdir()
    text = [r["line"] for r in sorted(catalogue.event_lines(spark, SF).collect())]
    for k in range(4):
        (folder / f"{k}.txt").write_text("\n".join(text[k * 250 : (k + 1) * 250]) + "\n")
    write_frames(read_line_stream(spark, str(folder), 1), str(tmp_path / "out"), str(tmp_path / "cp"), 100).awaitTermination()
    back = frames.verified(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(x for r in back.collect() for x in r["text"].split("\n")) == sorted(text)
    q = template_counts(read_line_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("templates").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = reshape.template_groups(reshape.tokenised_rows(catalogue.event_lines(spark, SF)))
    assert rows(spark.table("templates").filter("template_id is not null").select("template_id", "rows", "cols")) == rows(batch.select("template_id", "rows", "cols"))


def test_plans_have_no_cartesian_product_and_prune_columns(spark):
    for name in ("infer_schema_events", "delta_encode_orders", "nested_flatten_props", "enum_encode_events"):
        text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    plan = catalogue.QUERIES["delta_encode_orders"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_lossless_guard_and_argmin(spark):
    df = spark.createDataFrame([(1, "a", "a"), (1, "b", "B"), (2, None, None)], "k int, x string, y string")
    assert rows(planner.lossless(df, "x", "y", ("k",))) == [(1, False), (2, True)]
    c = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 9)], "block_id int, path string, size int")
    assert rows(planner.smallest(c)) == [(1, "a", 5)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "row_id long, col_id string, raw string")
    assert profile.infer_schema(empty).count() == 0 and encode_blocks(empty).count() == 0


def test_frame_files_as_source_and_sink(spark, tmp_path):
    import weftline
    from weftline.sources.frame_files import FrameFiles, files_in_order

    spark.dataSource.register(FrameFiles)
    texts = frames.frame_texts(catalogue.event_lines(spark, SF), 40).select("frame_id", "text")
    out = str(tmp_path / "out")
    texts.write.format("weftline").mode("append").save(out)
    back = spark.read.format("weftline").option("per_task", "3").load(out)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in texts.collect()) and {r["format"] for r in back.collect()} == {"ndjson"}
    texts.limit(2).write.format("weftline").mode("overwrite").save(out)
    assert spark.read.format("weftline").load(out).count() == 2
    (tmp_path / "b.wft").write_bytes(weftline.compress(b"one") + weftline.compress(b"two"))
    assert [r["text"] for r in spark.read.format("weftline").load(str(tmp_path / "b.wft")).orderBy("frame_no").collect()] == ["one", "two"]
    assert [p.rsplit("/", 1)[1] for p in files_in_order(str(tmp_path))] == ["b.wft"]


def test_windows_over_blocks_of_blocks(spark):
    import random

    from weftline.operators import encode, stats

    r = random.Random(1)
    values = [r.randrange(3) for _ in range(400)] + [7] * 130 + [1, 2]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v long")
    summary = df.selectExpr("k b", "v")
    before = {x["b"]: x["p"] for x in encode.previous(summary, "b", "v", "p", 7).collect()}
    assert before == {k: values[k - 1] if k else None for k in range(len(values))}
    sums = {x["b"]: x["s"] for x in encode.sum_before(summary, "b", "v", "s", 7).collect()}
    assert sums == {k: sum(values[:k]) for k in range(len(values))}
    from itertools import groupby

    want = sorted(len(list(g)) for _, g in groupby(values))
    for block in (3, 5, 1000):
        out = {x["run_len"]: x["n"] for x in stats.run_lengths(df, "k", F.col("v"), block).collect()}
        assert out == {n: want.count(n) for n in set(want)}, block


def test_dictionary_keeps_every_row(spark):
    from weftline.operators import encode

    df = spark.createDataFrame([(k, None if k % 9 == 0 else f"v{k % 400}") for k in range(1000)], "k long, v string")
    codes = encode.dictionary(df, "v")
    coded = encode.dict_encode(df, "v", codes)
    assert codes.count() == 255 and coded.count() == 1000
    back = encode.dict_decode(coded.select("k", "code", "literal"), codes)
    assert sorted((r["k"], r["value"] or "") for r in back.collect()) == sorted((r["k"], r["v"] or "") for r in df.collect())


def test_wide_objects_flatten(spark):
    rows = [(k, "{" + ", ".join(f'"k{k}_{j}": {j}' for j in range(300)) + "}") for k in range(40)]
    apart = reshape.taken_apart(spark.createDataFrame(rows, "row_id long, j string"), "j")
    cells = reshape.nested_cells(apart)
    assert cells.count() == 12000
    assert sorted(map(tuple, reshape.rebuild_objects(cells, reshape.nested_shells(apart)).collect())) == rows


def test_key_list_equals_the_scanner(spark):
    import random

    from weftline.operators.tokens import find_keys, key_list

    r = random.Random(4)
    texts = ["".join(r.choice(['"', ":", "\\", "a", " ", "{", "}", ",", "\n", "é"]) for _ in range(r.randint(0, 25))) for _ in range(500)] + ['{"a\\"b" : {"c":"d:"}, "e":1}', '"' + "\\n" * 50000 + '":']
    out = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", key_list("t").alias("x")).collect()
    assert all(x["x"] == find_keys(texts[x["k"]]) for x in out)


def test_grams_equal_brute_force(spark, monkeypatch):
    import random
    from collections import Counter

    from weftline.operators import stats

    monkeypatch.setattr(stats, "PIECE", 50)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdé日\U0001f600 \n") for _ in range(r.choice([0, 1, 3, 30, 400]))) for _ in range(60)] + [None, "", "".join(chr(200 + k) for k in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for back in ((), (1,), (2,), (3, 1), (4, 3, 2, 1), tuple(range(9, 0, -1))):
        want = Counter(("".join(t[k - b] for b in back), t[k]) for t in texts if t for k in range(max(back, default=0), len(t)))
        got = {(x["ctx"], x["next"]): x["n"] for x in stats.grams(df, back).collect()}
        assert got == dict(want), back
