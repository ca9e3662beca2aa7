"""The corpus operators against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Nulls in any column, empty and long texts, ties, repeated rows, near and exact copies."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = [" ".join(word() for _ in range(r.randint(1, 400))) for _ in range(40)]
    near = [base[0].replace(" ", "  ", 2), base[1] + " tail", base[2].upper(), "x " + base[3], base[5][: len(base[5]) // 2] + " changed " + base[5][len(base[5]) // 2 :]]
    passage = base[7][:700]
    texts = [*base, *near, base[0], base[0], "pre " + passage, passage + " post", passage, None, "", " \n\t", "é" * 300, "é" * 300 + "x", "a" * 1000, "ab " * 3000, " ".join(word() for _ in range(30000)), base[6], "日本語 " * 90, "one", "a b c"]
    rows = [(k, t, "en" if k % 3 else None, [None, "a", "b", "é"][k % 4] if k % 5 else "hot", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows + [rows[4], rows[4], rows[-3], (None, base[8], None, None, None), (9, base[9] + " other text, same id", "en", "a", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names clash with what the operators add
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).withColumn("wl_row", F.lit(1)).withColumn("kinds", F.lit("k")).withColumn("fp", F.lit(2)).withColumn("target", F.lit(0.5))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def repeats(rows, length):
    seen, out = Counter(), []
    bodies = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in bodies:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    for i, b in bodies:
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [200, 64])
def test_suffix_dedup(docs, rows, length):
    from weftline.llm.suffix_dedup import remove_repeats

    assert got(remove_repeats(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(rows, length)


def test_suffix_dedup_keeps_the_rest_and_takes_empty_tables(docs, empty):
    from weftline.llm.suffix_dedup import remove_repeats

    assert remove_repeats(empty).count() == 0
    for r in remove_repeats(docs, with_kept=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_suffix_dedup_of_texts_whose_short_hashes_collide(spark):
    import xxhash

    from weftline.llm.suffix_dedup import remove_repeats

    seen = {}
    for k in range(10**6):  # two texts that agree in the upper 32 bits of Spark's hash
        text = hashlib.shake_256(str(k).encode()).hexdigest(150)
        other = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), 42) >> 32, text)
        if other != text:
            break
    rows = [(None, text, "en", "a", 300), (None, other, "en", "a", 300), (5, text, "en", "a", 300), (-(2**63), "id " + other[:150], "en", "a", 153)]
    assert got(remove_repeats(spark.createDataFrame(rows, DOCS)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(rows, 200)


def test_anchors_of_split_texts_cover_all_windows():
    from weftline.llm.suffix_dedup import anchors, buckets

    raw = np.frombuffer(("".join(random.Random(2).choice("ab") for _ in range(3000)) + "q" * 900).encode(), np.uint8)
    _, first, n, _, _ = anchors(raw, np.array([0]), np.array([3900]), 200)
    assert sorted(k for f, m in zip(first, n, strict=True) for k in range(f, f + m)) == list(range(3701))
    _, full = buckets(raw, 200)
    equal = defaultdict(set)
    for k, b in enumerate(full):
        equal[b].add(raw[k : k + 200].tobytes())
    assert max(map(len, equal.values())) == 1 and len(equal) == len({raw[k : k + 200].tobytes() for k in range(3701)})


def test_exact_dedup(docs, rows, empty):
    from weftline.llm.exact_dedup import exact_dedup

    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = sorted(((i, min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for *_, i in g), key=str)
    for fan_in in (2, 8):
        out = exact_dedup(docs, fan_in=fan_in)
        assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == want
        assert sum(r["kept"] for r in out.collect()) == len(groups)
    assert exact_dedup(empty).count() == 0


def test_tree_merge_rounds(spark):
    from pyspark.sql import functions as F

    from weftline.llm.exact_dedup import digest_table, tree_merge

    d = digest_table(spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).cast("string").alias("text"))).withColumn("run", F.col("id") % 100).cache()
    assert got(tree_merge(d, 100, 3).select("best.id", "copies"), "id", "copies") == sorted([(k, 1000 // 7 + (k < 1000 % 7)) for k in range(7)], key=str)


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from weftline.llm.token_count import Counter as Pieces
    from weftline.llm.token_count import count_tokens, unigram_vocabulary
    from weftline.llm.token_ids import vocabulary

    path = vocabulary("piece_bpe_32k.model")
    pieces = unigram_vocabulary(path)
    split = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.Metaspace("▁", "always", True)])
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = split
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    assert got(count_tokens(docs, path), "doc_id", "n_tokens") == sorted(((i, size(t)) for i, t, *_ in rows), key=str)
    assert count_tokens(empty, path).count() == 0
    tied = [(p, float(-(k % 5))) for k, (p, _) in enumerate(pieces)]  # whole scores: ties everywhere
    tok = Tokenizer(models.Unigram(tied, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = split
    count, r = Pieces(tied), random.Random(4)
    for _ in range(500):
        t = "".join(r.choice("abé ion\nß1日▁") for _ in range(r.randint(0, 40)))
        assert count(t) == size(t)


def test_targets(spark):
    from weftline.llm.mixing import targets

    def water(sizes, weights, most=3.0):
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
        left, open_, out = float(sum(sizes.values())), set(order), {}
        while True:
            level = left / sum(w[s] for s in open_) if open_ else 0
            over = [s for s in open_ if level * w[s] > most * sizes[s]]
            if not over:
                return out | {s: level * w[s] for s in open_}
            for s in over:
                out[s] = most * sizes[s]
                left -= out[s]
                open_.remove(s)

    r = random.Random(3)
    for n in (1, 2, 5, 30):
        sizes = {f"s{k}" if k else None: r.choice([0, 1, 5, 100, 10000]) for k in range(n)}
        want = water(sizes, (5, 2, 1))
        for x in targets(spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")).collect():
            assert x["target"] == pytest.approx(want[x["source"]])


def test_mixing(docs, rows, empty, monkeypatch):
    from weftline.llm.mixing import mix

    out = mix(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out if r["doc_id"] is not None) == sorted((i, len(WORD.findall(t or ""))) for i, t, *_ in rows if i is not None)
    taken, size = defaultdict(int), defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["repeats"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] = r["size"] if r["size"] > size[r["source"]] else size[r["source"]]
    for r in out:
        assert abs(taken[r["source"]] - r["target"]) <= max(0.02 * r["target"], size[r["source"]])
    assert sorted(map(str, out)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert mix(empty).count() == 0


def test_mixing_in_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK", 64)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 37))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    out = mixing.mix(df).groupBy("source", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in out) == 4000 and all(abs(r["t"] - r["target"]) < 0.005 * r["target"] + 5 for r in out)


def test_flight_keeps_totals():
    from weftline.llm.mixing import flight

    r = np.random.default_rng(1)
    size, p = r.integers(1, 50, 500).astype(float), r.random(500)
    q = flight(size, p, r.random(500))
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum(), abs=1e-5) and (q * size).sum() == pytest.approx((p * size).sum(), abs=1e-4)


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, linked):
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [low.get(find(k)) for k in range(len(ids))]


def test_simhash(docs, rows, empty):
    from weftline.llm.simhash import near_duplicates

    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = components([r[0] for r in rows], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fp, comp, strict=True)), key=str)
    assert got(near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile,bucket", [(1024, 1024), (16, 4)])
def test_simhash_links_in_tiles_and_more_tables(spark, monkeypatch, tile, bucket):
    from weftline.llm import simhash
    from weftline.llm.components import connected_components

    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(8)
    centres = [r.getrandbits(64) for _ in range(150)]
    near = [c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 9))) for c in centres for _ in range(3)]
    cluster = [centres[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted({*centres, *near, *cluster})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    low = components(signed, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    found = {x["node"]: x["root"] for x in connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    assert [found.get(s, s) for s in signed] == low


def test_bit_slices():
    from weftline.llm.simhash import forest, within

    r = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 300):
        m = r.integers(0, 2**63, n, dtype=np.uint64)
        m[n // 2 :] = m[: n - n // 2] ^ np.uint64(0b1011)
        for radius in (0, 1, 3, 4, 7):
            got_bits = np.unpackbits(within(m, radius).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
            assert (got_bits == (np.bitwise_count(m[:, None] ^ m[None, :]) <= radius)).all()
        assert len(forest(m, 4)) <= n - 1


def test_components_of_chains_and_stars(spark):
    from weftline.llm.components import connected_components

    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(200, 260)] + [(5000, 5000), (7, 3)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(61)} | {k: 200 for k in [*range(200, 260), 1000]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind,name", [("byte_level", "byte_bpe_50k.json"), ("words", "word_bpe_49k.json")])
def test_token_ids_equal_the_library(rows, kind, name):
    from tokenizers import Tokenizer

    from weftline.llm.token_ids import encoder, vocabulary

    encode, r = encoder(kind, vocabulary(name)), random.Random(6)
    odd = ["", " ", "\n", "a  b", " x", "x ", "it's we'LL 'tis", "a\x1cb c", "İ ΑΣ ſ", "<|endoftext|> a", "a\r\nb\n\n c", "x " + "y" * 200, "e\n \n\n  f", "\0a", "a.b, c-d... 12 345"]
    odd += ["".join(r.choice("ab éß'\n ,.1\t́İΣ日$　") for _ in range(r.randint(1, 30))) for _ in range(800)]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "a", " ", "  ", "\n", "\0", "é", "'ll", ".", "日", "\t", "x" * 70]
    odd += ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    whole = Tokenizer.from_file(vocabulary(name))
    for t in [x[1] or "" for x in rows[:60]] + odd:
        ids = encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(t, add_special_tokens=False).ids, t


def test_token_ids_of_texts_with_nul():
    import public_tokenizers
    from tokenizers import Tokenizer

    from weftline.llm.token_ids import ByteLevelIds

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = ByteLevelIds(path), Tokenizer.from_file(path)
    for t in ["a \0b", "\0a", "\0", " \0", "a\n\0b c", "a \0\0b \0b", "x\0 y \n\0"]:
        ids = encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole.encode(t, add_special_tokens=False).ids, t


def ids_of(name, end):
    from tokenizers import Tokenizer

    from weftline.llm.token_ids import vocabulary

    tok = Tokenizer.from_file(vocabulary(name))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(docs, rows, empty, monkeypatch):
    from weftline.llm import packing
    from weftline.llm.token_ids import vocabulary

    path, ids = vocabulary("byte_bpe_50k.json"), ids_of("byte_bpe_50k.json", 0)
    for size in (4 << 20, 20_000):
        monkeypatch.setattr(packing, "BIN_BYTES", size)
        out = packing.pack(packing.tokenised(docs, path), with_ids=True).collect()
        own, seqs = defaultdict(list), defaultdict(list)
        for p in out:
            assert crc(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
            own[p["doc_id"]].append(p)
            seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        want = defaultdict(list)
        for i, t, *_ in rows:
            want[i].append(ids(t))
        for i, texts in want.items():
            assert sum(p["length"] for p in own[i]) == sum(map(len, texts))
            if len(texts) == 1:
                pieces = sorted(own[i], key=lambda p: p["start"])
                assert [x for p in pieces for x in p["ids"]] == texts[0] and {p["doc_tokens"] for p in pieces} == {len(texts[0])}
                assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        total = 0
        for pieces in seqs.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 1024
            total += 1024 - at
        assert total < 1024 * (1 if size > 1 << 20 else len({p["sequence_id"] >> 32 for p in out}))
    assert packing.pack(packing.tokenised(empty, path)).count() == 0


def test_packing_balances_cost():
    from weftline.llm.packing import plan

    lengths = np.array([1000, 900, 300, 300, 200, 100, 100, 50, 40, 30, 20])
    seqs = defaultdict(list)
    for _, _, length, seq, _ in plan(lengths):
        seqs[seq].append(length)
    assert len(seqs) == 3 and all(sum(x) <= 1024 for x in seqs.values()) and sum(map(sum, seqs.values())) == lengths.sum()


def test_quality(spark):
    from pyspark.sql import functions as F

    from weftline.llm import quality_pu as Q

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train(docs, labels)
    out = {r["doc_id"]: r for r in Q.score(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    pairs = [(out[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.5 for s in good]) > 0.95 and np.mean([s < 0.5 for s in bad]) > 0.8
    # labels of the held-out fold, and other columns, change nothing
    spoiled = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.train(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")), spoiled)
    assert np.array_equal(again.w1, model.w1) and again.b2 == model.b2


def test_quality_edges(docs, rows, empty, spark):
    from weftline.llm import quality_pu as Q

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train(docs, none)
    out = Q.score(docs, model)
    assert out.count() == len(rows) and {r["score"] for r in out.collect()} == {0.5}
    assert Q.score(empty, model).count() == 0 and Q.train(empty, none).prior == 0.5
    some = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, some, positives=5, unlabelled=7)
    assert 0 < model.prior < 1 and Q.score(docs, model).count() == len(rows)
    assert Q.accept(docs, model).columns == docs.columns
    assert not Q.features(None).any() and not Q.features("").any() and np.isfinite(Q.features("a" * 3_000_000)).all()


PII = [
    (1, "Dear Mr. John Smith and Mrs. Jane Smith; Herr Müller, госпожа Анна Иванова. Card 4111 1111 1111 1111 or 4111111111111111", "k"),
    (2, "mail a.b@ex.com or A.B@EX.com, call +49 30 1234 5678 or +1 (377) 555-0271, ssn 123-45-6789", None),
    (3, 'host 10.0.0.1. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "k"),
    (4, "no personal data: version 1.2.3, year 2024, ratio 3.14159, id 12345", "k"),
    (5, None, "k"), (6, "", "k"), (7, "  spaces\n\nkept ", "k"), (8, "x" * 200_000 + " 10.0.0.1 " + "é" * 100_000, "k"), (9, "Mr. John Smith again, a.b@ex.com", "k"), (9, "Mr. John Smith again, a.b@ex.com", "k"),
]


def test_surrogates(spark):
    from weftline.llm.surrogates import replace_personal_data

    df = spark.createDataFrame(PII, "doc_id long, text string, kinds string").repartition(2)
    out = replace_personal_data(df, "key").collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(PII)
    for i in (4, 5, 6, 7):
        assert by[i]["text"] == dict((a, b) for a, b, _ in PII)[i] and by[i]["n_entities"] == 0
    for real in ("John", "Smith", "Jane", "Müller", "Анна", "Иванова", "4111", "a.b@", "A.B@", "555-0271", "123-45-6789", "10.0.0.1", "04dbebab"):
        assert not any(real in (r["text"] or "") for r in out), real
    one = re.match(r"Dear Mr[.] (\w+) (\w+) and Mrs[.] (\w+) (\w+); Herr (\w+), \w+ ([Ѐ-ӿ]+) ([Ѐ-ӿ]+)[.] Card ([0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}) or ([0-9]{16})$", by[1]["text"])
    assert one[2] == one[4] and one[1] != one[3] and one[8].replace(" ", "") == one[9]
    digits = [int(c) for c in one[9]][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert by[9]["text"].startswith(f"Mr. {one[1]} {one[2]} again, ")
    mails = re.findall(r"\S+@[^\s,]+", by[2]["text"])
    assert mails[0] == mails[1].lower() and mails[0] in by[9]["text"] and mails[0].endswith(".com")
    assert re.search(r'token = "[0-9a-f]{40}"', by[3]["text"])
    assert by[8]["text"].startswith("x" * 200_000) and re.search(r" (\S+) é", by[8]["text"])[1] == re.search(r"host (\S+)[.] ", by[3]["text"])[1]
    assert sorted(map(str, out)) == sorted(map(str, replace_personal_data(df, "key").collect()))
    assert {r["text"] for r in replace_personal_data(df, "other").collect() if r["doc_id"] == 3} != {by[3]["text"]}
    assert replace_personal_data(spark.createDataFrame([], "doc_id long, text string"), "key").count() == 0


def brute_surrogates(rows, table):
    """Texts with entities replaced by a table {(kind, canon): surrogate}, one match after the other."""
    import regex

    from weftline.llm import surrogates as S

    kinds = [("email", S.EMAIL), ("ip", S.IP), ("ssn", S.SSN), ("card", S.CARD), ("phone", S.PHONE), ("name", S.NAME), ("secret", r"[\s\S]*")]
    genders = {c: k for (k, c) in sorted(table, reverse=True) if k in ("given_m", "given_f")}

    def cased(mention, new):
        if mention == mention.upper() and len(mention) > 1:
            return new.upper()
        return new if mention == mention.lower() else "".join(c.upper() if k < len(mention) and mention[k].isupper() else c for k, c in enumerate(new))

    def name(mention, known):
        title = regex.match(S.TITLE, mention)[0]
        gender = "given_m" if regex.match(rf"(?:{S._MALE})(?![\w-])", title) else "given_f" if regex.match(rf"(?:{S._FEMALE})(?![\w-])", title) else "given_u"
        words, out = mention[len(title) + 1 :].split(" "), [title]
        for k, w in enumerate(words):
            if w[0].isupper():
                kind = "family" if k == len(words) - 1 else gender if gender != "given_u" else genders.get(w.lower(), "given_u")
                known.setdefault(w.lower(), set()).add(("given_u" if kind != "family" and gender == "given_u" else kind, table[kind, w.lower()]))
                w = cased(w, table[kind, w.lower()])
            out.append(w)
        return " ".join(out)

    def digits(mention, new):
        it = iter(new)
        return "".join(next(it) if c in "0123456789" else c for c in mention) + "".join(it)

    out = []
    for text in rows:
        known, n, parts, at = {}, 0, [], 0
        for m in regex.finditer(S.FOUND, text):
            kind = next(k for k, rx in kinds if regex.fullmatch(rx, m[0]))
            parts += [(False, text[at : m.start()])]
            at, n = m.end(), n + 1
            if kind == "name":
                new = name(m[0], known)
            else:
                canon = regex.sub("[^0-9]", "", m[0]) if kind in S.DIGITS else m[0].lower() if kind == "email" else m[0]
                new = digits(m[0], table[kind, canon]) if kind in S.DIGITS else cased(m[0], table[kind, canon]) if kind == "email" else table[kind, canon]
            parts += [(True, new)]
        parts += [(False, text[at:])]
        done = []
        for fixed, part in parts:
            for t in [part] if fixed else regex.findall(S._TOKEN, part):
                if not fixed and t[:1].isupper() and t.lower() in known:
                    t, n = cased(t, min(known[t.lower()])[1]), n + 1
                done.append(t)
        out.append(("".join(done), n))
    return out


def test_surrogates_equal_brute_force(spark):
    from weftline.llm import surrogates as S

    r = random.Random(21)
    titles = ["Mr", "Mr.", "Mrs.", "Ms", "Herr", "Herr Dr.", "Frau", "Dr.", "Prof. Dr.", "господин", "госпожа", "κύριος", "Mme"]
    given, family = ["John", "Anna", "Jean-Luc", "Zoë", "Иван", "Анна", "Γιώργος", "Al"], ["Smithson", "O'Brien", "von Berg", "Müller", "Иванова", "Παπαδόπουλος", "Li", "SMITH"]
    other = ["a.b@ex.com", "A.B@EX.com", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234 5678", "(030) 123 4567", "123-45-6789", 'token = "abcdef123456"', "the", "The", "word", "Smithsonian", "John", "said", "é", "2024", "1.2.3", "\n", "x@", "Mr", "Dr."]

    def piece():
        k = r.random()
        if k < 0.25:
            return " ".join([r.choice(titles), *([r.choice(given)] if r.random() < 0.6 else []), r.choice(family)])
        return r.choice(given) + " " + r.choice(family) if k < 0.4 else r.choice([*given, *family]) + r.choice(["", "'s", ","]) if k < 0.5 else r.choice(other)

    texts = ["".join(piece() + r.choice([" ", ", ", ". "]) for _ in range(r.randint(0, 12))) for _ in range(250)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = df.selectExpr("doc_id row", f"posexplode(regexp_extract_all(text, {S._literal(S.FOUND)}, 0)) as (pos, mention)")
    units = S._units(found.withColumn("kind", S.kind_of(found["mention"]))).filter("kind <> 'as_is'").select("kind", "canon").distinct().collect()
    sure = {(k, c) for k, c in units if k != "given_u"}
    known = {c for k, c in sure if k.startswith("given")}
    every = sure | {(k, c) for k, c in units if c not in known}
    table = {(x["kind"], x["canon"]): x["surrogate"] for x in S.surrogate_table(spark.createDataFrame(sorted(every), "kind string, canon string"), "key").collect()}
    assert set(table) == every and len(set(table.values())) == len(table)
    got_rows = sorted((x["doc_id"], x["text"], x["n_entities"]) for x in S.replace_personal_data(df, "key").collect())
    assert got_rows == [(k, t, n) for k, (t, n) in enumerate(brute_surrogates(texts, table))]


def test_surrogates_keep_who_is_who(spark):
    from weftline.llm.surrogates import replace_personal_data

    r = random.Random(2)
    names = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)).capitalize() for _ in range(60)]
    names = sorted(set(names))[:50]
    texts = [f"Mr {g} Smithson came. {g} Smithson spoke, {g} left; Dr Smithson and SMITHSON stayed." for g in names]
    out = [x["text"] for x in replace_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").orderBy("doc_id").collect()]
    got = [re.fullmatch(r"Mr (\w+) (\w+) came[.] (\w+) (\w+) spoke, (\w+) left; Dr (\w+) and (\w+) stayed[.]", t).groups() for t in out]
    assert {g[1] for g in got} == {got[0][1]} and len({g[0] for g in got}) == len(names) and got[0][1] != "Smithson"
    assert all(a == c == e and b == d == f and h == b.upper() for a, b, c, d, e, f, h in got)
    assert not {g[0] for g in got} & set(names)


def test_surrogates_stay_distinct(spark):
    from weftline.llm.surrogates import surrogate_table

    # far too few one-letter names for all to differ at the first attempt
    many = [("email", f"{c}@x.com") for c in "abcdefghijklmnopqrstuvwxyz"] + [("ip", f"10.0.0.{k}") for k in range(60)] + [("secret", f"{k:08d}") for k in range(50)]
    out = surrogate_table(spark.createDataFrame(many, "kind string, canon string"), "k").collect()
    assert len(out) == len(many) == len({(r["kind"], r["surrogate"]) for r in out})
    assert not {(r["kind"], r["surrogate"]) for r in out} & set(many)


def brute_top(vectors, queries, k):
    code = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors}
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(code[q], c, strict=False)), i) for i, c in code.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_vector_file(spark, monkeypatch):
    from weftline.llm import vector_file as V

    r = np.random.default_rng(3)
    vectors = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(r.normal(size=(400, 16)))] + [(400 + k, [1.0] * 16) for k in range(60)] + [(460, [0.0] * 16), (461, [1.0, 2.0]), (462, [])]
    bad = [(500, None), (501, [1.0, None]), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").repartition(3)
    queries = [i for i, _ in vectors if i % 20 == 0]
    for size in (4096, 50):
        monkeypatch.setattr(V, "ROWS", size)
        monkeypatch.setattr(V, "QUERIES", size // 2)
        out = V.top_k(df, df.filter("vec_id % 20 = 0"), 5)
        assert got(out, "query_id", "rank", "vec_id", "score") == brute_top(vectors, queries, 5)
    few = df.filter("vec_id < 3")
    assert V.top_k(few, few.filter("vec_id = 0"), 5).count() == 2
    assert V.top_k(df.limit(0), df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (50, [1e30, 1.0])], "vec_id long, embedding array<float>")
    assert V.top_k(huge, huge).first()["score"] == 2**63 - 1


def test_approximations_bound_scores():
    from weftline.llm.vector_file import Approximations

    r = np.random.default_rng(4)
    for bits, dims in ((4, 8), (4, 7), (5, 3)):
        rows, queries = r.integers(-300, 300, (501, dims)), r.integers(-300, 300, (20, dims))
        file = Approximations(rows, bits)
        back = Approximations.unpack(501, dims, *file.pack())
        low, high = back.bounds(queries)
        assert (high >= queries @ rows.T).all() and (low <= queries @ rows.T).all() and (high - low).mean() < 100 * 300 * dims and (back.cell == file.cell).all()


def test_vector_file_reads_few_exact_vectors(spark, monkeypatch):
    from weftline.llm import vector_file as V

    monkeypatch.setattr(V, "ROWS", 100)
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(r.normal(size=(2000, 12)))], "vec_id long, embedding array<double>").repartition(3)
    file = V.write_vectors(df, 5)
    assert sum(x["n"] for x in file.select("n").collect()) == 2000 and file.count() >= 20
    ids, mine = np.array([0], np.int64), V.quantised([np.array(df.filter("vec_id = 0").first()["embedding"])], 12, 256.0)
    found = file.mapInArrow(V._scanner(ids, mine.astype(float), 5), V._FOUND)
    assert 5 <= found.count() < 1000


def test_vector_file_repeated_ids_and_vectors(spark, monkeypatch):
    from weftline.llm import vector_file as V

    for size in (16384, 3):
        monkeypatch.setattr(V, "QUERIES", size)
        rows = [(k, [1.0, 2.0]) for k in range(500)] + [(7, [1.0, 2.0])] * 200 + [(7, [3.0, 0.5]), (7, [-9.0, 0.0]), (600, [9.0, 9.0]), (600, [8.0, 8.0]), (600, [7.5, 8.0]), (50, [0.5, 0.5])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 id", "2 q").repartition(4)
        out = V.top_k(df, df.filter("vec_id % 50 = 0"), 5)
        code = {}
        for i, v in rows:
            code.setdefault(i, []).append([int(np.floor(256 * x)) for x in v])
        want = []
        for q in [i for i in code if i % 50 == 0]:
            scored = sorted((-max(a[0] * b[0] + a[1] * b[1] for a in code[q] for b in vs), i) for i, vs in code.items() if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:5], 1)]
        assert got(out, "query_id", "rank", "vec_id", "score") == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files(docs, rows, empty, kind):
    from weftline.llm.plane_store import read_token_files, write_token_files
    from weftline.llm.token_ids import vocabulary

    path, ids = vocabulary("word_bpe_49k.json"), ids_of("word_bpe_49k.json", 1)
    out = read_token_files(write_token_files(docs, path, kind=kind), with_ids=True).collect()
    want = sorted(((i, len(x), crc(x)) for i, t, *_ in rows for x in [ids(t)]), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out), key=str) == want
    out.sort(key=lambda r: r["start"])
    assert [r["start"] for r in out] == [sum(q["n_tokens"] for q in out[:k]) for k in range(len(out))]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert order == sorted(order) and all(crc([x & 0xFFFFFFFF for x in r["ids"]]) == r["ids_crc32"] for r in out)
    assert read_token_files(write_token_files(empty, path)).count() == 0


def test_planes_and_damage(tmp_path):
    from weftline.llm.plane_store import PlaneWriter, from_planes, read_planes, to_planes

    r = np.random.default_rng(7)
    for kind in ("bit", "byte"):
        for n in (0, 1, 9, 65536):
            a = r.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
            assert (from_planes(to_planes(a, kind), n, kind) == a).all()
    uri = f"file://{tmp_path}/x.planes"
    w = PlaneWriter(uri)
    docs = [(k, r.integers(0, 50000, int(r.integers(0, 9000))).astype("<u4")) for k in range(60)] + [(61, r.integers(0, 50000, 300_000).astype("<u4"))]
    for k, ids in docs:
        w.add(k, ids.tobytes())
    w.close()
    assert all(a == b and (x == y).all() for (a, x), (b, y) in zip(docs, read_planes(uri), strict=True))
    body = bytearray((tmp_path / "x.planes").read_bytes())
    body[100] ^= 255
    (tmp_path / "x.planes").write_bytes(body)
    with pytest.raises(Exception):  # noqa: B017
        list(read_planes(uri))


def test_merge_rounds_sort_their_runs(spark):
    from pyspark.sql import functions as F

    from weftline.llm.exact_dedup import digest_table, merge_round, tree_merge

    d = digest_table(spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    state = d.select("run", "sha", "chk", "nlen", F.struct(F.lit(0).alias("neg_len"), F.lit(False).alias("no_id"), "id", "row").alias("best"), F.lit(1).cast("long").alias("copies"))
    plan = merge_round(state, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2 and plan.count("Sort [run#") >= 2 and "Python" not in plan
    out = tree_merge(d, 4, 2)
    assert out.count() == 50


def test_spread_join_deals_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k <> 49")
    top = {r["k"]: (r["n"], r["top"]) for r in groups.collect()}
    joined = common.spread_join(rows, groups, ["k"], "n", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = common.spread_join(rows, groups, ["k"], "n", 1000)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(k#\d+L?, wl_deal#\d+L", plan)
    out = joined.collect()
    assert len(out) == 1000 and all((r["n"], r["top"]) == top.get(r["k"], (None, None)) for r in out)


def test_exact_dedup_of_many_repeated_rows(spark):
    from weftline.llm.exact_dedup import exact_dedup

    df = spark.createDataFrame([(None if k % 3 else 5, "same text", k) for k in range(3000)] + [(k, f"own {k}", k) for k in range(50)], "doc_id long, text string, row long").repartition(7)
    out = exact_dedup(df, carry=("text",)).collect()
    assert len(out) == 3050 and sum(r["kept"] for r in out) == 51 and {r["keep_id"] for r in out if r["text"] == "same text"} == {5} and {r["group_size"] for r in out} == {1, 3000}


def test_repeated_rows_spread_over_bins_and_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.llm import packing, plane_store
    from weftline.llm.token_ids import vocabulary

    monkeypatch.setattr(packing, "BIN_BYTES", 4000)
    monkeypatch.setattr(plane_store, "SMALL_BYTES", 4000)
    df = spark.createDataFrame([(None, f"same words {k % 40}") for k in range(2000)] + [(7, "x y")] * 300 + [(-(2**63), "a")], "doc_id long, text string").repartition(4)
    ids = packing.tokenised(df, vocabulary("byte_bpe_50k.json"))
    assert ids.groupBy("bin").count().agg(F.max("count")).first()[0] < 500
    files = plane_store.write_token_files(df, vocabulary("word_bpe_49k.json"))
    assert files.count() > 3 and files.agg(F.max("n_docs")).first()[0] < 1500
    out = sorted(plane_store.read_token_files(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None] * 2000 + [-(2**63)] + [7] * 300
    again = sorted(plane_store.read_token_files(plane_store.write_token_files(df.repartition(7), vocabulary("word_bpe_49k.json"))).collect(), key=lambda r: r["start"])
    assert out == again


def test_manifest_is_one_file(spark, monkeypatch):
    from weftline.llm import plane_store
    from weftline.llm.token_ids import vocabulary

    monkeypatch.setattr(plane_store, "SMALL_BYTES", 500)
    df = spark.createDataFrame([(k, f"some words {k}") for k in range(200)], "doc_id long, text string").repartition(4)
    files = plane_store.write_token_files(df, vocabulary("word_bpe_49k.json"))
    assert files.count() > 3 and len(files.inputFiles()) == 1


def test_suffix_dedup_of_hot_passages_and_repeated_rows(spark, monkeypatch):
    from weftline.llm import suffix_dedup as S

    monkeypatch.setattr(S, "REFINED", 8)
    r = random.Random(12)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage = noise(260)
    rows = [(k, noise(r.randint(0, 150)) + passage[r.randint(0, 30) : r.randint(225, 260)] + noise(r.randint(0, 150))) for k in range(150)]
    rows += [(None, "same row " * 60)] * 300 + [(7, noise(400))] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(rows, 200)
    keyed = df.selectExpr("coalesce(doc_id, -1) id", "xxhash64(doc_id, text) mark", "doc_id is null none", "cast(text as binary) body")
    runs = S.repeated_windows(keyed, 200)[0].filter("id = -1").collect()
    assert len(runs) < 100 and max(x["n"] or 0 for x in runs) == 300


def test_suffix_dedup_of_many_repeated_rows(spark):
    from weftline.llm.suffix_dedup import remove_repeats

    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(400))
    df = spark.range(10_000).selectExpr("if(id % 2 = 0, null, 3L) doc_id", f"'{text}' text")
    out = remove_repeats(df).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"], r["count"]) for r in out) == [("3", 400, 1, 5000), ("None", 400, 1, 5000)]


def test_quality_risk_and_its_gradient():
    from weftline.llm.quality_pu import risk

    r = np.random.default_rng(2)
    p, u = r.normal(size=(30, 6)) + 0.5, r.normal(size=(50, 6))
    w = [r.normal(size=(6, 4)), r.normal(size=4), r.normal(size=4), r.normal(size=1)]

    def brute(w, prior):
        score = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        loss = lambda z: 1 / (1 + np.exp(z))
        return prior * loss(score(p)).mean(), loss(-score(u)).mean() - prior * loss(-score(p)).mean()

    seen, plain = set(), u
    for prior in (0.2, 0.5, 0.99):
        for far in (False, True):  # unlabelled rows with the lowest scores of all make the negative part negative
            u = plain if not far else -3 * np.sign(w[0] @ w[2])[None, :].repeat(50, 0)
            positive, negative, grads = risk(w, p, u, prior)
            assert (positive, negative) == pytest.approx(brute(w, prior))
            seen.add(negative >= 0)
            target = (lambda w: sum(brute(w, prior))) if negative >= 0 else (lambda w: -brute(w, prior)[1])  # noqa: B023
            for k, g in enumerate(grads):
                for at in list(np.ndindex(w[k].shape))[:5]:
                    a, b = [x.copy() for x in w], [x.copy() for x in w]
                    a[k][at] += 1e-5
                    b[k][at] -= 1e-5
                    assert g[at] == pytest.approx((target(a) - target(b)) / 2e-5, abs=1e-6)
    assert seen == {True, False}


def test_prior_of_positives_and_unlabelled():
    from weftline.llm.quality_pu import estimate_prior

    r = np.random.default_rng(3)
    good, bad = (lambda n: r.normal(1.5, 1, (n, 5))), (lambda n: r.normal(-1.5, 1, (n, 5)))
    for prior in (0.2, 0.5, 0.8):
        n = int(2000 * prior)
        mixed = np.concatenate([good(n), bad(2000 - n)])[r.permutation(2000)]
        assert abs(estimate_prior(good(800), mixed) - prior) < 0.07
    assert estimate_prior(good(3), bad(5)) == 0.5


def test_quality_of_an_id_with_many_rows(spark):
    from weftline.llm import quality_pu as Q

    docs = spark.createDataFrame([(0, f"some words of row {k} and more") for k in range(3000)] + [(k, "x " * k) for k in range(1, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    assert Q.score(docs, Q.train(docs, labels, positives=20, unlabelled=30)).count() == 3049
