"""The registered queries: contracts, SQL where there is one, and the pipeline against brute force."""

import pytest
from helpers import SF, same
from test_operators import brute_fingerprint, components, corpus

import corpus_pipeline
from weftline.llm.common import table, written
from weftline.llm.queries import QUERIES, SQL

COLUMNS = {
    1: "doc_id n_bytes n_removed n_spans kept_sha256", 2: "doc_id keep_id group_size kept text_sha256", 3: "doc_id n_tokens", 4: "doc_id size source_size target taken", 5: "doc_id fingerprint component_id",
    6: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 7: "doc_id held_out score predicted", 8: "doc_id text n_entities", 9: "query_id rank vec_id score", 10: "doc_id start n_tokens ids_crc32",
}


@pytest.mark.parametrize("name", list(SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", list(QUERIES))
def test_contract(spark, name):
    out = QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert set(COLUMNS[n].split()) <= set(out.columns)
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.count() == docs if n not in (6, 9) else out.count() > 0


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), "stage")
        if k < 4:
            assert out.columns == docs.columns
        if name in ("quality classifier", "exact dedup", "near dedup"):
            assert 0.5 * before < out.count() <= before and out.subtract(docs).count() == 0
            before = out.count()
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0


def test_pipeline_filters_on_awkward_rows(spark):
    import re

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(bare(r["text"]) for r in once) == sorted({bare(t) for _, t, *_ in rows})
    near = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    places = components(list(range(len(rows))), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert len(near) == len(set(places))
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    from weftline.llm.mixing import mix

    assert mixed.count() == sum(r["repeats"] for r in mix(docs).collect()) and mixed.columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def word_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = word_shingles(a), word_shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_pipeline_drops_similar_texts(spark):
    import random

    r = random.Random(3)
    texts = []
    for k in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 100, 200, 400]))]
        texts.append(" ".join(words))
        other = list(words)
        while True:  # edits until the next one would take the pair below the goal
            step = list(other)
            step[r.randrange(len(step))] = f"v{r.randrange(10**6)}"
            if jaccard(texts[-1], " ".join(step)) < (0.8, 0.85, 0.95)[k % 3]:
                break
            other = step
        texts.append(" ".join(other))
        texts.append(" ".join(words[: len(words) // 2] + [f"u{r.randrange(10**6)}" for _ in words[len(words) // 2 :]]))
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF).collect()}
    places = components(list(range(len(texts))), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(places)) < len(texts) and kept == set(places)


def test_near_dedup_keeps_unlike_texts_without_ids(spark):
    texts = [" ".join(f"{letter}{k}" for k in range(50)) for letter in "abc"]
    docs = spark.createDataFrame([(None, t, "en", "a", len(t)) for t in [*texts, texts[0]]], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_similar):
        assert sorted(r["text"] for r in stage(spark, docs, SF).collect()) == texts


def test_rows_that_clash_are_told_apart(spark):
    from pyspark.sql import functions as F

    texts = [" ".join(f"w{k}x{j}" for j in range(30 + k)) for k in range(60)]
    rows = [(k, t, "en", s, len(t), "extra") for k, t in enumerate(texts) for s in ("s1", "s2")] + [(None, "", None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, wl_key string").repartition(3)
    from weftline.llm.mixing import mix

    want = {r["source"]: r["n"] for r in mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    size = F.size(F.split("text", " "))
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert mixed.columns == docs.columns and got.keys() == {"s1", "s2"} and all(abs(got[s] - want[s]) <= 2 * 90 for s in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, corpus_pipeline.mix_sources(spark, docs.repartition(5), SF).collect()))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_similar, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == len({(t, None if i is None else "x") for i, t, *_ in rows})
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= len(rows)


@pytest.mark.parametrize("tile", [512, 8])
def test_similarity_in_large_groups_equals_brute_force(spark, monkeypatch, tile):
    import random

    from weftline.llm import shingle_near, simhash

    monkeypatch.setattr(shingle_near, "TILE", tile)
    r = random.Random(17)
    bases = [[f"w{r.randrange(10**6)}" for _ in range(120)] for _ in range(4)]
    texts = []
    for k in range(160):
        words = list(bases[k % 4])
        for _ in range(r.randint(0, 6)):
            words[r.randrange(120)] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[3]] * 20 + ["", None, "one two", "two words", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x["root"] for x in simhash.similar(docs).collect()}
    places = components(list(range(len(texts))), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert len({(places[k], got[k]) for k in got}) == len(set(places)) == len(set(got.values())) and len(got) == len(texts)
    assert simhash.similar(docs.limit(0)).count() == 0


def test_near_dedup_finds_near_fingerprints_by_pigeonhole(spark, monkeypatch):
    """With minhashes that never meet, the links within the radius are found all the same, and no others."""
    import random

    import numpy as np

    from weftline.llm import shingle_near, simhash

    monkeypatch.setattr(shingle_near, "minhashes", lambda own: np.random.default_rng(own).integers(0, 1 << 63, 200, np.uint64))
    r, texts = random.Random(11), []
    for _ in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([80, 200, 400]))]
        texts.append(" ".join(words))
        for _ in range(3):
            words[r.randrange(len(words))] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(words))
    print_of = lambda t: simhash.majority(shingle_near.shingles(shingle_near.words_of(t)))
    for _ in range(5):  # near fingerprints of sets below the goal
        words = [f"w{r.randrange(10**6)}" for _ in range(40)]
        other = list(words)
        while other == words or (print_of(" ".join(words)) ^ print_of(" ".join(other))).bit_count() > shingle_near.SLICED:
            other = [*words[:20], f"v{r.randrange(10**6)}", *words[21:]]
        texts += [" ".join(words), " ".join(other)]
    fp = [print_of(t) for t in texts]
    together = components(list(range(len(texts))), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= shingle_near.SLICED)
    want = components(list(range(len(texts))), lambda a, b: together[a] == together[b] and jaccard(texts[a], texts[b]) >= 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["root"] for x in simhash.similar(docs).collect()}
    assert len(set(together)) < len(set(want)) < len(texts) // 2
    assert len({(want[k], got[k]) for k in got}) == len(set(want)) == len(set(got.values()))
