"""A quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows; unlabelled rows are any documents. With class prior pi the
risk of a scorer g is  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])  with the sigmoid loss
l(z) = 1 / (1 + e^z); where the second part is negative its gradient is turned around, as usual for
this estimator, so that the model doesn't fit the unlabelled sample too well.

The prior is estimated from the positives and the unlabelled rows alone. For any set S of documents
u(S) = pi p(S) + (1 - pi) n(S) >= pi p(S), so that u(S) / p(S) bounds the prior from above, and comes
near it where S holds hardly any negatives. A scorer that tells positives from unlabelled rows, fitted
on one half of both, orders the other half; the sets are the tops of that order, and the prior is the
lowest ratio, each share being moved by a confidence bound. Labels 0 are never used.

Features come from the whole text alone: shares of pairs of neighbouring character classes, word
and line repetition, and how well the text compresses. The scorer is a small network on top of
them. It is fitted on the driver on a bounded sample, ``POSITIVES`` and ``UNLABELLED`` rows, chosen
by a hash of the id and the text from all rows, so only some MB of features reach the driver at any
size. Unlabelled rows may be of the held-out fold, as their labels aren't looked at.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Rows that the model is fitted on.
POSITIVES, UNLABELLED = 4000, 8000

_CLASS = np.full(256, 1, np.uint8)
for _k, _chars in enumerate((b"\x00", b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,", b"!?", b"'\"()", b":;-_", b"|<>/\\", b"$%&#*@+=~^", b"[]{}`")):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 15
N_CLASS = 16
WIDTH = N_CLASS * N_CLASS + 12


def features(text: str | None) -> np.ndarray:
    """Numbers of about unit size that describe a whole text; zeros for an empty one."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    pairs = np.zeros(N_CLASS * N_CLASS, np.int64)
    for k in range(0, len(raw), 1 << 20):  # a piece overlaps the next by one byte
        c = _CLASS[np.frombuffer(raw, np.uint8, min(len(raw) - k, (1 << 20) + 1), k)]
        pairs += np.bincount(c[:-1].astype(np.intp) * N_CLASS + c[1:], minlength=N_CLASS * N_CLASS)
    out[: N_CLASS * N_CLASS] = np.sqrt(pairs / max(1, len(raw) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n = max(1, len(words))
    seen = np.fromiter(counts.values(), np.float64, len(counts)) if counts else np.ones(1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    packed = len(zlib.compress(raw[: 1 << 20], 1)) if len(raw) <= 1 << 20 else sum(len(zlib.compress(raw[k : k + (1 << 20)], 1)) for k in range(0, len(raw), 1 << 20))
    length = np.fromiter(map(len, counts), np.float64, len(counts)) if counts else np.zeros(1)
    out[N_CLASS * N_CLASS :] = (
        len(counts) / n, seen.max() / n, -(seen / n * np.log(seen / n)).sum() / max(1.0, np.log(n)), same / n,
        len(set(lines)) / len(lines), np.log1p(len(lines)) / np.log1p(n), np.log1p(n) / 10, np.log1p(len(raw)) / 12,
        packed / len(raw), (length * seen).sum() / n / 10, length.mean() / 10, min(1.0, length.std() / 10),
    )
    return out


@dataclass
class Model:
    """Standardisation, one hidden layer, and the estimated class prior."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """(positive part, negative part, gradient) of the risk of the network ``w`` on standardised features.

    The gradient is that of the sum, or, where the negative part is below zero, that of its negation alone.
    """
    hp, hu = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
    sp, su = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) for h in (hp, hu))
    # l(g) = 1 - s and l(-g) = s, so that their slopes in g are -s (1 - s) and s (1 - s)
    positive, negative = prior * (1 - sp).mean(), su.mean() - prior * sp.mean()
    dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
    gp, gu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
    back = [(x, h, g, np.outer(g, w[2]) * (1 - h * h)) for x, h, g in ((p, hp, gp), (u, hu, gu))]
    return positive, negative, [sum(x.T @ d for x, _, _, d in back), sum(d.sum(axis=0) for *_, d in back), sum(h.T @ g for _, h, g, _ in back), np.array([sum(g.sum() for _, _, g, _ in back)])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 300, rate: float = 0.01, decay: float = 0.01, seed: int = 5) -> Model:
    """Minimise the non-negative risk with Adam on the given features."""
    every = np.concatenate([positive, unlabelled]).astype(float)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    p, u = (np.clip((a - mean) / scale, -8, 8) for a in (positive.astype(float), unlabelled.astype(float)))
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(every.shape[1]), (every.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        grads = risk(w, p, u, prior)[2]
        grads[0] = grads[0] + decay * w[0]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, splits: int = 6, doubt: float = 0.5, seed: int = 9) -> float:
    """The share of positives among the unlabelled rows; 0.5 where there are too few rows to tell.

    The mean over random halvings. Sets with fewer than half of the positives don't count, as the
    ratio of small shares says little, and the shares are moved by ``doubt`` standard errors.
    """
    if min(len(positive), len(unlabelled)) < 40:
        return 0.5
    lowest, rng = [], np.random.default_rng(seed)
    for _ in range(splits):
        halves = [(x[at[::2]], x[at[1::2]]) for x in (positive, unlabelled) for at in [rng.permutation(len(x))]]
        # at a prior of one half the risk is that of telling the two samples apart
        model = fit(halves[0][0], halves[1][0], 0.5, steps=100)
        p, u = (np.sort(model.score(half.astype(float))) for _, half in halves)
        cut = np.unique(p)
        ps, us = (1 - np.searchsorted(x, cut) / len(x) for x in (p, u))
        error = lambda share, n: doubt * np.sqrt(np.maximum(share * (1 - share), 1 / n) / n)
        lowest.append(((us + error(us, len(u))) / np.maximum(ps - error(ps, len(p)), 0.05))[ps >= 0.5].min())
    return float(np.clip(np.mean(lowest), 0.01, 0.99))


def _held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on rows with label 1 outside the held-out fold and on unlabelled documents.

    At most ``positives`` and ``unlabelled`` rows are used, whatever the number of rows an id has. Null
    ids and texts without an id take no part, null texts count as empty, very long ones are described
    whole; without a positive or an unlabelled row every score is one half.
    """
    trusted = labels.filter(F.col(id_col).isNotNull() & (F.col(label_col) == 1) & ~_held_out(id_col, folds, fold)).select(F.col(id_col).alias("doc_id")).distinct()
    some = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).withColumn("kind", F.lit(1))
    rest = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).withColumn("kind", F.lit(0))
    chosen = F.broadcast(some.unionByName(rest))  # at most positives + unlabelled ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("mark")).join(chosen, "doc_id")
    described = written(texts.select("kind", "text", "mark").mapInArrow(_described, "kind int, mark long, x binary"), "features")
    # an id may have any number of rows, so the bound is on rows once more
    sides = []
    for kind, most in ((1, positives), (0, unlabelled)):
        rows = described.filter(F.col("kind") == kind).orderBy("mark", "x").limit(most).collect()
        rows.sort(key=lambda r: (r["mark"], r["x"]))
        sides.append(np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, WIDTH))
    if not all(len(s) for s in sides):  # nothing to learn from: every score is one half
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)
    return fit(*sides, estimate_prior(*sides))


def _described(batches):
    for batch in slices(batches):
        x = pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["kind", "mark", "x"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, fold: int = 1) -> DataFrame:
    """id, held_out, score and predicted of every row.

    Null and empty texts get the score of no features; repeated rows get equal scores; a null id is
    never held out; very long texts are described whole; an empty table gives an empty result. Other
    columns, whatever their names, have no part in a score.
    """

    def run(batches):
        for batch in slices(batches):
            x = np.stack([features(t) for t in batch.column(2).to_pylist()]) if batch.num_rows else np.zeros((0, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; nothing is shuffled.

    Null and empty texts have the score of no features; repeated rows stay or go together; an empty
    table gives an empty one.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                x = np.stack([features(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
