"""Quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled text are learned from. A small network minimises the
non-negative unbiased risk: what the positives explain of the unlabelled loss is taken off, and where
that would go below zero the step goes the other way. The class prior is estimated from the highest
scores: the least ratio of unlabelled to positive rows above a threshold, on rows kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import held_out, map_arrow

#: At most so many positives, and so many unlabelled rows, are fitted (those with the least hashes).
FIT_POSITIVES = 6_000
FIT_UNLABELLED = 9_000
N_FEATURES = 35
_SYMBOLS = b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"


def features(text: str | None) -> np.ndarray:
    """Shape and repetition of a whole text; all zero for a null or empty one."""
    x = np.zeros(N_FEATURES, np.float32)
    if not text:
        return x
    data = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    words, lines = data.split(), [line for line in data.split(b"\n") if line.strip()]
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    letters = upper + lower + hist[128:].sum()
    symbols = hist[list(_SYMBOLS)]
    x[0], x[1] = np.log1p(n), np.log1p(len(words))
    x[2] = upper / max(1, letters)
    x[3], x[4], x[5] = letters / n, hist[48:58].sum() / n, symbols.sum() / n
    x[6], x[7], x[8] = hist[46] / n, hist[44] / n, hist[10] / n
    x[9] = (hist[9] + hist[11:14].sum()) / n
    x[10] = hist[128:].sum() / n
    if words:
        total = len(words)
        distinct = set(words)
        pairs = set(zip(words, words[1:]))
        ends = [w[-1] for w in words]
        x[11] = len(distinct) / total
        x[12] = len(pairs) / max(1, total - 1)
        x[13] = sum(map(len, words)) / total / 10
        x[14] = sum(map(len, distinct)) / len(distinct) / 10
        x[15] = max(map(len, distinct)) / 50
        x[16] = sum(e in _SYMBOLS for e in ends) / total
        x[17] = sum(e == 46 or e == 44 for e in ends) / total
        x[18] = sum(w.isupper() for w in words) / total
        x[19] = sum(w.isalpha() for w in words) / total
        x[20] = sum(w[:1].isupper() for w in words) / total
        x[21] = np.log1p(total / len(distinct))
    if lines:
        x[22] = len(set(lines)) / len(lines)
        x[23] = np.log1p(n / len(lines))
        x[24] = np.log1p(len(lines))
        x[25] = max(map(len, lines)) / n
    share = hist / n
    x[26] = -(share[share > 0] * np.log(share[share > 0])).sum()
    for k, c in enumerate(b"|!*$%&#@"):
        x[27 + k] = np.log1p(100 * hist[c] / n)
    return x


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w + self.b) @ self.v + self.c


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def minimise_risk(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the non-negative risk with the sigmoid loss, positives and unlabelled rows in equal steps."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    p = [rng.normal(0, 1 / np.sqrt(pos.shape[1]), (pos.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    steps = max(1, -(-max(len(pos), len(unl)) // batch))
    for _ in range(max(epochs, -(-400 // steps))):
        orders = [rng.permutation(len(x)) for x in (pos, unl)]
        for k in range(steps):
            a, b = (x[np.take(order, range(k * batch, k * batch + min(batch, len(x))), mode="wrap")] for x, order in zip((pos, unl), orders))
            x = np.concatenate([a, b])
            h = np.tanh(x @ p[0] + p[1])
            g = _sigmoid(h @ p[2] + p[3])
            slope = g * (1 - g)
            is_pos = np.arange(len(x)) < len(a)
            # the loss of calling a row negative is g, of calling it positive 1 - g
            negative_part = g[~is_pos].mean() - prior * g[is_pos].mean()
            d = np.where(is_pos, -prior * slope / len(a), slope / len(b))
            if negative_part >= 0:
                d = d + np.where(is_pos, -prior * slope / len(a), 0)
            else:
                d = -d
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [x.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.999 * s[i] + 0.001 * grad * grad
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives among unlabelled scores: least ratio of the two upper tails, with a margin for small counts."""
    pos, unl = np.sort(pos)[::-1], np.sort(unl)[::-1]
    thresholds = pos
    p_tail = np.arange(1, len(pos) + 1) / len(pos)
    u_tail = np.searchsorted(-unl, -thresholds, side="right") / len(unl)
    slack = np.sqrt(np.log(4 / confidence) / 2)
    bound = (u_tail + slack / np.sqrt(len(unl)) + slack / np.sqrt(len(pos))) / p_tail
    best = int(np.argmin(bound))
    return float(np.clip(u_tail[best] / p_tail[best], 0.05, 0.95))


def fit(pos: np.ndarray, unl: np.ndarray) -> Network | None:
    """Estimate the prior on every other row, then fit on all; None without rows of either kind."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    prior = 0.5
    for _ in range(2):
        part = minimise_risk(pos[::2], unl[::2], prior, epochs=20)
        prior = estimate_prior(part.margin(pos[1::2]), part.margin(unl[1::2]))
    return minimise_risk(pos, unl, prior)


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Fit on a bounded sample: rows that aren't held out, positives those whose labels are all 1."""
    positive = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("least"), F.count("quality").alias("n")).where((F.col("least") == 1) & (F.col("n") > 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    )
    unlabelled = (
        docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"))
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(FIT_UNLABELLED).distinct().withColumn("positive", F.lit(False))
    )
    chosen = positive.union(unlabelled)  # at most FIT_POSITIVES + FIT_UNLABELLED ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one row per chosen id, the least text: a repeated id adds nothing to what is collected
    rows = rows.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [features(t).tolist() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "positive", "x"])

    found = map_arrow(rows.select("doc_id", "text", "positive"), extract, "doc_id long, positive boolean, x array<float>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), N_FEATURES)
    is_pos = found["positive"].to_numpy(bool)
    return fit(x[is_pos], x[~is_pos])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every whole text, from 0 to 1; positives are learned as described above.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``; other columns are ignored. A null or
    empty text is scored like any other, from features that are all zero. Repeated rows are each scored.
    Without positives or documents to learn from every score is 0.5. Returns ``doc_id, score, predicted``.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(batch.num_rows, N_FEATURES)
        s = np.full(len(x), 0.5) if model.value is None else _sigmoid(model.value.margin(x))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, answer, "doc_id long, score double, predicted int")
