"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

Training counts hashed byte n-grams of every training document per language. A document is then a
mixture of languages: EM estimates their shares from its n-grams, and languages leave the set one by
one, smallest share first, as long as that raises the penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import held_out, id_and_text, limit_batches, map_arrow

NGRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Bytes of a text that are turned into n-grams at a time; texts are read whole, slice by slice.
SLICE = 1 << 20
UNDETERMINED = "und"

#: Languages of a model at most; bounds what is collected and broadcast to so many times BUCKETS numbers.
MOST_LANGUAGES = 500
_LETTERS_ONLY = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of a text's hashed n-grams: lower case, every run of ASCII non-letters one space."""
    counts = np.zeros(BUCKETS, np.int64)
    if not text:
        return counts
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY) + b" ", np.uint8)
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    data = data[keep]
    data = np.pad(data, (0, max(0, NGRAM - len(data))), constant_values=32)
    for start in range(0, len(data) - NGRAM + 1, SLICE):
        part = data[start : start + SLICE + NGRAM - 1].astype(np.uint32)
        n = len(part) - NGRAM + 1
        code = part[:n] | part[1 : n + 1] << np.uint32(8) | part[2 : n + 2] << np.uint32(16) | part[3 : n + 3] << np.uint32(24)
        counts += np.bincount(code * np.uint32(2654435761) >> np.uint32(16), minlength=BUCKETS)
    return counts


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """N-gram probabilities of every language over all training documents.

    Each task sums its documents' counts, so what is shuffled and collected is at most one number per
    language and bucket. Returns the languages in order and a matrix (languages, BUCKETS).
    """
    limit_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in sums:
                    sums[lang] += ngram_counts(text)
                else:
                    sums[lang] = ngram_counts(text)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model is made for {MOST_LANGUAGES} at most")
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    for i, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, table / table.sum(axis=1, keepdims=True) if langs else table


def shares_by_em(likelihood: np.ndarray, counts: np.ndarray, start: np.ndarray, tolerance: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Mixture shares and log-likelihood; ``likelihood`` has one row per distinct n-gram."""
    shares, total = start, counts.sum()
    for _ in range(rounds):
        weight = counts / np.maximum(likelihood @ shares, 1e-300)
        new = shares * (weight @ likelihood) / total
        moved, shares = np.abs(new - shares).max(), new
        if moved < tolerance:
            break
    return shares, float(counts @ np.log(np.maximum(likelihood @ shares, 1e-300)))


def mixture(counts: np.ndarray, probability: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """EM shares over all languages, and the shares within the selected set (others 0).

    Overlapping n-grams are not independent: the log-likelihood counts once per NGRAM of them. A
    language stays only if it pays ``penalty * ln(n)``, n being the number of n-grams.
    """
    at = np.flatnonzero(counts)
    n, count = counts.sum(), counts[at].astype(float)
    likelihood = probability[at]
    likelihood = likelihood / likelihood.max(axis=1, keepdims=True)
    full, value = shares_by_em(likelihood, count, np.full(likelihood.shape[1], 1 / likelihood.shape[1]))
    chosen, shares = np.arange(len(full)), full
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), np.argmin(shares))
        start = shares[rest]
        less, less_value = shares_by_em(likelihood[:, chosen[rest]], count, np.full(len(rest), 1 / len(rest)) if start.sum() <= 0 else start / start.sum())
        if (value - less_value) / NGRAM > penalty * np.log(n):
            break
        chosen, shares, value = chosen[rest], less, less_value
    selected = np.zeros(len(full))
    selected[chosen] = shares
    return full, selected


def detect(text: str | None, langs: list[str], probability: np.ndarray, penalty: float) -> tuple[str, float, list[tuple[str, float]]]:
    """Language, its share among all languages, and the selected mixture; ``probability`` is (BUCKETS, languages)."""
    if not langs or not text or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, []
    full, selected = mixture(ngram_counts(text), probability, penalty)
    best = int(np.argmax(selected))
    return langs[best], float(min(1.0, full[best])), [(langs[i], float(selected[i])) for i in np.flatnonzero(selected)]


def fitted(source: DataFrame):
    """Broadcast model of ``train``: as many numbers as languages times BUCKETS."""
    columns = [F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("text", "string"), ("lang", "string"))]
    langs, probability = train(source.select(*columns))
    return source.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(probability.T)))


def identify(docs: DataFrame, training: DataFrame | None = None, penalty: float = 0.5) -> DataFrame:
    """Language of every text, with the shares of the languages it mixes.

    ``docs`` needs ``doc_id`` and ``text``; ``training`` (``docs`` if not given) also ``lang``. Only training rows
    with a language are learned from that ``held_out`` doesn't exclude. Other columns are ignored, and rows with
    a null id or repeated ids are each answered. A text that is null or has no letter, and any text if there
    was nothing to learn from, is ``und`` with score 0 and an empty mixture. Ties go to the language first
    in alphabetical order.
    Returns ``doc_id, lang_pred, score`` (EM share of that language among all) and ``mixture``
    (shares within the selected set).
    """
    model = fitted(docs if training is None else training)

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [detect(t, *model.value, penalty) for t in batch.column(1).to_pylist()]
        preds, scores, mixtures = zip(*found)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))],
            names=["doc_id", "lang_pred", "score", "mixture"],
        )

    return map_arrow(id_and_text(docs), answer, "doc_id long, lang_pred string, score double, mixture map<string,double>")


def acceptable(found: tuple[str, float, list[tuple[str, float]]], least_share: float) -> bool:
    """Whether the language that ``detect`` found has ``least_share`` of the selected mixture."""
    lang, _, shares = found
    return lang != UNDETERMINED and dict(shares)[lang] >= least_share


def accepted(docs: DataFrame, least_share: float = 0.5, penalty: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language with at least ``least_share`` of the selected mixture.

    Rows are judged in place, nothing is shuffled: rows that repeat an id, or have none, each for itself, whatever their other
    columns hold. Undetermined texts (null, empty, or without a letter) go, and all texts where no row has a language to
    learn from. Texts are read whole, however long. An empty table stays empty.
    """
    model, text = fitted(docs), docs.columns.index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [detect(t, *model.value, penalty) for t in batch.column(text).to_pylist()]
        return batch.filter(pa.array([acceptable(f, least_share) for f in found], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
