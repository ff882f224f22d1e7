"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

Words are tagged secret begin, inside or outside. A word's own shape, both its neighbours and the file
give the emission scores; Viterbi gives the tags. The field is trained by maximum likelihood on a
bounded sample of word windows, tagged by the fixed patterns; it generalises from shape and context.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import byte_words, id_and_text, map_arrow, store

# The patterns of the base spans and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

KINDS = ("assign", "access", "hex", "crf")
#: Bytes of a window that is learned from, at most; bounds what the driver collects to fit the field.
MOST_WINDOW_BYTES = 4_000
#: Windows with, and without, a base span that the field is fitted on (those with the least hashes).
FIT_WITH, FIT_WITHOUT = 2_000, 2_000
#: Words on both sides of the middle word of such a window.
REACH = 14
#: Distinct words of the windows that are features themselves.
LEXICON = 200
#: Distinct words whose type a task remembers before it starts again.
REMEMBERED_WORDS = 150_000
#: Least characters of a span that only the field finds.
LEAST_FOUND = 8
OUT, BEGIN, INSIDE = 0, 1, 2

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KEYWORD = re.compile(r"passw|secret|token|api", re.I | re.A)
_LONG = re.compile(r"[0-9a-f]{24}")
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 57 if 48 <= c <= 57 else 120 if c > 127 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_CORE = re.compile(r"[A-Za-z0-9+/_.=-]+(?:[^\n]*[A-Za-z0-9+/_=-])?")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed patterns, whole matches, leftmost and without overlap per kind."""
    if not text:
        return []
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if _LONG.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return found


def written(spans: list[tuple[int, int, str]]) -> str:
    """Spans as ``kind:start:end`` by start, then kind in the order of ``KINDS``."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _bucket(n: int) -> int:
    return n if n < 8 else 8 + n // 8 if n < 64 else 17


def word_type(word: bytes, lexicon: frozenset[bytes]) -> tuple:
    """What the features see of a word: shape with runs collapsed, length, distinct bytes, its lexicon entry."""
    shape = word.translate(_SHAPE)
    if shape.isalpha() and len(word) < 16 and shape[1:].islower():
        low = word.lower()
        return (b"a", len(word) // 4, 0, low if low in lexicon else b"")
    short = _RUN.sub(rb"\1", shape[:64])
    core = word.strip(b"\"'=:,.;()[]{}<>#$%&*!").lower()
    return (short[:10], _bucket(len(word)), len(set(word)) // 4 if len(word) > 11 else 0, core if core in lexicon else b"")


def type_features(kind: tuple) -> list[str]:
    short, length, distinct, core = kind
    return ["bias", f"shape {short!r}", f"len {length}", f"distinct {distinct} {length}", f"lex {core!r}", f"mixed {b'9' in short} {length}"]


def file_type(data_len: int, words: list[bytes]) -> tuple:
    """Of a whole file: its length, and the share of words with a digit-free assignment sign alone."""
    signs = words.count(b"=") + words.count(b":")
    return (min(20, data_len.bit_length()), min(3, signs))


def file_features(kind: tuple) -> list[str]:
    return [f"file length {kind[0]}", f"file signs {kind[1]}"]


def silver_tags(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    """Tags of a text's words by its base spans."""
    tags, spans = [], sorted(spans)
    k = 0
    open_span = None
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        hit = k < len(spans) and spans[k][0] < m.end()
        tags.append((INSIDE if open_span == k else BEGIN) if hit else OUT)
        open_span = k if hit else None
    return tags


class Field:
    """Weights of a trained field; emission scores of word types are computed when first met."""

    def __init__(self, lexicon: frozenset[bytes], weights: list[dict[str, np.ndarray]], transition: np.ndarray):
        self.lexicon, self.weights, self.transition = lexicon, weights, transition
        #: an outside tag that leads by more than this is certain whatever the neighbours' tags are
        self.certain = 2 * float(transition.max() - transition.min())

    def emission(self, features: list[str], place: int) -> np.ndarray:
        return sum((self.weights[place].get(f, 0) for f in features), np.zeros(3))


class Tagger:
    """Viterbi tags of whole texts; one per task."""

    def __init__(self, field: Field):
        self.field = field
        self.types: dict[tuple, int] = {}
        self.words: dict[bytes, int] = {}
        self.files: dict[tuple, np.ndarray] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, 3, 3))
        self.edge = self._type((b"edge", 0, 0, b""))

    def _type(self, kind: tuple) -> int:
        at = self.types.get(kind)
        if at is None:
            at = self.types[kind] = len(self.rows)
            names = type_features(kind)
            self.rows.append(np.stack([self.field.emission(names, place) for place in range(3)]))
        return at

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        known = self.words
        for word in set(words).difference(known):
            known[word] = self._type(word_type(word, self.field.lexicon))
        if len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def emissions(self, words: list[bytes], data_len: int) -> np.ndarray:
        ids = np.concatenate([[self.edge], self.ids(words), [self.edge]])
        kind = file_type(data_len, words)
        if kind not in self.files:
            self.files[kind] = self.field.emission(file_features(kind), 3)
        return self.table[ids[1:-1], 0] + self.table[ids[:-2], 1] + self.table[ids[2:], 2] + self.files[kind]

    def tags(self, words: list[bytes], data_len: int) -> list[tuple[int, int]]:
        """``(position, tag)`` of all words not tagged outside, on the best path.

        Where outside leads by more than any change of transitions can make up, the best path is outside; what lies between such
        words is decoded on its own, which gives the best path of the whole.
        """
        if not words:
            return []
        e = self.emissions(words, data_len)
        open_at = np.flatnonzero(e[:, 0] - e[:, 1:].max(1) <= self.field.certain)
        found = []
        for run in np.split(open_at, np.flatnonzero(np.diff(open_at) > 1) + 1):
            if len(run):
                found += [(int(run[0]) + k, t) for k, t in enumerate(viterbi(e[run], self.field.transition)) if t]
        return found


def viterbi(emission: np.ndarray, transition: np.ndarray) -> list[int]:
    """Best tags between two outside tags."""
    value, back = transition[OUT] + emission[0], []
    for row in emission[1:]:
        step = value[:, None] + transition
        back.append(step.argmax(0))
        value = step.max(0) + row
    tags = [int((value + transition[:, OUT]).argmax())]
    for pointer in reversed(back):
        tags.append(int(pointer[tags[-1]]))
    return tags[::-1]


def found_spans(text: str, tagged: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the field's tags, without outer signs; those that meet a base span are left to it."""
    if not tagged:
        return []
    wanted = dict(tagged)
    last, raw = -1, []
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            if raw and last == k - 1 and wanted[k] == INSIDE:
                raw[-1][1] = m.end()
            else:
                raw.append([m.start(), m.end()])
            last = k
    spans = []
    for start, end in raw:
        core = _CORE.search(text, start, end)
        if core and core.end() - core.start() >= LEAST_FOUND and not any(a < core.end() and core.start() < b for a, b, _ in base):
            spans.append((core.start(), core.end(), "crf"))
    return spans


def fit(windows: list[tuple[list[bytes], list[int], tuple]], rounds: int = 60) -> Field:
    """Maximum likelihood by Adam over all windows at once, forward-backward in step across windows."""
    windows = [w for w in windows if w[0]]
    near = Counter(w.strip(b"\"'=:,.;()[]{}<>#$%&*!").lower() for words, tags, _ in windows if any(tags) for w in words)
    lexicon = frozenset(w for w, _ in sorted(near.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if w)
    if not windows:
        return Field(lexicon, [{}, {}, {}, {}], np.zeros((3, 3)))
    types: dict[tuple, int] = {(b"edge", 0, 0, b""): 0}
    width = max(len(w) for w, _, _ in windows)
    ids = np.zeros((len(windows), width + 2), np.int64)
    gold = np.zeros((len(windows), width), np.int64)
    real = np.zeros((len(windows), width), bool)
    files: dict[tuple, int] = {}
    file_ids = np.array([files.setdefault(tuple(f), len(files)) for _, _, f in windows])
    for i, (words, tags, _) in enumerate(windows):
        ids[i, 1 : len(words) + 1] = [types.setdefault(word_type(w, lexicon), len(types)) for w in words]
        gold[i, : len(words)], real[i, : len(words)] = tags, True

    def incidence(kinds, features):
        names: dict[str, int] = {}
        rows = [[names.setdefault(f, len(names)) for f in features(k)] for k in kinds]
        m = np.zeros((len(rows), len(names)))
        for i, row in enumerate(rows):
            m[i, row] = 1
        return m, names

    m_type, type_names = incidence(types, type_features)
    m_file, file_names = incidence(files, file_features)
    w = [np.zeros((len(type_names), 3)) for _ in range(3)] + [np.zeros((len(file_names), 3)), np.zeros((3, 3))]
    mean, square = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    parts = [(ids[:, 1:-1], m_type), (ids[:, :-2], m_type), (ids[:, 2:], m_type), (np.repeat(file_ids[:, None], width, 1), m_file)]
    one_hot = np.eye(3)
    flat_real = real.reshape(-1)
    pair_real = real[:, 1:]
    gold_pairs = np.zeros((3, 3))
    np.add.at(gold_pairs, (gold[:, :-1][pair_real], gold[:, 1:][pair_real]), 1)
    for step in range(1, rounds + 1):
        e = sum((m @ w[k])[i] for k, (i, m) in enumerate(parts))
        e = np.where(real[..., None], e, [0.0, -50.0, -50.0])
        t = w[4]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, width):
            alpha[:, k] = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t, axis=1) + e[:, k]
        for k in range(width - 2, -1, -1):
            beta[:, k] = np.logaddexp.reduce(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        post = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        residual = (post - one_hot[gold]).reshape(-1, 3)
        residual[~flat_real] = 0
        grads = []
        for k, (i, m) in enumerate(parts):
            by_type = np.stack([np.bincount(i.reshape(-1), weights=residual[:, c], minlength=len(m)) for c in range(3)], 1)
            grads.append(m.T @ by_type / len(windows) + 1e-4 * w[k])
        grads.append((pair[pair_real].sum(0) - gold_pairs) / len(windows) + 1e-4 * t)
        for k, grad in enumerate(grads):
            mean[k] = 0.9 * mean[k] + 0.1 * grad
            square[k] = 0.99 * square[k] + 0.01 * grad * grad
            w[k] = w[k] - 0.15 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    named = [dict(zip(type_names, w[k])) for k in range(3)] + [dict(zip(file_names, w[3]))]
    return Field(lexicon, named, w[4])


def train(docs: DataFrame) -> Field:
    """Fit on a bounded sample of word windows from all documents.

    Every base span offers the window around it, and every document one window at a place that its id's hash
    gives. Repeated windows count once. Windows of MOST_WINDOW_BYTES or more, which hold very long words, are not learned from.
    """

    def offer(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = byte_words(text)
            if not words:
                continue
            spans = base_spans(text)
            tags = silver_tags(text, spans) if spans else [OUT] * len(words)
            middles = {k for k, t in enumerate(tags) if t == BEGIN} | {zlib.crc32(str(doc_id).encode()) % len(words)}
            about = file_type(len(text), words)
            for k in sorted(middles):
                part = slice(max(0, k - REACH), k + REACH + 1)
                if sum(map(len, words[part])) < MOST_WINDOW_BYTES:
                    rows.append((b" ".join(words[part]).decode("utf-8", "surrogatepass"), tags[part], list(about), any(tags[part])))
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["words", "tags", "file", "hit"])

    offered = map_arrow(id_and_text(docs), offer, "words string, tags array<int>, file array<int>, hit boolean")
    order = F.xxhash64("words")
    rows = []
    for hit, most in ((True, FIT_WITH), (False, FIT_WITHOUT)):
        # stored first: a sorted limit that is collected directly sends every task's share to the driver
        rows += store(offered.where(F.col("hit") == hit).orderBy(order, "words", "tags", "file").limit(most)).collect()
    distinct = {(r["words"], tuple(r["tags"]), tuple(r["file"])) for r in rows}
    return fit([(w.encode("utf-8", "surrogatepass").split(), list(t), f) for w, t, f in sorted(distinct)])


def spans_of(text: str | None, tagger: Tagger) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind: the base spans, and the field's where they meet none."""
    base = base_spans(text)
    found = found_spans(text, tagger.tags(byte_words(text), len(text)), base) if text and tagger.field.weights[0] else []
    return sorted(base + found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Spans of secrets in every whole text, in code points, end exclusive.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts have no spans. Repeated
    rows are scanned each. ``training`` is what the field learns from (``docs`` if not given); where it holds
    no text, the field finds nothing. Base spans always stay; the field's are added where they meet none.
    Returns ``doc_id`` and ``spans``, an array of (start, end, kind) in the order of ``written``.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training))

    def find(batch: pa.RecordBatch, tagger: Tagger) -> pa.RecordBatch:
        out = [[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(text, tagger)] for text in batch.column(1).to_pylist()]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return map_arrow(id_and_text(docs), find, "doc_id long, spans array<struct<start:long,end:long,kind:string>>", lambda: Tagger(field.value))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that meet are replaced together.

    All columns stay; ``n_chars``, where it is a column, becomes the new length. Null texts stay null, empty ones empty. Nothing
    is shuffled: rows that repeat an id, or have none, are each cleaned; texts are read whole, however long. An empty table stays empty.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs))
    at = docs.columns.index("text")

    def clean(batch: pa.RecordBatch, tagger: Tagger) -> pa.RecordBatch:
        out = []
        for text in batch.column(at).to_pylist():
            spans = spans_of(text, tagger)
            if spans:
                parts, done = [], 0
                for start, end, _ in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                text = "".join([*parts, text[done:]])
            out.append(text)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    cleaned = map_arrow(docs, clean, docs.schema, lambda: Tagger(field.value))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def span_text(spans):
    """A column of spans written as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


