"""Alignment of two tokenizers' tokens by lockstep merging.

Of a batch of texts, every text is a lane with one pointer into its tokens by A and one into those by B. All
lanes step at once, as NumPy vectors: the two tokens pointed at are linked, then the pointer whose token ends first
moves on, or both, which is a cut. Finished lanes are taken out. A long text is several lanes: a lane may start at
any byte, with the two tokens that hold it, and ends where the next one starts.

Corpus counts of linked id pairs are summed over batches, and come back to the batches, not to every link.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholium.llm.common import id_and_text, limit_batches, store

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that one lane steps through, about.
LANE_BYTES = 256
#: Bytes of an Arrow batch; texts of a batch are aligned together, with about 100 bytes of memory for each of theirs.
ALIGN_BYTES = 4 << 20
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 20
#: Distinct words whose ids by A a worker keeps at most.
KEPT_WORDS = 100_000
#: Words of an ASCII text as the byte-level splitter of A cuts them; merges never cross a word.
ASCII_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: The part of A's file that says how it cuts and joins; with any other, whole texts are given to it.
BYTE_LEVEL = {
    "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "post_processor": None, "truncation": None, "padding": None,
}
#: Batches whose rows of one id pair meet in one task, about.
BATCHES_PER_SLICE = 250_000
#: Pairs are numbered a * PAIR + b.
PAIR = 1 << 20

_ROWS = (
    "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " places array<int>, times array<int>, pairs array<long>, docs array<int>"
)


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, and its decimal number with each of the signs that may follow it: the one inside a group, then the last one."""

    def __init__(self, tokens: list[bytes], last: bytes):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.numbers = np.array([b"%d" % k + sign for sign in (b",", last) for k in range(len(tokens))], object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Words(dict):
    """Ids of words by one tokenizer, each as the bytes of its int64 numbers; none, if they do not spell the word.

    The tokenizer is asked only for a word that is not kept.
    """

    def __init__(self, tokenizer: Tokenizer, vocabulary: Vocabulary):
        self.tokenizer, self.vocabulary = tokenizer, vocabulary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        self[word] = out = np.array(ids, np.int64).tobytes() if self.vocabulary.joined(ids) == word.encode() else b""
        return out


class Encoders:
    """Both tokenizers and their vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        own = json.loads(self.a.to_str())
        # words are looked up only where A is plain byte-level and reads nothing but its special tokens, which are off, across words
        self.by_word = all(own[k] == v for k, v in BYTE_LEVEL.items()) and all(t["special"] for t in own["added_tokens"]) and not own["model"]["dropout"]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        entries = {k: t for t, k in self.a.get_vocab().items()}
        self.a_words = Vocabulary([bytes(letters[c] for c in entries.get(k, "")) for k in range(max(entries) + 1)], b"|")
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_words = Vocabulary(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)], b";")
        self.words = Words(self.a, self.a_words)

    def encode_a(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids by A of a space and each text, or None if they do not spell them: of ASCII texts word by word, of the others as a whole."""
        found, of = [], self.words.__getitem__
        alone = [self.by_word and t.isascii() for t in texts]
        whole = iter(self.a.encode_batch_fast([" " + t for t, w in zip(texts, alone) if not w], add_special_tokens=False))
        for text, by_word in zip(texts, alone):
            if by_word:
                ids = np.frombuffer(b"".join(map(of, ASCII_WORDS.findall(" " + text))), np.int64)
                spelled = self.a_words.lengths[ids].sum() == 1 + len(text)
            else:
                plain = next(whole).ids
                ids, spelled = np.array(plain, np.int64), self.a_words.joined(plain) == b" " + text.encode()
            found.append(ids if spelled else None)
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray | None, list[int]]]:
        at = 0
        while at < len(texts):
            size, stop = 0, at
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= ENCODE_BYTES):
                size += len(texts[stop])
                stop += 1
            some = texts[at:stop]
            yield from zip(self.encode_a(some), self.b.encode(some, num_threads=1))
            at = stop


@functools.cache
def encoders(a_path: str, b_path: str) -> Encoders:
    """One pair of tokenizers per worker process."""
    return Encoders(a_path, b_path)


def merge(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane_bytes: int = LANE_BYTES):
    """Links and cuts of many texts laid end to end.

    ``end_a``, ``end_b``: the bytes at which tokens end, over all texts; ``first_a``, ``first_b``: each text's first tokens, and
    the number of all at the end. Returns positions of linked tokens, and marks of the tokens of either side that end at a cut.
    """
    start = np.concatenate([[0], end_a[first_a[1:-1] - 1]]) if len(first_a) > 1 else np.zeros(0, np.int64)
    stop = end_a[first_a[1:] - 1]
    lanes = -(-(stop - start) // lane_bytes)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    byte = np.repeat(start, lanes) + nth * lane_bytes
    pa_, pb = np.searchsorted(end_a, byte, "right"), np.searchsorted(end_b, byte, "right")
    last_a, last_b = np.append(pa_[1:], len(end_a)), np.append(pb[1:], len(end_b))
    # lanes that begin within the same two tokens as the next one have nothing to do
    busy = (pa_ != last_a) | (pb != last_b)
    pa_, pb, last_a, last_b = pa_[busy], pb[busy], last_a[busy], last_b[busy]
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(pa_):
        links_a.append(pa_)
        links_b.append(pb)
        a, b = end_a[pa_], end_b[pb]
        both = a == b
        cut_a[pa_[both]] = True
        cut_b[pb[both]] = True
        pa_, pb = pa_ + (a <= b), pb + (b <= a)
        going = (pa_ != last_a) | (pb != last_b)
        if not going.all():
            pa_, pb, last_a, last_b = pa_[going], pb[going], last_a[going], last_b[going]
    return np.concatenate(links_a), np.concatenate(links_b), cut_a, cut_b


def group_texts(ids_a, ids_b, first_a, first_b, cut_a, cut_b, a_words: Vocabulary, b_words: Vocabulary) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b))])
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + before_b[group_a]] = a_words.numbers[ids_a + cut_a * len(a_words.tokens)]
    out[np.arange(len(ids_b)) + before_a[group_b + 1]] = b_words.numbers[ids_b + cut_b * len(b_words.tokens)]
    ends = (first_a + first_b).tolist()
    return [b"".join(out[a:b].tolist())[:-1] for a, b in zip(ends, ends[1:])]


def align_batch(texts: list[str | None], both: Encoders) -> dict:
    """Facts of every text of a batch, and the batch's distinct id pairs with the number of its texts that link them."""
    n = len(texts)
    given = [k for k, t in enumerate(texts) if t]
    kept, a, b = [], [], []
    for k, (x, y) in zip(given, both.encode([texts[k] for k in given])):
        if x is not None and both.b_words.joined(y) == b" " + texts[k].encode():
            kept.append(k)
            a.append(x)
            b.append(np.array(y, np.int64))
    facts = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    sha, places, times = [""] * n, [[]] * n, [[]] * n
    pairs, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if kept:
        first_a = np.concatenate([[0], np.cumsum([len(x) for x in a])])
        first_b = np.concatenate([[0], np.cumsum([len(x) for x in b])])
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        la, lb, cut_a, cut_b = merge(np.cumsum(both.a_words.lengths[ids_a]), np.cumsum(both.b_words.lengths[ids_b]), first_a, first_b)
        doc = np.searchsorted(first_a, la, "right") - 1
        # one plain sort of all links; only the distinct pairs of each text are then looked up among those of the batch
        span = len(both.a_words.tokens) * PAIR
        links = np.sort(doc * span + ids_a[la] * PAIR + ids_b[lb])
        first = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]]))
        count = np.diff(first, append=len(links))
        owner, held = np.divmod(links[first], span)
        ordered = np.sort(held)
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        pairs, docs = ordered[begin], np.diff(begin, append=len(ordered))
        place = np.searchsorted(pairs, held)
        bounds = np.searchsorted(owner, np.arange(len(kept) + 1)).tolist()
        facts["n_a"][kept], facts["n_b"][kept] = np.diff(first_a), np.diff(first_b)
        facts["n_groups"][kept] = np.add.reduceat(cut_a.astype(np.int64), first_a[:-1])
        facts["n_links"][kept] = np.bincount(doc, minlength=len(kept))
        texts_of = group_texts(ids_a, ids_b, first_a, first_b, cut_a, cut_b, both.a_words, both.b_words)
        for i, k in enumerate(kept):
            sha[k] = hashlib.sha256(texts_of[i]).hexdigest()
            places[k], times[k] = place[bounds[i] : bounds[i + 1]], count[bounds[i] : bounds[i + 1]]
    return {**facts, "groups_sha256": sha, "places": places, "times": times, "pairs": pairs, "docs": docs}


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.asarray(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document and one per batch (with ``pairs`` and ``docs``, and no ``n_a``)."""
    limit_batches(docs.sparkSession, ALIGN_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            found = align_batch(batch.column(1).to_pylist(), encoders(a_path, b_path))
            n = batch.num_rows

            def long(values, end=None):
                return pa.concat_arrays([pa.array(values, pa.int64()), pa.array([end], pa.int64())])

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, task + number)), pa.concat_arrays([batch.column(0), pa.nulls(1, pa.int64())]),
                    *[long(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array([*found["groups_sha256"], None], pa.string()),
                    _lists([*found["places"], []], pa.int32()), _lists([*found["times"], []], pa.int32()),
                    _lists([[]] * n + [found["pairs"]], pa.int64()), _lists([[]] * n + [found["docs"]], pa.int32()),
                ],
                names=[c.split()[0] for c in _ROWS.split(",")],
            )

    return docs.mapInArrow(run, _ROWS)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Links and groups of the tokens that two tokenizers make of every text.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A is a byte-level vocabulary given a space and the text, B one of
    pieces that adds the space itself; neither reads special tokens in a text. Texts that are null or empty, or whose tokens do not
    spell the space and the text byte by byte, have no tokens: zeros, and '' for the digest. Rows that repeat an
    id, or have none, are documents of their own. No rows give no rows.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A pair of ids counts as many documents as
    link it anywhere; ``n_best`` links have the highest count of all pairs of their A id, ``count_sum`` is over links.
    """
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    rows = store(aligned(id_and_text(docs), *paths))
    batches = rows.where(F.col("n_a").isNull())
    held = batches.select("batch", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("batch", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = store(held.groupBy("pair").agg(F.sum("docs").alias("n")))
    a_id = F.floor(F.col("pair") / PAIR)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    # every batch may hold the common pairs: rows of a pair are spread over slices by batch
    slices = max(1, -(-batches.count() // BATCHES_PER_SLICE))
    ranked = (
        counts.withColumn("a", a_id).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    )
    known = held.drop("docs").withColumn("slice", F.pmod(F.xxhash64("batch"), F.lit(slices)).cast("int")).join(ranked, ["pair", "slice"]).select("batch", "place", "n", "is_best")
    documents = rows.where(F.col("n_a").isNotNull()).drop("pairs", "docs")

    def total(own: pa.Table, known: pa.Table) -> pa.Table:
        size = known.num_rows
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = known.column("place").to_numpy()
        n[at], best[at] = known.column("n").to_numpy(), known.column("is_best").to_numpy(zero_copy_only=False)
        places, times = own.column("places").combine_chunks(), own.column("times").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy())])
        p, t = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def per_document(values):
            sums = np.concatenate([[0], np.cumsum(values)])
            return pa.array(sums[ends[1:]] - sums[ends[:-1]])

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[own.column(c) for c in names], per_document(best[p] * t), per_document(n[p] * t), own.column("groups_sha256")],
                        names=[*names, "n_best", "count_sum", "groups_sha256"])

    documents = documents.toDF(*documents.columns)  # other names than those in known
    return documents.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(
        total, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
