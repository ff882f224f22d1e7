"""Best-fit packing of tokenised documents into sequences.

The lengths of all pieces make a histogram of at most ``capacity`` bins, whatever the corpus. On it the
driver plans: full patterns of few documents are enumerated over rounded lengths, with a greedy pattern of
any number for each length that is in none of them; non-negative least squares fits how often each is repeated, the counts are rounded down, and
fitted again to what they leave; the rest, the shortest pieces among it, is packed best-fit into the sequences begun so far or into new ones. The plan consists of runs, "the next n pieces of this
length go to sequences s, s+1, ... at this offset"; pieces find their run by length and rank.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholium.llm.common import id_and_text, map_arrow, store

CAPACITY = 4096
END_ID = 1
#: Lengths are rounded up to one of so many steps to enumerate full patterns, of at most so many documents.
STEPS = 64
PATTERN_DOCS = 3
#: Shares of the fitted repeats that are tried in a single fit, none of them 0.
FIXED_SHARES = (1.0, 0.5, 0.25)
#: Plans that fit in rounds: share of the pieces, the shortest, that patterns leave out, and share of the fitted repeats.
IN_ROUNDS = ((0.05, 1.0), (0.05, 0.97), (0.06, 1.0), (0.06, 0.94), (0.07, 1.0), (0.08, 1.0))
ROUNDS = 12
#: Plans with no more than one in so many sequences above the fewest count as equally good.
NEAR_LEAST = 2_000
#: Distinct words whose ids a worker remembers before it starts again; bounds its memory, not its results.
REMEMBERED_WORDS = 600_000
#: Words encoded in one call; bounds the tokenizer's own results.
ENCODED_AT_ONCE = 2_000
#: Words, of one document or more, whose new ones are learned together.
LEARNED_AT_ONCE = 30_000
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")  # str.split() takes these for white space, the tokenizer does not
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
_LETTERS_SIGNS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")


def space_words(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in _SPACE.split(text) if w] if any(c in text for c in _NOT_SPACE) else text.split()


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in
    a row. A word of Latin letters and trailing ASCII signs (without the apostrophe, which may begin a
    contraction) also falls apart between the two. Only words not met before are encoded.
    """

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as little-endian 32-bit numbers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, letters: list[str], others: list[str]) -> None:
        """``letters`` are encoded as one text each time: a run of letters ends with its only word-end token."""
        for at in range(0, len(letters), ENCODED_AT_ONCE):
            some = letters[at : at + ENCODED_AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(some):
                raise RuntimeError("the vocabulary does not mark every word's end")
            data = ids.tobytes()
            self.known.update(zip(some, [data[i:j] for i, j in zip([0, *ends], ends)]))
        for at in range(0, len(others), ENCODED_AT_ONCE):
            some = others[at : at + ENCODED_AT_ONCE]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[part] = array("I", found.ids).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Ids of words met for the first time, from those of letters and signs; case is dropped by the tokenizer."""
        known, letters, others, split = self.known, set(), set(), []
        for word in new:
            found = _LETTERS_SIGNS.fullmatch(word)
            if found:
                head, tail = found.groups()
                head = head.lower()
                split.append((word, head, tail))
                if head not in known:
                    letters.add(head)
                if tail and tail not in known:
                    others.add(tail)
            else:
                others.add(word)
        self._encode(list(letters), list(others))
        for word, head, tail in split:
            known[word] = known[head] + known[tail] if tail else known[head]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        waiting: list[list[str]] = []
        size = 0
        for text in [*texts, None]:
            words = space_words(text)
            waiting.append(words)
            size += len(words)
            if size > LEARNED_AT_ONCE or len(out) + len(waiting) > len(texts):
                if len(self.known) > REMEMBERED_WORDS:
                    self.known.clear()
                new = set(itertools.chain.from_iterable(waiting)).difference(self.known)
                if new:
                    self._learn(new)
                known = self.known
                out += [b"".join([known[w] for w in ws]) for ws in waiting]
                waiting, size = [], 0
        return out[: len(texts)]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker process: what a task learned, the next one knows."""
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token ids of every document plus ``end_id``, cut where longer than ``capacity``; one row per piece."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch, encode: WordIds) -> pa.RecordBatch:
        doc, piece, start, length, crc = [], [], [], [], []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                doc.append(doc_id)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_arrow(id_and_text(docs), cut, "doc_id long, piece int, start long, length long, ids_crc32 long", lambda: word_ids(path))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Minimise ``|a x - b|`` over ``x >= 0`` by active sets: no more patterns are used than there are lengths."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(6 * len(b)):
        gain = a.T @ (b - a @ x)
        gain[used] = -1
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            free = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = free <= 1e-12
            if not low.any():
                break
            # as far towards the free solution as no pattern falls below none; those that reach it leave
            x[at] += (x[at][low] / (x[at][low] - free[low])).min() * (free - x[at])
            used &= x > 1e-12
            x[~used] = 0
        x[:] = 0
        x[at] = free
    return x


def patterns(steps: int, most: int, used: list[int]) -> list[tuple[int, ...]]:
    """Multisets of at most ``most`` of the ``used`` rounded lengths that fill ``steps`` exactly."""
    found: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], room: int) -> None:
        fits = [u for u in used if u <= room and (not prefix or u <= prefix[-1])]
        if room == 0:
            found.append(prefix)
        if len(prefix) < most:
            for u in fits:
                extend((*prefix, u), room - u)

    extend((), steps)
    return found


def greedy_patterns(steps: int, used: list[int], full: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """For each of the ``used`` rounded lengths, descending, in no ``full`` pattern: as many of it as fit, then of each shorter one."""
    found, held = [], {u for shape in full for u in shape}
    for at in (k for k, u in enumerate(used) if u not in held):
        shape, room = (), steps
        for u in used[at:]:
            shape, room = shape + (u,) * (room // u), room % u
        found.append(shape)
    return found


class Plan:
    """Groups of equally filled sequences, and the runs that filled them. A group is (room, first sequence, count)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.by_patterns = capacity, 0, 0
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, rank, count, sequence, offset
        self.ranks: dict[int, int] = defaultdict(int)

    def put(self, length: int, first: int, count: int, room: int) -> None:
        self.runs.append((length, self.ranks[length], count, first, self.capacity - room))
        self.ranks[length] += count
        self.add(room - length, first, count)

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            if not self.groups[room]:
                bisect.insort(self.rooms, room)
            self.groups[room].append((first, count))

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, count = self.groups[room].pop()
        if count > most:
            self.groups[room].append((first + most, count - most))
            count = most
        elif not self.groups[room]:
            self.rooms.remove(room)
        return first, count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count


def fit(histogram: np.ndarray, rounded: np.ndarray, steps: int, most: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns of the rounded lengths, and how often each should be repeated to use them up."""
    per_step = np.bincount(rounded, weights=histogram, minlength=steps + 1)
    used = [u for u in range(steps, 0, -1) if per_step[u]]
    shapes = patterns(steps, most, used)
    shapes += greedy_patterns(steps, used, shapes)
    if not shapes:
        return shapes, np.zeros(0)
    matrix = np.zeros((steps + 1, len(shapes)))
    for k, shape in enumerate(shapes):
        for u in shape:
            matrix[u, k] += 1
    scale = per_step.max()
    return shapes, nonnegative_least_squares(matrix, per_step / scale) * scale


def whole(repeats: np.ndarray) -> np.ndarray:
    return np.floor(repeats + 1e-6).astype(np.int64)


def plan_packing(histogram: np.ndarray, capacity: int, steps: int = STEPS, most: int = PATTERN_DOCS) -> Plan:
    """Plan for ``histogram[length]`` pieces of every length.

    Of all plans tried, those within one in NEAR_LEAST of the fewest sequences count as equal; of them that is taken whose patterns hold most
    pieces, or the one of fewest sequences if several hold nine in ten.
    """
    width = -(-capacity // steps)
    steps = capacity // width
    rounded = np.minimum(-(-np.arange(capacity + 1) // width), steps)
    shapes, repeats = fit(histogram, rounded, steps, most)
    plans = [fill(histogram, capacity, width, rounded, shapes, whole(share * repeats)) for share in FIXED_SHARES]
    plans += [fill_in_rounds(histogram, capacity, width, rounded, steps, most, *kind) for kind in IN_ROUNDS]
    least = min(plan.sequences for plan in plans)
    near = [plan for plan in plans if NEAR_LEAST * (plan.sequences - least) <= least]
    mostly = 0.9 * histogram.sum()
    return max(near, key=lambda plan: (min(plan.by_patterns, mostly), -plan.sequences, plan.by_patterns))


def fill(histogram: np.ndarray, capacity: int, width: int, rounded: np.ndarray, shapes: list, repeats: np.ndarray) -> Plan:
    """Fill sequences by patterns as often as ``repeats`` says, then pack what is left best-fit, longest first."""
    left, plan = histogram.astype(np.int64).copy(), Plan(capacity)
    place_patterns(plan, left, capacity, width, rounded, shapes, repeats)
    return best_fit(plan, left, capacity)


def fill_in_rounds(histogram: np.ndarray, capacity: int, width: int, rounded: np.ndarray, steps: int, most: int, fillers: float, share: float) -> Plan:
    """Fit patterns to what is left, again and again, until they place nothing more; then best-fit.

    The shortest pieces, a share ``fillers`` of all, take no part in patterns: they fill what those leave.
    """
    histogram = histogram.astype(np.int64)
    plan, short = Plan(capacity), histogram.copy()
    short[np.searchsorted(np.cumsum(histogram), fillers * histogram.sum(), "right") :] = 0
    left = histogram - short
    for _ in range(ROUNDS):
        before = plan.by_patterns
        shapes, repeats = fit(left, rounded, steps, most)
        place_patterns(plan, left, capacity, width, rounded, shapes, whole(share * repeats))
        if plan.by_patterns == before:
            break
    return best_fit(plan, left + short, capacity)


def place_patterns(plan: Plan, left: np.ndarray, capacity: int, width: int, rounded: np.ndarray, shapes: list, repeats: np.ndarray) -> None:
    """Open a sequence for every repeat that the pieces ``left`` allow, and take its pieces from them."""
    for k in sorted(np.flatnonzero(repeats), key=lambda k: (-repeats[k], k)):
        shape = shapes[k]
        need = {u: shape.count(u) for u in shape}
        have = {u: int(left[(rounded == u)].sum()) for u in need}
        count = int(min(repeats[k], *(have[u] // need[u] for u in need)))
        pending = [(plan.open(count), count, capacity)] if count else []
        for at, u in enumerate(shape):
            after = []
            for first, n, room in pending:
                while n:
                    # the last document fills what the exact lengths of the others left
                    top, low = (room, 1) if at == len(shape) - 1 else (min(u * width, capacity, room), (u - 1) * width + 1)
                    length = next((x for x in range(top, low - 1, -1) if left[x]), 0)
                    put = int(min(n, left[length])) if length else n
                    if length:
                        plan.runs.append((length, plan.ranks[length], put, first, capacity - room))
                        plan.ranks[length] += put
                        plan.by_patterns += put
                        left[length] -= put
                    after.append((first, put, room - length))
                    first, n = first + put, n - put
            pending = after
        for first, n, room in pending:
            plan.add(room, first, n)


def best_fit(plan: Plan, left: np.ndarray, capacity: int) -> Plan:
    """Put what is left, longest first, where it leaves least room."""
    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect.bisect_left(plan.rooms, length)
            if at < len(plan.rooms):
                room = plan.rooms[at]
                first, count = plan.take(room, int(left[length]))
            else:
                # as many equal pieces as fit go into new sequences together
                room, count = capacity, -(-int(left[length]) // (capacity // length))
                first = plan.open(count)
            left[length] -= count
            plan.put(length, first, count, room)
    return plan


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document's tokens into sequences of at most ``capacity``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text is one piece that only
    holds ``end_id``. Repeated rows are packed each, also under one id. A document of more than ``capacity`` ids is
    cut, and only then. Equal lengths go out in the order of partition, id and piece. Without documents
    there are no rows. Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    numbered = store(pieces(docs, vocabulary, capacity, end_id).withColumn("part", F.spark_partition_id()))
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("n"))
    bins = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in bins:
        histogram[row["length"]] = row["n"]
    runs = sorted(plan_packing(histogram, capacity).runs)
    # a piece's rank among all of its length: those of earlier parts, then its place within its part
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = numbered.withColumn("place", place).join(before, ["length", "part"]).withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0)))

    table = np.array(runs, np.int64).reshape(-1, 5)
    known = docs.sparkSession.sparkContext.broadcast(table)  # the number of runs depends on the bins, not on the documents

    def locate(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = known.value
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        order = table[:, 0] * (1 << 48) + table[:, 1]
        run = np.searchsorted(order, length * (1 << 48) + rank, side="right") - 1
        sequence = table[run, 3] + rank - table[run, 1]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(table[run, 4])],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )

    return map_arrow(
        ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), locate,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
