"""Removal of passages that occur earlier in the corpus, located by Aho-Corasick automata.

In every window of ``window`` words one phrase of ``PHRASE`` words is chosen by its hash, the same one wherever the
window's words recur: a window can only recur if its phrase does. Phrases that are chosen twice or more are
confirmed by their text. Documents are dealt to shards; each shard compiles an automaton of the
confirmed phrases chosen in its documents and streams those documents through it. The windows around what
it locates are compared across the corpus, by phrase and hash, for the one that starts earliest.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import id_and_text, limit_batches, map_arrow, mix64, own_id, remove, repeat, shared_dir, store, told_apart
from scholium.operators.lookup import lookup_join

PHRASE = 5
WINDOW = 20
#: Bytes of text in a shard, about; a longer document is a shard of its own.
SHARD_BYTES = 2_000_000
#: Rows of one context that meet its earliest row in a task, about.
ROWS_PER_SLICE = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def phrase_hashes(own: np.ndarray) -> np.ndarray:
    """Hashes of all runs of PHRASE words, in order."""
    acc = np.zeros(max(0, len(own) - PHRASE + 1), np.uint64)
    for k in range(PHRASE):
        acc *= _STEP
        acc += own[k : k + len(acc)]
    return mix64(acc)


def window_hashes(phrases: np.ndarray, window: int) -> np.ndarray:
    """Hashes of all windows, from those of phrases that cover them."""
    acc = np.zeros(len(phrases) - (window - PHRASE), np.uint64)
    for k in [*range(0, window - PHRASE, PHRASE), window - PHRASE]:
        acc *= _STEP
        acc += phrases[k : k + len(acc)]
    return mix64(acc)


def chosen(phrases: np.ndarray, window: int) -> np.ndarray:
    """Start of every window's phrase: the least hash in it, the leftmost of equals."""
    inside = np.lib.stride_tricks.sliding_window_view(phrases, window - PHRASE + 1)
    at = np.empty(len(inside), np.int64)
    for a in range(0, len(inside), 1 << 18):
        at[a : a + (1 << 18)] = inside[a : a + (1 << 18)].argmin(1)
    return at + np.arange(len(inside))


def phrase_text(words: list[bytes], at: int) -> str:
    return (b" " + b" ".join(words[at : at + PHRASE]) + b" ").decode("utf-8", "surrogatepass")


def phrases(docs: DataFrame, window: int) -> DataFrame:
    """``phrase, shard, n``: how often a phrase is chosen in a shard's documents, summed per batch."""

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        counts: Counter = Counter()
        for text, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            if len(words) >= window:
                places = np.unique(chosen(phrase_hashes(word_hashes(words)), window)).tolist()
                counts.update([(phrase_text(words, p), shard) for p in places])
        if not counts:
            return None
        texts, shards = zip(*counts)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(shards, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["phrase", "shard", "n"])

    return map_arrow(docs.select("text", "shard"), choose, "phrase string, shard long, n long")


def near_hits(found: np.ndarray, n_words: int, window: int) -> list[tuple[int, int]]:
    """Word ranges, apart from each other, of all windows that hold a phrase starting at one of the places found."""
    begin, stop = np.maximum(found - (window - PHRASE), 0), np.minimum(found + window, n_words)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > stop[:-1]]))
    last = np.concatenate([first[1:], [len(found)]]) - 1
    return list(zip(begin[first].tolist(), stop[last].tolist()))


def locate(words: list[bytes], automaton, window: int):
    """``(phrase hash, first window, window hashes)`` around every chosen phrase that the automaton finds.

    Only words around what the automaton finds are hashed.
    """
    text = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    ends = [end for end, _ in automaton.iter(text)]
    if not ends:
        return
    # the automaton reports the space behind a phrase; that space's number is the number of words before it
    marks = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.unique(np.searchsorted(np.flatnonzero(marks == 32), ends) - PHRASE)
    confirmed = np.zeros(len(words) + 1, bool)
    confirmed[found] = True
    for begin, stop in near_hits(found, len(words), window):
        if stop - begin < window:
            continue
        names = phrase_hashes(word_hashes(words[begin:stop]))
        at = chosen(names, window)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:], [len(at)]])
        keep = confirmed[at[first] + begin]
        if keep.any():
            hashes, names = window_hashes(names, window).view(np.int64), names.view(np.int64)
            for a, b in zip(first[keep].tolist(), last[keep].tolist()):
                yield int(names[at[a]]), begin + a, hashes[a:b]


def occurrences(docs: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """Rows ``phrase, context, doc_id, twin, start, windows``: neighbouring windows with one chosen, confirmed phrase."""
    limit_batches(docs.sparkSession)
    schema = pa.schema([
        ("phrase", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.binary()), ("start", pa.int32()), ("windows", pa.list_(pa.int64())),
    ])

    def scan(docs: pa.Table, own: pa.Table) -> pa.Table:
        phrase, context, start, windows, owner = [], [], [], [], []
        if own.num_rows and docs.num_rows:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in own.column("phrase").to_pylist():
                automaton.add_word(p)
            automaton.make_automaton()
            for k, text in enumerate(docs.column("text")):
                text = text.as_py()
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                if len(words) >= window:
                    for name, a, h in locate(words, automaton, window):
                        phrase.append(name)
                        context.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                        start.append(a)
                        windows.append(h)
                        owner.append(k)
        if not owner:
            return schema.empty_table()
        ends = np.concatenate([[0], np.cumsum([len(h) for h in windows])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(windows)))
        rows = pa.array(owner, pa.int64())
        return pa.table([pa.array(phrase, pa.int64()), pa.array(context, pa.int64()), docs.column("doc_id").take(rows), docs.column("twin").take(rows),
                         pa.array(start, pa.int32()), lists], schema=schema)

    return docs.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(
        scan, "phrase long, context long, doc_id long, twin binary, start int, windows array<long>")


def later_windows(found: DataFrame, window: int) -> DataFrame:
    """Rows ``doc_id, twin, start, stop``: words covered by windows that also start earlier.

    Equal contexts hold equal windows: all but the earliest are covered whole. Only the windows of each earliest
    context are looked up one by one. Windows are equal if their 64-bit hashes and those of their chosen phrases are.
    """
    place = F.struct("doc_id", "start")
    earliest = store(found.groupBy("phrase", "context").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    # a passage of every document is one context: its rows are dealt to slices
    firsts, counts = earliest.drop("n"), earliest.select("phrase", "context", "n")
    marked = lookup_join(found, firsts, ["phrase", "context"], "inner", ROWS_PER_SLICE, counts).withColumn("is_first", place == F.col("first"))
    marked = store(marked.select("phrase", "doc_id", "twin", "start", F.size("windows").alias("n"), F.when(F.col("is_first"), F.col("windows")).alias("windows")))
    whole = marked.where(F.col("windows").isNull()).select("doc_id", "twin", "start", (F.col("start") + F.col("n") + (window - 1)).alias("stop"))
    single = marked.where(F.col("windows").isNotNull()).select("phrase", "doc_id", "twin", F.col("start").alias("from"), F.posexplode("windows").alias("k", "window"))
    single = single.select("phrase", "window", "doc_id", "twin", (F.col("from") + F.col("k")).alias("start"))
    least = single.groupBy("phrase", "window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("phrase", "window", "first")
    later = single.join(least, ["phrase", "window"]).where(place != F.col("first"))
    return whole.union(later.select("doc_id", "twin", "start", (F.col("start") + window).alias("stop")))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every text without the words covered by a window that also starts earlier.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are runs without ASCII white space. Earlier means a
    smaller id, or the same id and an earlier start; a null id comes before all others. Rows that
    repeat an id are not earlier than each other at the same start, so equal ones are treated alike (they are worked on once). Windows are judged on the input.
    Null, empty and short texts lose nothing. No rows give no rows.
    Returns ``doc_id, n_words, n_removed, kept`` (the words left, joined by one space) and ``removed``, ranges of word positions.
    """
    if window <= PHRASE:
        raise ValueError(f"a window has more than {PHRASE} words")
    source, _ = told_apart(id_and_text(docs))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    source = source.withColumn("shard", F.pmod(F.xxhash64("doc_id", "twin"), F.lit(shards)))

    spark = docs.sparkSession
    paths = [shared_dir(spark) for _ in range(2)]
    counted = store(phrases(source, window), paths[0])
    recurring = counted.groupBy("phrase").agg(F.sum("n").alias("all")).where("all > 1").select("phrase")
    confirmed = store(counted.join(recurring, "phrase").select("phrase", "shard").distinct(), paths[1])
    found = store(occurrences(source, confirmed, window))
    for path in paths:
        remove(spark, path)
    ranges = later_windows(found, window).groupBy("doc_id", "twin").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("ranges"))
    ranges = store(ranges)

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept, removed = [], [], [], []
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            gone = np.zeros(len(words) + 1, np.int64)
            for r in own or []:
                gone[r["start"]] += 1
                gone[r["stop"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if own else words).decode("utf-8", "surrogatepass"))
            removed.append([{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(span)), batch.column(3)],
            names=["doc_id", "n_words", "n_removed", "kept", "removed", "n"],
        )

    rows = source.join(ranges, ["doc_id", "twin"], "left").select(own_id().alias("doc_id"), "text", "ranges", "n")
    out = map_arrow(rows, strip, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,stop:long>>, n long")
    return repeat(out, "n").drop("n")
