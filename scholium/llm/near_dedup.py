"""Near duplicates by SuperMinHash signatures, banding, exact verification and component labels.

Every shingle throws its ranks 0, 1, 2, ... at positions of a random permutation; a signature holds the least
rank and fraction per position and is complete as soon as no position waits for a later rank.
Documents of equal shingle sets are one node. Every node meets the chief of a bucket; then what is still
outside a bucket's largest component meets the nodes of others with which it shares a rare shingle: every
link between different components is found, without writing out the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import Scratch, id_and_text, limit_batches, map_arrow, mix64, own_id, repeat, store, told_apart, with_twin
from scholium.operators.lookup import lookup_join

#: At the least similarity s a link is missed with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8, 2e-8 at 0.85.
BANDS, ROWS = 24, 4
#: Pairs of one node that meet its text in a task, about.
TEXTS_PER_SLICE = 2_000
#: Counters that order shingles by frequency; bounds what is collected and broadcast.
TALLY = 1 << 20
#: Shingles whose permutations are held in memory at a time.
AT_ONCE = 1 << 16
_RANK, _FRACTION = np.uint64(56), np.uint64(8)
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z in lower case; the whole text if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    width = min(size, len(words))
    rows = len(words) - width + 1
    acc = np.full(rows, width, np.uint64)
    for k in range(width):
        acc = mix64(acc * _STEP + own[k : k + rows])
    return np.unique(acc)


def superminhash(hashes: np.ndarray, owner: np.ndarray, owners: int, length: int) -> np.ndarray:
    """Signatures (owners, length) of sets whose elements are ``hashes``; ``owner`` names each element's set."""
    signature = np.full(owners * length, np.iinfo(np.uint64).max, np.uint64)
    permuted = np.tile(np.arange(length, dtype=np.uint8), (len(hashes), 1))
    active = np.arange(len(hashes))
    for rank in range(length):
        if not len(active):
            break
        seed = hashes[active] + np.uint64(int(_STEP) * (rank + 1) % (1 << 64))
        swap = rank + (mix64(seed ^ _TURN) % np.uint64(length - rank)).astype(np.int64)
        place = permuted[active, swap]
        permuted[active, swap] = permuted[active, rank]
        np.minimum.at(signature, owner[active] * length + place, np.uint64(rank) << _RANK | mix64(seed) >> _FRACTION)
        waits = (signature.reshape(owners, length).max(1) >> _RANK) > rank
        active = active[waits[owner[active]]]
    return signature.reshape(owners, length)


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """Signatures of many sets; large sets are signed in parts, whose least values are theirs."""
    parts = [(i, s[a : a + AT_ONCE]) for i, s in enumerate(sets) for a in range(0, len(s), AT_ONCE)]
    out = np.full((len(sets), length), np.iinfo(np.uint64).max, np.uint64)
    group: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, (i, part) in enumerate(parts):
        group.append((i, part))
        size += len(part)
        if k + 1 == len(parts) or size + len(parts[k + 1][1]) > AT_ONCE:
            lengths = [len(p) for _, p in group]
            own = superminhash(np.concatenate([p for _, p in group]), np.repeat(np.arange(len(group)), lengths), len(group), length)
            np.minimum.at(out, [i for i, _ in group], own)
            group, size = [], 0
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        keys = mix64(keys * _STEP + parts[:, :, k])
    return keys.view(np.int64)


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, twin, copies, n_shingles, node, keys``; equal sets have one node, 128 bits wide, empty sets none."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, size) for t in batch.column(3).to_pylist()]
        keys = band_keys(signatures(sets, bands * rows), bands, rows).tolist()
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([k if len(s) else None for s, k in zip(sets, keys)], pa.list_(pa.int64())),
            ],
            names=["doc_id", "twin", "copies", "n_shingles", "node", "keys"],
        )

    return map_arrow(docs.select("doc_id", "twin", F.col("n").alias("copies"), "text"), make, "doc_id long, twin binary, copies long, n_shingles long, node binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of its component, for every node on an edge ``(a, b)``.

    Large and small stars in turn (each node's neighbours move to its least neighbour) until nothing changes. Only
    aggregates by node, and joins with them in which the edges of a node of very many are dealt to slices.
    """
    scratch = Scratch(edges.sparkSession)

    def least(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        per = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return per.select("u", "m"), per.select("u", "n")

    e = scratch.store(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = e.union(e.select("v", "u"))
        lower, counts = least(both)
        lower = lower.select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both, lower, "u", "inner", counts=counts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.store(large.where("u != v").distinct())
        lower, counts = least(large)
        moved = lookup_join(large, lower, "u", "inner", counts=counts)
        e = scratch.store(moved.select("u", F.col("m").alias("v")).union(moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct())
    out = store(e.select(F.col("u").alias("node"), F.col("v").alias("label")))
    scratch.clear()
    return out


def similarities(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``a, b, common, total``: shingles in both and in either full set of the nodes of every pair."""
    sides = pairs
    for side in "ab":  # the pairs of a node of very many are dealt to slices
        counts = pairs.groupBy(side).agg(F.count("*").alias("n"))
        sides = lookup_join(sides, texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}")), side, "inner", TEXTS_PER_SLICE, counts)
    limit_batches(pairs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets: dict[int, np.ndarray] = {}  # of this batch, whose bytes are bounded
            for nodes, column in ((a, batch.column(2)), (b, batch.column(3))):
                for k, node in enumerate(nodes):
                    if node not in sets:
                        sets[node] = shingle_hashes(column[k].as_py(), size)
            common = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)]
            total = [len(sets[x]) + len(sets[y]) - n for x, y, n in zip(a, b, common)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    return sides.select("a", "b", "ta", "tb").mapInArrow(count, "a long, b long, common long, total long")


def least_bands(percent: int, bands: int, rows: int, risk: float = 1e-6) -> int:
    """Bands that linked nodes share but for the given risk; 1, which banding asks for anyway, at least."""
    p = (percent / 100) ** rows
    fewer, shared = (1 - p) ** bands, 1
    while True:
        fewer += math.comb(bands, shared) * p**shared * (1 - p) ** (bands - shared)
        if fewer > risk:
            return shared
        shared += 1


def rare_first(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, at, shingle``: of every set as many of its rarest shingles as any linked set must share one of, in order.

    Sets of n and more shingles with ``percent`` of their union in common cannot avoid each other's first
    n - ceil(percent n / 100) + 1, in any order of all shingles. The order is by counts in a table of fixed size,
    so rare ones come first; shingles that share a place in it only make the order worse, not the result.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TALLY, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(seen, (shingle_hashes(text.as_py(), size) % np.uint64(TALLY)).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["place", "n"])

    spark = texts.sparkSession
    limit_batches(spark)
    counted = texts.select("text").mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(TALLY, np.int64)
    table[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    known = spark.sparkContext.broadcast(table)

    def rarest(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, lengths = [np.zeros(0, np.int64)], []
        for text in batch.column(1):
            own = shingle_hashes(text.as_py(), size)
            order = np.lexsort((own, known.value[(own % np.uint64(TALLY)).astype(np.int64)]))
            out.append(own[order[: len(own) + 1 - -(-percent * len(own) // 100)]].view(np.int64))
            lengths.append(len(out[-1]))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(np.concatenate(out))], names=["node", "at", "shingle"])

    return map_arrow(texts.select("node", "text"), rarest, "node long, at int, shingle long")


def link(nodes: DataFrame, texts: DataFrame, size: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``node, label`` of all nodes (numbers) that have a link.

    First every node meets one other, the chief of one of its buckets: the node whose buckets hold most. What that links
    is settled. In buckets that still hold several components, the nodes outside the largest one then meet those
    of other components with which they share a rare shingle and enough bands. Linked nodes share both,
    so no link between different components is missed, and no pair of a group is written out for the group's sake.
    """
    scratch = Scratch(nodes.sparkSession)
    posted = nodes.select("node", F.explode("keys").alias("key"))
    shared = scratch.store(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    posted = scratch.store(lookup_join(posted, shared.select("key", F.col("n").alias("held")), "key", "inner", counts=shared))
    reach = scratch.store(posted.groupBy("node").agg(F.sum("held").alias("reach")))
    texts = scratch.store(texts.join(reach.select("node"), "node"))  # only those of nodes that share a bucket
    chiefs = posted.drop("held").join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node")).alias("chief"))
    met = lookup_join(posted.drop("held"), chiefs, "key", "inner", counts=shared).where(F.col("node") != F.col("chief.node"))
    met = met.groupBy("node").agg(F.max("chief").alias("chief")).select(F.col("node").alias("a"), F.col("chief.node").alias("b"))
    sizes = nodes.select("node", "n")

    def near_in_size(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    met = lookup_join(met.join(sizes.toDF("a", "na"), "a"), sizes.toDF("b", "nb"), "b", "inner").where(near_in_size("na", "nb"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    enough = 100 * F.col("common") >= percent * F.col("total")
    labels = components(scratch.store(similarities(scratch.store(met), texts, size).where(enough).select("a", "b")))

    placed = scratch.store(posted.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    by_label = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    open_keys = scratch.store(open_keys.drop("labels"))
    inside = lookup_join(placed, open_keys.drop("n"), "key", "inner", counts=open_keys.select("key", "n"))
    inside = inside.groupBy("node").agg(F.any_value("label").alias("label"), F.max(F.col("label") != F.col("largest")).alias("outside"), F.count("*").alias("open"))
    # two nodes without a link yet share as many open buckets as linked ones share bands
    asked = least_bands(percent, bands, rows)
    inside = scratch.store(inside.where(F.col("open") >= asked).join(sizes, "node").select("node", "label", "outside", "n"))

    rare = rare_first(scratch.store(texts.join(inside.select("node"), "node")), size, percent)
    each = scratch.store(rare.join(inside, "node"))
    there = each.where("outside").select("shingle", *[F.col(c).alias(f"o_{c}") for c in ("node", "label", "n", "at")])
    # nothing before the first shingle that two share is common, so what follows it on either side bounds what is
    left = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    pairs = each.join(there, "shingle").where(
        (F.col("label") != F.col("o_label")) & (~F.col("outside") | (F.col("node") < F.col("o_node")))  # of two nodes outside, one row is enough
        & near_in_size("n", "o_n") & ((100 + percent) * left >= percent * (F.col("n") + F.col("o_n"))))
    pairs = scratch.store(pairs.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct())
    ints = nodes.select("node", F.transform("keys", lambda k: k.bitwiseAND((1 << 31) - 1).cast("int")).alias("bands")).join(inside.select("node"), "node")
    ints = scratch.store(ints)
    same = F.size(F.filter(F.zip_with("xs", "ys", lambda x, y: x == y), lambda x: x))
    pairs = scratch.store(pairs.join(ints.toDF("a", "xs"), "a").join(ints.toDF("b", "ys"), "b").where(same >= asked).select("a", "b"))
    second = similarities(pairs, texts, size).where(enough).select("a", "b")
    # links between labels: the components of components
    a, b = (labels.toDF(side, f"{side}_label") for side in "ab")
    ends = second.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    merged = components(ends)
    moved = labels.join(merged.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = store(moved.union(merged.join(labels, "node", "left_anti")))
    scratch.clear()
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate groups of whole texts.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Two documents are linked if their sets of ``size``-word
    shingles have at least ``percent`` of their union in common. Texts without words, also null ones, are linked with
    nothing. Rows that repeat an id are documents of their own with one id; if their texts differ, each has the group of its own text.
    Rows without an id are documents like others, and take part in links; a group of none but those has no ``component_id``.
    An empty table gives no rows. Returns ``doc_id, n_shingles, component_id, kept``: ``component_id`` is the smallest id reachable.
    """
    out, _ = grouped(docs, size, percent, bands, rows)
    out = repeat(out, "copies").select(own_id().alias("doc_id"), "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped(docs: DataFrame, size: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, bool]:
    """``doc_id, twin, copies, n_shingles, label, component_id`` of every id and text, and whether ids are unique.

    ``label`` is the number of a text's group, null without words; ids as in :func:`scholium.llm.common.told_apart`.
    """
    source, unique = told_apart(id_and_text(docs))
    sketches = store(sketch(source, size, bands, rows))
    full = sketches.where(F.col("node").isNotNull())
    nodes = full.groupBy("node").agg(
        F.min(F.struct("doc_id", "twin")).alias("holder"), F.min(own_id()).alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"),
        F.count("*").alias("rows"))
    # stored nodes keep their number, which stands for them from here on
    nodes = store(nodes.withColumnRenamed("node", "set").withColumn("node", F.monotonically_increasing_id()))
    texts = source.join(nodes.select("holder.*", "node"), ["doc_id", "twin"]).select("node", "text")  # one text of every node
    labels = link(nodes.select("node", "n", "keys"), texts, size, percent, bands, rows)
    label = nodes.select("set", "node", "least", "rows").join(labels, "node", "left").select("set", "least", "rows", F.coalesce("label", "node").alias("label"))
    least = label.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    answer = store(lookup_join(label.drop("least"), least.drop("n"), "label", counts=least.select("label", "n")).withColumnRenamed("set", "node"))
    columns = ["doc_id", "twin", "copies", "n_shingles", "label", "component_id"]
    out = lookup_join(full.drop("keys"), answer.drop("rows"), "node", "inner", counts=answer.select("node", F.col("rows").alias("n"))).select(columns)
    alone = sketches.where(F.col("node").isNull()).withColumns({"label": F.lit(None).cast("long"), "component_id": own_id()}).select(columns)
    return out.union(alone), unique


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the smallest id; all columns stay as they are.

    A row stands for its own text, so an id repeated with texts of several groups is kept or not in each of them. Where
    the smallest id has several rows in a group, the first text stays. A group without any id keeps one row.
    Texts without words are linked with nothing: of those that repeat an id one stays, those without an id stay all.
    An empty table gives no rows.
    """
    groups, unique = grouped(docs, size, percent)
    nameless = own_id().isNull()
    worded = groups.where(F.col("label").isNotNull())
    first = worded.groupBy("label").agg(F.min(F.struct(nameless.alias("nameless"), "doc_id")).alias("k")).select("label", "k.doc_id")
    bare = groups.where(F.col("label").isNull()).select("label", "doc_id", "twin")
    kept = store(worded.select("label", "doc_id", "twin").join(first, ["label", "doc_id"]).union(bare))
    if unique:  # at most one id is null
        chosen = kept.select(own_id().alias("_kept"))
        return docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    rows = with_twin(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = rows.join(kept, ["doc_id", "twin"])
    empty = F.col("label").isNull() & nameless
    one = rows.where(~empty).groupBy("label", "doc_id").agg(F.min_by("row", F.struct(F.col("text").isNull(), "text")).alias("row"))
    return one.select("row.*").union(rows.where(empty).select("row.*"))
