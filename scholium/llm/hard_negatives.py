"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

Rows are scaled to integers, ordered by label and by their place on a Hilbert curve, and written as Parquet
blocks, one folder each. A block's zone map is the least and largest value of every dimension and of the label.
Interval arithmetic on a zone map bounds the inner products of an anchor with all rows of the block: only blocks
whose interval can hold one of the anchor's best positives, or meets one of its score windows, are
read. The bounds are exact integers, so no answer is lost, whatever they leave out.

Anchors pass through in chunks of bounded size, each against the blocks it needs; within a task only the
anchors whose interval meets a block are multiplied with it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholium.llm.common import limit_batches, shared_dir, store

#: Rows of a block, and anchors of a chunk at most (the only rows that pass through the driver, chunk by chunk).
BLOCK_ROWS = 2_048
CHUNK = 16_384
#: Bits of a place on the curve, shared among the first dimensions, at most CURVE_DIMS.
CURVE_BITS, CURVE_DIMS = 60, 15
#: Products that are held at once in a task.
AT_ONCE = 1 << 21
#: Largest scaled component and dimension: 100 times 2**22 squared, times 2**12, fits a long.
MOST, MOST_DIMS = 1 << 22, 1 << 12
_NONE = -np.iinfo(np.int64).max


def curve_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every row of small non-negative integers on the Hilbert curve of as many dimensions."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            x[0] ^= np.where(high, below, 0)
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | x[i] >> level & 1
    return place


def curve_of(v: np.ndarray) -> np.ndarray:
    """Places of vectors by direction: the first components, as shares of the norm, cut into cells."""
    dims = min(v.shape[1], CURVE_DIMS)
    if not dims:
        return np.zeros(len(v), np.int64)
    bits = min(16, CURVE_BITS // dims)
    norm = np.maximum(np.sqrt((v.astype(float) ** 2).sum(1, keepdims=True)), 1e-9)
    share = v[:, :dims] / norm * np.sqrt(v.shape[1]) / 6 + 0.5
    return curve_places(np.clip(np.floor(share * (1 << bits)), 0, (1 << bits) - 1), bits)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; in floating point where every sum fits its mantissa."""
    if not a.size or not x.size:
        return np.zeros((len(a), len(x)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(x).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ x.T.astype(np.int64)


def interval(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every row of ``a`` with any vector between ``low`` and ``high``."""
    plus, minus, ends = np.maximum(a, 0), np.minimum(a, 0), np.stack([low, high])
    p, m = products(plus, ends), products(minus, ends)
    return p[:, 0] + m[:, 1], p[:, 1] + m[:, 0]


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v, dim`` of the rows that take part, components as ``floor(256 x)``."""
    v = F.transform("v", lambda c: F.floor(c * 256.0))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= MOST / 256.0))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(~bad & (F.size("v") <= MOST_DIMS))
    return rows.select("vec_id", "label", v.cast("array<int>").alias("v"), F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def with_curve(rows: DataFrame) -> DataFrame:
    """Rows with their ``place`` on the curve of their dimension."""
    limit_batches(rows.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            place = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                place[at] = curve_of(_matrix(batch.column("v").take(pa.array(at)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(put, "vec_id long, label long, v array<int>, dim int, anchor boolean, place long")


def write_blocks(rows: DataFrame, count: int) -> DataFrame:
    """Rows in order of dimension, label and curve, cut into blocks of one dimension, a folder per block."""
    spark = rows.sparkSession
    parts = max(1, -(-count // (32 * BLOCK_ROWS)))
    ordered = with_curve(rows).repartitionByRange(parts, "dim", "label", "place", "vec_id").sortWithinPartitions("dim", "label", "place", "vec_id")
    ordered = ordered.withColumn("part", F.spark_partition_id().cast("long")).drop("place")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = -1, 0, None
        for batch in batches:
            part = batch.column("part").to_numpy()
            out = np.empty(len(part), np.int64)
            for k, dim in enumerate(batch.column("dim").to_numpy().tolist()):
                if held == BLOCK_ROWS or dim != last:
                    block, held, last = block + 1, 0, dim
                held += 1
                out[k] = block
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names if n != "part"], pa.array(part << 32 | out)], names=[*[n for n in names if n != "part"], "block"])

    numbered = ordered.mapInArrow(number, "vec_id long, label long, v array<int>, dim int, anchor boolean, block long")
    path = shared_dir(spark)
    numbered.write.partitionBy("block").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of a task, each whole: rows of a block follow one another, in one batch or several."""
    def pieces():
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(block)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(block)]):
                if b > a:
                    yield int(block[a]), batch.slice(a, b - a)

    for block, group in itertools.groupby(pieces(), key=lambda piece: piece[0]):
        yield block, pa.Table.from_batches([piece for _, piece in group]).combine_chunks()


def block_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a block, by id: stable sorts then settle ties."""
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    dim = table.column("dim")[0].as_py()
    x = _matrix(table.column("v").combine_chunks(), dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], labels[order], x[order]


def zone_maps(blocks: DataFrame) -> DataFrame:
    """``block, dim, low, high, label_low, label_high``; a block read in two parts has two rows, which is as good."""
    limit_batches(blocks.sparkSession)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in runs(batches):
            _, labels, x = block_arrays(table)
            yield pa.RecordBatch.from_pylist(
                [{"block": block, "dim": x.shape[1], "low": x.min(0).tolist() if x.size else [], "high": x.max(0).tolist() if x.size else [],
                  "label_low": int(labels.min()), "label_high": int(labels.max())}],
                schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())),
                                  ("label_low", pa.int64()), ("label_high", pa.int64())]),
            )

    return blocks.select("vec_id", "label", "v", "dim", "block").mapInArrow(
        bound, "block long, dim int, low array<int>, high array<int>, label_low long, label_high long")


def anchors_with_floor(blocks: DataFrame, positives: int) -> DataFrame:
    """``vec_id, label, v, dim, block, floor``: the anchors, with the score that their own block already grants their last positive."""
    limit_batches(blocks.sparkSession)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in runs(batches):
            chosen = table.filter(table.column("anchor"))
            if not chosen.num_rows:
                continue
            ids, labels, x = block_arrays(table)
            who, own, a = block_arrays(chosen)
            floor = np.full(len(who), _NONE)
            if len(ids) > positives:
                for part in np.array_split(np.arange(len(who)), -(-len(who) * len(ids) // AT_ONCE)):
                    s = np.where((own[part, None] == labels) & (who[part, None] != ids), products(a[part], x), _NONE)
                    floor[part] = np.partition(s, len(ids) - positives, axis=1)[:, len(ids) - positives]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.array(own), pa.array(a.tolist(), pa.list_(pa.int32())), pa.array(np.full(len(who), a.shape[1], np.int32)),
                 pa.array(np.full(len(who), block)), pa.array(floor)], names=["vec_id", "label", "v", "dim", "block", "floor"])

    return blocks.mapInArrow(seed, "vec_id long, label long, v array<int>, dim int, block long, floor long")


def in_chunks(anchors: DataFrame, number: int) -> DataFrame:
    """Anchors with the ``chunk`` they pass through in: ranges of blocks, so that a chunk's anchors lie near each other."""
    chunks = -(-2 * number // CHUNK)  # twice as many as are needed, as ranges come out of unequal size
    if chunks < 2:
        return anchors.withColumn("chunk", F.lit(0))
    cuts = [k / chunks for k in range(1, chunks)]
    bounds = anchors.groupBy("dim").agg(F.percentile_approx("block", cuts, 20 * chunks).alias("bounds"))
    return anchors.join(bounds, "dim").withColumn("chunk", F.size(F.filter("bounds", lambda b: b < F.col("block")))).drop("bounds")


class Chunk:
    """Some anchors of one dimension and what they look for; sent to the tasks.

    Without ``windows``: the best of the own label, not below ``floor``. With ``windows`` (anchors, places; ``_NONE`` where there
    is none): for each the best of other labels, not above it nor below ``least`` per cent of it.
    """

    def __init__(self, ids, labels, vectors, floor=None, windows=None, least=80, keep=5):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.floor, self.windows, self.least, self.keep = floor, windows, least, keep

    def wanted(self, low, high, label_low: int, label_high: int) -> np.ndarray:
        """Positions of the anchors that must read a block."""
        least, most = interval(self.vectors, low, high)
        if self.windows is None:
            return np.flatnonzero((label_low <= self.labels) & (self.labels <= label_high) & (most >= self.floor))
        meets = (self.windows != _NONE) & (100 * most[:, None] >= self.least * self.windows) & (least[:, None] <= self.windows)
        return np.flatnonzero(meets.any(1) & ((label_low != self.labels) | (label_high != self.labels)))

    def search(self, blocks: Iterator[tuple[int, pa.Table]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (anchors, places, keep) of the best in the given blocks."""
        places = 1 if self.windows is None else self.windows.shape[1]
        score = np.full((len(self.ids), places, self.keep), _NONE)
        name = np.full(score.shape, _NONE)
        for _, table in blocks:
            ids, labels, x = block_arrays(table)
            if x.shape[1] != self.vectors.shape[1]:
                continue
            readers = self.wanted(x.min(0), x.max(0), labels.min(), labels.max()) if x.size else np.arange(len(self.ids))
            for part in np.array_split(readers, -(-len(readers) * len(ids) // AT_ONCE)) if len(readers) else []:
                s, same = products(self.vectors[part], x), self.labels[part, None] == labels
                for place in range(places):
                    if self.windows is None:
                        fits = same & (self.ids[part, None] != ids) & (s >= self.floor[part, None])
                    else:
                        top = self.windows[part, place, None]
                        fits = ~same & (top != _NONE) & (s <= top) & (100 * s >= self.least * top)
                    self.take(score[:, place], name[:, place], part, np.where(fits, s, _NONE), ids)
        return score, name

    def take(self, score, name, part, s, ids) -> None:
        """Merge a block's scores into the best so far; ids ascend, but not from block to block."""
        peak = s.max(1)
        rows = np.flatnonzero((peak != _NONE) & (peak >= score[part, -1]))
        if not len(rows):
            return
        at = part[rows]
        order = np.argsort(-s[rows], axis=1, kind="stable")[:, : self.keep]
        found = np.take_along_axis(s[rows], order, 1)
        both_s = np.hstack([score[at], found])
        both_n = np.hstack([name[at], np.where(found == _NONE, _NONE, ids[order])])
        rank = np.lexsort((both_n, -both_s), axis=1)[:, : self.keep]
        score[at], name[at] = np.take_along_axis(both_s, rank, 1), np.take_along_axis(both_n, rank, 1)


def read_by(chunk, blocks: DataFrame, zones: DataFrame, dim: int) -> DataFrame:
    """``anchor, place, vec_id, score``: the best of every task, from the blocks that the chunk's anchors must read."""
    limit_batches(blocks.sparkSession)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (_matrix(batch.column(c), dim) for c in ("low", "high"))
            labels = zip(batch.column("label_low").to_pylist(), batch.column("label_high").to_pylist())
            yes = [bool(len(chunk.value.wanted(a, b, *own))) for a, b, own in zip(low, high, labels)]
            yield batch.select(["block"]).filter(pa.array(yes, pa.bool_()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, name = chunk.value.search(runs(batches))
        who, place, k = np.nonzero(score != _NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.value.ids[who]), pa.array(place.astype(np.int32)), pa.array(name[who, place, k]), pa.array(score[who, place, k])],
            names=["anchor", "place", "vec_id", "score"])

    needed = zones.where(F.col("dim") == dim).mapInArrow(choose, "block long")
    # the chosen blocks prune the folders of the scan, where they are few enough to be sent around
    rows = blocks.where(F.col("dim") == dim).join(needed.distinct(), "block", "left_semi")
    return rows.select("vec_id", "label", "v", "dim", "block").mapInArrow(search, "anchor long, place int, vec_id long, score long")


def best(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of every anchor and place, numbered from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 5, least: int = 80,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``vectors`` holds an id, a vector and a label; other columns are ignored. Rows in which one of them is null, or a component is
    null, not finite or at least 16,384 in magnitude, or that have over 4,096 components, take no part (per cents of their products would not fit a long). Of rows that repeat
    an id the one of least label, then least vector, takes part. ``is_anchor`` tells anchors by id. Vectors meet those of their own
    dimension only. No rows, or no anchors: no result. Components count as ``floor(256 x)``, scores are exact inner products, higher ones first, ties by id.

    An anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other
    labels whose score is at most the positive's and at least ``least`` per cent of it are returned:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vector_col, label_col)
    counts = rows.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if counts["most"] > 1:
        one = F.min(F.struct("label", "v", "dim")).alias("r")
        rows = rows.groupBy("vec_id").agg(one).select("vec_id", "r.*")
    rows = rows.withColumn("anchor", F.coalesce(is_anchor(F.col("vec_id")), F.lit(False)))
    answer = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not counts["n"]:
        return spark.createDataFrame([], answer)
    blocks = write_blocks(rows, counts["n"])
    zones = store(zone_maps(blocks))
    anchors = anchors_with_floor(blocks, positives)
    number = blocks.where("anchor").count()
    anchors = store(in_chunks(store(anchors), number))
    path = shared_dir(spark)
    for part in anchors.select("dim", "chunk").distinct().orderBy("dim", "chunk").collect():
        own = anchors.where((F.col("dim") == part["dim"]) & (F.col("chunk") == part["chunk"])).orderBy("vec_id").toArrow()
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        a = _matrix(own.column("v").combine_chunks(), part["dim"])
        first = Chunk(ids, labels, a, floor=own.column("floor").to_numpy(), keep=positives)
        sent = spark.sparkContext.broadcast(first)
        good = best(read_by(sent, blocks, zones, part["dim"]), positives).toArrow()
        sent.unpersist()
        at, rank = np.searchsorted(ids, good.column("anchor").to_numpy()), good.column("rank").to_numpy() - 1
        windows, names = np.full((len(ids), positives), _NONE), np.full((len(ids), positives), _NONE)
        windows[at, rank], names[at, rank] = good.column("score").to_numpy(), good.column("vec_id").to_numpy()
        sent = spark.sparkContext.broadcast(Chunk(ids, labels, a, windows=windows, least=least, keep=negatives))
        hard = best(read_by(sent, blocks, zones, part["dim"]), negatives)
        of = spark.createDataFrame(good).select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        hard.join(of, ["anchor", "place"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(answer).parquet(path) if number else spark.createDataFrame([], answer)
