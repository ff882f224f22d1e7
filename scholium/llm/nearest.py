"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances: vectors are scaled by the largest norm and get one more component, so
that the nearest are those of largest inner product. Each table cuts ``k`` Gaussian projections into
cells; a query visits its own bucket and then perturbed ones in estimated order of success. Candidates of
all tables are ranked by the exact product. Equal vectors are indexed once.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholium.llm.common import map_arrow, mix64, store

TABLES = 4
#: Queries whose exact neighbours choose the number of hashes and probes: those with the least hashes.
CALIBRATION_QUERIES = 64
#: Share of exact neighbours of those queries that the visited buckets must hold.
CALIBRATION_RECALL = 0.96
MOST_PROBES = 243
#: Width of a cell that holds all vectors.
ONE_CELL = 1e12
#: Indexed vectors, and queries, that meet in one task at most (about, for the hash that deals them out).
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 8_192
SEED = 11


def perturbations(k: int, most: int) -> list[tuple[int, ...]]:
    """Sets of positions among the 2k sorted boundary distances, by expected distance, the empty one first."""
    j = np.arange(1, 2 * k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2))
    cost = np.where(j <= k, near, far)
    found: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(found) < most:
        value, chosen = heapq.heappop(heap)
        if all(2 * k - 1 - c not in chosen for c in chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (float(value - cost[last] + cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (float(value + cost[last + 1]), (*chosen, last + 1)))
    return found


@dataclass
class Hashing:
    """Cells of one set of tables; ``scale`` is the largest norm of an indexed vector."""

    dim: int
    k: int
    width: float
    scale: float
    probes: int = 1

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(TABLES, self.dim + 1, self.k))
        self.b = rng.uniform(0, 1, size=(TABLES, self.k))
        self.odd = rng.integers(1, 1 << 62, size=self.k).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])

    def key(self, table: int, cells: np.ndarray) -> np.ndarray:
        mixed = (cells.astype(np.int64).view(np.uint64) * self.odd).sum(-1, dtype=np.uint64)
        return mix64(mixed + np.uint64(table)).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Keys (rows, TABLES) of indexed vectors."""
        lifted = self.lift(x, False)
        return np.stack([self.key(t, np.floor(lifted @ self.a[t] / self.width + self.b[t])) for t in range(TABLES)], 1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Keys (rows, TABLES, probes) that queries visit, in order."""
        lifted, rows = self.lift(x, True), np.arange(len(x))
        out = []
        for t in range(TABLES):
            at = lifted @ self.a[t] / self.width + self.b[t]
            cell = np.floor(at)
            inside = at - cell
            order = np.argsort(np.hstack([inside, 1 - inside]), axis=1, kind="stable")
            keys = []
            for chosen in perturbations(self.k, self.probes):
                moved = cell.copy()
                for position in chosen:
                    which = order[:, position]
                    moved[rows, which % self.k] += np.where(which < self.k, -1, 1)
                keys.append(self.key(t, moved))
            out.append(np.stack(keys, 1))
        return np.stack(out, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: no nulls, only finite components, not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda c: c != 0))
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def exact_neighbours(index: DataFrame, queries: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest indexed vectors of a bounded set of queries: each task keeps its own nearest."""
    dim = queries.shape[1]
    known = index.sparkSession.sparkContext.broadcast(queries)

    def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(0), dim)
        s = known.value @ x.T
        best = np.argsort(-s, axis=1, kind="stable")[:, :count]
        q = np.repeat(np.arange(len(s)), best.shape[1])
        at = best.reshape(-1)
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s[q, at]), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["q", "score", "v"])

    found = map_arrow(index.select("v"), nearest, "q int, score double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "v"))
    rows = found.withColumn("rank", rank).where(F.col("rank") <= count).select("q", "score", "v").collect()
    return np.array([[r["q"], r["score"], *r["v"]] for r in rows], float).reshape(-1, dim + 2)


def calibrate(index: DataFrame, dim: int, count: int) -> Hashing:
    """Cells and probes from the exact neighbours of a bounded sample of the indexed vectors.

    Cells are as wide as the median distance to the farthest wanted neighbour. The number of hashes begins
    with the logarithm of the index's size and falls until the least number of probes that reaches the recall is
    within bounds. Where none is, or distances are not finite, there is one cell: every query then meets every vector.
    """
    size, norm = index.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()
    sample = index.orderBy(F.xxhash64("v"), "rep").limit(CALIBRATION_QUERIES).collect()
    queries = np.array([r["v"] for r in sample], float).reshape(-1, dim)
    found = exact_neighbours(index, queries, count)
    own, near = queries[found[:, 0].astype(int)], found[:, 2:]
    distance = np.sqrt(np.maximum(0, 2 - 2 * found[:, 1] / (np.linalg.norm(own, axis=1) * norm)))
    farthest = [distance[found[:, 0] == q].max() for q in range(len(queries))]
    width = float(np.maximum(np.median(farthest), 1e-6))
    everything = Hashing(dim, 1, ONE_CELL, norm if math.isfinite(norm) else 1.0)
    if not math.isfinite(width):
        return everything
    for k in range(max(1, round(math.log2(max(2, size / BLOCK_ROWS)) / 1.5) + 4), 0, -1):
        hashing = Hashing(dim, k, width, norm, MOST_PROBES)
        hit = hashing.visits(own) == hashing.buckets(near)[:, :, None]
        first = np.where(hit.any(2), hit.argmax(2), MOST_PROBES + 1).min(1) + 1
        needed = int(np.sort(first)[max(0, math.ceil(CALIBRATION_RECALL * len(first)) - 1)])
        if needed <= MOST_PROBES:
            hashing.probes = needed
            return hashing
    return everything


def neighbours(vectors: DataFrame, queries: DataFrame, count: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest ``count`` candidates of every query, by inner product in double precision.

    ``vectors`` and ``queries`` hold an id and a vector; other columns are ignored. Vectors that are null or zero or hold null or
    non-finite components take no part, on either side, nor do rows without an id. Queries are looked up
    among vectors of their own dimension; a candidate with the query's id is left out. Of
    repeated ids with equal vectors one counts. Ties go to the smaller id. No usable rows: no result.
    Returns ``query_id, rank, vec_id, score``.
    """
    data = usable(vectors, id_col, vector_col).distinct()
    asked = usable(queries, id_col, vector_col).distinct()
    # of equal vectors no query needs more than the first count + 1; the window keeps no more per task
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = store(
        data.withColumn("place", first).where(F.col("place") <= count + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]).withColumn("dim", F.size("v"))
    )
    wanted = store(asked.groupBy("v").agg(F.min("vec_id").alias("qid")).withColumn("dim", F.size("v")))
    dims = [r["dim"] for r in wanted.select("dim").distinct().intersect(index.select("dim").distinct()).orderBy("dim").collect()]
    found = None
    for dim in dims:
        part = search(index.where(F.col("dim") == dim), wanted.where(F.col("dim") == dim), dim, count)
        found = part if found is None else found.union(part)
    if found is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # back from distinct vectors to ids
    members = found.join(index.select("rep", "ids"), "rep").select("qid", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))
    lists = (
        members.withColumn("place", best).where(F.col("place") <= count + 1).groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    )
    answers = asked.join(wanted.select("v", "qid"), "v").select(F.col("vec_id").alias("query_id"), "qid").join(lists, "qid")
    own_out = answers.select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, count)).alias("at", "n"))
    return own_out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def search(index: DataFrame, wanted: DataFrame, dim: int, count: int) -> DataFrame:
    """``qid, rep, score``: for every query the best ``count + 1`` distinct vectors of all buckets visited."""
    spark = index.sparkSession
    hashing = spark.sparkContext.broadcast(calibrate(index, dim, count))
    keep = count + 1

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = hashing.value.buckets(_matrix(batch.column(1), dim))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), TABLES)), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(keys))), pa.array(keys.reshape(-1))],
            names=["rep", "tab", "key"],
        )

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = hashing.value.visits(_matrix(batch.column(1), dim))
        n, t, p = keys.shape
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), t * p)), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(keys.reshape(-1))],
            names=["qid", "tab", "key"],
        )

    placed = store(map_arrow(index.select("rep", "v"), put, "rep long, tab int, key long"))
    # buckets are dealt to blocks of about BLOCK_ROWS; a bucket of more rows is spread over several
    sizes = placed.groupBy("tab", "key").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(index.count() / BLOCK_ROWS)).cast("int"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    plan = store(sizes.select("tab", "key", F.pmod(F.xxhash64("tab", "key"), blocks).alias("block"), slices.alias("slices")))
    rows = (
        placed.join(plan, ["tab", "key"]).withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("slices")))
        .join(index.select("rep", "v"), "rep").select("tab", "block", "slice", "key", "rep", "v")
    )
    asks = store(
        map_arrow(wanted.select("qid", "v"), visit, "qid long, tab int, key long").join(plan, ["tab", "key"])
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
        .groupBy("qid", "tab", "block", "slice").agg(F.collect_list("key").alias("keys"))
    )
    # a block goes where its own queries are: once for as many as fit a task, and nowhere if nobody asks for it
    load = store(asks.groupBy("tab", "block", "slice").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts")))
    rows = rows.join(load, ["tab", "block", "slice"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    probes = (
        asks.join(load, ["tab", "block", "slice"]).withColumn("part", F.pmod(F.xxhash64("qid", F.lit(2)), F.col("parts")).cast("int")).drop("parts")
        .join(wanted.select("qid", "v"), "qid")
    )

    def rank(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asked.empty:
            return pd.DataFrame({"qid": [], "rep": [], "score": []})
        held = held.sort_values("key", kind="stable")
        x, q = np.stack(held["v"].to_numpy()), np.stack(asked["v"].to_numpy())
        keys, starts = np.unique(held["key"].to_numpy(), return_index=True)
        ends = [*starts[1:], len(held)]
        lists = asked["keys"].to_numpy()
        who = np.repeat(np.arange(len(asked)), [len(k) for k in lists])
        which = np.searchsorted(keys, np.concatenate(lists))
        order = np.argsort(which, kind="stable")
        who, which = who[order], which[order]
        best_s, best_r = np.full((len(q), keep), -np.inf), np.full((len(q), keep), -1, np.int64)
        reps = held["rep"].to_numpy()
        for bucket, (a, b) in enumerate(zip(starts, ends)):
            lo, hi = np.searchsorted(which, [bucket, bucket + 1])
            for at in range(lo, hi, 1024):
                some = who[at : min(hi, at + 1024)]
                s = np.hstack([best_s[some], q[some] @ x[a:b].T])
                r = np.hstack([best_r[some], np.broadcast_to(reps[a:b], (len(some), b - a))])
                top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                best_s[some], best_r[some] = np.take_along_axis(s, top, 1), np.take_along_axis(r, top, 1)
        real = best_r >= 0
        return pd.DataFrame({"qid": np.repeat(asked["qid"].to_numpy(), real.sum(1)), "rep": best_r[real], "score": best_s[real]})

    on = ["tab", "block", "slice", "part"]
    probes = probes.toDF(*probes.columns)  # other names for the plan's columns than those in rows
    found = rows.groupBy(on).cogroup(probes.groupBy(on)).applyInPandas(rank, "qid long, rep long, score double")
    # tables find the same vectors again; the order of sums in a product may differ, so one score is kept
    merged = found.groupBy("qid", "rep").agg(F.max("score").alias("score"))
    exact = merged.join(index.select("rep", F.col("v").alias("x")), "rep").join(wanted.select("qid", F.col("v").alias("y")), "qid")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "rep"))
    return exact.select("qid", "rep", score.alias("score")).withColumn("place", place).where(F.col("place") <= keep).drop("place")
