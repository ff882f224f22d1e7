"""Key look-ups that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLICE = 2_000_000
MAX_HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, keys: list[str], rows_per_slice: int, name: str) -> DataFrame:
    """Hot keys of a (keys, n) frame with the number of slices each is cut into.

    A key is hot when it has more than ``rows_per_slice`` rows and more than 1/MAX_HOT_KEYS of
    all rows; so there are at most MAX_HOT_KEYS of them at any scale.
    """
    share = counts.select(F.coalesce(F.sum("n"), F.lit(0)) / MAX_HOT_KEYS).scalar()
    limited = counts.withColumn("_limit", F.greatest(share, F.lit(float(rows_per_slice))))
    return limited.where(F.col("n") > F.col("_limit")).select(
        *keys, F.ceil(F.col("n") / F.col("_limit")).cast("int").alias(name)
    )


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    key: str | list[str],
    how: str = "left",
    rows_per_slice: int = ROWS_PER_SLICE,
    counts: DataFrame | None = None,
) -> DataFrame:
    """``rows`` joined to ``dim`` (unique on ``key``) without a hot partition.

    A side small enough by its bytes is broadcast by the adaptive planner. Rows of a hot key are spread over slices by hash, and its one dimension row is repeated per slice;
    the list of hot keys is bounded, hence broadcast. Counting combines on the map side.
    ``counts`` (key, n) may be given when the caller has them already.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, keys, rows_per_slice, "_slices")
    others = [c for c in rows.columns if c not in keys]
    spread = F.xxhash64(*others) if others else F.lit(0)
    left = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.pmod(spread, F.coalesce("_slices", F.lit(1))).cast("int")
    ).drop("_slices")
    right = dim.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    ).drop("_slices")
    return left.join(right, [*keys, "_slice"], how).drop("_slice")
