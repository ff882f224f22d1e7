"""Frame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, still inside the same stage.

    A filter on a plain projected column is pushed below the projection with its whole
    expression copied, so a costly text expression would run again for every filter and every
    explode. A one-element generator keeps the value as an attribute: it is narrow, runs in
    generated code, and optimizer rules do not look through it.
    """
    keep = [c for c in df.columns if c not in columns]
    fields = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(fields)))
