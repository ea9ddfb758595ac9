"""One row per key, and rows not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best_per_key(df: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return (
        df.groupBy(*keys).agg(pick(row).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate, not a window: copies of a key shrink to one row per map
    task before the shuffle, so a key with a third of all rows is harmless.
    """
    rank = F.struct(*[F.col(c) for c in order])
    return _best_per_key(df, keys, lambda row: F.min_by(row, rank))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.struct(*[F.col(c) for c in order])
    return _best_per_key(df, keys, lambda row: F.max_by(row, rank))


def not_seen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``seen``."""
    return new.join(seen.select(*keys), keys, "left_anti")
