"""Approximate quantiles and distinct counts from small sketches that are stored per batch and merged later.

The exact operators read all rows again for each new batch; these read a row
per group and batch.  A sketch has a bounded size, so a hot group costs no
more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scalars import without_nan

# Accuracy: ranks are off by about 0.3 per cent, distinct counts by about 0.8 per cent.
RANK_K = 800
DISTINCT_LG_K = 14


def sketch_groups(df: DataFrame, keys: list[str], value: str, entity: str) -> DataFrame:
    """Per group: rows, a sketch of ``value`` and one of the distinct ``entity``; missing ones are not in them."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.kll_sketch_agg_double(without_nan(F.col(value)), F.lit(RANK_K)).alias("values"),
        F.hll_sketch_agg(F.col(entity), F.lit(DISTINCT_LG_K)).alias("entities"),
    )


def merge_sketches(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several batches as one per group."""
    return stored.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.kll_merge_agg_double("values", F.lit(RANK_K)).alias("values"),
        F.hll_union_agg("entities").alias("entities"),
    )


def sketched(merged: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``keys, rows, distinct`` and ``q0, q1 ...`` for the wanted quantiles (null for a group without values)."""
    known = F.kll_sketch_get_n_double("values") > 0
    quantiles = [F.when(known, F.kll_sketch_get_quantile_double("values", F.lit(float(p)))).alias(f"q{i}") for i, p in enumerate(probs)]
    return merged.select(*keys, "rows", F.hll_sketch_estimate("entities").alias("distinct"), *quantiles)
