"""Exact interpolated quantiles per group, for groups of any size.

Values fall into narrow bins whose counts combine on the map side, so the
first shuffle is small however large a group is.  The counts tell which bins
hold a wanted rank; only values in those bins are looked at again, counted
and sorted.  A bin that still has more distinct values than one task should
sort is cut again, as often as needed.  The result is exact.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.operators.scale import GROUP_ROWS, attach, durable

BINS = 4096

# First bins: this many per unit of ln(1 + |value|), each about 0.1 % wide.
# A double has no more than 2 * 710 such units, which bounds bins per group.
FINENESS = 1024


def _ranks(probs: list[float]) -> list[tuple[Column, Column]]:
    """0-based lower and upper rank of each quantile among ``_total`` values."""
    spots = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    return [(F.floor(s), F.ceil(s)) for s in spots]


def _holds_rank(probs: list[float]) -> Column:
    first, last = F.col("_before"), F.col("_before") + F.col("_n") - 1
    return reduce(or_, [r.between(first, last) for pair in _ranks(probs) for r in pair])


def _place(value: Column) -> Column:
    """Where a value lies on a scale that keeps the order of values."""
    return F.signum(value) * F.log1p(F.abs(value))


def _candidates(values: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Distinct values in the bins that hold a wanted rank, with their counts."""
    scope = [*keys, "_slot"]
    placed = values.withColumn("_slot", F.floor(_place(F.col("_value")) * FINENESS))
    bins = placed.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_part")
    )
    whole = W.partitionBy(*keys)
    run = whole.orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    wanted = (
        bins.withColumns(
            {
                "_total": F.sum("_n").over(whole),
                "_sum": F.sum("_part").over(whole),
                "_before": F.sum("_n").over(run) - F.col("_n"),
            }
        )
        .filter(_holds_rank(probs))
        .select(*scope, "_total", "_sum", F.col("_before").alias("_below"))
    )
    return (
        attach(placed, wanted, scope)
        .groupBy(*scope, "_total", "_sum", "_below", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _narrow(pieces: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Cut every piece into bins and keep the bins that hold a wanted rank."""
    scope = [*keys, "_slot"]
    spread = pieces.withColumn("_x", _place(F.col("_value")))
    ends = spread.groupBy(*scope).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    share = F.try_divide(F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    cell = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1))
    binned = attach(spread, ends, scope).withColumn("_bin", F.col("_slot") * BINS + cell)

    # At most BINS rows per scope reach this window.
    run = W.partitionBy(*scope).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    wanted = (
        binned.groupBy(*scope, "_bin", "_total", "_sum")
        .agg(F.sum("_n").alias("_n"), F.first("_below").alias("_below"))
        .withColumn("_before", F.col("_below") + F.sum("_n").over(run) - F.col("_n"))
        .filter(_holds_rank(probs))
        .select(*scope, "_bin", "_before")
    )
    return attach(binned, wanted, [*scope, "_bin"]).select(
        *keys,
        F.col("_bin").alias("_slot"),
        "_value", "_n", "_total", "_sum",
        F.col("_before").alias("_below"),
    )


def _largest(pieces: DataFrame, scope: list[str]) -> int:
    sizes = pieces.groupBy(*scope).agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg(F.max("c").alias("m")).first()["m"] or 0


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probs: dict[str, float],
    count_as: str = "n",
    mean_as: str | None = None,
    max_group: int = GROUP_ROWS,
) -> DataFrame:
    """Quantiles of ``value`` per key: one row per key with the number of
    values, their mean if asked for, and one column per entry of ``probs``.

    Missing values and rows without a key do not count.
    """
    points = list(probs.values())
    scope = [*keys, "_slot"]
    # key and value alone are written, so that the work above runs once
    values = durable(df.select(*keys, value.alias("_value")).dropna())
    pieces = durable(_candidates(values, keys, points))
    while _largest(pieces, scope) > max_group:
        pieces = durable(_narrow(pieces, keys, points))

    run = W.partitionBy(*scope).orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    placed = pieces.withColumn(
        "_before", F.col("_below") + F.sum("_n").over(run) - F.col("_n")
    )
    first, last = F.col("_before"), F.col("_before") + F.col("_n") - 1
    picks = {}
    for i, (lower, upper) in enumerate(_ranks(points)):
        picks[f"_lo{i}"] = F.max(F.when(lower.between(first, last), F.col("_value")))
        picks[f"_hi{i}"] = F.max(F.when(upper.between(first, last), F.col("_value")))
    picked = placed.filter(_holds_rank(points)).groupBy(*keys, "_total", "_sum").agg(
        *[c.alias(name) for name, c in picks.items()]
    )
    result = [F.col("_total").alias(count_as)]
    if mean_as:
        result.append((F.col("_sum") / F.col("_total")).alias(mean_as))
    for i, (name, p) in enumerate(probs.items()):
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        step = (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot))
        result.append((F.col(f"_lo{i}") + step).alias(name))
    return picked.select(*keys, *result)
