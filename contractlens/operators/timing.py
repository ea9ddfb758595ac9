"""Near-identical contracts by one buyer in a short time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scalars import MINUTE, micros, without_nan
from contractlens.operators.neighbours import with_neighbours
from contractlens.operators.scale import GROUP_ROWS, SPREAD

DAY = 24 * 60 * MINUTE


def _close(earlier: Column, later: Column, window: int, tolerance: float) -> Column:
    """Gap of 0..window and a relative difference below the tolerance.

    The earlier value is the base: 0 never matches, a negative one always does.
    """
    gap = later["_t"] - earlier["_t"]
    base = F.nullif(earlier["_v"], F.lit(0.0))
    apart = F.try_divide(F.abs(later["_v"] - earlier["_v"]), base)
    return F.coalesce(gap.between(0, window) & (apart < tolerance), F.lit(False))


def flag_timing_clusters(
    df: DataFrame,
    buyer: str = "org_name",
    time: str = "contract_date",
    value: str = "total_value",
    order: str = "id",
    window_minutes: float = 30,
    value_tolerance: float = 0.02,
    max_group: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``timing_cluster_flag``: true for both rows of each neighbouring
    pair of one buyer.  ``order`` breaks ties in time and must be unique.

    A buyer's rows are cut into stretches of time, so that a busy buyer is
    spread over many tasks.  Rows near a cut also go, as context, to the
    stretch on the other side; a stretch is at least as long as the window,
    so any pair is seen whole.  Cuts fall at 03:00, when little happens.
    Rows without buyer or time are never flagged and are spread by hash.
    """
    window = int(window_minutes * MINUTE)
    stretch = max(DAY, 8 * window)
    origin = stretch // 8
    into = F.pmod(F.col("_t") - origin, F.lit(stretch))
    slot = (F.col("_t") - origin - into) / stretch
    spread = F.pmod(F.xxhash64(F.col(order)), F.lit(SPREAD))

    def copies(own: Column) -> Column:
        """The row's own stretch, and the one next to it when near its end."""

        def copy(at: Column, is_own: bool) -> Column:
            return F.struct(at.cast("long").alias("_slot"), F.lit(is_own).alias("_own"))

        # near one end at most, as a stretch is 8 windows long
        return F.inline(
            F.when(into >= stretch - window, F.array(copy(own, True), copy(slot + 1, False)))
            .when(into <= window, F.array(copy(own, True), copy(slot - 1, False)))
            .otherwise(F.array(copy(own, True)))
        )

    timed = df.withColumn("_t", F.when(F.col(buyer).isNotNull(), micros(F.col(time))))
    known = timed.select(buyer, "_t").filter(F.col("_t").isNotNull())
    sizes = known.select(buyer, copies(slot)).groupBy(buyer, "_slot").agg(
        F.count(F.lit(1)).alias("_size")
    )
    placed = timed.withColumn("_v", without_nan(F.col(value))).select(
        "*", copies(F.coalesce(slot, spread))
    )
    seen = with_neighbours(
        placed, [buyer, "_slot"], ["_t", order], ["_t", "_v"], sizes, max_group
    )
    here = {"_t": F.col("_t"), "_v": F.col("_v")}
    flag = _close(F.col("_prev"), here, window, value_tolerance) | _close(
        here, F.col("_next"), window, value_tolerance
    )
    return (
        seen.filter("_own")
        .withColumn("timing_cluster_flag", flag)
        .select(*df.columns, "timing_cluster_flag")
    )
