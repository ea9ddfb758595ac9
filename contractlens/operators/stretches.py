"""Groups cut into stretches of time, with the rows near a cut on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A cut falls this part of a stretch after its round beginning: with days, at 03:00, when little happens.
OFFSET = 8


def stretch_length(window: int, least: int) -> int:
    """Long enough that a row is near one end at most."""
    return max(least, 8 * window, 8)


def in_stretches(df: DataFrame, at: str, window: int, length: int) -> DataFrame:
    """Each row in its own stretch (``_own``), and once more as context for the one
    next to it when it lies within ``window`` of the cut.

    ``at`` and both lengths are in one unit.  Rows that lie within ``window``
    of a stretch's own row are then all in that stretch.  Adds ``_slot`` and ``_own``.
    """
    into = F.pmod(F.col(at) - length // OFFSET, F.lit(length))
    slot = (F.col(at) - length // OFFSET - into) / length

    def copy(to: Column, own: bool) -> Column:
        return F.struct(to.cast("long").alias("_slot"), F.lit(own).alias("_own"))

    copies = (
        F.when(into >= length - window, F.array(copy(slot, True), copy(slot + 1, False)))
        .when(into <= window, F.array(copy(slot, True), copy(slot - 1, False)))
        .otherwise(F.array(copy(slot, True)))
    )
    return df.select("*", F.inline(copies))
