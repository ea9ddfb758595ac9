"""Similar contracts of one buyer within a time range, neighbours in time or not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scalars import MINUTE, micros, without_nan
from contractlens.operators.stretches import in_stretches, stretch_length

# A value band is this many tolerances wide.
BAND = 64

# Cells are counted together up to about this many rows.
ROWS = 100_000


class Ranks:
    """A sequence of ranks that answers how many of a stretch of it are below a bound.

    A wavelet matrix: one bit plane per binary digit, each with its running
    count of zeros, so any number of questions takes one step per digit.
    """

    def __init__(self, ranks: np.ndarray) -> None:
        self.bits = max(1, int(ranks.max(initial=0)).bit_length())
        self.planes = []
        for k in reversed(range(self.bits)):
            ones = (ranks >> k) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])
            self.planes.append(zeros)
            ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])

    def below(self, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many ranks in places ``begin`` to ``end`` (exclusive) are less than ``bound``."""
        begin, end = begin.copy(), np.maximum(begin, end)
        total = np.zeros(len(begin), np.int64)
        over = bound >= (1 << self.bits)
        length = end - begin
        for k, zeros in zip(reversed(range(self.bits)), self.planes, strict=True):
            b, e = zeros[begin], zeros[end]
            high = ((bound >> k) & 1).astype(bool)
            total += np.where(high, e - b, 0)
            begin, end = np.where(high, zeros[-1] + begin - b, b), np.where(high, zeros[-1] + end - e, e)
        return np.where(over, length, np.where(bound <= 0, 0, total))


def _matches(times: np.ndarray, values: np.ndarray, window: int, tolerance: float):
    """For rows in time order: later and earlier matches of each, and the place of its partner (or -1)."""
    n = len(times)
    here = np.arange(n)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = here
    ordered = values[order]

    def close(later, base):
        return np.abs(later - base) / base < tolerance

    # The ranks that match a row as the earlier one: an interval around it, as the difference grows with the distance.
    low = np.searchsorted(ordered, values * (1 - tolerance))
    high = np.searchsorted(ordered, values * (1 + tolerance), "right")
    for _ in range(n):  # the bounds may be off by rounding
        down = (low > 0) & close(ordered[np.maximum(low - 1, 0)], values)
        up = (low < n) & ~close(ordered[np.minimum(low, n - 1)], values) & (low < rank)
        if not (down | up).any():
            break
        low += up.astype(np.int64) - down
    for _ in range(n):
        up = (high < n) & close(ordered[np.minimum(high, n - 1)], values)
        down = (high > 0) & ~close(ordered[np.maximum(high - 1, 0)], values) & (high - 1 > rank)
        if not (down | up).any():
            break
        high += up.astype(np.int64) - down

    end = np.searchsorted(times, times + window, "right")
    begin = np.searchsorted(times, times - window)
    by_rank, by_low, by_high = Ranks(rank), Ranks(low), Ranks(high)

    def later(upto):
        return by_rank.below(here + 1, upto, high) - by_rank.below(here + 1, upto, low)

    def earlier(since):
        # rows whose interval holds this rank: begun at or before it, not ended at or before it
        return by_low.below(since, here, rank + 1) - by_high.below(since, here, rank + 1)

    after, before = later(end), earlier(begin)
    # the first later match, else the last earlier one, by halving
    first_low, first_high = here + 1, end.copy()
    last_low, last_high = begin.copy(), here.copy()
    for _ in range(int(n).bit_length() + 1):
        middle = (first_low + first_high) // 2
        met = later(middle) > 0
        first_high, first_low = np.where(met, middle, first_high), np.where(met, first_low, np.minimum(middle + 1, first_high))
        middle = (last_low + last_high + 1) // 2
        met = earlier(np.minimum(middle, here)) > 0
        last_low, last_high = np.where(met, middle, last_low), np.where(met, last_high, np.maximum(middle - 1, last_low))
    partner = np.where(after > 0, first_high - 1, np.where(before > 0, last_low, -1))
    return after, before, partner


def whole_cells(batches: Iterator[pd.DataFrame], cell: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in parts of whole cells, of ``ROWS`` rows or one cell at least, with the number of each row's cell."""
    held: list[pd.DataFrame] = []
    size, wanted = 0, ROWS

    def numbered(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for c in cell:
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < wanted:
            continue
        rows = pd.concat(held, ignore_index=True)
        at = numbered(rows)
        last = int(np.searchsorted(at, at[-1]))
        if last:
            yield rows[:last], at[:last]
            rows = rows[last:].reset_index(drop=True)
        held, size = [rows], len(rows)
        wanted = max(ROWS, 2 * size)  # a cell that goes on is put together ever more rarely
    if size:
        rows = pd.concat(held, ignore_index=True)
        yield rows, numbered(rows)


def range_matches(
    df: DataFrame,
    buyer: str = "org_name",
    time: str = "contract_date",
    value: str = "total_value",
    order: str = "id",
    window_minutes: float = 30,
    value_tolerance: float = 0.02,
) -> DataFrame:
    """Per row of ``order`` (unique): ``later_matches``, ``earlier_matches`` and one ``partner``.

    Two contracts of one buyer match if the later one (by time, then
    ``order``) follows within ``window_minutes`` and its value differs by less
    than ``value_tolerance`` of the earlier one's.  The partner is the first
    later match, else the last earlier one, else null.  Unlike the timing
    clusters, rows between two twins do not hide them.  Rows without buyer or
    time, and rows whose value is missing, not positive or not finite, match nothing.

    Matches are counted, never listed: a buyer's rows go to the cells of a
    grid over time and logarithm of value, those near a cell's edge also to the next
    one, and a cell counts by rank, so its cost grows with its rows and
    not with their pairs.
    """
    window = int(window_minutes * MINUTE)
    amount = without_nan(F.col(value))
    known = df.select(
        F.col(buyer).alias("_b"), micros(F.col(time)).alias("_t"), amount.alias("_v"), F.col(order)
    ).withColumn("_fits", F.coalesce(F.col("_b").isNotNull() & F.col("_t").isNotNull() & (F.col("_v") > 0) & (F.col("_v") < float("inf")), F.lit(False)))

    # one unit is a tolerance in the logarithm, with room for both directions and for rounding
    unit = 2 * float(np.log1p(value_tolerance) - np.log1p(-value_tolerance))
    fits = known.where("_fits").withColumn("_u", F.floor(F.ln("_v") / unit).cast("long"))
    grid = in_stretches(fits, "_t", window, stretch_length(window, 0)).withColumnsRenamed({"_slot": "_when", "_own": "_here"})
    grid = in_stretches(grid, "_u", 1, BAND).withColumn("_own", F.col("_own") & F.col("_here"))
    kind = df.schema[order].dataType.simpleString()
    length = stretch_length(window, 0)
    cell = ["_b", "_when", "_slot"]
    sorted_cells = (
        grid.withColumn("_t", F.col("_t") - F.col("_when") * length)
        .select(*cell, "_t", "_v", order, "_own")
        .repartition(*cell)
        .sortWithinPartitions(*cell, "_t", order)
    )

    def counted_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, at in whole_cells(batches, cell):
            # cells lie one after another on one axis, too far apart to match
            times = rows["_t"].to_numpy() + at * (4 * length + window)
            after, before, partner = _matches(times, rows["_v"].to_numpy(), window, value_tolerance)
            ids = rows[order]
            found = pd.DataFrame({order: ids, "later_matches": after, "earlier_matches": before})
            found["partner"] = ids.astype(object).take(np.maximum(partner, 0)).reset_index(drop=True).where(partner >= 0, None)
            yield found[rows["_own"].to_numpy()]

    counted = sorted_cells.mapInPandas(counted_cells, f"`{order}` {kind}, later_matches long, earlier_matches long, partner {kind}")
    none = F.lit(0).cast("long")
    rest = known.where("NOT _fits").select(order, none.alias("later_matches"), none.alias("earlier_matches"), F.lit(None).cast(kind).alias("partner"))
    return counted.unionByName(rest)
