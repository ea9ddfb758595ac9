"""Timing clusters on a stream of contracts, with the batch detector's result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contractlens.functions.scalars import MINUTE, without_nan

NEVER = -(2**62)


# Buyers are kept in this many groups, as a state and a call of their own each costs far more than their rows.
BUYER_GROUPS = 256


class Waiting:
    """Rows of some buyers that are not given out yet, in order, and the last one of each buyer that was.

    ``rows`` has ``buyer, t, id, v``, ``last`` has ``buyer, t, v``.
    """

    def __init__(self, last: pd.DataFrame, rows: pd.DataFrame, window: int, tolerance: float) -> None:
        self.last, self.window, self.tolerance = last, window, tolerance
        # buyers by number: those of ``last`` first
        self.names = pd.factorize(pd.concat([last["buyer"], rows["buyer"]], ignore_index=True), use_na_sentinel=False)
        code = self.names[0][len(last) :]
        order = np.lexsort((rows["id"].to_numpy(), rows["t"].to_numpy(), code))
        self.code, self.rows = code[order], rows.iloc[order].reset_index(drop=True)

    def _close(self, earlier: np.ndarray, base: np.ndarray, later: np.ndarray, values: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = np.abs(values - base) / np.where(base == 0, np.nan, base)
        gap = later - earlier
        return (gap >= 0) & (gap <= self.window) & (apart < self.tolerance)

    def settled(self, until: int) -> pd.DataFrame:
        """Take out the rows whose neighbours are known, as no row up to ``until`` is still to come."""
        code, t, v = self.code, self.rows["t"].to_numpy(), self.rows["v"].to_numpy()
        count = len(self.names[1])
        last_t, last_v = np.full(count, NEVER, np.int64), np.zeros(count)
        given = self.names[0][: len(self.last)]
        last_t[given], last_v[given] = self.last["t"].to_numpy(), self.last["v"].to_numpy()
        if len(t):
            begins = np.diff(code, prepend=-1) != 0
            earlier = np.where(begins, last_t[code], np.roll(t, 1)), np.where(begins, last_v[code], np.roll(v, 1))
            pairs = self._close(*earlier, t, v)
            goes_on = np.append(~begins[1:], False)
            known = goes_on & (np.roll(t, -1) <= until)
            # a row is settled when the next one is final, or when all that is to come is too far away
            ready = (t <= until) & (known | (t + self.window < until))
            # those of a buyer up to the first that is not
            open_before = np.cumsum(~ready)
            settled = open_before == (open_before - ~ready)[np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))]
            # the pair with a next row that may still move back is too far apart to count
            flags = pairs | (goes_on & np.roll(pairs, -1))
            done = self.rows[["buyer", "t", "id"]][settled].assign(flag=flags[settled])
            last_t[code[settled]], last_v[code[settled]] = t[settled], v[settled]  # of equal codes the later one stays
            self.code, self.rows = code[~settled], self.rows[~settled].reset_index(drop=True)
        else:
            done = self.rows[["buyer", "t", "id"]].assign(flag=np.zeros(0, bool))
        # where no row waits, nothing to come can be near a last row that is far enough back
        waits = np.zeros(count, bool)
        waits[self.code] = True
        kept = (last_t != NEVER) & (waits | (last_t + self.window >= until))
        self.last = pd.DataFrame({"buyer": pd.Series(self.names[1])[kept], "t": last_t[kept], "v": last_v[kept]})
        return done.reset_index(drop=True)

    def next_time(self) -> int | None:
        """The earliest time at which something here may change without new rows; None if nothing is here."""
        times = [c["t"].min() for c in (self.rows, self.last) if len(c)]
        return int(min(times)) + self.window if times else None


def stream_timing_clusters(
    stream: DataFrame,
    buyer: str = "org_name",
    time: str = "contract_date",
    value: str = "total_value",
    order: str = "id",
    window_minutes: float = 30,
    value_tolerance: float = 0.02,
    delay: str = "1 hour",
) -> DataFrame:
    """``buyer, time, order, timing_cluster_flag`` for a stream of contracts; write it in append mode.

    Equal to ``flag_timing_clusters`` on the same rows as long as none comes
    later than ``delay`` behind the latest seen; those are dropped.  ``order`` is a number
    that breaks ties in time.  A row is given out once its neighbours are
    known, that is when the watermark has passed the row after it, or the
    row's whole window.  The state holds, for each of ``BUYER_GROUPS`` groups of buyers, their rows of about the delay and the
    window.  A checkpoint from before there were groups cannot be gone on with.  Rows without buyer or time go through at once, never flagged.
    """
    window = int(window_minutes * MINUTE)
    by, at = stream.schema[buyer].dataType.simpleString(), F.col(time).cast("timestamp")
    rows = stream.select(
        F.col(buyer).alias("buyer"), at.alias("at"), F.col(order).cast("long").alias("id"),
        F.coalesce(without_nan(F.col(value)), F.lit(float("nan"))).alias("v"),
    )
    whole = F.col("buyer").isNotNull() & F.col("at").isNotNull()
    output = f"buyer {by}, t long, id long, flag boolean"
    kept = f"last_buyer array<{by}>, last_t array<long>, last_v array<double>, buyer array<{by}>, t array<long>, id array<long>, v array<double>"

    def frame(**columns) -> pd.DataFrame:
        kinds = {"t": np.int64, "id": np.int64, "v": np.float64}
        return pd.DataFrame({n: pd.Series(c, dtype=kinds.get(n, object)) for n, c in columns.items()})

    def of_group(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_b, last_t, last_v, b, t, ids, v = state.get if state.exists else ([],) * 7
        old = frame(buyer=b, t=t, id=ids, v=v)
        come = [frame(**{c: p[c] for c in old.columns}) for p in parts]
        waiting = Waiting(frame(buyer=last_b, t=last_t, v=last_v), pd.concat([old, *come], ignore_index=True), window, value_tolerance)
        until = state.getCurrentWatermarkMs() * 1000
        done = waiting.settled(until)
        left, last, then = waiting.rows, waiting.last, waiting.next_time()
        if then is not None:
            state.update(tuple(c.tolist() for c in (last["buyer"], last["t"], last["v"], *(left[n] for n in old.columns))))
            state.setTimeoutTimestamp(max(then // 1000, until // 1000) + 1)
        elif state.exists:
            state.remove()
        yield done

    watched = rows.where(whole).withWatermark("at", delay).withColumns({"t": F.unix_micros("at"), "_group": F.pmod(F.xxhash64("buyer"), F.lit(BUYER_GROUPS))})
    flagged = watched.groupBy("_group").applyInPandasWithState(of_group, output, kept, "append", GroupStateTimeout.EventTimeTimeout)
    others = rows.where(~whole).select("buyer", F.unix_micros("at").alias("t"), "id", F.lit(False).alias("flag"))
    return flagged.unionByName(others).select(
        F.col("buyer").alias(buyer), F.timestamp_micros("t").alias(time), F.col("id").alias(order), F.col("flag").alias("timing_cluster_flag")
    )
