"""Date windows, which of them are done, and how fast they went."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = ["from_date", "to_date"]


def date_windows(bounds: DataFrame, start: str, end: str, step_days: int = 1) -> DataFrame:
    """Consecutive windows of ``step_days`` over the range in ``bounds``.

    Reversed ends are swapped, the step is at least 1, the last window is
    clipped.  Each day is in exactly one window.
    """
    step = max(1, step_days)
    low = F.least(F.col(start), F.col(end)).cast("date")
    high = F.greatest(F.col(start), F.col(end)).cast("date")
    starts = F.sequence(low, high, F.make_dt_interval(F.lit(step)))
    return bounds.select(F.explode(starts).alias("from_date"), high.alias("_high")).select(
        "from_date",
        F.least(F.date_add("from_date", step - 1), F.col("_high")).alias("to_date"),
    )


def windows_between(spark: SparkSession, first: str, last: str, step_days: int = 1) -> DataFrame:
    """Windows between two dates given as ``dd-MM-yyyy``."""
    ends = spark.range(1).select(
        F.to_date(F.lit(first), "dd-MM-yyyy").alias("a"),
        F.to_date(F.lit(last), "dd-MM-yyyy").alias("b"),
    )
    return date_windows(ends, "a", "b", step_days)


def as_text(windows: DataFrame) -> DataFrame:
    return windows.select(*[F.date_format(c, "dd-MM-yyyy").alias(c) for c in WINDOW])


def pending_windows(
    windows: DataFrame, ledger: DataFrame, limit: int | None = None, recheck: bool = False
) -> DataFrame:
    """Windows not in the ledger, earliest first.

    Any entry counts as done; with ``recheck`` those taken as empty without a
    page that says so are visited again.
    """
    done = ledger.filter(F.col("note") != "zero_assumed") if recheck else ledger
    todo = windows.join(done.select(*WINDOW), WINDOW, "left_anti").orderBy(*WINDOW)
    return todo.limit(limit) if limit else todo


def ledger_summary(ledger: DataFrame) -> DataFrame:
    nothing = F.lit(0).cast("long")
    return ledger.agg(
        F.count(F.lit(1)).alias("windows_done"),
        F.coalesce(F.sum("contracts"), nothing).alias("contracts"),
    )


def review_windows(ledger: DataFrame) -> DataFrame:
    """Windows taken as empty without a page that says so, oldest first."""
    return (
        ledger.filter(F.col("note") == "zero_assumed")
        .select(*WINDOW, "completed_at")
        .orderBy("completed_at", *WINDOW)
    )


def coverage(windows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Total, done, pending and unsure windows, in one row."""
    marked = windows.join(ledger.select(*WINDOW, "note", F.lit(True).alias("_done")), WINDOW, "left")
    done = F.col("_done").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("windows_total"),
        F.count_if(done).alias("windows_done"),
        F.count_if(~done).alias("windows_pending"),
        F.count_if(F.col("note") == "zero_assumed").alias("zero_assumed"),
    )


def ingest_rate(ledger: DataFrame, windows: DataFrame, started_at=None) -> DataFrame:
    """Rows per minute since the start, and windows done of all."""
    log = ledger.select("rows", "completed_at", F.lit(1).alias("_done"), F.lit(0).alias("_all"))
    planned = windows.select(
        F.lit(None).cast("long").alias("rows"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(0).alias("_done"),
        F.lit(1).alias("_all"),
    )
    start = F.lit(started_at).cast("timestamp") if started_at else F.min("completed_at")
    seconds = (F.unix_micros(F.max("completed_at")) - F.unix_micros(start)) / 1_000_000
    return (
        log.unionByName(planned)
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"),
            F.sum("_done").alias("windows_done"),
            F.sum("_all").alias("windows_total"),
            F.greatest(F.coalesce(seconds, F.lit(0.0)), F.lit(1.0)).alias("_seconds"),
        )
        .select(
            "rows", "windows_done", "windows_total",
            (F.col("rows") / F.col("_seconds") * 60).alias("rows_per_minute"),
            (F.col("_seconds") / 60).alias("elapsed_minutes"),
        )
    )
