"""Anomaly score, review list and run figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens import values


def add_score(df: DataFrame) -> DataFrame:
    """0..2: how many of the price and timing flags are set."""
    score = F.col("overpriced_flag").cast("int") + F.col("timing_cluster_flag").cast("int")
    return df.withColumn("anomaly_score", score)


def review_list(scored: DataFrame, order: str = "id") -> DataFrame:
    return scored.filter(F.col("anomaly_score") > 0).orderBy(F.desc("anomaly_score"), order)


def run_metrics(scored: DataFrame, value: str = "total_value") -> DataFrame:
    """One row of run figures, from one global aggregate."""
    price, timing = F.col("overpriced_flag"), F.col("timing_cluster_flag")
    score = F.col("anomaly_score")
    money = F.sum(F.col(value).cast("decimal(18,2)")).cast("double")
    return scored.agg(
        F.count(F.lit(1)).alias("contracts"),
        F.round(money / values.CRORE, 6).alias("total_crore"),
        F.count_if(price).alias("price_flagged"),
        F.round(F.avg(price.cast("double")), 6).alias("price_rate"),
        F.count_if(timing).alias("timing_flagged"),
        F.round(F.avg(timing.cast("double")), 6).alias("timing_rate"),
        F.count_if(score > 0).alias("flagged_any"),
        F.count_if(score == 2).alias("flagged_both"),
    )


def report_lines(
    metrics: DataFrame, missing: DataFrame | None = None, hhi: DataFrame | None = None,
    group: str = "ministry", top: int = 5,
) -> DataFrame:
    """Run figures as text, for display only: one row.

    ``missing`` adds the share of rows without entity, ``hhi`` the most
    concentrated groups.  All three are one row each by the time they meet.
    """
    parts = [
        F.format_string(
            "%,d contracts, %s Cr total value", "contracts",
            F.format_number("total_crore", 0),
        ),
        F.format_string(
            "price outliers: %,d (%.2f%%)", "price_flagged", F.col("price_rate") * 100
        ),
        F.format_string(
            "timing clusters: %,d (%.2f%%)", "timing_flagged", F.col("timing_rate") * 100
        ),
        F.format_string("by at least one: %,d", "flagged_any"),
        F.format_string("by both: %,d", "flagged_both"),
    ]
    if missing is not None:
        metrics = metrics.crossJoin(F.broadcast(missing.select("missing_rate")))
        parts.append(F.format_string("without entity: %.1f%%", F.col("missing_rate") * 100))
    if hhi is not None:
        first = hhi.orderBy(F.desc("hhi"), group).limit(top)
        line = F.format_string("%s: %s", group, F.format_number("hhi", 0))
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("hhi")).alias("o"), F.col(group).alias("g"), line.alias("line"))))
        lines = first.agg(F.array_join(F.transform(ranked, lambda r: r["line"]), "\n").alias("_top"))
        metrics = metrics.crossJoin(F.broadcast(lines))
        parts.append(F.concat(F.lit("most concentrated:\n"), "_top"))
    return metrics.select(F.concat_ws("\n", *parts).alias("report"))
