"""Whole runs: contracts in, concentration, review list and figures out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from contractlens.operators.cleaning import contracts_analysis, contracts_clean
from contractlens.operators.concentration import compute_hhi, missing_rate
from contractlens.operators.overpricing import apply_fences, price_fences
from contractlens.operators.reports import anomaly_impact, median_outliers
from contractlens.operators.scale import Steps
from contractlens.operators.scoring import add_score, report_lines, review_list, run_metrics
from contractlens.operators.timing import flag_timing_clusters
from contractlens.sources.tables import (
    csv_problems, csv_rejects, read_csv_text, type_columns, write_csv, write_table,
)


def score_contracts(
    df: DataFrame,
    product: str = "product_name",
    price: str = "unit_price",
    buyer: str = "org_name",
    time: str = "contract_date",
    value: str = "total_value",
    order: str = "id",
    min_group_size: int = 5,
    iqr_multiplier: float = 3.0,
    window_minutes: float = 30,
    value_tolerance: float = 0.02,
) -> DataFrame:
    """Both flags and the score on one frame.

    The fences come from the input itself, so the rows are shuffled once (by
    buyer and time) and the fences are joined to the result.
    """
    fences = price_fences(df, product, price, min_group_size, iqr_multiplier)
    timed = flag_timing_clusters(
        df, buyer, time, value, order, window_minutes, value_tolerance
    )
    return add_score(apply_fences(timed, fences, product, price))


@dataclass(frozen=True)
class Outputs:
    hhi: DataFrame
    flagged: DataFrame
    metrics: DataFrame
    problems: DataFrame
    rejects: DataFrame
    report: DataFrame


def run_pipeline(
    spark: SparkSession, path: str, out: str, order: str = "id", multi_line: bool = True, on_step: Callable[[str], None] | None = None,
) -> Outputs:
    """CSV of clean contracts to ``hhi_by_ministry``, ``scored``,
    ``flagged_anomalies``, ``run_metrics`` and ``run_report`` under ``out``.

    The contracts are kept as a typed table, of which each step reads its
    columns.  Cells that do not fit their type are counted in
    ``csv_problems``, records that do not fit their header are in ``csv_rejects``.  The scored table is written once; review list and figures
    read it.  ``multi_line=False`` lets large files be read by many tasks,
    where no cell holds a line end.  ``on_step`` is called with the name of each table once it is written;
    after ``csv_rejects`` the text is not read again.
    """
    step = on_step or (lambda name: None)
    with Steps(spark):
        text = read_csv_text(spark, path, multi_line)
        contracts = write_table(type_columns(text), f"{out}/contracts")
        step("contracts")
        problems = write_table(csv_problems(text), f"{out}/csv_problems")
        step("csv_problems")
        rejects = write_table(csv_rejects(spark, path, multi_line), f"{out}/csv_rejects")
        step("csv_rejects")
        hhi = compute_hhi(contracts, "ministry", "brand")
        write_csv(hhi, f"{out}/hhi_by_ministry")
        step("hhi_by_ministry")

        scored = write_table(score_contracts(contracts, order=order), f"{out}/scored")
        step("scored")
        flagged = review_list(scored, order)
        write_csv(flagged, f"{out}/flagged_anomalies")
        step("flagged_anomalies")
        metrics = write_table(run_metrics(scored), f"{out}/run_metrics")
        step("run_metrics")
        lines = report_lines(metrics, missing_rate(contracts), hhi, "ministry")
        report = write_table(lines, f"{out}/run_report")
        step("run_report")
    return Outputs(hhi, flagged, metrics, problems, rejects, report)


@dataclass(frozen=True)
class Analysis:
    analysis: DataFrame
    anomalies: DataFrame
    impact: DataFrame


def run_analysis(raw: DataFrame, out: str) -> Analysis:
    """Raw contracts to the analysis view and the anomaly table.

    The analysis view is written, as the medians and the rows both read it.
    """
    with Steps(raw.sparkSession):
        clean = contracts_analysis(contracts_clean(raw))
        analysis = write_table(clean, f"{out}/contracts_analysis")
        anomalies = write_table(median_outliers(analysis), f"{out}/price_anomalies")
    return Analysis(analysis, anomalies, anomaly_impact(anomalies))


def save_anomalies(anomalies: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace the catalog table ``name``, split by year and month, and read it back.

    A filter on year or month then reads only the folders it names.  ``path``
    puts the data there and not in the warehouse.
    """
    spark = anomalies.sparkSession
    writer = anomalies.write.mode("overwrite").partitionBy("year", "month").format("parquet")
    if path:
        writer = writer.option("path", path)
    # rows of one month go to few files
    writer.saveAsTable(name)
    return spark.table(name)
