"""Reports over the clean and the analysis view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens import values
from contractlens.functions.scalars import ratio, starts_with_digit
from contractlens.operators.quantiles import group_quantiles
from contractlens.operators.scale import GROUP_ROWS, attach


def _money(column: str) -> Column:
    """Sum of money that does not depend on the order of addition."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def type_coverage(clean: DataFrame) -> DataFrame:
    return clean.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("total_value"), 2).alias("avg_val"),
        F.round(F.avg("unit_price"), 4).alias("avg_unit_price"),
    )


def service_check(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("contract_type") == "service").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("quantity_clean").alias("avg_quantity"),
        F.avg("total_value_clean").alias("avg_total"),
    )


def held_total_check(classified: DataFrame) -> DataFrame:
    held = (
        F.col("total_value").isNull()
        & F.col("unit_price").isNotNull()
        & starts_with_digit(F.col("quantity"))
    )
    return classified.filter(held).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total_value_clean").alias("avg_total"),
        F.avg("unit_price_clean").alias("avg_unit_price"),
    )


def product_benchmark(
    analysis: DataFrame,
    low: float = 10,
    high: float = 500_000,
    min_contracts: int = 10,
    min_ministries: int = 3,
    top: int = 50,
) -> DataFrame:
    """Products by how far their dearest contract is above their average."""
    scope = (
        (F.col("contract_type") == "goods")
        & (F.col("quantity") > 1)
        & F.col("unit_price").between(low, high)
    )
    return (
        analysis.filter(scope)
        .groupBy("product_name")
        .agg(
            F.count(F.lit(1)).alias("contracts"),
            F.count_distinct("ministry").alias("ministries"),
            F.min("unit_price").alias("min_price"),
            F.max("unit_price").alias("max_price"),
            F.avg("unit_price").alias("avg_price"),
            F.round(ratio(F.max("unit_price"), F.avg("unit_price")), 1).alias("max_vs_avg"),
        )
        .filter((F.col("contracts") >= min_contracts) & (F.col("ministries") >= min_ministries))
        .orderBy(F.desc("max_vs_avg"), "product_name")
        .limit(top)
    )


def average_outliers(
    analysis: DataFrame,
    products: list[str] | DataFrame | None = values.SUSPECT_PRODUCTS,
    factor: float = 5,
) -> DataFrame:
    """Contracts dearer than ``factor`` times the average of their product.

    The average is over all contracts of the product.  ``products=None``
    looks at every product; a long list comes as a frame of names.
    """
    if isinstance(products, DataFrame):
        names = products.select("product_name").distinct()
        analysis = attach(analysis, names, ["product_name"], "left_semi")
    elif products is not None:
        analysis = analysis.filter(F.col("product_name").isin(products))
    average = analysis.groupBy("product_name").agg(F.avg("unit_price").alias("_avg"))
    return (
        attach(analysis, average, ["product_name"])
        .filter(F.col("unit_price") > F.col("_avg") * factor)
        .select(
            "contract_number", "ministry", "org_name", "product_name", "quantity",
            "unit_price", "total_value", "contract_date", "contract_status",
        )
        .orderBy("product_name", F.desc("unit_price"), "contract_number")
    )


def product_medians(
    analysis: DataFrame, min_contracts: int = 10, max_group: int = GROUP_ROWS
) -> DataFrame:
    """Median, average and number of peer prices per product."""
    peers = analysis.filter(
        (F.col("unit_price") > 0)
        & (F.col("contract_type") == "goods")
        & (F.col("quantity") > 1)
    )
    medians = group_quantiles(
        peers, ["product_name"], F.col("unit_price"), {"median_price": 0.5},
        count_as="contract_count", mean_as="avg_price", max_group=max_group,
    )
    return medians.filter(F.col("contract_count") >= min_contracts)


def median_outliers(
    analysis: DataFrame,
    factor: float = 5,
    min_contracts: int = 10,
    goods_only: bool = False,
    max_group: int = GROUP_ROWS,
) -> DataFrame:
    """Contracts dearer than ``factor`` times the median of their product.

    Peers are goods with a quantity above 1.  ``goods_only`` also asks that
    of the type of the contract looked at.
    """
    rows = analysis.filter(F.col("quantity") > 1)
    if goods_only:
        rows = rows.filter(F.col("contract_type") == "goods")
    price, median = F.col("unit_price"), F.col("median_price")
    stats = product_medians(analysis, min_contracts, max_group)
    return (
        attach(rows, stats, ["product_name"])
        .filter(price > median * factor)
        .select(
            "contract_number", "ministry", "org_name", "department", "product_name",
            "quantity", "unit_price", "total_value", "contract_date", "year", "month",
            "buying_mode", "median_price", "avg_price", "contract_count",
            F.round(ratio(price, median), 1).alias("price_ratio"),
            F.round(ratio(price - median, median) * 100, 1).alias("pct_above_median"),
        )
    )


def by_ratio(anomalies: DataFrame) -> DataFrame:
    """Reading order of the anomaly table: storage keeps none."""
    return anomalies.orderBy(F.desc("price_ratio"), "contract_number")


def anomaly_impact(anomalies: DataFrame) -> DataFrame:
    over = F.col("total_value") - F.col("median_price") * F.col("quantity")
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_distinct("ministry").alias("ministries_involved"),
        F.count_distinct("product_name").alias("products_affected"),
        _money("total_value").alias("total_value_at_risk"),
        F.sum(over).alias("estimated_overcharge"),
    )


def top_ministries(contracts: DataFrame, n: int = 10) -> DataFrame:
    return (
        contracts.filter(F.col("ministry") != "")
        .groupBy("ministry")
        .agg(F.count(F.lit(1)).alias("n"), _money("total_value").alias("v"))
        .orderBy(F.desc("n"), "ministry")
        .limit(n)
    )


def value_range(contracts: DataFrame) -> DataFrame:
    return contracts.filter(F.col("total_value") > 0).agg(
        F.min("total_value").alias("min_value"),
        F.max("total_value").alias("max_value"),
        F.avg("total_value").alias("avg_value"),
    )


def row_count(contracts: DataFrame) -> DataFrame:
    return contracts.agg(F.count(F.lit(1)).alias("n"))
