"""Log-price outliers per product by quartile fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scalars import log_price
from contractlens.operators.quantiles import group_quantiles
from contractlens.operators.scale import GROUP_ROWS, attach


def price_fences(
    df: DataFrame,
    product: str = "product_name",
    price: str = "unit_price",
    min_group_size: int = 5,
    iqr_multiplier: float = 3.0,
    max_group: int = GROUP_ROWS,
) -> DataFrame:
    """Per product with enough priced peers: quartiles of log price and fence."""
    quartiles = group_quantiles(
        df, [product], log_price(F.col(price)), {"q1": 0.25, "q3": 0.75},
        count_as="peers", max_group=max_group,
    )
    fence = F.col("q3") + iqr_multiplier * (F.col("q3") - F.col("q1"))
    return quartiles.filter(F.col("peers") >= min_group_size).withColumn("upper_fence", fence)


def apply_fences(
    df: DataFrame,
    fences: DataFrame,
    product: str = "product_name",
    price: str = "unit_price",
) -> DataFrame:
    """Add ``log_price`` and ``overpriced_flag``.  All rows stay."""
    above = F.col("log_price") > F.col("upper_fence")
    priced = df.withColumn("log_price", log_price(F.col(price)))
    return (
        attach(priced, fences.select(product, "upper_fence"), [product], "left")
        .withColumn("overpriced_flag", F.coalesce(above, F.lit(False)))
        .select(*df.columns, "log_price", "overpriced_flag")
    )


def flag_overpricing(
    df: DataFrame,
    product: str = "product_name",
    price: str = "unit_price",
    min_group_size: int = 5,
    iqr_multiplier: float = 3.0,
    max_group: int = GROUP_ROWS,
) -> DataFrame:
    """Flag contracts above the upper fence of their product."""
    fences = price_fences(df, product, price, min_group_size, iqr_multiplier, max_group)
    return apply_fences(df, fences, product, price)
