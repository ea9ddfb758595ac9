"""Vendor concentration (Herfindahl-Hirschman index)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scalars import without_nan


def compute_hhi(
    df: DataFrame, group: str, entity: str = "brand", value: str = "total_value"
) -> DataFrame:
    """Sum of squared shares x 10000 per group, highest first.

    Rows without group or entity do not count.  A group that sums to 0 has
    index 0.  Both sums combine on the map side, so hot groups cost nothing
    extra, and the second one runs over the sums of the first.
    """
    amount = F.coalesce(without_nan(F.col(value)), F.lit(0.0))
    per_entity = (
        df.dropna(subset=[group, entity])
        .groupBy(group, entity)
        .agg(F.sum(amount).alias("_v"))
    )
    total = F.sum("_v")
    squares = F.sum(F.col("_v") * F.col("_v"))
    hhi = F.coalesce(F.try_divide(squares * 10000, total * total), F.lit(0.0))
    return per_entity.groupBy(group).agg(hhi.alias("hhi")).orderBy(F.desc("hhi"), group)


def missing_rate(df: DataFrame, entity: str = "brand") -> DataFrame:
    """Share of rows without the entity; NULL for no rows at all."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(entity).isNull().cast("double")).alias("missing_rate"),
    )


def missing_by(df: DataFrame, group: str = "contract_type", entity: str = "brand") -> DataFrame:
    """Rows and share of rows without the entity, per value of ``group``."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(entity).isNull().cast("double")).alias("missing_rate"),
    )
