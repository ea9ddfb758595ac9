"""Raw contracts to the clean and the analysis view.

One projection and one filter: no shuffle, and the filter reaches the scan
as far as the raw columns allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens import values
from contractlens.functions.scalars import (
    is_junk_product, numeric_prefix, parse_when, ratio, starts_with_digit,
)


def fix_org_type(org_type: Column) -> Column:
    """A leaked label in place of a value becomes ``Unknown``."""
    leaked = F.lower(F.trim(org_type)) == "organization"
    return F.when(leaked, F.lit("Unknown")).otherwise(org_type)


def with_calendar_parts(df: DataFrame, contract_date: str = "contract_date") -> DataFrame:
    """Add ``contract_year``, ``contract_month`` and ``contract_hour``."""
    text = F.col(contract_date)
    return (
        df.withColumn("_when", F.when(text != "", parse_when(text)))
        .withColumns(
            {
                "contract_year": F.year("_when"),
                "contract_month": F.month("_when"),
                "contract_hour": F.hour("_when"),
            }
        )
        .drop("_when")
    )


def classify_and_clean(
    raw: DataFrame, strip_commas: bool = False
) -> DataFrame:
    """Add contract type, clean amounts and calendar parts.

    The branches are tried in order: a service row keeps its total in
    ``quantity`` (after the rupee sign) and its count in ``model``; a goods
    row without total keeps the total in ``unit_price``; any other goods row
    with a positive total is as it says.  ``strip_commas`` also removes
    thousands separators from counts.
    """
    quantity, model = F.col("quantity"), F.col("model")
    total, unit = F.col("total_value"), F.col("unit_price")

    def count_in(text: Column) -> Column:
        plain = F.replace(text, F.lit(","), F.lit("")) if strip_commas else text
        return F.when(starts_with_digit(text), numeric_prefix(plain))

    # Step by step, so that each number is read from its text once.
    read = raw.withColumns(
        {
            "_branch": F.when(F.startswith(quantity, F.lit("₹")), "service")
            .when(total.isNull() & unit.isNotNull() & starts_with_digit(quantity), "held")
            .when(total > 0, "normal"),
            "_count": count_in(quantity),
            "_service_count": count_in(model),
        }
    ).withColumn("_count", F.when(F.col("_count") > 0, F.col("_count")))

    branch = F.col("_branch")
    service, held, normal = branch == "service", branch == "held", branch == "normal"
    paid = numeric_prefix(F.translate(F.trim(quantity), "₹,", ""))
    clean = read.withColumns(
        {
            "contract_type": F.when(service, "service").otherwise("goods"),
            "total_value_clean": F.when(service, paid).when(held, unit).when(normal, total),
            "quantity_clean": F.when(service, F.col("_service_count")).when(
                held | normal, F.col("_count")
            ),
            "org_type": fix_org_type(F.col("org_type")),
        }
    )
    each = ratio(F.col("total_value_clean"), F.col("quantity_clean"))
    unit_price = F.when(normal, F.round(each, 4)).when(F.col("quantity_clean") > 0, each)
    priced = clean.withColumn("unit_price_clean", unit_price)
    return with_calendar_parts(priced).drop("_branch", "_count", "_service_count")


def contracts_clean(raw: DataFrame, strip_commas: bool = False) -> DataFrame:
    """The clean view: 22 columns, rows with a positive total."""
    goods = F.col("contract_type") == "goods"
    clean = classify_and_clean(raw, strip_commas).withColumns(
        {
            "total_value": F.col("total_value_clean"),
            "quantity": F.col("quantity_clean"),
            "unit_price": F.col("unit_price_clean"),
            "year": F.col("contract_year"),
            "month": F.col("contract_month"),
            "hour": F.col("contract_hour"),
            "model": F.when(goods, F.col("model")),
        }
    )
    return clean.filter(F.col("total_value") > 0).select(*values.CLEAN_COLUMNS)


def contracts_analysis(clean: DataFrame) -> DataFrame:
    """The analysis view: real products only.  A missing name leaves too."""
    return clean.filter(~is_junk_product(F.col("product_name")) & (F.col("total_value") > 0))


def register_views(raw: DataFrame) -> None:
    """(Re)place the temp views ``contracts_clean`` and ``contracts_analysis``."""
    clean = contracts_clean(raw)
    clean.createOrReplaceTempView("contracts_clean")
    contracts_analysis(clean).createOrReplaceTempView("contracts_analysis")


def date_preview(raw: DataFrame, order: str = "id", n: int = 5) -> DataFrame:
    first = raw.select(order, "contract_date").orderBy(order).limit(n)
    return with_calendar_parts(first)


def unit_price_preview(raw: DataFrame, order: str = "id", n: int = 10) -> DataFrame:
    goods = (F.col("contract_type") == "goods") & F.col("unit_price_clean").isNotNull()
    return (
        classify_and_clean(raw)
        .filter(goods)
        .orderBy(order)
        .limit(n)
        .select(
            order, "quantity", "total_value",
            F.col("unit_price").alias("old_unit_price"),
            F.col("unit_price_clean").alias("real_unit_price"),
        )
    )
