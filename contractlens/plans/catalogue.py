"""The given star-schema tables seen as contracts, pages and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.operators.scale import spread
from contractlens.sources.growing import Files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _lines(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """Line items with order, customer, nation and part.

    Customers are joined to the fewer orders first, so that line items move by order only, not by customer again.
    """
    t = lambda name: table(spark, sf_dir, name)
    return (
        (line_items(spark, sf_dir) if items is None else items)
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(order_details(t("orders"), spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    )


def _number() -> Column:
    return F.concat_ws(
        "-", F.lit("GEMC"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


def _brand() -> Column:
    return F.when(F.col("p_size") % 9 >= 4, F.col("p_brand"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clean contracts."""
    kind = F.when(F.col("l_returnflag") == "R", "service").otherwise("goods")
    return _lines(spark, sf_dir).select(
        _number().alias("contract_number"),
        F.col("n_name").alias("ministry"),
        F.col("c_mktsegment").alias("department"),
        F.col("c_name").alias("org_name"),
        F.col("o_orderpriority").alias("buying_mode"),
        F.col("o_orderdate").alias("contract_date"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        kind.alias("contract_type"),
        F.col("l_extendedprice").alias("total_value"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_linestatus").alias("contract_status"),
        F.col("p_name").alias("product_name"),
        _brand().alias("brand"),
    )


def money_text(amount: str) -> Column:
    return F.col(amount).cast("decimal(18,2)").cast("string")


def date_text(when: Column, clock: Column) -> Column:
    return F.concat(F.day(when), F.lit("/"), F.month(when), F.lit("/"), F.year(when), F.lit(" "), clock)


def raw_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as they would come from pages: text, swapped columns, gaps."""
    line = F.col("l_linenumber")
    money, count = money_text("l_extendedprice"), F.col("l_quantity").cast("int").cast("string")
    service = F.col("l_returnflag") == "R"
    held = F.col("l_returnflag") == "A"
    price = F.col("l_extendedprice")

    service_quantity = (
        F.when(line == 1, F.concat(F.lit("₹"), money))
        .when(line == 2, F.concat(F.lit("₹ "), money))
        .otherwise(F.concat(F.lit("₹1,"), money))
    )
    held_quantity = (
        F.when(line == 5, F.concat(count, F.lit(" nos")))
        .when(line == 6, "0")
        .when(line == 7, "abc")
        .otherwise(count)
    )
    normal_quantity = (
        F.when(line == 3, "0")
        .when(line == 4, "abc")
        .when(line == 5, "1,200")
        .when(line == 6, " ₹5")
        .otherwise(count)
    )
    model = F.when(
        service, F.when(line == 3, "lot").when(line == 4, "0").otherwise(count)
    ).otherwise(F.concat(F.lit("M"), F.col("l_suppkey")))
    clock = F.concat(F.lpad((line + 7).cast("string"), 2, "0"), F.lit(":30"))
    date = (
        F.when(line == 7, "")
        .when((line == 2) & (F.col("l_linestatus") == "F"), "31/02/2026 09:30")
        .otherwise(date_text(F.col("o_orderdate"), clock))
    )
    leaked = F.when(F.col("c_mktsegment") == "BUILDING", " Organization ").otherwise(
        F.col("c_mktsegment")
    )
    return _lines(spark, sf_dir, spread(line_items(spark, sf_dir))).select(
        F.xxhash64(_number()).alias("id"),
        _number().alias("contract_number"),
        leaked.alias("org_type"),
        F.col("n_name").alias("ministry"),
        F.col("c_mktsegment").alias("department"),
        F.col("c_name").alias("org_name"),
        F.lit("").alias("office_zone"),
        F.lit("").alias("buyer_designation"),
        F.col("o_orderpriority").alias("buying_mode"),
        date.alias("contract_date"),
        F.when(service | held, F.lit(None)).when(line == 7, 0.0).otherwise(price).alias("total_value"),
        F.col("l_linestatus").alias("contract_status"),
        junk_name().alias("product_name"),
        _brand().alias("brand"),
        model.alias("model"),
        F.when(service, service_quantity)
        .when(held, held_quantity)
        .otherwise(normal_quantity)
        .alias("quantity"),
        price.alias("unit_price"),
        F.col("l_shipdate").cast("timestamp").alias("scraped_at"),
    )


def junk_name() -> Column:
    """Part names, some with the look of a leaked heading."""
    size, name = F.col("p_size") % 12, F.col("p_name")
    return (
        F.when(size == 0, F.concat(F.lit("fepl-"), name))
        .when(size == 1, F.concat(F.lit("Item "), name))
        .when(size == 2, F.concat(F.lit("TITLE"), name))
        .when(size == 3, F.concat(name, F.lit(" False")))
        .when(size == 4, F.lit("PBB"))
        .when(size == 5, F.concat(F.lit("Items "), name))
        .otherwise(name)
    )


def order_details(orders: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, batch or stream, with customer and nation."""
    return orders.join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def _row(*cells: Column, tag: str = "td") -> Column:
    inner = [F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells]
    return F.concat(F.lit("<tr>"), *inner, F.lit("</tr>"))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"<p><strong>{label}:</strong>\n <span>"), value, F.lit("</span></p>"))


def render_pages(details: DataFrame) -> DataFrame:
    """One result page per order, each with its contract block twice.

    Orders of status ``P`` show no contract number, those of priority
    ``5-LOW`` have no product table, the total of ``1-URGENT`` has no label
    of its own.  Some markup is sloppy: a stray quote before the blocks of
    ``2-HIGH``, no-break spaces in the header of ``3-MEDIUM``, a misplaced end
    tag in a cell of ``4-NOT SPECIFIED``.
    """
    money, key = money_text("o_totalprice"), F.col("o_orderkey").cast("string")
    numbered, priority = F.col("o_orderstatus") != "P", F.col("o_orderpriority")
    header = F.concat(
        F.lit('<div class="block_header"><p>Contract No: '),
        F.when(numbered, F.concat(F.lit("GEMC-"), key)).otherwise("withheld"),
        F.lit("</p><p>"),
        F.when(priority == "3-MEDIUM", "&#160;Status&nbsp;of&nbsp;the&nbsp;Contract:").otherwise("Status of the Contract:"),
        F.lit(" <b>State "),
        F.col("o_orderstatus"),
        F.lit("</b></p></div>"),
    )
    total = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.concat(F.lit("<div>Total : ₹ "), money, F.lit("</div>")),
    ).otherwise(_labelled("Total Value", F.concat(F.lit("₹&nbsp;"), money)))
    products = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(
        F.concat(
            F.lit('<table class="table table-striped">'),
            _row(F.lit("Product"), F.lit("Brand"), tag="th"),
            _row(
                F.concat(
                    F.lit("Pens &amp; "), priority,
                    F.when(priority == "4-NOT SPECIFIED", "</div>").otherwise(""),
                ),
                F.col("c_mktsegment"),
                F.concat(F.lit("M"), F.col("c_nationkey")),
                F.lit(" 4 "),
                F.concat(F.lit("₹"), money),
            ),
            _row(F.lit("Spare"), F.lit(""), F.lit("")),
            F.lit("</table>"),
        )
    )
    block = F.concat(
        F.lit('<div class="border block">'),
        header,
        F.lit('<span class="x ajxtag_buyer_dept_org">'),
        F.col("c_mktsegment"),
        F.lit("</span><div>"),
        _labelled("Ministry", F.col("n_name")),
        _labelled("Department", F.col("c_mktsegment")),
        _labelled("Organization Name", F.col("c_name")),
        _labelled("Buying Mode", F.col("o_orderpriority")),
        _labelled("Contract Date", date_text(F.col("o_orderdate"), F.lit("09:30"))),
        total,
        products,
        F.lit("</div></div>"),
    )
    return details.select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(
            F.lit('<html><head><script>var t="</div>";</script></head><body>'),
            F.when(priority == "2-HIGH", "<p title=it's>").otherwise(""),
            block, block, F.lit("</body></html>"),
        ).alias("html"),
        F.col("o_orderdate").cast("date").alias("from_date"),
        F.col("o_orderdate").cast("date").alias("to_date"),
        F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
    )


def contract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_pages(order_details(spread(table(spark, sf_dir, "orders")), spark, sf_dir))


def order_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visited result pages, one date window per day."""
    day = F.col("o_orderdate").cast("date")
    found = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    outcome = (
        F.when(found, "results")
        .when(F.col("o_orderstatus") == "O", "no_results")
        .otherwise("unknown")
    )
    return table(spark, sf_dir, "orders").select(
        day.alias("from_date"),
        day.alias("to_date"),
        outcome.alias("outcome"),
        F.when(found, F.lit(0)).alias("block_no"),
        F.concat(F.lit("GEMC-"), F.col("o_custkey")).alias("contract_number"),
        F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
    )


# Rows that one task writes into a file of a stream.
STREAM_FILE_ROWS = 1_000_000


def as_stream_files(rows: DataFrame, time: str, path: str, parts: int) -> int:
    """Write ``rows`` in so many parts, the earlier of them first, for a stream to read in this order.

    Each part is as many files as are returned, one where the rows are few: a stream that takes so many
    files a batch takes one part.
    """
    files = max(1, math.ceil(rows.count() / parts / STREAM_FILE_ROWS))
    share = [k / parts for k in range(1, parts)]
    at = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = rows.select(at.alias("t")).approxQuantile("t", share, 0.001)
    written = Files(rows.sparkSession, path)
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True), 1):
        some = rows
        if low is not None:
            some = some.where(at >= low)
        if high is not None:
            some = some.where(at < high)
        some = some.coalesce(1) if files == 1 else some.repartition(files)
        some.write.mode("append").parquet(path)
        # a part of few rows has no rows for some of its files
        for _ in range(k * files - sum(n.startswith("part-") for n in written.names(""))):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)
    return files
