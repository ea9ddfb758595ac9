import pytest
from pyspark.sql import functions as F

from contractlens import values
from contractlens.operators import cleaning, reports

# id, quantity, model, total_value, unit_price
RAW = [
    (1, "₹ 5,000.00", "10", None, 500.0),
    (2, " ₹5", "10", 90.0, 1.0),
    (3, "4", "M1", None, 100.0),
    (4, "3", "M1", 10.0, 10.0),
    (5, "1,200", "M1", 2400.0, 2400.0),
    (6, "abc", "M1", 10.0, 10.0),
    (7, "0", "M1", 10.0, 10.0),
    (8, "₹900", "lot", None, 1.0),
    (9, "5", "M1", None, None),
    (10, "5", "M1", 0.0, 3.0),
    (11, "₹900", "0", None, 1.0),
]
# id -> type, total, quantity, unit price
CLEAN = {
    1: ("service", 5000.0, 10.0, 500.0),
    2: ("goods", 90.0, None, None),
    3: ("goods", 100.0, 4.0, 25.0),
    4: ("goods", 10.0, 3.0, 3.3333),
    5: ("goods", 2400.0, 1.0, 2400.0),
    6: ("goods", 10.0, None, None),
    7: ("goods", 10.0, None, None),
    8: ("service", 900.0, None, None),
    9: ("goods", None, None, None),
    10: ("goods", None, None, None),
    11: ("service", 900.0, 0.0, None),
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = spark.createDataFrame(RAW, "id long, quantity string, model string, total_value double, unit_price double")
    filled = {
        f.name: F.lit(None).cast(f.dataType) for f in values.CONTRACTS.fields if f.name not in rows.columns
    }
    return rows.withColumns(
        {
            **filled,
            "contract_date": F.when(F.col("id") == 1, "1/4/2026 09:30").when(F.col("id") == 2, "").otherwise("31/02/2026 09:30"),
            "org_type": F.when(F.col("id") == 1, " Organization ").otherwise("State"),
            "product_name": F.when(F.col("id") == 4, "Item 9").otherwise("Pen"),
        }
    ).select(*[f.name for f in values.CONTRACTS.fields])


def test_branches(raw):
    got = {
        r.id: (r.contract_type, r.total_value_clean, r.quantity_clean, r.unit_price_clean)
        for r in cleaning.classify_and_clean(raw).collect()
    }
    assert got == CLEAN


def test_strip_commas_option(raw):
    row = cleaning.classify_and_clean(raw, strip_commas=True).filter("id = 5").first()
    assert (row.quantity_clean, row.unit_price_clean) == (1200.0, 2.0)


def test_clean_view(raw):
    clean = cleaning.contracts_clean(raw)
    assert clean.columns == values.CLEAN_COLUMNS
    rows = {r.id: r for r in clean.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7, 8, 11}
    assert (rows[1].year, rows[1].month, rows[1].hour) == (2026, 4, 9)
    assert (rows[2].year, rows[3].year) == (None, None)
    assert (rows[1].org_type, rows[2].org_type) == ("Unknown", "State")
    assert (rows[1].model, rows[3].model) == (None, "M1")


def test_clean_view_is_one_scan_without_shuffle(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "raw"))
    stored = spark.read.parquet(str(tmp_path / "raw"))
    plan = cleaning.contracts_clean(stored).select("total_value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<total_value:double,quantity:string,unit_price:double>" in plan


def test_analysis_view_and_views(spark, raw):
    ids = {r.id for r in cleaning.contracts_analysis(cleaning.contracts_clean(raw)).collect()}
    assert ids == {1, 2, 3, 5, 6, 7, 8, 11}
    cleaning.register_views(raw)
    cleaning.register_views(raw)
    assert spark.sql("select count(*) from contracts_clean").first()[0] == 9
    assert spark.sql("select count(*) from contracts_analysis").first()[0] == 8


def test_checks_and_previews(raw):
    classified = cleaning.classify_and_clean(raw)
    service = reports.service_check(classified).first()
    assert (service.n, service.avg_quantity, service.avg_total) == (3, 5.0, pytest.approx(6800 / 3))
    held = reports.held_total_check(classified).first()
    assert (held.n, held.avg_total, held.avg_unit_price) == (1, 100.0, 25.0)
    assert [r.contract_year for r in cleaning.date_preview(raw, n=3).collect()] == [2026, None, None]
    shown = cleaning.unit_price_preview(raw, n=2).collect()
    assert [(r.id, r.real_unit_price) for r in shown] == [(3, 25.0), (4, 3.3333)]


PEERS = [("p", "m", "goods", 2.0, float(v)) for v in (10, 10, 10, 10, 10, 12, 12, 12, 12, 60)]


def peers(spark, extra=()):
    rows = [(i, *r, r[4] * (r[3] or 1)) for i, r in enumerate([*PEERS, *extra])]
    names = "contract_number int, product_name string, ministry string, contract_type string, quantity double, unit_price double, total_value double"
    df = spark.createDataFrame(rows, names)
    return df.withColumns(
        {c: F.lit("x") for c in ("org_name", "department", "contract_date", "buying_mode", "contract_status")}
    ).withColumns({c: F.lit(1) for c in ("year", "month")})


@pytest.mark.parametrize("max_group", [10**6, 2])
def test_median_outliers(spark, max_group):
    extra = [
        ("p", "m", "service", 5.0, 90.0),  # not a peer, still compared
        ("p", "m", "goods", 1.0, 900.0),  # quantity of 1: neither
        ("few", "m", "goods", 2.0, 1.0),
        (None, "m", "goods", 2.0, 900.0),
    ]
    found = reports.median_outliers(peers(spark, extra), max_group=max_group)
    rows = {r.contract_number: r for r in found.collect()}
    assert set(rows) == {9, 10}
    assert rows[9].median_price == 11.0 and rows[9].contract_count == 10
    assert rows[9].avg_price == pytest.approx(15.8)
    assert (rows[9].price_ratio, rows[9].pct_above_median) == (5.5, 445.5)
    goods = reports.median_outliers(peers(spark, extra), goods_only=True, max_group=max_group)
    assert [r.contract_number for r in goods.collect()] == [9]
    impact = reports.anomaly_impact(found).first()
    assert (impact.total_anomalies, impact.products_affected) == (2, 1)
    assert impact.total_value_at_risk == 120.0 + 450.0
    assert impact.estimated_overcharge == pytest.approx(120 - 22 + 450 - 55)
    assert [r.contract_number for r in reports.by_ratio(found).collect()] == [10, 9]


def test_average_outliers(spark):
    rows = [("p", "m", "service", 1.0, 1000.0)]
    df = peers(spark, rows)
    assert [r.contract_number for r in reports.average_outliers(df, None).collect()] == [10]
    assert reports.average_outliers(df).count() == 0
    assert reports.average_outliers(df, ["p"]).count() == 1
    names = spark.createDataFrame([("p",), ("p",), ("q",)], "product_name string")
    assert reports.average_outliers(df, names).count() == 1


def test_benchmark_needs_ministries(spark):
    df = peers(spark)
    assert reports.product_benchmark(df).count() == 0
    row = reports.product_benchmark(df, min_ministries=1).first()
    assert (row.contracts, row.ministries, row.min_price, row.max_price) == (10, 1, 10.0, 60.0)
    assert row.max_vs_avg == 3.8
