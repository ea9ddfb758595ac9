import datetime as dt

import pytest
from pyspark.sql import functions as F

from contractlens.functions import scalars as S


def apply(spark, function, texts, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_price_text(spark):
    texts = ["₹ 1,200.50", "Rs. 500", "1e5", "INR 12", "-", "₹1.2.3", "", None, "1 200", "1 　200", "-5"]
    assert apply(spark, S.clean_price, texts) == [
        1200.5, 0.5, 15.0, 12.0, None, None, None, None, 1200.0, 1200.0, -5.0,
    ]


def test_price_text_strict(spark):
    assert apply(spark, lambda c: S.clean_price(c, strict=True), ["Rs. 500", "Rs 500", "INR 12", "₹5"]) == [
        500.0, 500.0, 12.0, 5.0,
    ]


def test_numeric_prefix(spark):
    texts = ["12abc", "1,200", "5e3x", " 9", "", "abc", "12d", "5e", ".5", "-3", None]
    assert apply(spark, S.numeric_prefix, texts) == [12, 1, 5000, 9, 0, 0, 12, 5, 0.5, -3, None]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1/4/2026 09:30", dt.datetime(2026, 4, 1, 9, 30)),
        ("01/04/2026 9:30", dt.datetime(2026, 4, 1, 9, 30)),
        ("31/02/2026 09:30", None),
        ("x", None),
        (None, None),
        ("05-06-2024", dt.datetime(2024, 6, 5)),
        ("05/06/2024", dt.datetime(2024, 6, 5)),
        ("05/26/2024", dt.datetime(2024, 5, 26)),
        ("2024-06-05", dt.datetime(2024, 6, 5)),
        ("05 Jun 2024", dt.datetime(2024, 6, 5)),
        ("05 June 2024", dt.datetime(2024, 6, 5)),
        ("07 May 2024", dt.datetime(2024, 5, 7)),
        ("2024-06-05 10:11:12", dt.datetime(2024, 6, 5, 10, 11, 12)),
    ],
)
def test_dates(spark, text, expected):
    assert apply(spark, S.parse_when, [text]) == [expected]


def test_junk_names(spark):
    names = ["Is False here", "title x", "ITEM 5", "fepl-1", "PBB", None, "Items", "My Title", "", "Ball Pen"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    kept = rows.filter(~S.is_junk_product(F.col("n"))).collect()
    assert [r.n for r in kept] == ["Items", "My Title", "", "Ball Pen"]


def test_missing_tokens(spark):
    assert apply(spark, S.missing_to_null, ["NA", "N/A", "None", "null", "", "nan", "Na", "x"]) == [
        None, None, None, None, None, None, "Na", "x",
    ]


def test_log_price_and_nan(spark):
    got = apply(spark, S.log_price, [0.0, -4.0, None, float("nan")], "double")
    assert got == [0.0, 0.0, None, None]


def test_ratio_by_zero_is_missing(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (5.0, 2.0)], "a double, b double")
    assert [r[0] for r in rows.select(S.ratio(F.col("a"), F.col("b"))).collect()] == [None, 2.5]
