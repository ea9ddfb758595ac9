import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contractlens.operators.concentration import compute_hhi, missing_rate
from contractlens.operators.overpricing import flag_overpricing, price_fences
from contractlens.operators.quantiles import group_quantiles
from contractlens.operators.scoring import add_score, report_lines, review_list, run_metrics
from contractlens.operators.timing import flag_timing_clusters
from contractlens.plans.runs import score_contracts


# -- concentration -------------------------------------------------------------

HHI = [
    ("M", "a", 60.0), ("M", "b", 30.0), ("M", "c", 10.0), ("N", "a", 5.0), ("N", None, 9.0),
    ("Z", "a", 0.0), (None, "a", 1.0), ("E", "a", 50.0), ("E", "b", 25.0), ("E", "b", 25.0),
    ("K", "a", None),
]


def test_hhi(spark):
    df = spark.createDataFrame(HHI, "g string, e string, v double")
    got = [(r.g, r.hhi) for r in compute_hhi(df, "g", "e", "v").collect()]
    assert got == [("N", 10000.0), ("E", 5000.0), ("M", pytest.approx(4600.0)), ("K", 0.0), ("Z", 0.0)]
    assert missing_rate(df, "e").first().missing_rate == pytest.approx(1 / 11)
    assert missing_rate(df.limit(0), "e").first().missing_rate is None


def test_hhi_does_not_change_when_rows_are_split(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), rng.choice("abcd"), float(rng.randint(1, 99))) for _ in range(200)]
    halves = [(g, e, v / 2) for g, e, v in rows for _ in range(2)]
    one, two = (
        {r.g: r.hhi for r in compute_hhi(spark.createDataFrame(x, "g string, e string, v double"), "g", "e", "v").collect()}
        for x in (rows, halves)
    )
    assert one == pytest.approx(two)
    assert all(0 < h <= 10000 for h in one.values())


# -- quantiles and prices --------------------------------------------------------


@pytest.mark.parametrize("max_group", [1_000_000, 50, 2])
def test_quantiles_are_exact_for_any_group_size(spark, max_group):
    """Small and large limits give the same as sorting the whole group."""
    rng = random.Random(7)
    hot = [("hot", round(rng.lognormvariate(4, 3), 2)) for _ in range(3000)]
    hot += [("hot", 12.5)] * 1500 + [("hot", -v) for _, v in hot[:100]]
    cold = [(rng.choice("abc"), rng.random() * 100) for _ in range(300)] + [("one", 3.0)]
    rows = hot + cold + [(None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99, "low": 0.0, "high": 1.0}
    got = group_quantiles(df, ["k"], F.col("v"), probs, mean_as="avg", max_group=max_group)
    frame = pd.DataFrame(hot + cold, columns=["k", "v"]).groupby("k").v
    rows = {r.k: r for r in got.collect()}
    assert set(rows) == set(frame.groups)
    for key, values in frame:
        assert rows[key].n == len(values)
        assert rows[key].avg == pytest.approx(values.mean(), rel=1e-9, abs=1e-9)
        for name, p in probs.items():
            assert rows[key][name] == pytest.approx(values.quantile(p), rel=1e-12, abs=1e-12)


PRICES = (
    [("P", 10.0)] * 4 + [("P", 10000.0)]
    + [("Q", float(p)) for p in (10, 11, 12, 13, 14, 100)]
    + [("R", float(p)) for p in (10, 11, 12, 13)]
    + [(None, 1e9), ("P", None), ("S", float("nan"))]
)


@pytest.mark.parametrize("max_group", [1_000_000, 2])
def test_overpricing(spark, max_group):
    df = spark.createDataFrame(PRICES, "product_name string, unit_price double")
    flagged = flag_overpricing(df, max_group=max_group)
    assert flagged.count() == len(PRICES)
    assert flagged.filter("overpriced_flag is null").count() == 0
    got = {(r.product_name, r.unit_price) for r in flagged.filter("overpriced_flag").collect()}
    assert got == {("P", 10000.0), ("Q", 100.0)}
    q = price_fences(df, max_group=max_group).filter("product_name = 'Q'").first()
    assert (q.q1, q.q3, q.upper_fence) == pytest.approx((2.504917, 2.690802, 3.248456), abs=1e-6)


def test_overpricing_near_the_fence(spark):
    rows = [("Q", float(p)) for p in (10, 11, 12, 13, 14, 25)]
    df = spark.createDataFrame(rows, "product_name string, unit_price double")
    assert [r.unit_price for r in flag_overpricing(df).filter("overpriced_flag").collect()] == [25.0]


# -- timing ------------------------------------------------------------------------


def at(clock):
    return None if clock is None else dt.datetime.fromisoformat(f"2024-01-01 {clock}")


TIMING = [
    (1, "B1", "10:00", 100.0), (2, "B1", "10:30", 101.0), (3, "B1", "11:01", 101.0),
    (4, "B2", "10:00", 100.0), (5, "B2", "10:01", 102.0),
    (6, "B3", "10:00", 100.0), (7, "B3", "10:01", 500.0), (8, "B3", "10:02", 100.0),
    (9, None, "10:00", 100.0), (10, None, "10:00", 100.0),
    (11, "B4", "10:00", 0.0), (12, "B4", "10:00", 0.0),
    (13, "B5", "10:00", -100.0), (14, "B5", "10:05", 900.0),
    (15, "B6", "10:00", 7.0), (16, "B6", None, 7.0),
    (17, "B7", "10:00", 50.0), (18, "B7", "10:04", 50.0), (19, "B7", "10:08", 50.5),
    (20, "B8", "10:00", 5.0), (21, "B8", "10:01", None), (22, "B8", "10:02", 5.0),
    # a pair across the place where stretches are cut
    (23, "B9", "02:50", 5.0), (24, "B9", "03:10", 5.0),
]
SCHEMA = "id long, org_name string, contract_date timestamp, total_value double"


@pytest.mark.parametrize("max_group", [1_000_000, 1])
def test_timing_vectors(spark, max_group):
    df = spark.createDataFrame([(i, b, at(t), v) for i, b, t, v in TIMING], SCHEMA)
    flagged = flag_timing_clusters(df, max_group=max_group)
    assert flagged.columns == [*df.columns, "timing_cluster_flag"]
    assert flagged.count() == len(TIMING)
    got = sorted(r.id for r in flagged.filter("timing_cluster_flag").collect())
    assert got == [1, 2, 13, 14, 17, 18, 19, 23, 24]


def brute_timing(rows, minutes, tolerance):
    """Neighbouring pairs, one buyer at a time, by plain loops."""
    flagged, by_buyer = set(), {}
    for i, buyer, when, value in rows:
        if buyer is not None and when is not None:
            by_buyer.setdefault(buyer, []).append((when, i, value))
    for group in by_buyer.values():
        group.sort(key=lambda r: r[:2])
        for (t0, i0, v0), (t1, i1, v1) in zip(group, group[1:]):
            near = (t1 - t0).total_seconds() / 60 <= minutes
            if near and v0 not in (0, None) and v1 is not None and abs(v1 - v0) / v0 < tolerance:
                flagged |= {i0, i1}
    return flagged


@pytest.mark.parametrize("minutes, tolerance, max_group", [(30, 0.02, 10**6), (30, 0.2, 20), (600, 0.5, 3), (0, 0.3, 5)])
def test_timing_against_brute_force(spark, minutes, tolerance, max_group):
    """A hot buyer, ties in time, gaps in all columns; groups cut or whole."""
    rng = random.Random(minutes + max_group)
    start, rows = dt.datetime(2024, 2, 28), []
    for i in range(1500):
        buyer = rng.choice(["hot", "hot", "b", "c", None])
        when = start + dt.timedelta(minutes=rng.randint(0, 4000)) if rng.random() > 0.05 else None
        if rng.random() < 0.2 and when:
            when = when.replace(hour=0, minute=0)
        value = rng.choice([None, 0.0, -1.0] + [float(v) for v in range(90, 120)])
        rows.append((i, buyer, when, value))
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = flag_timing_clusters(
        df, window_minutes=minutes, value_tolerance=tolerance, max_group=max_group
    )
    assert flagged.count() == len(rows)
    got = {r.id for r in flagged.filter("timing_cluster_flag").collect()}
    assert got == brute_timing(rows, minutes, tolerance)


def test_timing_shuffles_rows_once(spark):
    df = spark.createDataFrame([(i, b, at(t), v) for i, b, t, v in TIMING], SCHEMA)
    plan = flag_timing_clusters(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("+- Sort ") == 1
    assert "Python" not in plan


# -- score -------------------------------------------------------------------------


def test_score_and_review_list(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    scored = score_contracts(
        events, "event_type", "value", "user_id", "ts", "value", "event_id",
        iqr_multiplier=0.6, window_minutes=600, value_tolerance=0.2,
    ).cache()
    assert scored.count() == events.count()
    rows = scored.collect()
    assert all(r.anomaly_score == r.overpriced_flag + r.timing_cluster_flag for r in rows)
    listed = [r.anomaly_score for r in review_list(scored, "event_id").collect()]
    assert listed == sorted(listed, reverse=True) and 0 not in listed
    figures = run_metrics(scored, "value").first()
    assert figures.flagged_any == len(listed)
    assert figures.flagged_any == figures.price_flagged + figures.timing_flagged - figures.flagged_both
    assert f"by both: {figures.flagged_both}" in report_lines(run_metrics(scored, "value")).first().report
    assert math.isclose(figures.price_rate, figures.price_flagged / len(rows), abs_tol=1e-6)


def test_score_is_sum_of_flags(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False)], "overpriced_flag boolean, timing_cluster_flag boolean")
    assert [r.anomaly_score for r in add_score(df).collect()] == [2, 1, 0]
