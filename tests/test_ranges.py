"""Split orders, twins in a time range, and timing clusters on a stream, against brute force."""

import datetime as dt

import numpy as np
import pytest

from contractlens.operators import concentration, sketches, splitting, timing, twins
from contractlens.plans.runs import save_anomalies
from contractlens.streaming import ingest
from contractlens.streaming.timing import stream_timing_clusters

START = dt.datetime(2024, 3, 1, 2, 30)
ROWS = "id long, org_name string, product_name string, contract_date timestamp, total_value double"


def made(seed, n, buyers=4, minutes=3000, hot=0.35):
    """Rows of some buyers, a third of them of one, with ties and repeated values."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        buyer = "hot" if rng.random() < hot else f"b{rng.integers(buyers)}"
        value = float(rng.choice([90.0, 91.0, 99.99, 100.0, 85.0, 90.001]) if rng.random() < 0.6 else np.round(rng.lognormal(4, 1), 2))
        rows.append((i, buyer, f"p{rng.integers(2)}", START + dt.timedelta(minutes=int(rng.integers(minutes))), value))
    return rows


ODD = [
    (900, None, "p0", START, 95.0), (901, "b0", None, START, 95.0), (902, "b0", "p0", None, 95.0), (903, "b0", "p0", START, None),
    (904, "b0", "p0", START, float("nan")), (905, "b0", "p0", START, 0.0), (906, "b0", "p0", START, -95.0), (907, "b1", "p0", START, float("inf")),
]


def usable(value):
    return value is not None and value == value and 0 < value < float("inf")


def test_quantity_splitting(spark):
    rows = made(1, 500) + ODD
    window, limit, near, least = dt.timedelta(minutes=240), 100, 0.9, 3
    got = {r.id: (r.split_count, round(r.split_total, 2), r.split_flag) for r in splitting.flag_quantity_splitting(
        spark.createDataFrame(rows, ROWS), limit, near=near, window_minutes=240, least=least).collect()}
    close = [r for r in rows if None not in r and near * limit <= r[4] < limit]
    seen = {r[0]: [o for o in close if o[1:3] == r[1:3] and r[3] - window <= o[3] <= r[3]] for r in close}
    hits = [r for r in close if len(seen[r[0]]) >= least and round(sum(round(o[4], 2) for o in seen[r[0]]), 2) >= limit]
    want = {r[0]: (0, 0.0, False) for r in rows}
    for r in close:
        flag = any(h[1:3] == r[1:3] and r[3] <= h[3] <= r[3] + window for h in hits)
        want[r[0]] = (len(seen[r[0]]), round(sum(round(o[4], 2) for o in seen[r[0]]), 2), flag)
    assert got == want
    assert 0 < sum(f for _, _, f in want.values()) < len(close)


def test_splitting_reads_each_row_a_fixed_number_of_times(spark):
    plan = splitting.flag_quantity_splitting(spark.createDataFrame(made(2, 50), ROWS), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("specifiedwindowframe(RangeFrame, unboundedpreceding$()") >= 2


def brute_twins(rows, window, tolerance):
    known = sorted((r for r in rows if r[1] is not None and r[3] is not None and usable(r[4])), key=lambda r: (r[3], r[0]))
    out = {r[0]: (0, 0, None) for r in rows}
    for i, a in enumerate(known):
        match = lambda e, l: e[1] == l[1] and l[3] - e[3] <= window and abs(l[4] - e[4]) / e[4] < tolerance
        later = [b[0] for b in known[i + 1 :] if match(a, b)]
        earlier = [b[0] for b in known[:i] if match(b, a)]
        out[a[0]] = (len(later), len(earlier), later[0] if later else earlier[-1] if earlier else None)
    return out


@pytest.mark.parametrize("minutes, tolerance, rows_at_once", [(30, 0.02, 100_000), (240, 0.1, 50)])
def test_range_matches(spark, monkeypatch, minutes, tolerance, rows_at_once):
    monkeypatch.setattr(twins, "ROWS", rows_at_once)
    rows = made(3, 700) + ODD
    df = spark.createDataFrame(rows, ROWS)
    got = {r.id: (r.later_matches, r.earlier_matches, r.partner) for r in twins.range_matches(df, window_minutes=minutes, value_tolerance=tolerance).collect()}
    want = brute_twins(rows, dt.timedelta(minutes=minutes), tolerance)
    assert got == want and sum(a for a, _, _ in want.values()) > 100


def test_text_ids_and_no_rows(spark):
    rows = [("é", "b", START, 1.0), ("z", "b", START, 1.0), ("c", "c", START, 2.0)]
    df = spark.createDataFrame(rows, "id string, org_name string, contract_date timestamp, total_value double")
    assert {tuple(r) for r in twins.range_matches(df).collect()} == {("z", 1, 0, "é"), ("é", 0, 1, "z"), ("c", 0, 0, None)}
    assert twins.range_matches(df.limit(0)).count() == 0


def test_counting_grows_with_the_rows():
    """300,000 rows at one instant and value have 45 billion pairs."""
    times, values = np.zeros(300_000, np.int64), np.full(300_000, 5.0)
    after, before, partner = twins._matches(times, values, 10, 0.02)
    assert after[0] == 299_999 and before[-1] == 299_999 and partner[0] == 1 and partner[-1] == 299_998


def test_ranks_count_like_a_loop():
    rng = np.random.default_rng(4)
    ranks = rng.integers(0, 37, 200)
    matrix = twins.Ranks(ranks.copy())
    begin, end, bound = rng.integers(0, 201, 500), rng.integers(0, 201, 500), rng.integers(-1, 70, 500)
    want = [int((ranks[b:e] < x).sum()) if e > b else 0 for b, e, x in zip(begin, end, bound, strict=True)]
    assert matrix.below(begin, end, bound).tolist() == want


def test_missing_by(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, None)], "contract_type string, brand string")
    assert {tuple(r) for r in concentration.missing_by(df).collect()} == {("a", 2, 0.5), (None, 1, 1.0)}


@pytest.mark.parametrize("files", [1, 7])
def test_stream_equals_batch(spark, tmp_path, files):
    """Rows come in up to an hour out of order, in one file or many."""
    rng = np.random.default_rng(6)
    rows = [r for r in made(5, 400) + ODD if r[3] is not None]
    rows = sorted(rows, key=lambda r: r[3] + dt.timedelta(minutes=int(rng.integers(0, 55))))
    df = spark.createDataFrame(rows, ROWS)
    want = {r.id: r.timing_cluster_flag for r in timing.flag_timing_clusters(df, window_minutes=60, value_tolerance=0.1).collect()}
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[(-1, "end", "p", START + dt.timedelta(days=30), 1.0)]]
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    flagged = stream_timing_clusters(stream, window_minutes=60, value_tolerance=0.1, delay="1 hour")
    query = flagged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    out = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.id >= 0]
    assert len(out) == len(rows) and {r.id: r.timing_cluster_flag for r in out} == want
    assert 0 < sum(want.values()) < len(rows)


def test_sketches_merge(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 3 else f"g{i % 5}", i % 4, float(v), f"b{i % 700}") for i, v in enumerate(rng.normal(size=20_000))]
    rows += [("none", 0, None, None), ("none", 1, float("nan"), None)]
    df = spark.createDataFrame(rows, "product_name string, batch int, unit_price double, org_name string")
    stored = sketches.sketch_groups(df, ["product_name", "batch"], "unit_price", "org_name")
    got = {r.product_name: r for r in sketches.sketched(sketches.merge_sketches(stored, ["product_name"]), ["product_name"], [0.1, 0.5]).collect()}
    assert (got["none"].rows, got["none"].distinct, got["none"].q0) == (2, 0, None)
    for name, r in got.items():
        values = np.sort([v for g, _, v, _ in rows if g == name and v is not None and v == v])
        if len(values):
            assert all(abs(np.searchsorted(values, q) / len(values) - p) <= 0.01 for q, p in ((r.q0, 0.1), (r.q1, 0.5)))
            assert abs(r.distinct - len({b for g, _, _, b in rows if g == name})) <= 0.05 * 700


def test_a_month_reads_its_own_folder(spark, tmp_path):
    rows = [("c1", 2024, 1), ("c2", 2024, 2), ("c3", 2025, 1)]
    df = spark.createDataFrame(rows, "contract_number string, year int, month int")
    for _ in range(2):  # a table that is there is replaced
        table = save_anomalies(df, "anomalies_test", str(tmp_path / "t"))
    month = table.where("year = 2024 AND month = 2")
    assert [r.contract_number for r in month.collect()] == ["c2"] and table.count() == 3
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    spark.sql("DROP TABLE anomalies_test")


def test_buyers_of_a_stream_share_few_states(spark, tmp_path, monkeypatch):
    """A state and a call for each buyer cost far more than its rows."""
    from contractlens.streaming import timing as of_stream

    monkeypatch.setattr(of_stream, "BUYER_GROUPS", 4)
    rows = [(k, f"o{k % 50}", "p", START + dt.timedelta(minutes=k // 2), 100.0 + k % 3) for k in range(600)]
    df = spark.createDataFrame(rows, ROWS)
    want = {r.id: r.timing_cluster_flag for r in timing.flag_timing_clusters(df, window_minutes=60, value_tolerance=0.1).collect()}
    for part in (rows[:200], rows[200:400], rows[400:], [(-1, "end", "p", START + dt.timedelta(days=30), 1.0)]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    flagged = of_stream.stream_timing_clusters(stream, window_minutes=60, value_tolerance=0.1, delay="1 hour")
    query = flagged.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    out = {r.id: r.timing_cluster_flag for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.id >= 0}
    assert out == want and 0 < sum(want.values()) <= len(rows)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(states) == 4 and 0 < max(states) <= 4
