import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from contractlens import values
from contractlens.operators import coverage, dedup
from contractlens.operators.scale import Steps, durable, measured_bytes
from contractlens.plans.runs import run_analysis, run_pipeline
from contractlens.sources import tables
from contractlens.sources.growing import Growing
from contractlens.streaming import ingest
from test_pages import block

DAY = dt.date(2024, 1, 1)
PAGES = "page_id long, html string, from_date date, to_date date, scraped_at timestamp"


def visits(*pages):
    """(page_id, day of January, html)"""
    return [
        (i, html, DAY.replace(day=d), DAY.replace(day=d), dt.datetime(2024, 2, 1) + dt.timedelta(minutes=i))
        for i, d, html in pages
    ]


FOUR = visits(
    (1, 1, block("GEMC-1") + block("GEMC-2")),
    (2, 2, block("GEMC-2") + block("none")),
    (3, 3, "<p>No records found</p>"),
    (4, 4, "<p>?</p>"),
)


def numbers(spark, store):
    return sorted(r.contract_number for r in spark.read.parquet(store.contracts).collect())


def test_first_and_latest_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), ("a", 3, "z")], "k string, o int, v string")
    assert {tuple(r) for r in dedup.first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, None)}
    assert {tuple(r) for r in dedup.latest_per_key(df, ["k"], ["o"]).collect()} == {("a", 3, "z"), ("b", 5, None)}
    plan = dedup.first_per_key(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("partial_min_by") == 1


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    two = spark.createDataFrame([("b", 0), ("c", 1)], "k string, o int")
    add = lambda df, batch: tables.append_new(df, path, batch, ["k"], ["o"])
    assert [add(one, "1"), add(two, "2"), add(two, "2"), add(one, "3")] == [2, 1, 1, 0]
    got = {(r.k, r.o, str(r.batch)) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 1, "1"), ("b", 1, "1"), ("c", 1, "2")}


def test_ingest_batch(spark, tmp_path):
    store = ingest.Store(str(tmp_path))
    pages = spark.createDataFrame(FOUR, PAGES)
    assert ingest.ingest_batch(pages, "0", store) == 2
    assert ingest.ingest_batch(pages, "0", store) == 2  # a replay of the batch
    assert ingest.ingest_batch(pages, "1", store) == 0  # the same pages again
    assert numbers(spark, store) == ["GEMC-1", "GEMC-2"]
    assert spark.read.parquet(store.rejects).filter("batch = '0'").count() == 1
    ledger = tables.ledger_latest(tables.read_ledger(spark, store.ledger)).orderBy("from_date").collect()
    assert [(r.contracts, r.rows, r.note) for r in ledger] == [
        (2, 4, "normal"), (1, 4, "normal"), (0, 0, "zero_confirmed"), (0, 0, "zero_assumed"),
    ]


@pytest.mark.parametrize("grain", ["contract", "line"])
def test_stream_equals_batch(spark, tmp_path, grain):
    two_lines = block("GEMC-7", rows=(("a",), ("b",)))
    rows = FOUR + visits((5, 5, two_lines), (6, 5, two_lines))
    pages = spark.createDataFrame(rows, PAGES)
    whole = ingest.Store(str(tmp_path / "whole"), grain)
    ingest.ingest_batch(pages, "all", whole)

    for i, row in enumerate(rows):  # one file per page, one page per micro-batch
        spark.createDataFrame([row], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = ingest.page_stream(spark, str(tmp_path / "in"), pages.schema, files_per_batch=1)
    parts = ingest.Store(str(tmp_path / "parts"), grain)
    for _ in range(2):  # the second start finds nothing new
        ingest.start_ingest(source, parts, str(tmp_path / "progress")).awaitTermination()
    assert numbers(spark, whole) == numbers(spark, parts)
    assert len(numbers(spark, whole)) == (3 if grain == "contract" else 4)
    state = [
        sorted((r.from_date, r.contracts, r.rows, r.note) for r in tables.ledger_latest(tables.read_ledger(spark, s.ledger)).collect())
        for s in (whole, parts)
    ]
    assert state[0] == state[1]


def test_drop_seen(spark, tmp_path):
    rows = [("a", i, dt.datetime(2024, 1, 1, 0, i)) for i in range(30)] + [("b", 1, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "k string, v int, ts timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v int, ts timestamp").parquet(str(tmp_path / "in"))
    query = (
        ingest.drop_seen(stream, "k", "ts", salts=4).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


# -- windows -----------------------------------------------------------------------


@pytest.mark.parametrize("first, last, step, expected", [
    ("01-01-2024", "10-01-2024", 4, [(1, 4), (5, 8), (9, 10)]),
    ("10-01-2024", "01-01-2024", 4, [(1, 4), (5, 8), (9, 10)]),
    ("01-01-2024", "03-01-2024", 0, [(1, 1), (2, 2), (3, 3)]),
    ("05-01-2024", "05-01-2024", 9, [(5, 5)]),
])
def test_date_windows(spark, first, last, step, expected):
    got = coverage.windows_between(spark, first, last, step).orderBy("from_date").collect()
    assert [(r.from_date.day, r.to_date.day) for r in got] == expected


def ledger(spark, *rows):
    full = [(DAY.replace(day=d), DAY.replace(day=d), c, r, dt.datetime(2024, 2, 1, h), note) for d, c, r, h, note in rows]
    return spark.createDataFrame(full, values.LEDGER)


def test_ledger_latest_and_coverage(spark):
    log = ledger(
        spark,
        (1, 2, 2, 1, "normal"), (1, 3, 5, 2, "normal"),
        (2, 9, 9, 1, "normal"), (2, 0, 0, 5, "zero_assumed"),  # replaced
        (3, 0, 0, 1, "zero_assumed"), (3, 0, 0, 2, "zero_confirmed"),
    )
    latest = tables.ledger_latest(log)
    got = {r.from_date.day: (r.contracts, r.rows, r.note) for r in latest.collect()}
    assert got == {1: (3, 5, "normal"), 2: (0, 0, "zero_assumed"), 3: (0, 0, "zero_confirmed")}
    windows = coverage.windows_between(spark, "01-01-2024", "05-01-2024")
    assert [r.from_date.day for r in coverage.pending_windows(windows, latest).collect()] == [4, 5]
    assert coverage.pending_windows(windows, latest, 1).count() == 1
    assert tuple(coverage.coverage(windows, latest).first()) == (5, 3, 2, 1)
    assert tuple(coverage.ledger_summary(latest).first()) == (3, 3)
    assert tuple(coverage.ledger_summary(latest.limit(0)).first()) == (0, 0)
    assert [r.from_date.day for r in coverage.review_windows(latest).collect()] == [2]
    rate = coverage.ingest_rate(latest, windows, dt.datetime(2024, 2, 1, 1)).first()
    assert (rate.rows, rate.windows_done, rate.windows_total) == (5, 3, 5)
    assert rate.elapsed_minutes == 240 and rate.rows_per_minute == pytest.approx(5 / 240)


def test_old_ledger_is_migrated(spark):
    old = ledger(spark, (1, 2, 2, 1, "x")).drop("note", "rows")
    row = tables.migrate_ledger(old).first()
    assert (row.note, row.rows, row.contracts) == ("normal", 2, 2)


def test_missing_table_reads_as_empty(spark, tmp_path):
    assert tables.read_or_empty(spark, str(tmp_path / "none"), values.CONTRACTS).count() == 0


def test_create_if_absent(spark, tmp_path):
    path = str(tmp_path / "contracts")
    assert tables.create_if_absent(spark, path, values.CONTRACTS)
    assert not tables.create_if_absent(spark, path, values.CONTRACTS)
    assert spark.read.parquet(path).schema.names == values.CONTRACTS.names


# -- files and runs -----------------------------------------------------------------

CSV = '''id,contract_number,ministry,org_name,brand,product_name,contract_date,total_value,unit_price,note
1,C1,M,O,NA,Pen,1/4/2026 09:30,100,10,"a ""quoted"", text"
2,C2,M,O,x,Pen,01/04/2026 09:40,100.5,10,
3,C3,M,O,None,Pen,31/02/2026 09:30,oops,10,n/a
4,C4,N,P,y,Pen,2026-04-01,NaN,10,
5,C5,N,P,y,Pen,5/4/2026 10:00,7,1000,
6,C6,N,P,z,Pen,,7,10,
'''


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "contracts.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_scan(spark, csv):
    text = tables.read_csv_text(spark, csv)
    rows = {r.id: r for r in tables.type_columns(text).collect()}
    assert [rows[i].brand for i in range(1, 7)] == [None, "x", None, "y", "y", "z"]
    assert rows[1].contract_date == dt.datetime(2026, 4, 1, 9, 30) and rows[3].contract_date is None
    assert rows[1].note == 'a "quoted", text' and rows[3].note is None
    assert [rows[i].total_value for i in (1, 3, 4)] == [100.0, None, None]
    bad = tables.csv_problems(text).first()
    assert (bad.contract_date, bad.total_value, bad.unit_price) == (1, 1, 0)


def test_run_from_csv(spark, csv, tmp_path):
    done = run_pipeline(spark, csv, str(tmp_path / "out"))
    assert [(r.ministry, r.hhi) for r in done.hhi.collect()] == [("M", 10000.0), ("N", pytest.approx(5000.0))]
    flagged = spark.read.option("header", True).csv(str(tmp_path / "out/flagged_anomalies"))
    assert sorted(r.id for r in flagged.collect()) == ["1", "2", "5"]
    assert {"log_price", "overpriced_flag", "timing_cluster_flag", "anomaly_score"} <= set(flagged.columns)
    figures = done.metrics.first()
    assert (figures.contracts, figures.price_flagged, figures.timing_flagged, figures.flagged_both) == (6, 1, 2, 0)
    assert spark.read.option("header", True).csv(str(tmp_path / "out/hhi_by_ministry")).columns == ["ministry", "hhi"]


def test_run_analysis_replaces_its_tables(spark, sf, tmp_path):
    from contractlens.plans import catalogue as cat

    raw = cat.raw_contracts(spark, sf)
    first = run_analysis(raw, str(tmp_path)).anomalies.count()
    again = run_analysis(raw, str(tmp_path))
    assert again.anomalies.count() == first == again.impact.first().total_anomalies


def test_size_helpers(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "s string, n int")
    assert measured_bytes(df) == 2 * 32 + 3 and measured_bytes(df.limit(0)) == 0


def test_steps_are_removed_also_on_failure(spark):
    with pytest.raises(ValueError), Steps(spark):
        kept = durable(spark.range(5))
        (file,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
        folder = pathlib.Path(file.removeprefix("file:").replace("//", "/"))
        assert kept.count() == 5 and folder.exists()
        raise ValueError
    assert not folder.exists()


def test_quoted_line_ends_and_rejects(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('id,product_name,total_value\n1,"Pen\nblue",5\n2,short\n3,a,6,long\n4,"say ""x""",7\n')
    got = tables.read_contracts_csv(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "Pen\nblue", 5.0), (4, 'say "x"', 7.0)]
    rejects = tables.csv_rejects(spark, str(path)).collect()
    assert sorted(r.record for r in rejects) == ["2,short", "3,a,6,long"]


def test_other_column_order_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,product_name,total_value\n1,p,5\n")
    (tmp_path / "b.csv").write_text("product_name,id,total_value\nq,2,6\n")
    with pytest.raises(Exception, match="header"):
        tables.read_contracts_csv(spark, str(tmp_path)).collect()


def test_dates_with_time(spark):
    from contractlens.functions.scalars import parse_when

    texts = ["1/4/2026 09:30:15", "2026-04-01 09:30", "01-04-2026 09:30", "2026-04-01T09:30:00", "01-04-2026 09:30:01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.w for r in df.select(parse_when(F.col("t")).alias("w")).collect()]
    base = dt.datetime(2026, 4, 1, 9, 30)
    assert got == [base.replace(second=15), base, base, base, base.replace(second=1)]


def test_old_ledger_counts_as_done(spark, tmp_path):
    old = ledger(spark, (1, 2, 2, 1, "x")).drop("note", "rows")
    tables.write_batch(old, str(tmp_path / "ledger"), "0")
    read = tables.read_ledger(spark, str(tmp_path / "ledger"))
    windows = read.select("from_date", "to_date")
    row = coverage.coverage(windows, read).first()
    assert (row.windows_done, row.windows_pending) == (1, 0)
    assert coverage.pending_windows(windows, read).count() == 0


def test_recheck_visits_assumed_windows_again(spark):
    log = ledger(spark, (1, 0, 0, 1, "zero_assumed"), (2, 2, 2, 1, "normal"))
    windows = log.select("from_date", "to_date")
    assert coverage.pending_windows(windows, log).count() == 0
    assert coverage.pending_windows(windows, log, recheck=True).count() == 1


# -- growing tables -------------------------------------------------------------------


def grown(spark, path, batches, size=40, gap=0):
    """Batches of rising keys; each repeats the last ``gap`` keys of the one before."""
    schema = "k long, o int"
    table = Growing(spark, path, spark.createDataFrame([], schema).schema, ["k"])
    added = [
        table.append_new(spark.createDataFrame([(k, b) for k in range(b * size - gap * (b > 0), (b + 1) * size)], schema), f"{b}", ["o"])
        for b in range(batches)
    ]
    return table, added


def test_a_late_batch_opens_no_more_files_than_an_early_one(spark, tmp_path):
    table, added = grown(spark, str(tmp_path / "t"), 20, gap=5)
    assert added == [40] * 20 and table.read().count() == 800
    opened = [len(table.touched(b * 40 - 5, b * 40 + 39, f"{b}")) for b in (2, 20)]
    assert 0 < opened[1] <= 2 * opened[0] and opened[1] < 20
    assert len(table.files.names("_manifest")) == 3  # older ones go


def test_compaction(spark, tmp_path, monkeypatch):
    from contractlens.sources import growing

    monkeypatch.setattr(growing, "FILE_ROWS", 100)
    table, _ = grown(spark, str(tmp_path / "t"), 8)
    before = {(r.k, r.o) for r in table.read().collect()}
    assert table.compact(keep_last=2) == 6
    assert {(r.k, r.o) for r in table.read().collect()} == before == {(r.k, r.o) for r in spark.read.parquet(table.path).collect()}
    assert sorted(n for n in table.files.names("") if n.startswith("batch=")) == ["batch=6", "batch=7", "batch=until-9"]
    merged = table.manifest().where("batch = 'until-9'").orderBy("low").collect()
    assert len(merged) >= 2 and all(a.high < b.low for a, b in zip(merged, merged[1:], strict=False))
    one = spark.createDataFrame([(3, 9), (1000, 9)], "k long, o int")
    assert table.append_new(one, "8", ["o"]) == 1 and table.append_new(one, "8", ["o"]) == 1  # also as a replay
    assert table.compact(keep_last=9) == 0


def test_a_reader_sees_a_table_before_or_after_a_change(spark, tmp_path, monkeypatch):
    table, _ = grown(spark, str(tmp_path / "t"), 3)
    monkeypatch.setattr(table, "_commit", lambda entries: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        table.append_new(spark.createDataFrame([(900, 1)], "k long, o int"), "3", ["o"])
    with pytest.raises(RuntimeError, match="stopped"):
        table.compact(keep_last=1)
    monkeypatch.undo()
    assert table.read().count() == 120
    assert table.append_new(spark.createDataFrame([(900, 1)], "k long, o int"), "3", ["o"]) == 1 and table.read().count() == 121


def test_a_table_without_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(spark.createDataFrame([(1, 1), (2, 1)], "k long, o int"), path, "old")
    assert tables.append_new(spark.createDataFrame([(2, 5), (3, 5)], "k long, o int"), path, "new", ["k"], ["o"]) == 1


# -- a run that goes on ------------------------------------------------------------------


def page_files(spark, path, rows, per_file=1):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], PAGES).coalesce(1).write.mode("append").parquet(path)


def ledger_of(spark, store):
    return sorted((r.from_date, r.contracts, r.rows, r.note) for r in tables.ledger_latest(tables.read_ledger(spark, store.ledger)).collect())


def many_visits(n):
    """A contract of its own on each page, one that each page repeats, and one without number."""
    return visits(*[(i, i % 9 + 1, block(f"GEMC-{i}") + block("GEMC-77777") + block("none")) for i in range(n)])


def test_timed_batches_equal_one_batch(spark, tmp_path):
    """Twenty micro-batches by a timed trigger, drained and stopped, with state, compaction and figures."""
    rows = many_visits(20)
    whole, parts = ingest.Store(str(tmp_path / "whole")), ingest.Store(str(tmp_path / "parts"))
    ingest.ingest_batch(spark.createDataFrame(rows, PAGES), "all", whole)
    page_files(spark, str(tmp_path / "in"), rows)
    schema = spark.createDataFrame([], PAGES).schema
    source = ingest.page_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    query = ingest.start_ingest(source, parts, str(tmp_path / "progress"), every="0 seconds", tasks=2, seen_within="1 day", compact_every=8)
    ingest.drain(query)
    assert not query.isActive
    assert numbers(spark, parts) == numbers(spark, whole) and len(numbers(spark, whole)) == 21
    assert ledger_of(spark, parts) == ledger_of(spark, whole)
    rates = ingest.batch_rates(spark, parts).collect()
    assert len(rates) == 20 and sum(r.added for r in rates) == 21 and all((r.pages, r.lines) == (1, 3) for r in rates)
    assert ingest.live_progress(spark, query).where("input_rows > 0").count() >= 1
    assert len([f for f in (tmp_path / "parts/contracts").iterdir() if f.name.startswith("batch=")]) < 20


def test_contracts_met_again_never_reach_the_table(spark, tmp_path, monkeypatch):
    met, real = [], ingest.append_new

    def spy(rows, *how):
        met.append(sorted({r.contract_number for r in rows.select("contract_number").collect()}))
        return real(rows, *how)

    monkeypatch.setattr(ingest, "append_new", spy)
    page_files(spark, str(tmp_path / "in"), many_visits(4))
    source = ingest.page_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], PAGES).schema, files_per_batch=1)
    ingest.start_ingest(source, ingest.Store(str(tmp_path / "s")), str(tmp_path / "c"), seen_within="1 day").awaitTermination()
    assert len(met) == 4 and sum(len(m) for m in met) == 5  # four of their own and the repeated one once
    plan = ingest.mark_seen(ingest.contract_lines(source, outer=True))._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan


@pytest.mark.parametrize("where", ["contracts", "sightings", "ledger"])
@pytest.mark.parametrize("seen_within", [None, "1 day"])
def test_a_run_goes_on_after_a_crash(spark, tmp_path, where, seen_within):
    rows = many_visits(3)
    whole, parts = ingest.Store(str(tmp_path / "whole")), ingest.Store(str(tmp_path / "parts"))
    ingest.ingest_batch(spark.createDataFrame(rows, PAGES), "all", whole)
    page_files(spark, str(tmp_path / "in"), rows)
    source = ingest.page_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], PAGES).schema, files_per_batch=1)
    steps = []

    def crash(name):
        steps.append(name)
        if name == where and steps.count(name) == 2:
            raise RuntimeError("crash")

    run = lambda: ingest.start_ingest(source, parts, str(tmp_path / "c"), seen_within=seen_within, on_step=crash)
    with pytest.raises(Exception, match="crash"):
        run().awaitTermination()
    if where == "contracts":  # stopped before its window counts as done
        assert len(ledger_of(spark, parts)) == 1
    run().awaitTermination()
    assert numbers(spark, parts) == numbers(spark, whole) and ledger_of(spark, parts) == ledger_of(spark, whole)


def test_seen_contracts_share_few_states(spark, tmp_path, monkeypatch):
    """The state grows in groups, not in entries of one contract each, and the tables are worked on with adaptive plans."""
    monkeypatch.setattr(ingest, "SEEN_GROUPS", 4)
    adaptive, real = [], ingest.append_new

    def spy(rows, *how):
        adaptive.append(rows.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return real(rows, *how)

    monkeypatch.setattr(ingest, "append_new", spy)
    rows, store = many_visits(24), ingest.Store(str(tmp_path / "s"))
    page_files(spark, str(tmp_path / "in"), rows, per_file=8)
    source = ingest.page_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], PAGES).schema, files_per_batch=1)
    query = ingest.start_ingest(source, store, str(tmp_path / "c"), seen_within="1 day")
    query.awaitTermination()
    assert len(numbers(spark, store)) == 25 and adaptive == ["true"] * 3
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(states) == 3 and 0 < max(states) <= 4


def test_csv_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """A file with line ends in cells is read by one task, so more rows make more files."""
    from contractlens.plans import queries

    assert tables.csv_files(0) == tables.csv_files(1_600_000) == 8 and tables.csv_files(200_000_001) == 1001
    monkeypatch.setattr(tables, "CSV_FILE_ROWS", 4)
    day = dt.datetime(1996, 1, 2)
    at = lambda name: str(tmp_path / f"{name}.parquet")
    spark.range(40).selectExpr(
        "id l_orderkey", "1L l_partkey", "1L l_suppkey", "1 l_linenumber", "10d l_quantity", "100d l_extendedprice", "'N' l_returnflag", "'O' l_linestatus",
        "timestamp'1996-01-03' l_shipdate").write.parquet(at("lineitem"))
    spark.createDataFrame([(1, "bolt", "B", 5)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(at("part"))
    spark.range(40).selectExpr("id o_orderkey", "1L o_custkey", "'1-URGENT' o_orderpriority").withColumn("o_orderdate", F.lit(day)).write.parquet(at("orders"))
    spark.createDataFrame([(1, "c", 1, "BUILDING")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(at("customer"))
    spark.createDataFrame([(1, "X")], "n_nationkey int, n_name string").write.parquet(at("nation"))
    path = queries._as_csv(spark, str(tmp_path))
    files = list(pathlib.Path(path.removeprefix("file:")).glob("*.csv"))
    assert len(files) == 10 and len(tables.read_csv_text(spark, path).select("contract_number").collect()) == 40


@pytest.mark.parametrize("rows, days", [(40, 4), (40, 1), (0, 1)])
def test_stream_parts_of_many_files(spark, tmp_path, monkeypatch, rows, days):
    """A part is written by several tasks, and a batch of so many files is one part, also where parts are short or empty."""
    from contractlens.plans import catalogue as cat

    monkeypatch.setattr(cat, "STREAM_FILE_ROWS", 4)
    df = spark.range(rows).select("id", (F.lit(DAY).cast("timestamp") + F.make_dt_interval((F.col("id") % days).cast("int"))).alias("t"))
    if not rows:
        df = df.withColumn("t", F.lit(DAY).cast("timestamp"))
        df = df.unionByName(spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id long, t timestamp"))
    path = str(tmp_path / "in")
    files = cat.as_stream_files(df, "t", path, 4)
    assert files == (3 if rows else 1)
    assert len([f for f in (tmp_path / "in").iterdir() if f.name.startswith("part-")]) == 4 * files
    batches = []
    source = ingest.page_stream(spark, path, df.schema, files_per_batch=files)
    note = lambda part, _: batches.append(sorted({r.t.day for r in part.collect()}))
    source.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 4 and [d for b in batches for d in b] == list(range(1, days + 1))


def test_spread_counts_the_rows_of_each_partition(spark, tmp_path):
    """One row group in a file cut into many splits: all rows would be in one task."""
    from pyspark.sql import functions as F

    from contractlens.operators.scale import spread

    path = str(tmp_path / "one")
    spark.range(100_000).withColumn("x", F.rand(1)).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(path)
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 8
        sizes = [r["count"] for r in spread(df, 8).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 100_000 and len(sizes) == 8 and max(sizes) < 20_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_line_items_meet_parts_and_orders_only(spark, sf):
    """Customers and nations are joined to the orders, not to the many more line items."""
    from contractlens.plans import catalogue as cat

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return (plan.nodeName() == "Join" and "l_extendedprice" in plan.toString()) + sum(map(joins, below))

    assert joins(cat.contracts(spark, sf)._jdf.queryExecution().optimizedPlan()) == 2


def test_large_texts_are_written_where_their_rows_are(spark, sf, tmp_path, monkeypatch):
    """Moved once more they would take nearly as much disk as the text; each task cuts its own files."""
    from contractlens.plans import catalogue, queries

    lines = catalogue.line_items(spark, sf).count()
    small = sorted(map(tuple, queries.csv_scan(spark, sf).collect()), key=repr)
    monkeypatch.setattr(tables, "CSV_MOVED_ROWS", 100)
    monkeypatch.setattr(tables, "CSV_FILE_ROWS", 500)
    written, write = [], tables.write_csv
    monkeypatch.setattr(tables, "write_csv", lambda df, *how: (written.append(df), write(df, *how)))
    path = queries._as_csv(spark, sf)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    files = [r.file for r in tables.read_csv_text(spark, path).select("contract_number", F.input_file_name().alias("file")).collect()]
    assert len(files) == lines and max(files.count(f) for f in set(files)) <= 500
    assert sorted(map(tuple, queries.csv_scan(spark, sf).collect()), key=repr) == small


def test_text_of_a_run_goes_once_it_is_read(spark, sf, tmp_path, monkeypatch):
    from contractlens.plans import queries

    made, as_csv = [], queries._as_csv
    monkeypatch.setattr(queries, "_as_csv", lambda *a: made.append(as_csv(*a)) or made[0])
    run, out = queries._csv_run(spark, sf)
    assert not pathlib.Path(made[0].removeprefix("file:")).exists()
    assert run.metrics.first().contracts > 0 and run.rejects.count() == 0 and run.hhi.count() > 0
    steps = []
    from contractlens.plans.runs import run_pipeline

    path = as_csv(spark, sf)
    run_pipeline(spark, path, str(tmp_path / "out"), order="contract_number", on_step=steps.append)
    assert steps.index("contracts") < steps.index("csv_problems") < steps.index("csv_rejects") < steps.index("scored") < steps.index("run_report")
    assert pathlib.Path(path.removeprefix("file:")).exists()
