"""Every operator as a query over the given tables."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.functions import scalars as S
from contractlens.operators import cleaning, concentration, coverage, dedup, overpricing
from contractlens.operators import reports, scoring, sketches, splitting, timing, twins
from contractlens.operators.scale import Steps, attach, durable, fresh_path, spread
from contractlens.plans import catalogue as cat
from contractlens.plans.runs import run_analysis, run_pipeline, save_anomalies, score_contracts
from contractlens.sources import pages as P
from contractlens.sources import tables
from contractlens.sources.growing import Files
from contractlens.streaming import ingest
from contractlens.streaming import timing as stream_timing_of

EVENTS = dict(product="event_type", price="value", buyer="user_id", time="ts", value="value", order="event_id")
WIDE = dict(window_minutes=240, value_tolerance=0.1)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- detectors ---------------------------------------------------------------


def hhi_by_group(spark, sf):
    return _rounded(concentration.compute_hhi(cat.contracts(spark, sf), "ministry"), 6, "hhi")


def hhi_by_product(spark, sf):
    return _rounded(concentration.compute_hhi(cat.contracts(spark, sf), "product_name"), 6, "hhi")


def hhi_top(spark, sf):
    return hhi_by_group(spark, sf).orderBy(F.desc("hhi"), "ministry").limit(5)


def hhi_missing_rate(spark, sf):
    return _rounded(concentration.missing_rate(cat.contracts(spark, sf)), 6, "missing_rate")


def price_fences(spark, sf):
    fences = overpricing.price_fences(cat.contracts(spark, sf))
    return _rounded(fences, 6, "q1", "q3", "upper_fence")


def overpricing_flags(spark, sf):
    flagged = overpricing.flag_overpricing(cat.contracts(spark, sf), iqr_multiplier=1.0)
    return flagged.select("contract_number", "product_name", "overpriced_flag")


def overpricing_default(spark, sf):
    flagged = overpricing.flag_overpricing(cat.contracts(spark, sf))
    return flagged.select("contract_number", "overpriced_flag")


def _timing(spark, sf, **how):
    events = cat.table(spark, sf, "events")
    return timing.flag_timing_clusters(events, "user_id", "ts", "value", "event_id", **how)


def timing_clusters(spark, sf):
    return _timing(spark, sf).select("event_id", "user_id", "timing_cluster_flag")


def timing_clusters_wide(spark, sf):
    return _timing(spark, sf, **WIDE).select("event_id", "user_id", "timing_cluster_flag")


def timing_clusters_contracts(spark, sf):
    """All dates fall on midnight here, so ties and busy days are the rule."""
    flagged = timing.flag_timing_clusters(
        cat.contracts(spark, sf), buyer="ministry", order="contract_number"
    )
    return flagged.select("contract_number", "ministry", "timing_cluster_flag")


SPLIT = dict(limit=50_000, near=0.8, window_minutes=7 * 24 * 60, least=3)


def quantity_split(spark, sf):
    """Contracts of one ministry and product that stay just below a limit within a week."""
    flagged = splitting.flag_quantity_splitting(cat.contracts(spark, sf), buyer="ministry", **SPLIT)
    return flagged.select("contract_number", "split_count", F.round("split_total", 2).alias("split_total"), "split_flag")


def timing_range_pairs(spark, sf):
    """Similar events of one user in a time range, whatever lies between them."""
    events = cat.table(spark, sf, "events")
    return twins.range_matches(events, "user_id", "ts", "value", "event_id", **WIDE)


def stream_timing(spark, sf):
    """The timing clusters of events that come as a stream, in six parts by time."""
    events = cat.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = fresh_path(spark, "timing")
    files = cat.as_stream_files(events, "ts", f"{root}/in", parts=6)
    # a row far in the future moves the watermark past all events
    late = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"),
    )
    late.write.mode("append").parquet(f"{root}/in")
    stream = ingest.page_stream(spark, f"{root}/in", events.schema, files_per_batch=files)
    flagged = stream_timing_of.stream_timing_clusters(stream, "user_id", "ts", "value", "event_id", delay="1 day")
    flagged.writeStream.format("parquet").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").where("event_id >= 0").select("event_id", "user_id", "timing_cluster_flag")


def missing_brand_by_type(spark, sf):
    return _rounded(concentration.missing_by(cat.contracts(spark, sf)), 6, "missing_rate")


def _scored(spark, sf):
    events = cat.table(spark, sf, "events")
    return score_contracts(events, **EVENTS, iqr_multiplier=0.6, **WIDE)


def anomaly_score(spark, sf):
    return _scored(spark, sf).select(
        "event_id", "overpriced_flag", "timing_cluster_flag", "anomaly_score"
    )


def flagged_review(spark, sf):
    return scoring.review_list(_scored(spark, sf), "event_id").select(
        "event_id", "user_id", "event_type", "value", "anomaly_score"
    )


def run_metrics(spark, sf):
    return scoring.run_metrics(_scored(spark, sf), "value")


# -- cleaning ----------------------------------------------------------------


def clean_contracts(spark, sf):
    return cleaning.contracts_clean(cat.raw_contracts(spark, sf)).select(
        "contract_number", "org_type", "contract_date", "year", "month", "hour",
        "contract_type", "total_value", "quantity", F.round("unit_price", 6).alias("unit_price"),
        "product_name", "model",
    )


def classified_contracts(spark, sf):
    return cleaning.classify_and_clean(cat.raw_contracts(spark, sf), strip_commas=True).select(
        "contract_number", "contract_type", "total_value_clean", "quantity_clean",
    )


def analysis_rows(spark, sf):
    clean = cleaning.contracts_clean(cat.raw_contracts(spark, sf))
    return cleaning.contracts_analysis(clean).select("contract_number", "product_name", "total_value")


def service_check(spark, sf):
    classified = cleaning.classify_and_clean(cat.raw_contracts(spark, sf))
    return _rounded(reports.service_check(classified), 4, "avg_quantity", "avg_total")


def held_total_check(spark, sf):
    classified = cleaning.classify_and_clean(cat.raw_contracts(spark, sf))
    return _rounded(reports.held_total_check(classified), 4, "avg_total", "avg_unit_price")


def date_parts(spark, sf):
    text = cat.date_text(F.col("ts"), F.date_format("ts", "HH:mm"))
    events = cat.table(spark, sf, "events").select("event_id", text.alias("contract_date"))
    return cleaning.with_calendar_parts(events)


def date_formats(spark, sf):
    """Days written in six ways, read back."""
    kind, day = F.col("event_id") % 6, F.col("ts")
    text = (
        F.when(kind == 0, F.date_format(day, "dd-MM-yyyy"))
        .when(kind == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(day, "MM/dd/yyyy"))
        .when(kind == 4, F.date_format(day, "dd MMM yyyy"))
        .otherwise(F.date_format(day, "dd MMMM yyyy"))
    )
    events = cat.table(spark, sf, "events").select("event_id", text.alias("written"))
    return events.withColumn("day", S.parse_when(F.col("written")).cast("date"))


def org_type_fix(spark, sf):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", " ORGANIZATION ").otherwise(F.col("c_mktsegment"))
    return cat.table(spark, sf, "customer").select(
        "c_custkey", cleaning.fix_org_type(raw).alias("org_type")
    )


def junk_product_filter(spark, sf):
    parts = cat.table(spark, sf, "part").select("p_partkey", cat.junk_name().alias("product_name"))
    return parts.filter(~S.is_junk_product(F.col("product_name")))


def price_clean(spark, sf):
    money, line = cat.money_text("l_extendedprice"), F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(F.lit("₹ 1,"), money))
        .when(line == 2, F.concat(F.lit("Rs. "), money))
        .when(line == 3, F.concat(money, F.lit("e5")))
        .when(line == 4, F.concat(F.lit("$\u00a0"), money))
        .when(line == 5, "-")
        .when(line == 6, F.concat(F.lit("INR "), money))
        .otherwise(money)
    )
    lines = spread(cat.line_items(spark, sf)).select("l_orderkey", "l_partkey", "l_suppkey", line, text.alias("written"))
    return lines.withColumns(
        {"price": S.clean_price(F.col("written")), "strict_price": S.clean_price(F.col("written"), strict=True)}
    )


def numeric_prefix(spark, sf):
    line, count = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(line == 1, F.concat(count, F.lit("abc")))
        .when(line == 2, F.concat(count, F.lit(",200")))
        .when(line == 3, F.concat(count, F.lit("e3x")))
        .when(line == 4, F.concat(F.lit(" "), count))
        .when(line == 5, "")
        .when(line == 6, F.concat(F.lit("."), count))
        .otherwise(F.concat(count, F.lit("d")))
    )
    lines = cat.line_items(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", line, text.alias("written"))
    return lines.withColumn("number", S.numeric_prefix(F.col("written")))


def date_preview(spark, sf):
    return cleaning.date_preview(cat.raw_contracts(spark, sf), "contract_number")


def unit_price_preview(spark, sf):
    return cleaning.unit_price_preview(cat.raw_contracts(spark, sf), "contract_number")


# -- reports -----------------------------------------------------------------


def type_coverage(spark, sf):
    return reports.type_coverage(cat.contracts(spark, sf))


def product_benchmark(spark, sf):
    report = reports.product_benchmark(cat.contracts(spark, sf))
    return _rounded(report, 6, "min_price", "max_price", "avg_price")


def average_outliers(spark, sf):
    rows = reports.average_outliers(cat.contracts(spark, sf), products=None)
    return _rounded(rows, 6, "unit_price")


def average_outliers_named(spark, sf):
    rows = reports.average_outliers(
        cat.contracts(spark, sf), ["hot bolt", "blue ring", "large ring"], factor=3
    )
    return rows.select("contract_number", "product_name", "total_value")


ANOMALY = [
    "contract_number", "ministry", "department", "product_name", "quantity", "total_value",
    "year", "month", "buying_mode", "contract_count", "price_ratio", "pct_above_median",
]


def median_outliers(spark, sf):
    rows = reports.by_ratio(reports.median_outliers(cat.contracts(spark, sf)))
    return _rounded(rows, 6, "median_price", "avg_price").select(*ANOMALY, "median_price", "avg_price")


def median_outliers_goods(spark, sf):
    rows = reports.median_outliers(cat.contracts(spark, sf), factor=3, goods_only=True)
    return rows.select(*ANOMALY)


def anomaly_impact(spark, sf):
    impact = reports.anomaly_impact(reports.median_outliers(cat.contracts(spark, sf)))
    return _rounded(impact, 2, "estimated_overcharge")


def analysis_chain(spark, sf):
    """Raw text to anomaly table, through the written tables."""
    done = run_analysis(cat.raw_contracts(spark, sf), fresh_path(spark, "analysis"))
    return done.anomalies.select(
        "contract_number", "product_name", "total_value", "contract_count", "price_ratio"
    )


def catalog_anomalies(spark, sf):
    """The anomaly table in the catalog, read for one year's first half."""
    with Steps(spark):
        # medians and rows both read the contracts: their joins move all line items
        rows = reports.median_outliers(durable(cat.contracts(spark, sf).drop("contract_status", "brand")))
        table = save_anomalies(rows, "price_anomalies_by_month", fresh_path(spark, "anomalies"))
    return table.where("year = 1996 AND month <= 6").select(
        "contract_number", "product_name", "total_value", "year", "month", "price_ratio"
    )


PROBS = [0.25, 0.5, 0.75]


def sketched_prices(spark, sf):
    """Quartiles and distinct buyers per product from sketches of seven batches, held against the exact ranks and counts."""
    contracts = cat.contracts(spark, sf).select("product_name", "unit_price", "org_name", F.dayofweek("contract_date").alias("batch"))
    path = fresh_path(spark, "sketches")
    sketches.sketch_groups(contracts, ["product_name", "batch"], "unit_price", "org_name").write.parquet(path)
    found = sketches.sketched(sketches.merge_sketches(spark.read.parquet(path), ["product_name"]), ["product_name"], PROBS)
    below = [F.count_if(F.col("unit_price") <= F.col(f"q{i}")).alias(f"up_to_{i}") for i in range(3)]
    equal = [F.count_if(F.col("unit_price") == F.col(f"q{i}")).alias(f"at_{i}") for i in range(3)]
    seen = attach(contracts, found, ["product_name"]).groupBy("product_name", "rows", "distinct").agg(
        *below, *equal, F.count_distinct("org_name").alias("buyers")
    )
    # a value that stands for several ranks is right if one of them is
    near = [
        (F.col(f"up_to_{i}") >= (p - 0.01) * F.col("rows") - 1) & (F.col(f"up_to_{i}") - F.col(f"at_{i}") <= (p + 0.01) * F.col("rows") + 1)
        for i, p in enumerate(PROBS)
    ]
    few = F.abs(F.col("distinct") - F.col("buyers")) <= 1 + 0.05 * F.col("buyers")
    return seen.select("product_name", "rows", "buyers", (near[0] & near[1] & near[2]).alias("ranks_within_1_percent"), few.alias("buyers_within_5_percent"))


def top_ministries(spark, sf):
    return reports.top_ministries(cat.contracts(spark, sf))


def value_range(spark, sf):
    return _rounded(reports.value_range(cat.contracts(spark, sf)), 4, "avg_value")


def row_count(spark, sf):
    return reports.row_count(cat.contracts(spark, sf))


# -- dedup and ingest --------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]


def dedup_first(spark, sf):
    lines = cat.table(spark, sf, "lineitem").select(*LINE)
    return dedup.first_per_key(lines, ["l_orderkey"], LINE_ORDER)


def new_contracts(spark, sf):
    lines = cat.table(spark, sf, "lineitem")
    seen = lines.filter(F.col("l_linestatus") == "F").select("l_orderkey")
    new = dedup.not_seen(lines.filter(F.col("l_linestatus") == "O"), seen, ["l_orderkey"])
    return dedup.first_per_key(new.select(*LINE), ["l_orderkey"], LINE_ORDER)


def append_twice(spark, sf):
    """Two batches into one table, the second one written twice."""
    path, lines = fresh_path(spark, "append"), cat.table(spark, sf, "lineitem")
    keep = [*LINE, "l_linestatus"]
    for status, batch in (("F", "1"), ("O", "2"), ("O", "2")):
        rows = lines.filter(F.col("l_linestatus") == status).select(*keep)
        tables.append_new(rows, path, batch, ["l_orderkey"], LINE_ORDER)
    return spark.read.parquet(path).select(*keep)


def _windows(spark, sf, step):
    ends = cat.table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return coverage.date_windows(ends, "a", "b", step)


def date_windows(spark, sf):
    return coverage.as_text(_windows(spark, sf, 7))


def _run(spark, sf, run="1"):
    """The ledger rows of a visit to all pages, or of the empty ones again."""
    visited = cat.order_outcomes(spark, sf)
    if run == "2":
        visited = visited.filter(F.col("outcome") != "results")
    notes = P.window_notes(P.sightings(visited))
    late = F.make_dt_interval(F.lit(int(run)))
    return notes.withColumn("completed_at", F.col("from_date").cast("timestamp") + late)


def window_note(spark, sf):
    return _run(spark, sf).select("from_date", "to_date", "contracts", "rows", "note")


def _done(spark, sf):
    """The ledger of the first half of the days."""
    return tables.ledger_latest(_run(spark, sf)).filter(F.col("from_date") < "1998-01-01")


def pending_windows(spark, sf):
    return coverage.pending_windows(_windows(spark, sf, 1), _done(spark, sf))


def recheck_windows(spark, sf):
    return coverage.pending_windows(_windows(spark, sf, 1), tables.ledger_latest(_run(spark, sf)), recheck=True)


def next_windows(spark, sf):
    return coverage.pending_windows(_windows(spark, sf, 1), _done(spark, sf), limit=10)


def ledger_migrated(spark, sf):
    """A ledger written before there were notes and rows, read in the present layout."""
    path = fresh_path(spark, "ledger")
    tables.write_batch(_run(spark, sf).drop("note", "rows"), path, "0")
    return coverage.coverage(_windows(spark, sf, 1), tables.read_ledger(spark, path))


def ledger_latest(spark, sf):
    both = _run(spark, sf).unionByName(_run(spark, sf, "2"))
    return tables.ledger_latest(both).select("from_date", "to_date", "contracts", "rows", "note")


def ledger_summary(spark, sf):
    return coverage.ledger_summary(tables.ledger_latest(_run(spark, sf)))


def review_windows(spark, sf):
    return coverage.review_windows(tables.ledger_latest(_run(spark, sf))).select("from_date", "to_date")


def window_coverage(spark, sf):
    return coverage.coverage(_windows(spark, sf, 1), tables.ledger_latest(_run(spark, sf)))


def ingest_rate(spark, sf):
    ledger = tables.ledger_latest(_run(spark, sf))
    return _rounded(
        coverage.ingest_rate(ledger, _windows(spark, sf, 1)), 6, "rows_per_minute", "elapsed_minutes"
    )


# -- pages -------------------------------------------------------------------

CONTRACT = [
    "contract_number", "org_type", "ministry", "department", "org_name", "office_zone",
    "buying_mode", "contract_date", "total_value", "contract_status", "product_name",
    "brand", "model", "quantity", "unit_price",
]


def extract_contracts(spark, sf):
    return P.extract_contracts(cat.contract_pages(spark, sf)).select(*CONTRACT)


def extract_lines(spark, sf):
    return P.extract_contracts(cat.contract_pages(spark, sf), grain="line").select("line_no", *CONTRACT)


def extract_rejects(spark, sf):
    lines = P.contract_lines(cat.contract_pages(spark, sf))
    return P.rejected_lines(lines).select("page_id", "block_no", "line_no", "reason")


def page_outcome(spark, sf):
    """The given pages as they are, and each with a notice added."""
    notice = (
        F.when(F.col("page_id") % 3 == 0, "<p>No&#160;<b>Record&#40;s&#41;</b>\n Found</p>")
        .when(F.col("page_id") % 3 == 1, "<p>Invalid CAPTCHA</p><script>no data found</script>")
        .otherwise('<div class="border block"></div><p>no data found</p>')
    )
    pages = P.with_outcome(spread(cat.table(spark, sf, "pages")))
    noticed = pages.withColumn("html", F.concat("html", notice))
    return P.with_outcome(noticed, name="outcome_with_notice").drop("html", "url")


def stream_ingest(spark, sf):
    """Rendered pages as a stream into the contract table, run to the end."""
    schema = cat.table(spark, sf, "orders").schema
    # a pattern, as a stream reads folders and patterns but not one file
    orders = ingest.page_stream(spark, f"{sf}/{{orders}}.parquet", schema)
    pages = cat.render_pages(cat.order_details(orders, spark, sf))
    root = fresh_path(spark, "stream")
    store = ingest.Store(root)
    tasks = spark.sparkContext.defaultParallelism
    ingest.start_ingest(pages, store, f"{root}/_progress", tasks=tasks).awaitTermination()
    return spark.read.parquet(store.contracts).select(*CONTRACT)


def _page_run(spark, sf, name, parts, **how):
    """Orders as page files in ``parts`` parts by day, ingested one part a batch; ``how`` goes to ``start_ingest``."""
    root = fresh_path(spark, name)
    orders = cat.table(spark, sf, "orders")
    files = cat.as_stream_files(orders, "o_orderdate", f"{root}/in", parts)
    stream = ingest.page_stream(spark, f"{root}/in", orders.schema, files_per_batch=files)
    pages = cat.render_pages(cat.order_details(stream, spark, sf))
    store = ingest.Store(root)
    start = lambda **more: ingest.start_ingest(pages, store, f"{root}/_progress", tasks=spark.sparkContext.defaultParallelism, **how, **more)
    return start, store


def _notes(spark, store):
    return tables.ledger_latest(tables.read_ledger(spark, store.ledger)).select("from_date", "to_date", "contracts", "rows", "note")


def stream_ledger(spark, sf):
    """The ledger of a timed run over five batches, with contracts already met kept in its state."""
    start, store = _page_run(spark, sf, "timed", 5, every="0 seconds", seen_within="1 day", compact_every=3)
    ingest.drain(start())
    return _notes(spark, store)


def stream_resume(spark, sf):
    """Ledger and contracts of a run that stops between the two tables of its second batch, and is started again."""
    start, store = _page_run(spark, sf, "resume", 3)
    met = []

    def stop_once(name):
        met.append(name)
        if met.count("contracts") == 2 and name == "contracts":
            raise RuntimeError("stopped on purpose")

    try:
        start(on_step=stop_once).awaitTermination()
    except StreamingQueryException as stopped:
        if "stopped on purpose" not in str(stopped):
            raise
    start().awaitTermination()
    stored = spark.read.parquet(store.contracts).groupBy(F.to_date(F.split_part("contract_date", F.lit(" "), F.lit(1)), "d/M/yyyy").alias("from_date")).agg(F.count("*").alias("stored"))
    return _notes(spark, store).join(stored, "from_date", "left").fillna(0, ["stored"])


def stream_rate(spark, sf):
    """Batches of a run, the rows they say they added, the rows stored, and batches where the two differ."""
    start, store = _page_run(spark, sf, "rate", 4)
    start().awaitTermination()
    stored = spark.read.parquet(store.contracts).groupBy("batch").agg(F.count("*").alias("stored"))
    rates = ingest.batch_rates(spark, store).join(stored, "batch", "left")
    same = F.col("added") == F.coalesce("stored", F.lit(0))
    return rates.agg(
        F.count("*").alias("batches"), F.sum("pages").alias("pages"), F.sum("lines").alias("lines"),
        F.sum("added").alias("rows_added"), F.sum("stored").alias("rows_stored"), F.count_if(~same).alias("batches_that_differ"),
    )


def stream_dedup(spark, sf):
    """Events as a stream: users and types seen, each once."""
    schema = cat.table(spark, sf, "events").schema
    events = ingest.page_stream(spark, f"{sf}/{{events}}.parquet", schema).select(
        F.concat_ws(":", "user_id", "event_type").alias("seen"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    root = fresh_path(spark, "dedup")
    (
        ingest.drop_seen(events, "seen", "ts", delay="60 days")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start(f"{root}/out")
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/out").select("seen")


# -- files and whole runs ----------------------------------------------------


def _as_csv(spark, sf) -> str:
    """Contracts as text files: gaps and dates written in several ways, line
    ends in cells, counts that are no numbers."""
    path = fresh_path(spark, "csv")
    gap = F.when(F.col("quantity") < 10, "NA").when(F.col("quantity") < 20, "None").otherwise("")
    day = F.when(F.col("quantity") % 2 == 0, F.date_format("contract_date", "d/M/yyyy HH:mm")).otherwise(
        F.date_format("contract_date", "yyyy-MM-dd HH:mm:ss")
    )
    rows = cat.contracts(spark, sf).withColumns(
        {
            "brand": F.coalesce("brand", gap),
            "contract_date": day,
            "unit_price": F.round("unit_price", 4),
            "contract_status": F.concat("contract_status", F.lit('\n"held", later')),
            "quantity": F.when(F.col("quantity") == 50, "fifty").otherwise(F.col("quantity").cast("string")),
        }
    )
    lines = cat.line_items(spark, sf).count()
    if lines <= tables.CSV_MOVED_ROWS:
        rows = rows.repartition(tables.csv_files(lines))
    tables.write_csv(rows, path, tables.CSV_FILE_ROWS if lines > tables.CSV_MOVED_ROWS else None)
    return path


def csv_scan(spark, sf):
    return tables.read_contracts_csv(spark, _as_csv(spark, sf)).select(
        "contract_number", "ministry", "brand", "product_name", "total_value", "contract_status",
        F.col("contract_date").cast("date").alias("contract_date"),
    )


def csv_problems(spark, sf):
    return tables.csv_problems(tables.read_csv_text(spark, _as_csv(spark, sf)))


def _csv_run(spark, sf):
    path, out = _as_csv(spark, sf), fresh_path(spark, "run")

    def drop_text(name):
        if name == "csv_rejects":  # the last table that reads the text
            Files(spark, path).delete("")

    return run_pipeline(spark, path, out, order="contract_number", on_step=drop_text), out


def csv_to_hhi(spark, sf):
    return _rounded(_csv_run(spark, sf)[0].hhi, 6, "hhi")


def csv_to_metrics(spark, sf):
    return _csv_run(spark, sf)[0].metrics


def hhi_file(spark, sf):
    """The concentration file, read back."""
    text = tables.read_csv_text(spark, f"{_csv_run(spark, sf)[1]}/hhi_by_ministry")
    return text.select("ministry", F.round(F.col("hhi").cast("double"), 6).alias("hhi"))


def flagged_file(spark, sf):
    """The file of flagged contracts, read back."""
    text = tables.read_csv_text(spark, f"{_csv_run(spark, sf)[1]}/flagged_anomalies")
    return text.select("contract_number", "contract_status", F.col("anomaly_score").cast("int").alias("anomaly_score"))


def run_report(spark, sf):
    return _csv_run(spark, sf)[0].report


ALL = [
    hhi_by_group, hhi_by_product, hhi_top, hhi_missing_rate,
    price_fences, overpricing_flags, overpricing_default,
    timing_clusters, timing_clusters_wide, timing_clusters_contracts,
    quantity_split, timing_range_pairs, stream_timing, missing_brand_by_type,
    anomaly_score, flagged_review, run_metrics,
    clean_contracts, classified_contracts, analysis_rows, service_check, held_total_check,
    date_parts, date_formats, org_type_fix, junk_product_filter, price_clean, numeric_prefix,
    date_preview, unit_price_preview,
    type_coverage, product_benchmark, average_outliers, average_outliers_named,
    median_outliers, median_outliers_goods, anomaly_impact, analysis_chain,
    catalog_anomalies, sketched_prices, top_ministries, value_range, row_count,
    dedup_first, new_contracts, append_twice,
    date_windows, window_note, pending_windows, recheck_windows, next_windows, ledger_latest,
    ledger_migrated, ledger_summary,
    review_windows, window_coverage, ingest_rate,
    extract_contracts, extract_lines, extract_rejects, page_outcome,
    stream_ingest, stream_ledger, stream_resume, stream_rate, stream_dedup,
    csv_scan, csv_problems, csv_to_hhi, csv_to_metrics, hhi_file, flagged_file, run_report,
]


def queries() -> dict:
    return {q.__name__: q for q in ALL}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked review list of all contracts."""
    scored = score_contracts(
        cat.contracts(spark, sf), order="contract_number", iqr_multiplier=1.0
    )
    return scoring.review_list(scored, "contract_number").select(
        "contract_number", "ministry", "org_name", "product_name", "unit_price",
        "total_value", "contract_date", "overpriced_flag", "timing_cluster_flag", "anomaly_score",
    )
