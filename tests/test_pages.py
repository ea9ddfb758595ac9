import datetime as dt

import pytest
from pyspark.sql import functions as F

from contractlens import values
from contractlens.operators.cleaning import contracts_analysis, contracts_clean
from contractlens.sources import pages as P
from contractlens.sources.blocks import parse_page

LABELS = "".join(
    f"<p><strong>{name}:</strong> {value}</p>"
    for name, value in [
        ("Ministry", "a"), ("Department", "d &amp; e"), ("Organization Name", "o"),
        ("Office Zone", ""), ("Buyer Designation", ": head"), ("Buying Mode", "bid"),
        ("Contract Date", "1/4/2026 09:30"),
    ]
)


def block(number="GEMC-1", rows=(("a", "b", "c", "2", "₹1,000.00"),), total="<p><strong>Total:</strong> ₹ 2,000</p>", status="Status: X"):
    cells = "".join("<tr>" + "".join(f"<td> {c} </td>" for c in row) + "</tr>" for row in rows)
    table = f'<table class="big table-striped"><tr><th>h</th></tr>{cells}</table>' if rows else ""
    return (
        f'<div class="border block"><div class="block_header">No {number} {status}</div>'
        f'<span class="ajxtag_buyer_dept_org"> State </span>{LABELS}{total}{table}</div>'
    )


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_one_block(spark):
    row = P.extract_contracts(pages(spark, block())).first()
    assert row.contract_number == "GEMC-1" and row.contract_status == "X"
    assert (row.ministry, row.department, row.org_name) == ("a", "d & e", "o")
    assert (row.office_zone, row.buyer_designation, row.buying_mode) == ("", "head", "bid")
    assert row.contract_date == "1/4/2026 09:30" and row.org_type == "State"
    assert (row.product_name, row.brand, row.model, row.quantity) == ("a", "b", "c", "2")
    assert (row.unit_price, row.total_value) == (1000.0, 2000.0)


def test_no_table_gives_one_blank_line(spark):
    row = P.extract_contracts(pages(spark, block(rows=()))).first()
    assert (row.product_name, row.quantity, row.unit_price) == ("", "", None)


def test_grain(spark):
    html = block(rows=(("a", "b", "c", "2", "5"), ("x", "", "")))
    both = P.extract_contracts(pages(spark, html), grain="line").orderBy("line_no").collect()
    assert [(r.line_no, r.product_name, r.quantity, r.unit_price) for r in both] == [(0, "a", "2", 5.0), (1, "x", "", None)]
    assert [r.product_name for r in P.extract_contracts(pages(spark, html)).collect()] == ["a"]


def test_first_page_wins_and_seen_are_skipped(spark):
    html = [block(rows=(("late",),)), block(rows=(("early",),)), block("GEM/2024/B/7", rows=(("z",),))]
    rows = spark.createDataFrame([(9, html[0]), (2, html[1]), (3, html[2] + html[2])], "page_id long, html string")
    got = P.extract_contracts(rows)
    assert {(r.contract_number, r.product_name) for r in got.collect()} == {("GEMC-1", "early"), ("GEM/2024/B/7", "z")}
    seen = spark.createDataFrame([("GEMC-1",)], "contract_number string")
    assert [r.contract_number for r in P.extract_contracts(rows, seen=seen).collect()] == ["GEM/2024/B/7"]


def test_no_number_is_rejected_or_kept_once(spark):
    rows = pages(spark, block("none"), block("none") + block())
    assert P.extract_contracts(rows).count() == 1
    reasons = [r.reason for r in P.rejected_lines(P.contract_lines(rows)).collect()]
    assert reasons == ["no contract number"] * 2
    kept = P.extract_contracts(rows, keep_blank=True)
    assert sorted(r.contract_number for r in kept.collect()) == ["", "GEMC-1"]


def test_total_falls_back_to_the_text(spark):
    rows = pages(
        spark,
        block(total="<div>Total : ₹ 3,500.50 only</div>"),
        block("GEMC-2", total="<p><strong>Total:</strong> n/a</p><div>total: 7</div>"),
        block("GEMC-3", total=""),
        block("GEMC-4", total="<p><b>x</b><strong>Sub Total</strong> : 4</p>"),
    )
    got = {r.contract_number: r.total_value for r in P.extract_contracts(rows).collect()}
    assert got == {"GEMC-1": 3500.5, "GEMC-2": 7.0, "GEMC-3": None, "GEMC-4": 4.0}


def test_status_falls_back_to_part_of_the_header(spark):
    rows = pages(spark, block(status="y" * 90), block("GEMC-2", status="Status of the Contract- Paid "))
    got = {r.contract_number: r.contract_status for r in P.extract_contracts(rows).collect()}
    assert got == {"GEMC-1": ("No GEMC-1 " + "y" * 90)[20:80], "GEMC-2": "Paid"}


def test_messy_markup():
    html = """<!-- <div class="border block"> --><script>var t='<div class="border block"></div>';</script>
    <DIV CLASS='border  block' data-x="a>b"><div class=block_header><p>No <b>GEMC-5</b><br>Status: <i>Y</i>
    </div><table class="table-striped"><tr><td>a<td>b<tr><td>c</table><p><strong>Ministry</strong>: M<p>next</div>"""
    (found,) = parse_page(html)
    assert found["header"] == "No GEMC-5 Status: Y"
    assert found["cells"] == [["a", "b"], ["c"]]
    assert found["labels"] == [{"label": "ministry", "bold": "Ministry", "line": "Ministry: M"}]


@pytest.mark.parametrize(
    "html",
    [None, "", "border block", "<div class='border block'>no header</div>", "<div class='border block",
     '<div class="block border"><div class="block_header">GEMC-1</div></div>', "</div></p><td>border"],
)
def test_no_block_no_crash(html):
    assert parse_page(html) == []


def test_pages_to_clean_contracts(spark):
    service = block("GEMC-9", rows=(("Cleaning", "", "4", "₹ 8,000", "1"),))
    goods = block("GEMC-8", rows=(("Pen", "x", "m", "10", "2,000"),), total="")
    raw = P.as_contracts(P.extract_contracts(pages(spark, service + goods)))
    assert raw.schema.names == values.CONTRACTS.names
    rows = {r.contract_number: r for r in contracts_analysis(contracts_clean(raw)).collect()}
    got = {k: (r.contract_type, r.total_value, r.quantity, r.unit_price, r.year) for k, r in rows.items()}
    assert got == {
        "GEMC-9": ("service", 8000.0, 4.0, 2000.0, 2026),
        "GEMC-8": ("goods", 2000.0, 10.0, 200.0, 2026),
    }
    assert all(r.scraped_at is not None for r in rows.values())


def test_many_rows_and_deep_pages():
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(3000))
    head = '<div class="border block"><div class="block_header">GEMC-1</div>'
    (found,) = parse_page("<div>" * 3000 + head + f'<table class="table-striped">{rows}</table></div>')
    assert len(found["cells"]) == 3000


def test_given_pages_have_no_blocks(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    assert P.blocks_of(given).count() == 0
    outer = P.blocks_of(given, outer=True)
    assert outer.filter("block_no is null").count() == given.count()


def test_outcome(spark):
    rows = pages(
        spark,
        block() + "no records found",
        "<p>No <b>Records</b>&nbsp;Found</p>",
        "<div>Invalid\n Captcha</div>",
        "<script>no data found</script><p>hello</p>",
        '<section class="my-block wide border">',
        "<p>no data found, wrong captcha",
    )
    got = [r.outcome for r in P.with_outcome(rows).orderBy("page_id").collect()]
    assert got == ["results", "no_results", "captcha_error", "unknown", "results", "no_results"]


def test_window_notes(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (day, "results", 0, "GEMC-1"), (day, "results", 0, "GEMC-1"), (day, "results", 1, ""),
        (day.replace(day=2), "unknown", None, None), (day.replace(day=2), "no_results", None, None),
        (day.replace(day=3), "captcha_error", None, None),
        (day.replace(day=4), "results", 0, ""),
    ]
    visits = spark.createDataFrame(rows, "from_date date, outcome string, block_no int, contract_number string")
    notes = P.window_notes(P.sightings(visits.withColumn("to_date", F.col("from_date")))).orderBy("from_date").collect()
    assert [(r.contracts, r.rows, r.note) for r in notes] == [
        (1, 3, "normal"), (0, 0, "zero_confirmed"), (0, 0, "zero_assumed"), (0, 1, "normal"),
    ]


def test_stray_quote_loses_no_block():
    got = parse_page("<p title=it's>x" + block("GEMC-1") + "<p title=it's>" + block("GEMC-2"))
    assert [b["header"][:9] for b in got] == ["No GEMC-1", "No GEMC-2"]


def test_stray_end_tags_do_not_cut_a_block():
    html = block(rows=(("Pen</div>", "B", "c", "2", "5"),)).replace("</table>", "</table><p><strong>Buying Mode:</strong> late</p>")
    got = parse_page(html + "</span></div></td>" + block("GEMC-2"))
    assert got[0]["cells"] == [["Pen", "B", "c", "2", "5"]] and len(got) == 2
    assert any(x["line"].endswith("late") for x in got[0]["labels"])


@pytest.mark.parametrize("piece", ["<script ", "<script>", "<!-- ", "<p title='", '<a b="', "<div ", "</", "<"])
def test_scan_time_is_linear(piece):
    import time

    begin = time.perf_counter()
    parse_page('<div class="border block">' + piece * (100_000 // len(piece)))
    assert time.perf_counter() - begin < 1


def test_unclosed_script_and_comment_hide_no_block():
    assert len(parse_page("<!-- open <p>" + block())) == 1
    assert len(parse_page("<script>var a;" + block())) == 1
    assert len(parse_page('<script>var a = "<div class=\'border block\'>";</script>' + block())) == 1


def test_no_break_spaces(spark):
    space = "&nbsp;"
    html = block(f"GEM/2024/B/7{space}", status=f"Status{space}of{space}the{space}Contract: Paid", total=f"<div>Total{space}:{space}₹{space}500</div>")
    row = P.extract_contracts(pages(spark, html)).first()
    assert (row.contract_number, row.contract_status, row.total_value) == ("GEM/2024/B/7", "Paid", 500.0)


def test_outcome_decodes_references_and_leaves_the_title_out(spark):
    rows = pages(
        spark, "<p>No&#160;records found</p>", "no record&#40;s&#41; found", "<title>invalid captcha</title><p>x</p>",
        '<section class="block border"></section>no data found', None, "",
    )
    got = [r.outcome for r in P.with_outcome(rows).orderBy("page_id").collect()]
    assert got == ["no_results", "no_results", "unknown", "results", "unknown", "unknown"]


def test_a_tag_met_before_reads_as_the_first_time():
    """Tags are looked up by their text: what stands around them must not change what they say."""
    from contractlens.sources import blocks

    def seen(html):
        texts, elements = blocks._scan(html)
        return texts, [(e.tag, list(e.classes), e.start, e.end) for e in elements]

    pages = [
        '<div class="border block">a<b class=\'x>y\'>c</b></div>', '<div class="a>b" id=c>d</div>', '<a b="x"c="y">z</a>', '<p title=it\'s>q<p class="k">r',
        '<table><tr><td>1<td>2</table>', '<a b="', '<a b="x">1</a><a b="x', "<x<y>z</x<y>", "<br/><BR>a</br>", "<script>a<b</script>c", "<title>",
    ]
    first = []
    for page in pages:
        blocks._KNOWN.clear()
        first.append(seen(page))
    assert [seen(p) for p in pages] == first == [seen(p) for p in pages]
    assert 0 < len(blocks._KNOWN) and not any("'" in t for t in blocks._KNOWN)


def _page(rows=40):
    row = "<tr>" + "".join(f"<td>{c}</td>" for c in "abcde") + "</tr>"
    labels = "<p><strong>Ministry:</strong>\n <span>N</span></p>" * 20
    return f'<div class="border block"><div class="block_header"><p>Contract No: GEMC-1</p></div>{labels}<table class="table table-striped">{row * rows}</table></div>'


def test_a_page_is_read_in_few_calls():
    """Reading pages is the cost of extraction: some five calls a tag, where there were ten."""
    import sys

    page, calls = _page(), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    first = parse_page(page)
    sys.setprofile(count)
    try:
        again = parse_page(page)
    finally:
        sys.setprofile(None)
    assert again == first and len(first[0]["cells"]) == 40 and len(first[0]["labels"]) == 20
    assert calls < 7 * page.count("<")


@pytest.mark.parametrize("windows", [(1, 1), (7, 3), (64, 16)])
def test_windows_do_not_change_what_is_read(monkeypatch, windows):
    from contractlens.sources import blocks

    odd = ["<p title=it's>", "a > b", "<x<y>", "<!-- <p> -->", "<script>a<b</script>", "&am<b>p;</b>", "</td>", "<p>", "<br/>", "<" + "a" * 300 + ">", "<td", "</"]
    pages = [_page(3) + "".join(odd[k:]) + _page(1) + "".join(odd[:k]) for k in range(len(odd))]
    whole = [blocks.read_blocks(p) for p in pages]
    monkeypatch.setattr(blocks, "_WINDOW", windows[0])
    monkeypatch.setattr(blocks, "_FIRST_WINDOW", windows[1])
    assert [blocks.read_blocks(p) for p in pages] == whole


def test_labels_are_stripped_of_all_white_space_without_patterns(spark):
    import re

    from contractlens.functions.scalars import strip_space

    kind = re.compile(f"[{values.SPACE}]", re.ASCII)
    assert {c for c in map(chr, range(0x10000)) if kind.fullmatch(c)} == set(values.SPACES)
    texts = [s + "a" + c + "b" + t for c in values.SPACES for s, t in ((c, c), ("", c + "\n"), (" " + c, ""))] + [values.SPACES, "", None, "​x﻿"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_space(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [r.t and r.t.strip(values.SPACES) for r in rows]
    lines = P.contract_lines(pages(spark, block("GEMC-1")))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 6  # prices only
