"""Stored web pages to raw contract rows."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlens import values
from contractlens.functions.scalars import clean_price, contains_any, plain_text, strip_space
from contractlens.operators.dedup import first_per_key, not_seen
from contractlens.sources.blocks import BLOCK, LABEL, read_blocks

_LABEL = T.StructType([T.StructField(n, T.StringType()) for n in LABEL])
_BLOCK = [
    T.StructField("block_no", T.IntegerType()),
    T.StructField("header", T.StringType()),
    T.StructField("org_type", T.StringType()),
    T.StructField("labels", T.ArrayType(_LABEL)),
    T.StructField("body", T.StringType()),
    T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("error", T.StringType()),
    T.StructField("page_text", T.StringType()),
]


def _lists(lists: list[list | None], entries: pa.Array) -> pa.ListArray:
    """``entries``, those of one list after another, as these lists; None is a null list."""
    ends = [0, *accumulate(len(x) if x else 0 for x in lists)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=pa.array([x is None for x in lists], pa.bool_()))


def _block_columns(found: list[tuple], page_texts: list[str | None]) -> list[pa.Array]:
    """``found`` (number and what ``read_blocks`` tells) in the columns of ``_BLOCK``."""
    numbers, headers, org_types, labels, bodies, cells, errors = zip(*found, strict=True) if found else [()] * 7
    texts = [pa.array(c, pa.string()) for c in (headers, org_types, bodies, errors, page_texts)]
    told = list(zip(*[x for of_block in labels if of_block for x in of_block], strict=True)) or [()] * len(LABEL)
    label = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in told], LABEL)
    rows = [row for of_block in cells if of_block for row in of_block]
    row = _lists(rows, pa.array([cell for r in rows for cell in r], pa.string()))
    return [pa.array(numbers, pa.int32()), *texts[:2], _lists(labels, label), texts[2], _lists(cells, row), *texts[3:]]


def blocks_of(pages: DataFrame, html: str = "html", outer: bool = False) -> DataFrame:
    """One row per contract block, with the other page columns kept.

    ``outer`` also keeps a page without blocks, as a row without
    ``block_no``; ``page_text`` is then its text, if it shows no block at all.
    Pages are independent: no shuffle, Arrow in and out.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    names = [f.name for f in kept]
    no_block = (None,) * (1 + len(BLOCK))

    def run(batches):
        for batch in batches:
            source, found, page_texts = [], [], []
            for i, text in enumerate(batch.column(html).to_pylist()):
                blocks, page_text = read_blocks(text)
                for no, block in enumerate(blocks):
                    source.append(i)
                    found.append((no, *block))
                    page_texts.append(None)
                if outer and not blocks:
                    source.append(i)
                    found.append(no_block)
                    page_texts.append(page_text)
            rows = pa.array(source, pa.int32())
            columns = [batch.column(n).take(rows) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *_block_columns(found, page_texts)], [*names, *(f.name for f in _BLOCK)])

    return pages.mapInArrow(run, T.StructType([*kept, *_BLOCK]))


def _with_labels(blocks: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Per label, the text after the first bold element that holds it.

    The element is a column of its own, so each search runs once.
    """

    def first_with(label: str) -> Column:
        wanted = F.lit(label.lower())
        return F.get(F.filter("labels", lambda b: F.contains(b["label"], wanted)), F.lit(0))

    hits = {f"_hit_{name}": first_with(label) for name, label in labels.items()}

    def after(hit: Column) -> Column:
        start = F.position(hit["bold"], hit["line"]) + F.length(hit["bold"])
        rest = F.ltrim(F.substr(hit["line"], start), F.lit(":"))
        return F.coalesce(strip_space(rest), F.lit(""))

    return (
        blocks.withColumns(hits)
        .withColumns({name: after(F.col(f"_hit_{name}")) for name in labels})
        .drop(*hits, "labels")
    )


def _status(header: Column) -> Column:
    said = strip_space(F.regexp_extract(header, values.STATUS_PATTERN, 1))
    return F.when(header.rlike(values.STATUS_PATTERN), said).otherwise(
        F.substring(header, 21, 60)
    )


def contract_lines(
    pages: DataFrame, number_pattern: str = values.NUMBER_PATTERN, outer: bool = False
) -> DataFrame:
    """All product lines of all blocks, typed, with ``line_no`` from 0.

    A block without product rows gives one line with empty cells, and with
    ``outer`` a page without blocks gives one line without ``block_no``, and
    each line has the ``outcome`` of its page.
    """
    if "scraped_at" not in pages.columns:
        pages = pages.withColumn("scraped_at", F.current_timestamp())
    body_total = F.regexp_extract("body", values.TOTAL_PATTERN, 1)
    total = F.coalesce(clean_price(F.col("_total")), clean_price(body_total))
    labels = {**values.LABELS, "_total": values.TOTAL_LABEL}
    blank = F.array(F.array().cast("array<string>"))
    page = [c for c in pages.columns if c != "html"]

    blocks = _with_labels(blocks_of(pages, outer=outer), labels).withColumns(
        {
            "contract_number": F.regexp_extract("header", number_pattern, 1),
            "contract_status": _status(F.col("header")),
            "total_value": total,
        }
    )
    kept = [
        *page, "block_no", "contract_number", "org_type", *values.LABELS,
        "total_value", "contract_status", "error", *(["page_text"] if outer else []),
    ]
    rows = F.when(F.size("cells") > 0, F.col("cells")).otherwise(blank)
    lines = blocks.select(*kept, F.posexplode(rows).alias("line_no", "cell"))

    def cell(i: int) -> Column:
        return F.coalesce(F.get("cell", F.lit(i)), F.lit(""))

    if outer:
        lines = _outcome_of(lines, "page_text", "outcome")
    return lines.withColumns(
        {
            "product_name": cell(0),
            "brand": cell(1),
            "model": cell(2),
            "quantity": cell(3),
            "unit_price": clean_price(cell(4)),
        }
    ).drop("cell")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines without a contract number or with a read error, with the reason."""
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(
        F.coalesce(F.col("contract_number"), F.lit("")) == "", F.lit("no contract number")
    )
    found = lines.filter(F.col("block_no").isNotNull())
    return found.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def accepted_lines(lines: DataFrame) -> DataFrame:
    """Lines with a contract number and no read error."""
    return lines.filter(F.col("error").isNull() & (F.col("contract_number") != ""))


def key_of(grain: str) -> list[str]:
    return {"contract": ["contract_number"], "line": ["contract_number", "line_no"]}[grain]


def extract_contracts(
    pages: DataFrame,
    grain: str = "contract",
    page_order: list[str] | None = None,
    keep_blank: bool = False,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Raw contract rows of the pages, one per key, first page wins.

    ``grain="contract"`` keeps the first line of each contract, ``"line"``
    all its lines.  Blocks without a number are left to ``rejected_lines``;
    with ``keep_blank`` they share the empty number as their key.  Contracts
    in ``seen`` are skipped.
    """
    return first_lines(contract_lines(pages), grain, page_order, keep_blank, seen)


def first_lines(
    lines: DataFrame,
    grain: str = "contract",
    page_order: list[str] | None = None,
    keep_blank: bool = False,
    seen: DataFrame | None = None,
) -> DataFrame:
    """The lines kept by ``extract_contracts``, from lines already read."""
    readable = lines.filter(F.col("error").isNull()).drop("error")
    if not keep_blank:
        readable = readable.filter(F.col("contract_number") != "")
    if grain == "contract":
        readable = readable.filter(F.col("line_no") == 0)
    order = [*(page_order or ["page_id"]), "block_no", "line_no"]
    first = first_per_key(readable, key_of(grain), order)
    if seen is not None:
        first = not_seen(first, seen, ["contract_number"])
    return first.withColumn("id", F.xxhash64("contract_number", "line_no"))


def as_contracts(rows: DataFrame) -> DataFrame:
    """Extracted rows in the columns of the raw contract table."""
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in values.CONTRACTS.fields])


def _outcome_of(pages: DataFrame, text: str, name: str) -> DataFrame:
    """What a result page shows, in place of its text; the first that fits wins. No text: it shows a block.

    The plain text is a column of its own, so that it is made once and not for each phrase.
    """
    plain = F.col("_plain")
    outcome = (
        F.when(plain.isNull(), F.lit("results"))
        .when(contains_any(plain, values.NO_RESULT_PHRASES), F.lit("no_results"))
        .when(contains_any(plain, values.CAPTCHA_ERROR_PHRASES), F.lit("captcha_error"))
        .otherwise(F.lit("unknown"))
    )
    return pages.withColumn("_plain", plain_text(F.col(text))).drop(text).withColumn(name, outcome).drop("_plain")


def with_outcome(pages: DataFrame, html: str = "html", name: str = "outcome") -> DataFrame:
    """Add what a result page shows, from its text as a reader sees it: without
    title and hidden parts, with character references decoded."""

    def run(batches):
        for batch in batches:
            texts = [read_blocks(text)[1] for text in batch.column(html).to_pylist()]
            yield batch.append_column("_text", pa.array(texts, pa.string()))

    shown = pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("_text", T.StringType())]))
    return _outcome_of(shown, "_text", name)


def sightings(visits: DataFrame) -> DataFrame:
    """What was seen per date window and contract number.

    ``visits`` has one row per line found, and one without ``block_no`` for
    each page that shows no contract, with ``from_date``, ``to_date``,
    ``outcome`` and ``contract_number``.
    """
    line = F.col("block_no").isNotNull()
    number = F.when(line, F.nullif(F.col("contract_number"), F.lit("")))
    return visits.groupBy("from_date", "to_date", number.alias("contract_number")).agg(
        F.count_if(line).alias("rows"),
        F.count_if(F.col("outcome") == "no_results").alias("empty_pages"),
    )


def window_notes(seen: DataFrame) -> DataFrame:
    """Per date window: contracts and rows found, and how it ended.

    ``seen`` are the sightings of one or more batches; a contract that is in
    several of them counts once.
    """
    found = seen.groupBy("from_date", "to_date").agg(
        F.count_distinct("contract_number").alias("contracts"),
        F.sum("rows").alias("rows"),
        F.sum("empty_pages").alias("_empty"),
    )
    note = (
        F.when(F.col("rows") > 0, "normal")
        .when(F.col("_empty") > 0, "zero_confirmed")
        .otherwise("zero_assumed")
    )
    return found.withColumn("note", note).drop("_empty")
