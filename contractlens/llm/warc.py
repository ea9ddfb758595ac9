"""WARC archives: write records, index them, and read chosen records by byte ranges.

Archives are written by Spark's text writer, one record per row, with the
blank lines that end a record as the line separator; so they go through the
cluster's own file systems and commit protocol.  The index then holds file,
offset, length, URL and digest of every record.  Reading sorts the chosen
index rows by file and offset, joins neighbouring ranges, and fetches each
joined range once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.operators.scale import BROADCAST_BYTES, durable, fresh_path, measured_bytes

END = "\r\n\r\n"

# Payloads below this are always written in full.
REVISIT_BYTES = 100

# A read fetches at most this much at once, unless one record is larger, and
# reads over gaps up to the second size rather than seek.
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10

DATE = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"

_HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is NULL."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def with_revisits(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, size, record type and what a revisit refers to.

    Of payloads of at least ``REVISIT_BYTES`` that are equal, the record with
    the smallest page_id is the response and others revisit it.  Rows that
    repeat that page_id are responses too.  A NULL page_id counts as larger
    than any other; where all ids are NULL all records are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    large = F.col("payload_bytes") >= REVISIT_BYTES
    first = (
        rows.where(large)
        .groupBy(F.col("payload_digest").alias("__digest"))
        .agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
        .where(F.col("__n") > 1)
        .drop("__n")
    )
    first = durable(first)
    if measured_bytes(first) <= BROADCAST_BYTES:  # then payloads do not move
        first = F.broadcast(first)
    # small payloads never match; their keys are spread so that no task gets all of them
    key = F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("__digest", key).join(first, "__digest", "left")
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__first")).alias("refers_to"),
    )


def record_text() -> Column:
    """The record of a row of ``with_revisits``, without the blank lines that end it."""
    # line ends and other controls cannot stand in a header
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one WARC record per page (columns page_id, url, html) into archives below ``path``."""
    with_revisits(pages).select(record_text().alias("value")).write.option("lineSep", END).text(path)


def _open(uri: str):
    """A seekable file of any file system that Arrow knows by its URI."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = [line.partition(b": ") for line in head.split(b"\r\n")]
    return {name.decode(): value.decode() for name, _, value in lines}


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _parse(data, begin: int) -> tuple[dict[str, str], int, int, int] | None:
    """Header fields of the record at ``begin``, where its payload begins and its block ends, and its HTTP length."""
    head = _HEAD.match(data, begin)
    if not head:
        return None
    fields = _fields(head[1])
    end = head.end() + int(fields["Content-Length"])
    body = data.find(b"\r\n\r\n", head.end()) + 4
    if body < 4:
        return None
    length = int(_fields(data[head.end() : body - 4].split(b"\r\n", 1)[1])["Content-Length"])
    return fields, body, end, length


def _index_file(uri: str) -> Iterator[tuple]:
    """Index rows of one archive, read front to back in bounded pieces."""
    with _open(uri) as file:
        size, at, data, base = file.size(), 0, b"", 0
        while at < size:
            found = _parse(data, at - base)
            if not found:
                # keep what is left and read on; a header longer than a piece grows it
                more = file.read_at(READ_BYTES, base + len(data))
                if not more:
                    raise ValueError(f"{uri}: no record at {at}")
                data, base = data[at - base :] + more, at
                continue
            fields, _, end, length = found
            stop = base + end + len(END)
            yield (
                uri, at, stop - at, fields["WARC-Type"], _id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"),
                fields["WARC-Payload-Digest"].removeprefix("sha256:"), length, _id(fields.get("WARC-Refers-To")),
            )
            at = stop
            if at - base >= len(data):  # over the rest of a record without reading it
                data, base = b"", at


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_INDEX = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
])
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()),
])


def _index_batches(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows = []
            for row in _index_file(uri):
                rows.append(row)
                if len(rows) >= 4096:
                    yield _table(rows, _INDEX)
                    rows = []
            if rows:
                yield _table(rows, _INDEX)


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """File, offset, length, URL and digest of every record below ``path``; one task per archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    files = files.where("length > 0").select("path")
    tasks = max(1, len(files.inputFiles()))
    return files.repartition(tasks, "path").mapInArrow(_index_batches, INDEX)


def _ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Join neighbouring index rows, sorted by file and offset, to reads of bounded size."""
    run: list[tuple] = []
    for row in rows:
        if run and (
            row[0] != run[0][0]
            or row[1] > run[-1][1] + run[-1][2] + GAP_BYTES
            or row[1] + row[2] - run[0][1] > READ_BYTES
        ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _read_batches(with_payload: bool):
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        name = file = None
        try:
            for ranges in _ranges(rows()):
                if ranges[0][0] != name:
                    if file:
                        file.close()
                    name, file = ranges[0][0], _open(ranges[0][0])
                begin = ranges[0][1]
                data = file.read_at(ranges[-1][1] + ranges[-1][2] - begin, begin)
                out = []
                for _, offset, length, digest in ranges:
                    fields, body, end, http = _parse(data, offset - begin)
                    if fields["WARC-Payload-Digest"] != f"sha256:{digest}" or end + len(END) - (offset - begin) != length:
                        raise ValueError(f"{name}: the record at {offset} is not what the index says")
                    payload = None
                    if fields["WARC-Type"] == "response":
                        payload = data[body:end]
                        http, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if fields["WARC-Payload-Digest"] != f"sha256:{digest}":
                            raise ValueError(f"{name}: the payload at {offset} does not have its digest")
                    out.append((
                        _id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                        _id(fields.get("WARC-Refers-To")), http, digest,
                        payload.decode("utf-8", "replace") if with_payload and payload is not None else None,
                    ))
                yield _table(out, _RECORDS)
        finally:
            if file:
                file.close()

    return run


def read_records(index: DataFrame, with_payload: bool = True, tasks: int | None = None) -> DataFrame:
    """The records that the rows of ``index`` name, payloads checked against their digests.

    A revisit has no payload of its own (NULL); its size and digest are those
    of the payload it refers to.  URLs come back as written: with white space
    and control characters as ``%20``.
    """
    parts = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = index.select("file", "offset", "length", "payload_digest").repartitionByRange(parts, "file", "offset")
    return sorted_rows.sortWithinPartitions("file", "offset").mapInArrow(_read_batches(with_payload), RECORDS)


def archive_round_trip(pages: DataFrame, path: str | None = None, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives, write their index, and read every record back by the index.

    NULL html is an empty payload; empty tables give no records; other columns
    than page_id, url and html are not archived.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, f"{path}/archives")
    index_archives(spark, f"{path}/archives").write.parquet(f"{path}/index")
    return read_records(spark.read.schema(INDEX).parquet(f"{path}/index"), with_payload)


ORACLE = f"""
WITH p AS (
    SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), f AS (
    SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
