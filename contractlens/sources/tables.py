"""CSV and Parquet sources and sinks, and the two growing tables."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlens import values
from contractlens.functions.scalars import missing_to_null, parse_when
from contractlens.operators.dedup import latest_per_key
from contractlens.operators.scale import shuffles_end
from contractlens.sources.growing import Growing

# types of the detector input; every other CSV column stays text
CSV_TYPES = {
    "id": "bigint",
    "total_value": "double",
    "unit_price": "double",
    "quantity": "double",
    "contract_date": "timestamp",
}

# --------------------------------------------------------------------------
# CSV
# --------------------------------------------------------------------------


CORRUPT = "_corrupt_record"

# Rows of a CSV file that one task writes and reads.
CSV_FILE_ROWS = 200_000

# More rows than this are written where they are, each task in files of ``CSV_FILE_ROWS`` rows: moved once more, they would
# take nearly as much disk as the text itself.
CSV_MOVED_ROWS = 2_000_000


def _read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All records as text, with those that do not fit their header whole in ``CORRUPT``.

    The columns are those of one file's header; a file whose header differs in
    names or order raises an error, as its cells would go to other columns.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    return (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every column as text under its header name, missing tokens as NULL.

    Quoted cells may hold line ends, so a file is read by one task: large
    tables come as many files.  Records with too few or too many cells are
    left to ``csv_rejects``.  ``multi_line=False`` splits files, for sources
    known to have no line ends in cells.
    """
    text = _read_csv(spark, path, multi_line)
    good = text.filter(F.col(CORRUPT).isNull())
    names = [c for c in text.columns if c != CORRUPT]
    return good.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in names])


def csv_rejects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Records that do not fit their header, and the file they are in."""
    text = _read_csv(spark, path, multi_line)
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in text.columns if c != CORRUPT]))
    kept = text.select(F.col(CORRUPT).alias("record"), whole.alias("cells"), F.input_file_name().alias("file"))
    return kept.filter(F.col("record").isNotNull())


def _typed(column: str, kind: str):
    text = F.col(column)
    if kind == "timestamp":
        return parse_when(text)
    return F.trim(text).try_cast(kind)


def type_columns(text: DataFrame, types: dict[str, str] = CSV_TYPES) -> DataFrame:
    """Typed columns; text that does not fit its type becomes NULL."""
    return text.withColumns({c: _typed(c, k) for c, k in types.items() if c in text.columns})


def csv_problems(text: DataFrame, types: dict[str, str] = CSV_TYPES) -> DataFrame:
    """Per typed column, how many cells hold text that does not fit."""
    bad = [
        F.count_if(F.col(c).isNotNull() & _typed(c, k).isNull()).alias(c)
        for c, k in types.items()
        if c in text.columns
    ]
    return text.agg(*bad)


def read_contracts_csv(
    spark: SparkSession, path: str, types: dict[str, str] = CSV_TYPES
) -> DataFrame:
    return type_columns(read_csv_text(spark, path), types)


def csv_files(rows: int) -> int:
    """Into how many files so many rows go, as a file with line ends in cells is read by one task."""
    return max(8, math.ceil(rows / CSV_FILE_ROWS))


def write_csv(df: DataFrame, path: str, file_rows: int | None = None) -> None:
    """Replace the text files at ``path``; with ``file_rows`` none has more rows."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    with shuffles_end(df.sparkSession):
        writer.option("maxRecordsPerFile", file_rows or 0).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace the Parquet table at ``path`` and read it back."""
    with shuffles_end(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


# --------------------------------------------------------------------------
# Growing tables: one folder per batch, so that a batch can be written again
# --------------------------------------------------------------------------


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, *parts: str) -> DataFrame:
    """The table at ``path``, or no rows of ``schema`` when there is none yet.

    ``parts`` are the folder columns besides ``batch``, as DDL.
    """
    folders = [T.StructField("batch", T.StringType()), *[f for p in parts for f in T.StructType.fromDDL(p).fields]]
    with_batch = T.StructType([*schema.fields, *folders])
    try:
        return spark.read.schema(with_batch).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], with_batch)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Write an empty table of ``schema`` unless there is one at ``path``."""
    try:
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
    except AnalysisException as problem:
        if "PATH_ALREADY_EXISTS" not in str(problem):
            raise
        return False
    return True


def write_batch(df: DataFrame, path: str, batch: str, *parts: str) -> str:
    """Write one batch, replacing an earlier try of it, split by the columns ``parts``; returns its folder."""
    place = f"{path.rstrip('/')}/batch={batch}"
    df.write.mode("overwrite").partitionBy(*parts).parquet(place)
    return place


def append_new(batch_rows: DataFrame, path: str, batch: str, keys: list[str], order: list[str]) -> int:
    """Append rows whose key is new, the first row of each key, and return
    how many really went in.  Writing the same batch again changes nothing."""
    return Growing(batch_rows.sparkSession, path, batch_rows.schema, keys).append_new(batch_rows, batch, order)


# --------------------------------------------------------------------------
# Ledger of date windows
# --------------------------------------------------------------------------

def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, entries of older layouts in the present one."""
    return migrate_ledger(read_or_empty(spark, path, values.LEDGER).drop("batch"))


def migrate_ledger(old: DataFrame) -> DataFrame:
    """A ledger of an older layout in the present one.

    A missing ``note`` reads as ``normal``, missing ``rows`` as the contracts.
    """
    known = {"note": F.lit("normal"), "rows": F.col("contracts")}
    for name, fill in known.items():
        old = old.withColumn(name, F.coalesce(F.col(name), fill) if name in old.columns else fill)
    return old.select(*[F.col(f.name).cast(f.dataType) for f in values.LEDGER.fields])


def ledger_latest(ledger: DataFrame) -> DataFrame:
    """One row per window: a later entry replaces an earlier one; of equal times the fuller one."""
    return latest_per_key(ledger, ["from_date", "to_date"], ["completed_at", "rows", "contracts", "note"])
