"""Helpers that keep plans safe for large inputs."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured size is below this.
BROADCAST_BYTES = 64 * 1024 * 1024

# A group larger than this is never handled by one task as a whole.
GROUP_ROWS = 2_000_000

# A task gets about so many of the rows that ``spread`` moves.
SPREAD_ROWS = 200_000

# NULL-key rows are spread over this many groups.
SPREAD = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a folder of its own.
    """
    named = dict(spark.sparkContext.getConf().getAll()).get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    own = tempfile.mkdtemp(prefix="contractlens-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/contractlens/{name}-{uuid.uuid4().hex}"


class Steps:
    """The intermediate copies of one run, removed when it ends, also on failure.

    Within ``with Steps(spark):`` all copies that ``durable`` writes belong to
    it.  Frames built on them end with it, so results are written inside.
    Runs may lie within one another; ``keep`` writes a copy that outlives this one.
    """

    _open: ContextVar[Steps | None] = ContextVar("steps", default=None)

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Steps:
        self._outer = Steps._open.get()
        self._token = Steps._open.set(self)
        return self

    def keep(self, df: DataFrame, run: Steps | None = None) -> DataFrame:
        """``durable`` for another run: by default that around this one, or the caller where there is none."""
        token = Steps._open.set(run or self._outer)
        try:
            return durable(df)
        finally:
            Steps._open.reset(token)

    def __exit__(self, *problem) -> None:
        Steps._open.reset(self._token)
        self.drop()

    def drop(self) -> int:
        dropped = len(self.paths)
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return dropped


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query are removed when the query ends.

    For queries whose result is written: nothing reads their shuffles again, and
    without this they stay on the executors' disks until the driver's memory is cleaned.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def durable(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written copy, in ``session`` if given.

    What follows does not recompute the work above it, also not after an
    executor is lost.  The copy belongs to the innermost open ``Steps``;
    without one it stays, as the caller's frame reads it.
    """
    path = fresh_path(df.sparkSession, "step")
    owner = Steps._open.get()
    if owner:
        owner.paths.append(path)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows of a few unsplit files over ``tasks`` tasks (by default one per core), for costly work on each row.

    What the scan already cuts evenly into that many partitions stays as it is: a large table does not move.
    The rows of each partition are counted, as a file is cut by bytes but read by row groups, each by one task.
    """
    tasks = tasks or df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    rows = sizes.rows or 0
    if rows and 4 * sizes.most * tasks <= 5 * rows:
        return df
    return df.repartition(max(tasks, math.ceil(rows / SPREAD_ROWS)))


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of ``df`` in memory, by one aggregate."""
    fixed = 8 * len(df.columns) + 16
    sizes = [
        F.coalesce(F.octet_length(f.name), F.lit(0))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.StringType, T.BinaryType))
    ]
    sizes += [
        F.coalesce(F.size(f.name), F.lit(0)) * (f.dataType.elementType.simpleString().count(",") * 8 + 24)
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType)
    ]
    row = F.lit(fixed)
    for size in sizes:
        row = row + size
    return df.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics back to rows.

    ``stats`` holds one row per key and is written first, so its size is
    known: small ones are broadcast, so that rows do not move at all; for large ones
    the shuffle join is left to adaptive execution, which splits the
    partition of a hot key.
    """
    stats = durable(stats)
    if measured_bytes(stats) <= BROADCAST_BYTES:
        stats = F.broadcast(stats)
    return rows.join(stats, keys, how)
