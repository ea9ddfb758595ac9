"""The row before and the row after, within groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.operators.scale import attach, durable


def _lag_lead(df: DataFrame, part: list[str], order: list[str], seen: Column) -> DataFrame:
    w = W.partitionBy(*part).orderBy(*order)
    return df.withColumns({"_prev": F.lag(seen).over(w), "_next": F.lead(seen).over(w)})


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    seen: list[str],
    sizes: DataFrame,
    max_group: int,
) -> DataFrame:
    """Add ``_prev`` and ``_next``: the columns ``seen`` of the neighbouring
    rows of the same key, as structs.

    ``sizes`` has the rows per key as ``_size``; keys it leaves out are small.
    Rows of normal groups take one shuffle and one sort.  Groups above
    ``max_group`` are cut by a range partitioning over key and order, so no
    task holds one of them as a whole.
    """
    look = F.struct(*[F.col(c) for c in seen])
    hot = sizes.filter(F.col("_size") > max_group)
    heavy = hot.agg(F.sum("_size").alias("s")).first()["s"] or 0
    if heavy == 0:
        return _lag_lead(df, keys, order, look)

    # There are at most rows / max_group hot keys.
    hot = durable(hot.select(*keys))
    big = df.join(hot, keys, "left_semi")
    rest = df.join(hot, keys, "left_anti")
    cut = _cut_neighbours(big, keys, order, look, math.ceil(heavy / max_group) + 1)
    return _lag_lead(rest, keys, order, look).unionByName(cut)


def _cut_neighbours(
    df: DataFrame, keys: list[str], order: list[str], look: Column, pieces: int
) -> DataFrame:
    # The piece of a row is written down, so that every later read agrees.
    cut = durable(
        df.repartitionByRange(pieces, *keys, *order).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    inner = _lag_lead(cut, ["_piece", *keys], order, look)

    # First and last row of each piece: at most ``pieces`` rows in all.
    place = F.struct(*[F.col(c) for c in [*keys, *order]])
    key = F.struct(*[F.col(k) for k in keys])
    edge = F.struct(key.alias("key"), look.alias("row"))
    ends = cut.groupBy("_piece").agg(
        F.min_by(edge, place).alias("first"), F.max_by(edge, place).alias("last")
    )
    w = W.orderBy("_piece")
    ends = ends.select(
        "_piece", F.lag("last").over(w).alias("_left"), F.lead("first").over(w).alias("_right")
    )
    joined = attach(inner, ends, ["_piece"])
    fill = {
        "_prev": F.coalesce("_prev", F.when(F.col("_left.key") == key, F.col("_left.row"))),
        "_next": F.coalesce("_next", F.when(F.col("_right.key") == key, F.col("_right.row"))),
    }
    return joined.withColumns(fill).drop("_piece", "_left", "_right")
