"""Orders split to stay below a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.functions.scalars import MINUTE, micros, without_nan
from contractlens.operators.stretches import in_stretches, stretch_length

DAY = 24 * 60 * MINUTE


def flag_quantity_splitting(
    df: DataFrame,
    limit: float,
    buyer: str = "org_name",
    product: str = "product_name",
    time: str = "contract_date",
    value: str = "total_value",
    near: float = 0.9,
    window_minutes: float = 7 * 24 * 60,
    least: int = 3,
) -> DataFrame:
    """Add ``split_count``, ``split_total`` and ``split_flag``.

    A contract is just below the limit if ``near * limit <= value < limit``.
    For such rows the count and the sum cover the same buyer's contracts of
    the same product just below the limit, from ``window_minutes`` before the
    row up to its instant (all rows of that instant included).  The flag marks each
    row that lies in a window of ``least`` or more of them whose
    sum reaches the limit.  All other rows, and rows without buyer, product,
    time or value, have 0, 0 and false.

    Entries and exits of the window are one ordered sequence, whose running
    sums are the window's: each row is looked at a fixed number of times
    however full a window is.  A group is cut into stretches of time, so a
    busy buyer is spread over many tasks; only candidate rows are shuffled.
    """
    window = int(window_minutes * MINUTE)
    money = F.col(value).cast("decimal(18,2)")
    amount = without_nan(F.col(value))
    candidate = F.coalesce(
        F.col(buyer).isNotNull() & F.col(product).isNotNull() & F.col(time).isNotNull() & (amount >= near * limit) & (amount < limit), F.lit(False)
    )
    marked = df.withColumn("_near", candidate)
    rest = marked.where(~F.col("_near")).drop("_near").withColumns(
        {"split_count": F.lit(0).cast("long"), "split_total": F.lit(0).cast("double"), "split_flag": F.lit(False)}
    )
    timed = marked.where("_near").drop("_near").withColumns({"_t": micros(F.col(time)), "_m": money})
    placed = in_stretches(timed, "_t", window, stretch_length(window, DAY))

    # An exit comes after the entries of its instant, so both ends of a window count.
    steps = placed.withColumn(
        "_step",
        F.explode(
            F.array(
                F.struct((F.col("_t") * 2).alias("at"), F.lit(1).alias("n")),
                F.struct(((F.col("_t") + window) * 2 + 1).alias("at"), F.lit(-1).alias("n")),
            )
        ),
    ).withColumns({"_at": F.col("_step.at"), "_n": F.col("_step.n")})
    group = [buyer, product, "_slot"]
    so_far = W.partitionBy(*group).orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = steps.withColumns(
        {"split_count": F.sum("_n").over(so_far), "_sum": F.sum(F.col("_m") * F.col("_n")).over(so_far)}
    ).where("_n = 1")
    hit = (F.col("split_count") >= least) & (F.col("_sum") >= F.lit(limit).cast("decimal(18,2)"))
    from_here = W.partitionBy(*group).orderBy(F.desc("_t")).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = summed.withColumn("_next", F.min(F.when(hit, F.col("_t"))).over(from_here)).where("_own")
    flagged = found.withColumns(
        {
            "split_total": F.col("_sum").cast("double"),
            "split_flag": F.coalesce(F.col("_next") - F.col("_t") <= window, F.lit(False)),
        }
    )
    return flagged.select(*rest.columns).unionByName(rest)
