"""Mix sources to target weights by Poisson replication.

A source with target share ``w`` of the total mass and own mass ``m`` is
repeated ``rate = w * total / m`` times on average.  Each document draws its
number of copies by inverting the Poisson distribution of that mean at a
uniform value hashed from the seed and its id, so a draw depends on nothing
but the document and its source's rate.  Copies are then put in one global
order by a hash of seed, id and copy number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.operators.scale import attach

# 13 hexadecimal digits fit a double exactly.
DIGITS = 13

# Means up to this are drawn at once; exp(-mean) is far from underflow.
MOST_RATE = 500


def uniform(seed: int, *parts: Column) -> Column:
    """A value in [0, 1) hashed from the seed and ``parts``; nulls count as the text ``null``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def source_rates(docs: DataFrame, source: str, mass: Column, weights: dict[str, float] | None) -> DataFrame:
    """One row per source: its mass in characters, and its mean number of copies.

    Without ``weights`` all sources get the same share.  With them, shares
    are in proportion to the weights and sources not named get none.  A source
    without mass has rate 0.
    """
    masses = docs.groupBy(F.col(source).cast("string").alias("mix_source")).agg(F.sum(F.coalesce(mass, F.lit(0)).cast("long")).alias("mix_mass"))
    if weights is None:
        weight = F.when(F.col("mix_mass") > 0, 1.0).otherwise(0.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)) & (F.col("mix_mass") > 0), float(value)).otherwise(weight)
    masses = masses.withColumn("mix_weight", weight)
    total = masses.agg(F.sum("mix_mass").alias("mix_total"), F.sum("mix_weight").alias("mix_weights"))
    rate = F.col("mix_weight") / F.col("mix_weights") * F.col("mix_total") / F.col("mix_mass")
    return masses.crossJoin(F.broadcast(total)).select(  # one row of totals
        "mix_source", "mix_mass", F.when(F.col("mix_weight") > 0, rate).otherwise(0.0).alias("mix_rate")
    )


def distribution(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... as an array, up to where a double cannot tell it from 1."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add, lambda state: state["sums"])


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    seed: int = 7,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    mass: str | None = None,
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson draw, in one global random order.

    New columns: ``mix_copy`` (from 0), ``mix_copies`` (the row's draw),
    ``mix_rate`` (its source's mean), ``mix_key`` (rows are sorted by it).
    Input columns of these names are replaced.  A row's mass is the length of
    its text in characters, or the column ``mass``.

    NULL sources are a source of their own; NULL texts weigh nothing; rows
    with equal id draw alike, and each repeated row is drawn for; a NULL id
    draws as one id.  An empty table gives an empty result.  Rates above
    ``MOST_RATE`` are drawn as a sum of smaller ones, whose sum is Poisson too.
    """
    docs = docs.drop("mix_copy", "mix_copies", "mix_rate", "mix_key")
    rates = source_rates(docs, source, F.col(mass) if mass else F.length(text), weights)
    draws = F.greatest(F.ceil(F.col("mix_rate") / MOST_RATE).cast("int"), F.lit(1))
    stats = rates.withColumn("mix_draws", draws).select(
        F.xxhash64(F.coalesce(F.concat(F.lit("+"), "mix_source"), F.lit("-"))).alias("mix_group"),
        "mix_rate", "mix_draws", distribution(F.col("mix_rate") / F.col("mix_draws")).alias("mix_sums"),
    )
    keyed = docs.withColumn("mix_group", F.xxhash64(F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))))
    drawn = attach(keyed, stats, ["mix_group"])
    one = lambda u: F.size(F.filter("mix_sums", lambda p: p <= u))
    first = one(uniform(seed, F.col(doc_id)))
    more = F.transform(F.sequence(F.lit(2), F.col("mix_draws")), lambda k: one(uniform(seed, F.col(doc_id), F.concat(F.lit("draw "), k))))
    counts = F.when(F.col("mix_draws") > 1, F.concat(F.array(first), more)).otherwise(F.array(first))
    drawn = drawn.withColumn("mix_counts", counts).withColumn("mix_copies", F.aggregate("mix_counts", F.lit(0), lambda a, n: a + n))
    # one draw at a time, so that no row ever holds a long list of copies
    begin = F.aggregate(F.slice("mix_counts", 1, F.col("mix_draw")), F.lit(0), lambda a, n: a + n)
    drawn = drawn.select("*", F.posexplode("mix_counts").alias("mix_draw", "mix_n")).where("mix_n > 0")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("mix_copy").cast("string")))
    return (
        drawn.withColumn("mix_begin", begin)
        .withColumn("mix_copy", F.explode(F.expr("sequence(mix_begin, mix_begin + mix_n - 1)")))
        .withColumn("mix_key", order)
        .select(*docs.columns, "mix_rate", "mix_copies", "mix_copy", "mix_key")
        .orderBy("mix_key")
    )


def oracle_sql(seed: int = 7) -> str:
    """DuckDB's form of the query: the same draws from the same hashes."""
    scale = float(16**DIGITS)
    return f"""
WITH RECURSIVE masses AS (
    SELECT source, sum(length(coalesce(text, ''))) AS mass FROM documents GROUP BY source
), totals AS (
    SELECT sum(mass) AS total, sum(CASE WHEN mass > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS weights FROM masses
), rates AS (
    SELECT source, CASE WHEN mass > 0 THEN 1.0::DOUBLE / weights * total / mass ELSE 0.0 END AS rate FROM masses, totals
), sums AS (
    SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS p FROM rates
    UNION ALL
    SELECT source, rate, k + 1, term * rate / (k + 1), p + term * rate / (k + 1)
    FROM sums WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
), draws AS (
    SELECT doc_id, source, lang, n_chars,
        CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {DIGITS}) AS BIGINT)::DOUBLE / {scale:.1f} AS u
    FROM documents
), copies AS (
    SELECT d.doc_id, d.source, d.lang, d.n_chars, r.rate,
        (SELECT count(*) FROM sums s WHERE s.source IS NOT DISTINCT FROM d.source AND s.p <= d.u) AS mix_copies
    FROM draws d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, source, lang, n_chars, CAST(mix_copies AS INTEGER) AS mix_copies, CAST(c AS INTEGER) AS mix_copy,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(c AS VARCHAR)) AS mix_key
FROM (SELECT *, unnest(range(mix_copies)) AS c FROM copies)
"""
