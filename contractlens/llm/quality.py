"""Quality rules with thresholds that follow each language and source.

Measures of a text are integers.  Their distribution is kept per language and
source in a sketch: counts of values in buckets of at most 1/32 relative
width.  Sketches merge by adding counts, so a group's sketch is one aggregate
with map-side combine, and a small group can borrow from its language or from
all texts by merging.  Quantiles of the sketches give fences, and the fences
are joined back to judge each text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import by_slice, word_hashes, word_lists
from contractlens.operators.scale import attach, durable

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Fixed words a text must have, and the share of repeated words that fails it.
LEAST_WORDS = 50
MOST_REPEATED = 50

# Groups with fewer texts borrow from their language, and these from all texts.
LEAST_TEXTS = 100

# A fence stands FENCE spreads above the third quartile (or below the first).
# The spread is the distance of the quartiles, but no less than the slack.
FENCE = 3

# Measures with the slack of their spread, and whether low values fail too:
# symbols, repeated lines and repeated words per 1000 words, hundredths of
# characters a word.
MEASURES = {"symbols": (30, False), "dup_lines": (30, False), "repeats": (150, False), "word_length": (60, True)}


def _repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, each word counted once."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    _, codes = np.unique(hashes, return_inverse=True)
    codes = codes.astype(np.int64)
    m = int(codes.max()) + 1
    _, pairs = np.unique(codes[:-2] * m + codes[1:-1], return_inverse=True)
    _, at, counts = np.unique(pairs.astype(np.int64) * m + codes[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(n + 2, bool)
    for j in range(3):
        covered[j : j + n] |= again
    return int(covered.sum())


def _dup_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measure(text: str):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column(text), "")
        words, offsets = word_lists(texts)
        hashes = word_hashes(words)
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
        symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
        lines = np.fromiter((_dup_lines(t) for t in texts.to_pylist()), np.int64, len(texts))
        repeats = np.fromiter((_repeat_words(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(texts))
        made = [np.diff(offsets), chars[offsets[1:]] - chars[offsets[:-1]], symbols, lines, repeats]
        for name, values in zip(BASE, made, strict=True):
            batch = batch.append_column(name, pa.array(values, pa.int64()))
        return batch

    return by_slice(text, work)


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of ``BASE``; NULL and empty texts count nothing. Columns of these names are replaced."""
    df = df.drop(*[c for c in BASE if c in df.columns])
    schema = df.withColumns({c: F.lit(None).cast("long") for c in BASE}).schema
    return df.mapInArrow(_measure(text), schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The judged measures as whole numbers; 0 where there are no words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    per = lambda scale, c: F.lit(scale) * F.col(c)
    whole = lambda a: F.floor(a / words).cast("long")
    return {
        "symbols": whole(per(1000, "n_symbols")),
        "dup_lines": whole(per(1000, "n_dup_lines")),
        "repeats": whole(per(1000, "n_repeat_words")),
        "word_length": whole(per(100, "word_chars")),
    }


def bucket(value: Column) -> Column:
    """Lower edge of the sketch bucket of a whole number: exact below 64, then 32 buckets for each power of two."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per group, measure and bucket, of texts that pass the base rules."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in measures().items()])
    return (
        measured.where(~base_failed())
        .select(*keys, F.explode(values).alias("v"))
        .groupBy(*keys, F.col("v.measure").alias("measure"), F.col("v.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure: texts, first and third quartile (bucket edges)."""
    counts = F.sort_array(F.collect_list(F.struct("bucket", "n")))  # buckets of one measure: a few hundred
    grouped = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("texts"), counts.alias("counts"))

    def quantile(quarter: int) -> Column:
        need = F.floor((F.col("texts") * quarter + 3) / 4)
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        return F.aggregate(
            "counts",
            start,
            lambda s, c: F.struct(
                (s["seen"] + c["n"]).alias("seen"),
                F.when(s["at"].isNull() & (s["seen"] + c["n"] >= need), c["bucket"]).otherwise(s["at"]).alias("at"),
            ),
            lambda s: s["at"],
        )

    return grouped.select(*keys, "measure", "texts", quantile(1).alias("q1"), quantile(3).alias("q3"))


def fences(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """One row per language and source: lower and upper fence of each measure."""
    keys = ["__lang", "__source"]
    named = measured.select(*BASE, F.col(lang).alias("__lang"), F.col(source).alias("__source"))
    groups = named.select(*keys).distinct()
    own = sketches(named, keys)
    of_lang, of_all = merge(own, ["__lang"]), merge(own, [])
    levels = [
        (quartiles(own, keys), keys),
        (quartiles(of_lang, ["__lang"]), ["__lang"]),
        (quartiles(of_all, []), []),
    ]
    rows = groups
    for level, (found, by) in enumerate(levels):
        wide = [
            F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}{level}") for m in MEASURES for c in ("texts", "q1", "q3")
        ]
        flat = found.groupBy(*by).agg(*wide)
        renamed = flat.select(*[F.col(k).alias(f"{k}_r") for k in by], *[c for c in flat.columns if c not in by])
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in by], F.lit(True))
        # the last level is one row
        rows = (rows.join(renamed, match, "left") if by else rows.crossJoin(F.broadcast(renamed))).drop(*[f"{k}_r" for k in by])
    out = []
    for m, (slack, low) in MEASURES.items():
        def pick(c: str, m: str = m) -> Column:
            enough = [F.col(f"{m}_texts{level}") >= LEAST_TEXTS for level in (0, 1)]
            return F.when(enough[0], F.col(f"{m}_{c}0")).when(enough[1], F.col(f"{m}_{c}1")).otherwise(F.col(f"{m}_{c}2"))

        width = FENCE * F.greatest(pick("q3") - pick("q1"), F.lit(slack))
        out.append((pick("q3") + width).alias(f"{m}_most"))
        out.append((pick("q1") - width if low else F.lit(None).cast("long")).alias(f"{m}_least"))
    return rows.select(*keys, *out)


def judge_measured(measured: DataFrame, lang: str = "lang", source: str = "source", rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (those of ``measured`` if not given) with ``base_failed`` and ``kept``; fences come from all rows of ``measured``."""
    rows = measured if rows is None else rows
    rows = rows.drop(*[c for c in ("base_failed", "kept") if c in rows.columns])
    stats = fences(measured, lang, source)
    group = lambda a, b: F.xxhash64(*[F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")) for c in (a, b)])
    stats = stats.select(group("__lang", "__source").alias("__group"), *[c for c in stats.columns if not c.startswith("__")])
    joined = attach(rows.withColumn("__group", group(lang, source)), stats, ["__group"])
    inside = [~F.col("base_failed")]
    for m, value in measures().items():
        inside.append(F.coalesce(value <= F.col(f"{m}_most"), F.lit(True)))
        if MEASURES[m][1]:
            inside.append(F.coalesce(value >= F.col(f"{m}_least"), F.lit(True)))
    judged = joined.withColumn("base_failed", base_failed()).withColumn("kept", reduce(lambda a, b: a & b, inside))
    return judged.select(*rows.columns, "base_failed", "kept")


def measured_rows(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns ``keep``, lang, source and ``BASE`` of all rows, written once: the texts are read one time."""
    return durable(base_measures(docs, text).select(*keep, lang, source, *BASE))


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` with ``BASE``, ``base_failed`` and ``kept``.

    A text is kept if it passes the base rules and all its measures lie within
    the fences of its language and source (NULLs are groups of their own).
    Fences come from all texts that pass the base rules.  Empty and NULL texts
    fail; an empty table gives an empty result; rows are kept one for one.
    Columns of the new names are replaced.
    """
    own = base_measures(df, text)
    return judge_measured(durable(own.select(lang, source, *BASE)), lang, source, own)


def oracle_sql() -> str:
    """DuckDB's form of the judgement of ``documents``."""
    values = "\nUNION ALL ".join(
        f"SELECT doc_id, lang, source, '{m}' AS measure, CAST(floor({scale} * {column} / greatest(n_words, 1)) AS BIGINT) AS v, {slack} AS slack, {str(low).lower()} AS low FROM judged"
        for (m, (slack, low)), (scale, column) in zip(
            MEASURES.items(), [(1000, "n_symbols"), (1000, "n_dup_lines"), (1000, "n_repeat_words"), (100, "word_chars")], strict=True
        )
    )

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""
), {name}_sums AS (
    SELECT {by}measure, bucket, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {by}measure) AS texts
    FROM (SELECT {by}measure, bucket, count(*) AS n FROM buckets GROUP BY ALL)
), {name} AS (
    SELECT {by}measure, any_value(texts) AS texts, min(bucket) FILTER (seen >= (texts + 3) // 4) AS q1,
        min(bucket) FILTER (seen >= (texts * 3 + 3) // 4) AS q3
    FROM {name}_sums GROUP BY ALL"""

    return f"""
WITH w AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), runs AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
    FROM (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))
), covered AS (
    SELECT doc_id, count(DISTINCT i + j) AS n FROM runs, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), base AS (
    SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
    SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base
), measured AS (
    {values}
), buckets AS (
    SELECT m.*, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket
    FROM measured m JOIN judged USING (doc_id) WHERE NOT base_failed{level("own", "lang, source")}{level("of_lang", "lang")}{level("of_all", "")}
), fenced AS (
    SELECT m.doc_id, m.v, m.slack, m.low,
        CASE WHEN o.texts >= {LEAST_TEXTS} THEN o.q1 WHEN l.texts >= {LEAST_TEXTS} THEN l.q1 ELSE a.q1 END AS q1,
        CASE WHEN o.texts >= {LEAST_TEXTS} THEN o.q3 WHEN l.texts >= {LEAST_TEXTS} THEN l.q3 ELSE a.q3 END AS q3
    FROM measured m
    LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source AND o.measure = m.measure
    LEFT JOIN of_lang l ON l.lang IS NOT DISTINCT FROM m.lang AND l.measure = m.measure
    LEFT JOIN of_all a ON a.measure = m.measure
), inside AS (
    SELECT doc_id, bool_and(coalesce(v <= q3 + {FENCE} * greatest(q3 - q1, slack), true)
        AND (NOT low OR coalesce(v >= q1 - {FENCE} * greatest(q3 - q1, slack), true))) AS ok
    FROM fenced GROUP BY doc_id
)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND ok AS kept FROM judged JOIN inside USING (doc_id)
"""
