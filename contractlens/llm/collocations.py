"""Phrases whose words belong together, by best-first branch and bound.

Words and neighbouring pairs are counted over all texts.  A pair is the root
of the triples that begin with it, and its counts bound them: a triple is no
more frequent than its pair, so its score is at most ``SCALE * f(pair) /
f(first word)``.  The frontier is opened from the highest bound down: triples
that hold an open pair at either end are counted in a pass over the texts,
which gives the scores below an open pair and all that could drop it.  A
language is settled when enough surviving phrases lie at or above the level down
to which its frontier is open, as nothing closed can reach that level; until
then the level sinks.  Levels are bands of the score, so equal scores are opened together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.llm.common import arrow_rows, mixed, slices, word_hashes
from contractlens.operators.scale import attach, durable

SCALE = 1_000_000

# n-grams that a task gathers before it counts them
GATHERED = 1 << 19

# bytes of text that a task looks at, and texts that reach it at a time
SLICE = 1 << 20
ROWS = 512

# Open pairs that one pass over the texts looks for: 8 bytes each on every executor.  More take more passes.
OPEN = 1 << 20

# The first level is that of so many times the phrases asked for.
MARGIN = 3

# Bands of the score to each doubling.
BANDS = 16

SALTS = 64

# White space and the marks that end a piece
SPACES = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_KIND = np.array([1 if b in SPACES else 2 if b in BREAKS else 0 for b in range(256)], np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of texts: where they are, a 64-bit hash of word and language, and the piece each is in."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int) -> None:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        self.data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        kind = _KIND[self.data]
        word = kind == 0
        edge = np.zeros(len(word) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        self.lengths = np.flatnonzero(word & (~after | edge[1:])) + 1 - self.starts
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        # grows with each mark and with each text
        self.piece = np.cumsum(kind == 2)[self.starts] + self.doc if len(self.starts) else self.doc
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.hashes = self._hashes(np.flatnonzero(word), seed)

    def _hashes(self, at: np.ndarray, seed: int) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        values = np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        first = np.cumsum(self.lengths) - self.lengths
        powers = np.cumprod(np.full(int(self.lengths.max()) + 1, _BASE, np.uint64))
        place = np.arange(len(at)) - np.repeat(first, self.lengths)
        sums = np.add.reduceat(values[self.data[at]] * powers[place], first)
        tongue = word_hashes(self.langs) + np.uint64(seed)
        return mixed(mixed(sums + self.lengths.astype(np.uint64)) ^ tongue[self.lang[self.doc]])

    def distinct(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Hash, word, language and count of each distinct word."""
        hashes, first, counts = np.unique(self.hashes, return_index=True, return_counts=True)
        starts, lengths = self.starts[first], self.lengths[first]
        ends = np.cumsum(lengths)
        taken = self.data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]))] if len(ends) else self.data[:0]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(hashes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(taken.tobytes()))
        return hashes, words.cast(pa.string()), self.langs.cast(pa.string()).take(pa.array(self.lang[self.doc[first]])), counts

    def runs(self, words: int) -> np.ndarray:
        """Where runs of so many words of one piece begin."""
        return np.flatnonzero(self.piece[words - 1 :] == self.piece[: len(self.piece) - words + 1]) if len(self.piece) >= words else np.zeros(0, np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _BASE + second)


class Gathered:
    """n-grams of several slices, counted together."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def counts(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows and counts; a row may come twice where hashes of rows collide."""
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.size = [], 0
        key = columns[0]
        for c in columns[1:]:
            key = pair_keys(key, c)
        order = np.argsort(key)
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        begins = np.flatnonzero(new)
        return [c[begins] for c in columns], np.diff(np.append(begins, len(order)))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64), pa.int64())


_COUNTED = "h1 long, h2 long, word string, lang string, n long"


def _rows_counted(h1=None, h2=None, word=None, lang=None, n=None) -> pa.RecordBatch:
    size = len(n)
    blank = lambda kind: pa.nulls(size, kind)
    return pa.RecordBatch.from_arrays(
        [blank(pa.int64()) if h1 is None else _longs(h1), blank(pa.int64()) if h2 is None else _longs(h2),
         blank(pa.string()) if word is None else word, blank(pa.string()) if lang is None else lang, pa.array(n, pa.int64())],
        ["h1", "h2", "word", "lang", "n"],
    )


def _count_words(seed: int):
    """For ``mapInArrow``: counts of words (no ``h2``), pairs (no ``word``) and of all words of a language (no ``h1``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Gathered()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part.column("text"), part.column("lang"), seed)
                if not len(words.hashes):
                    continue
                hashes, text, lang, counts = words.distinct()
                yield _rows_counted(h1=hashes, word=text, lang=lang, n=counts)
                of_lang = np.bincount(words.lang[words.doc], minlength=len(words.langs))
                yield _rows_counted(lang=words.langs.cast(pa.string()), n=of_lang)
                at = words.runs(2)
                pairs.add([words.hashes[at], words.hashes[at + 1]])
                if pairs.size >= GATHERED:
                    (a, b), counts = pairs.counts()
                    yield _rows_counted(h1=a, h2=b, n=counts)
        if pairs.size:
            (a, b), counts = pairs.counts()
            yield _rows_counted(h1=a, h2=b, n=counts)

    return run


def _count_triples(seed: int, wanted):
    """For ``mapInArrow``: counts of the triples that hold a wanted pair (a broadcast sorted array of pair keys)."""

    def known(keys: np.ndarray) -> np.ndarray:
        sought = wanted.value
        return sought[np.minimum(np.searchsorted(sought, keys), len(sought) - 1)] == keys

    def made(triples: Gathered) -> pa.RecordBatch:
        columns, counts = triples.counts()
        return pa.RecordBatch.from_arrays([*map(_longs, columns), pa.array(counts, pa.int64())], ["h1", "h2", "h3", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples = Gathered()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part.column("text"), part.column("lang"), seed)
                at = words.runs(3)
                if not len(at):
                    continue
                h = words.hashes
                open_pairs = known(pair_keys(h[:-1], h[1:]))
                at = at[open_pairs[at] | open_pairs[at + 1]]
                triples.add([h[at], h[at + 1], h[at + 2]])
                if triples.size >= GATHERED:
                    yield made(triples)
        if triples.size:
            yield made(triples)

    return run


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """``floor(SCALE * a * a / (l * r))`` in whole numbers of 38 digits."""
    big = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")
    top = (big(a) * big(a)).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (big(l) * big(r)).cast("decimal(38,0)")).cast("long")


def _level(score: Column) -> Column:
    return F.floor(F.log2(score.cast("double") + 1) * BANDS).cast("int")


def _first_level(histogram: DataFrame, wanted: Column | int) -> DataFrame:
    """``lang, level``: the highest level at or above which there are ``wanted`` entries, or -1 where there are fewer.

    ``histogram`` has ``lang, level, n``, and at most a few hundred levels for each language.
    """
    down = W.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    reached = histogram.withColumn("sum", F.sum("n").over(down))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("sum") >= wanted, F.col("level"))), F.lit(-1)).alias("level"))


def _top(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each language with their ``rank``, in two steps, as one language may have most rows."""
    salt = F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(SALTS))
    few = rows.withColumn("_s", salt).withColumn("_n", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_n") <= most)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def _open(texts: DataFrame, seed: int, front: DataFrame, least: int) -> list[DataFrame]:
    """Triples that hold a pair of ``front``, counted in as many passes over the texts as the number of pairs asks for."""
    spark = texts.sparkSession
    passes = -(-front.count() // OPEN)
    found = []
    for k in range(passes):
        some = front.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(passes)) == k).select("h1", "h2").toArrow()  # about OPEN rows
        first, second = (some.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        if not len(first):
            continue
        wanted = spark.sparkContext.broadcast(np.sort(pair_keys(first, second)))
        counted = texts.mapInArrow(_count_triples(seed, wanted), "h1 long, h2 long, h3 long, n long")
        with arrow_rows(spark, ROWS):
            found.append(durable(counted.groupBy("h1", "h2", "h3").agg(F.sum("n").alias("a")).where(F.col("a") >= least)))
        wanted.unpersist()
    return found


def _counted(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Counts of words, pairs and languages, and the seed whose hashes tell all frequent words apart."""
    seed = 0
    while True:
        counts = texts.mapInArrow(_count_words(seed), _COUNTED).groupBy("h1", "h2", "word", "lang").agg(F.sum("n").alias("n"))
        with arrow_rows(texts.sparkSession, ROWS):
            counts = durable(counts.where((F.col("n") >= least) | F.col("h1").isNull()))
        if not counts.where("word IS NOT NULL").groupBy("h1").count().where("count > 1").head(1):
            return counts, seed
        seed += 1


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, least: int = 10, covered: int = 50
) -> DataFrame:
    """The first ``top`` phrases of two or three words of each language.

    Returns ``lang, rank, phrase, a, l, r, n, score``.  Texts are lower-cased
    (A-Z) and cut at ``.,;:!?`` and line ends into pieces, these at spaces and
    tabs into words; a phrase lies in one piece.  a, l and r are the counts of
    the phrase and of the two parts of its lowest-scoring cut (of equal ones
    the first), n that of all words of the language; the score is ``floor(SCALE
    * a * a / (l * r))``.  Phrases need ``least`` occurrences.  Pairs inside a
    triple that has at least ``covered`` per cent of their count are dropped.
    Order: score, a (both falling), phrase (by its bytes).

    A null text is empty, a null language is ``und``.  Empty texts and empty
    tables give no rows.  Repeated rows count as often as they come; ties are
    broken by the phrase.  Texts are read whole, however long.  Other columns
    play no part.  Words are told apart by 64-bit hashes within counts of
    pairs and triples; where two words of ``least`` occurrences share one, another seed is taken.
    """
    texts = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    counts, seed = _counted(texts, least)
    words = counts.where("word IS NOT NULL").select("lang", "word", F.col("h1").alias("h"), "n")
    totals = counts.where("h1 IS NULL").select("lang", F.col("n").alias("total"))

    pairs = counts.where("h2 IS NOT NULL").select("h1", "h2", F.col("n").alias("a"))
    pairs = attach(pairs, words.select("lang", F.col("h").alias("h1"), F.col("n").alias("l")), ["h1"])
    pairs = attach(pairs, words.select(F.col("h").alias("h2"), F.col("n").alias("r")), ["h2"])
    bound = F.call_function("div", (F.col("a").cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,0)"), F.col("l").cast("decimal(38,0)")).cast("long")
    pairs = durable(pairs.withColumns({"score": _score("a", "l", "r"), "bound": _level(bound)}).withColumn("level", _level(F.col("score"))))

    scores = pairs.groupBy("lang", "level").agg(F.count("*").alias("n"))
    bounds = durable(pairs.groupBy("lang", F.col("bound").alias("level")).agg(F.count("*").alias("n")))
    state = durable(_first_level(scores, MARGIN * top).withColumn("before", F.lit(None).cast("int")))
    found: list[DataFrame] = []
    while True:
        front = attach(pairs.select("lang", "h1", "h2", "bound"), state.withColumnRenamed("level", "low"), ["lang"])
        front = front.where((F.col("bound") >= F.col("low")) & (F.col("before").isNull() | (F.col("bound") < F.col("before"))))
        found += _open(texts, seed, front, least)
        survivors = durable(_survivors(pairs, _triples(found, pairs), state, covered))
        kept = survivors.groupBy("lang").agg(F.count("*").alias("kept"))
        # levels of languages that are not settled sink until twice as many pairs are open
        undone = state.join(kept, "lang", "left").where((F.col("level") >= 0) & (F.coalesce("kept", F.lit(0)) < top)).select("lang", F.col("level").alias("was"))
        undone = durable(undone)
        if not undone.head(1):
            break
        open_now = bounds.join(undone, "lang").groupBy("lang").agg(F.greatest(F.lit(1), 2 * F.sum(F.when(F.col("level") >= F.col("was"), F.col("n")))).alias("wanted"))
        lower = _first_level(bounds.join(open_now, "lang"), F.col("wanted"))
        state = durable(
            state.select("lang", F.col("level").alias("was"))
            .join(lower, "lang", "left")
            .select("lang", F.coalesce(F.least("level", F.col("was") - 1), "was").alias("level"), F.col("was").alias("before"))
        )

    named = survivors
    for k in (1, 2, 3):
        named = attach(named, words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), [f"h{k}"], "left")
    named = named.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    best = _top(named, [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return attach(best, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _triples(found: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """Triples with their scores; one found from both its pairs counts once."""
    blank = pairs.limit(0).select("h1", "h2", F.col("h2").alias("h3"), "a")
    every = blank
    for some in found:
        every = every.unionByName(some)
    every = every.dropDuplicates(["h1", "h2", "h3"])
    head = pairs.select("lang", "h1", "h2", F.col("l").alias("f1"), F.col("a").alias("f12"))
    tail = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    scored = every.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).withColumns({"cut1": _score("a", "f1", "f23"), "cut2": _score("a", "f12", "f3")})
    early = F.col("cut1") <= F.col("cut2")
    return scored.select(
        "lang", "h1", "h2", "h3", "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("cut1", "cut2").alias("score"),
    )


def _survivors(pairs: DataFrame, triples: DataFrame, state: DataFrame, covered: int) -> DataFrame:
    """Pairs and triples at or above the level of their language, without pairs that a triple covers."""
    triples = durable(triples)
    inside = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    most = inside.groupBy("h1", "h2").agg(F.max("a").alias("most"))
    high = attach(pairs.select("lang", "h1", "h2", "a", "l", "r", "score", "level"), state.select("lang", F.col("level").alias("low")), ["lang"]).where("level >= low")
    free = high.join(most, ["h1", "h2"], "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * covered, F.lit(True)))
    columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    long = attach(triples.withColumn("level", _level(F.col("score"))), state.select("lang", F.col("level").alias("low")), ["lang"]).where("level >= low")
    return free.withColumn("h3", F.lit(None).cast("long")).select(*columns).unionByName(long.select(*columns))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, p, row_number() OVER () AS id
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS p FROM documents)
),
lists AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM lists WHERE len(w) > 0),
f AS (
  SELECT lang, phrase, count(*) AS n FROM (
    SELECT lang, unnest([array_to_string(w[i:i], ' '),
      CASE WHEN i + 1 <= len(w) THEN array_to_string(w[i:i + 1], ' ') END,
      CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i + 2], ' ') END]) AS phrase FROM spots)
  WHERE phrase IS NOT NULL GROUP BY ALL
),
many AS (SELECT lang, phrase, n, string_split(phrase, ' ') AS w FROM f WHERE n >= 10),
cuts AS (
  SELECT m.lang, m.phrase, m.w, m.n AS a, k, l.n AS l, r.n AS r,
    CAST(1000000 AS HUGEINT) * m.n * m.n // (CAST(l.n AS HUGEINT) * r.n) AS score
  FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS k FROM many WHERE len(w) > 1) m
  JOIN many l ON l.lang = m.lang AND l.phrase = array_to_string(m.w[1:k], ' ')
  JOIN many r ON r.lang = m.lang AND r.phrase = array_to_string(m.w[k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY m.lang, m.phrase ORDER BY score, k) = 1
),
inner_pairs AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cuts WHERE len(w) = 3)
  GROUP BY ALL
),
kept AS (
  SELECT c.* FROM cuts c LEFT JOIN inner_pairs t ON t.lang = c.lang AND t.phrase = c.phrase AND len(c.w) = 2
  WHERE t.a IS NULL OR 100 * t.a < 50 * c.a
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, totals.n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
