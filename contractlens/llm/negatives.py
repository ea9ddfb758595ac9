"""Hard negatives by a secondary sort: scored pairs ordered within their anchor, read as a stream.

Anchors meet all rows in cells of a grid.  A cell holds a bounded share of
the rows, past which its anchors stream; it gives, per anchor, no more rows
than can still count (its best positives, then its best negatives in each
positive's window), so what is shuffled is small and nothing is lost.  The
pairs are then dealt by anchor and sorted by (anchor, falling score, id).  In
that order a positive comes before the negatives of its window: the reader
opens a window at each positive and gives out negatives as they come, with
the open windows as its only state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.operators.scale import durable

# A cell's rows take no more than about this in memory.
CELL_BYTES = 64 << 20

# Scores of so many anchors and rows are held at a time.
ANCHORS, ROWS = 256, 8192

_LONG = 2**63 - 1


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact; those beyond 64 bits are the largest or smallest 64-bit number."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = [max(abs(int(x.min())), int(x.max())) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 2**53:  # then doubles are exact
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -_LONG - 1, _LONG).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the first ``most`` stand by falling score, then by id."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        close = np.flatnonzero(scores >= least)
    else:
        close = np.arange(len(scores))
    return close[np.lexsort((ids[close], -scores[close].astype(object) if (scores[close] == -_LONG - 1).any() else -scores[close]))[:most]]


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest score n with low * score <= 100 * n <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _matrix(part: pa.RecordBatch, size: int) -> np.ndarray:
    flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(part.num_rows, size)


def _once(ids: np.ndarray, last: int | None) -> np.ndarray:
    """True for the first of each run of equal ids."""
    fresh = np.ones(len(ids), bool)
    fresh[1:] = ids[1:] != ids[:-1]
    if len(ids) and last is not None and ids[0] == last:
        fresh[0] = False
    return fresh


def _met(pick):
    """For ``mapInArrow`` over cells sorted by vector size, rows before anchors, id: what ``pick`` takes of each anchor's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows, held, last = None, [], None, None
        for batch in batches:
            sizes, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "kind"))
            cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if size != sizes[begin]:
                    size, rows, held, last = int(sizes[begin]), [], None, None
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                if kinds[begin] and held is None:
                    held, last = _held(rows, size), None
                fresh = _once(ids, last)
                last = int(ids[-1])
                labels = part.column("of").to_numpy(zero_copy_only=False).astype(np.int64)
                vectors = _matrix(part, size)
                if not kinds[begin]:
                    rows.append((ids[fresh], labels[fresh], vectors[fresh]))
                    continue
                marks = part.column("marks").to_pylist()
                chosen = np.flatnonzero(fresh)
                for at in range(0, len(chosen), ANCHORS):
                    few = chosen[at : at + ANCHORS]
                    found = pick(ids[few], labels[few], vectors[few], [marks[i] for i in few.tolist()], held)
                    if found:
                        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "id", "score"])

    return run


def _held(rows: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a cell by label, then id."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size), np.int64)
    ids, labels, vectors = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((ids, labels))
    return ids[order], labels[order], vectors[order]


def _pick_positives(most: int):
    def pick(anchors, labels, vectors, marks, held):
        ids, of, rows = held
        for label in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == label)
            begin, end = np.searchsorted(of, [label, label + 1])
            for at in range(begin, end, ROWS):
                here = slice(at, min(at + ROWS, end))
                scores = _scores(vectors[mine], rows[here])
                for k, i in enumerate(mine.tolist()):
                    others = np.flatnonzero(ids[here] != anchors[i])
                    best = others[_first(scores[k, others], ids[here][others], most)]
                    yield np.full(len(best), anchors[i]), ids[here][best], scores[k, best]

    return lambda *a: list(pick(*a))


def _pick_negatives(most: int, low: int, high: int):
    def pick(anchors, labels, vectors, marks, held):
        ids, of, rows = held
        windows = [[_bounds(score, low, high) for score in m or []] for m in marks]
        for at in range(0, len(ids), ROWS):
            here = slice(at, at + ROWS)
            scores = _scores(vectors, rows[here])
            for k, open_at in enumerate(windows):
                least, largest = min((w[0] for w in open_at), default=1), max((w[1] for w in open_at), default=0)
                near = np.flatnonzero((scores[k] >= least) & (scores[k] <= largest) & (of[here] != labels[k]))
                if not len(near):
                    continue
                s, n = scores[k, near], ids[here][near]
                kept = np.zeros(len(near), bool)
                for a, b in set(open_at):
                    inside = np.flatnonzero((s >= a) & (s <= b))
                    kept[inside[_first(s[inside], n[inside], most)]] = True
                yield np.full(int(kept.sum()), anchors[k]), n[kept], s[kept]

    return lambda *a: list(pick(*a))


def _stream(most: int, low: int, high: int):
    """For ``mapInArrow`` over pairs by (anchor, falling score, positives first, id)."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for a, score, negative, i in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "score", "negative", "id")), strict=True):
                if a != anchor:
                    anchor, windows = a, []
                if not negative:
                    windows.append([*_bounds(score, low, high), 0, i, score])
                    continue
                # a window ends with its last negative, or when scores have fallen below it
                windows = [w for w in windows if w[2] < most and score >= w[0]]
                for w in windows:
                    if score <= w[1]:
                        w[2] += 1
                        out.append((a, w[3], w[2], i, w[4], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _in_cells(rows: DataFrame, anchors: DataFrame, across: int, down: int) -> DataFrame:
    """Rows and anchors dealt to the cells of a grid: each row to ``across`` cells, each anchor to ``down``."""
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("*", F.lit(None).cast("array<long>").alias("marks"), F.lit(0).alias("kind"), part(down, 0).alias("y"), every(across).alias("x"))
    asked = anchors.select(*rows.columns, "marks", F.lit(1).alias("kind"), part(across, 1).alias("x"), every(down).alias("y"))
    dealt = held.unionByName(asked).withColumn("cell", (F.col("y") * across + F.col("x")).cast("int"))
    return (
        dealt.repartitionById(across * down, "cell")
        .sortWithinPartitions("size", "kind", "id", "of", "vector")
        .select("size", "kind", "id", "of", "vector", "marks")
    )


def hard_negatives(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of another label with ``low * p <= 100 * n <= high * p``, where p and n
    are the scores of the positive and of the negative.

    Components become ``floor(scale * x)`` and a score is the integer inner
    product with the anchor; higher scores come first, ties by the smaller id.
    ``anchor`` is a condition on the rows.  Returns ``anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score``; other columns of
    ``vectors`` play no part, whatever their names.

    Rows without id, label or vector, or with a component that is null or not
    finite, take no part.  Of rows that share an id and a vector size, that of
    the smallest label, then vector, counts.  Vectors of different sizes have
    no score together; empty ones have the score 0.  Anchors without a
    positive, and empty tables, give no rows.  Scores beyond 64 bits count as
    the largest or smallest 64-bit number.
    """
    spark = vectors.sparkSession
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(fine).select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("of"),
        F.size(vector).alias("size"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    count = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("a"), F.sum(F.col("size").cast("long") * 8 + 64).alias("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # anchors are fewer, so they are the ones that are repeated most
    across = max(1, round(math.sqrt(tasks * count.a / max(1, count.n))))
    down = max(math.ceil(tasks / across), math.ceil((count.bytes or 0) / CELL_BYTES))

    asked = rows.where("asks").drop("asks")
    rows = rows.drop("asks")
    pair = "anchor_id long, id long, score long"
    near = _in_cells(rows, asked.withColumn("marks", F.lit(None).cast("array<long>")), across, down).mapInArrow(_met(_pick_positives(positives)), pair)
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = durable(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).drop("nth"))

    marks = best.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set("score"), False).alias("marks"))
    far = _in_cells(rows, asked.join(marks, "id"), across, down).mapInArrow(_met(_pick_negatives(negatives, low, high)), pair)

    pairs = best.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return (
        pairs.repartition("anchor_id")
        .sortWithinPartitions("anchor_id", F.desc("score"), "negative", "id")
        .mapInArrow(_stream(negatives, low, high), result)
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
