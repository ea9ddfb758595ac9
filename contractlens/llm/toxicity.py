"""Toxicity by non-negative positive-unlabelled learning.

The classifier is fitted on confirmed toxic texts and on unlabelled ones, which
are toxic or not in the share of the class prior.  Its risk is that of the
positives, plus the unlabelled risk as negatives less what positives add to it;
where that difference turns negative the fit is pushed back instead, so it
cannot gain by overfitting the positives.  A text's features are its distinct
words, hashed; a text is scored whole, in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import by_slice, mixed, word_hashes, word_lists

# Texts the classifier is fitted on, at most: confirmed toxic ones, and unlabelled ones.
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000

FEATURES = 1 << 18

# A word is used if enough confirmed toxic texts have it and its share among them
# differs from that among the unlabelled by this many standard errors.
LEAST_TEXTS = 3
ERRORS = 2.0

# Chosen in four folds of the rows that are not held out: of nine pairs, the best F1 of those that make no error on planted words.
STEPS = 400
RATE = 0.05
DECAY = 1e-4

# Rows with this remainder are held out of the fit.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text divisible by FOLDS? Rows without id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def feature_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct features of each whole text: its words in lower case without outer punctuation."""
    words, offsets = word_lists(texts)
    bare = pa.compute.utf8_trim(words, characters=".,;:!?\"'()[]{}<>|*#$%&_-")
    at = (mixed(word_hashes(bare, lower=True)) % np.uint64(FEATURES)).astype(np.int32)
    return [np.unique(at[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = pa.array(feature_sets(batch.column("text")), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), made], names=["doc_id", "features"])


def sample_features(docs: DataFrame, most: int, seed: int) -> list[np.ndarray]:
    """Features of at most ``most`` rows, chosen by a hash of the id."""
    chosen = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("order")).distinct().orderBy("order").limit(most)
    texts = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most ``most`` ids
    # of rows that share an id the smallest text; in order, so that sums do not depend on the partitioning
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(by_slice("text", _features), "doc_id long, features array<int>")
    table = rows.toArrow().sort_by("doc_id")
    return [np.asarray(x, np.int32) for x in table.column("features").to_pylist()]


class Classifier:
    """A linear model of hashed words, fitted by Adam on the non-negative risk of the logistic loss.

    All weights start from zero, so it is the fit that ranks texts; without
    it every text has the prior for its score.
    """

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> None:
        self.weights = np.zeros(FEATURES)
        self.bias = float(np.log(prior / (1 - prior)))
        if positive and unlabelled:
            self._fit(positive, unlabelled, prior, steps)

    @staticmethod
    def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = [len(r) for r in rows]
        return np.concatenate(rows) if sum(lengths) else np.zeros(0, np.int32), np.repeat(np.arange(len(rows)), lengths)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    @staticmethod
    def _sure(in_positive: np.ndarray, in_unlabelled: np.ndarray, n: int, m: int) -> np.ndarray:
        """What each word counts, 0 to 1: how far its shares among positives and unlabelled differ beyond chance."""
        p, u = (in_positive + 0.5) / (n + 1), (in_unlabelled + 0.5) / (m + 1)
        errors = np.abs(p - u) / np.sqrt(np.maximum(p, u) * (1 - np.minimum(p, u)) * (1 / n + 1 / m))
        return np.clip((errors - ERRORS) / np.maximum(errors, 1e-9), 0, 1) * (in_positive >= LEAST_TEXTS)

    def _fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int) -> None:
        n, m = len(positive), len(unlabelled)
        (at_p, row_p), (at_u, row_u) = self._flat(positive), self._flat(unlabelled)
        sure = self._sure(np.bincount(at_p, minlength=FEATURES), np.bincount(at_u, minlength=FEATURES), n, m)
        used = np.flatnonzero(sure)
        scale = sure[used]
        place = np.full(FEATURES, -1)
        place[used] = np.arange(len(used))
        parts = []
        for at, row in ((at_p, row_p), (at_u, row_u)):
            mine = place[at] >= 0
            parts.append((place[at[mine]], row[mine]))
        (at_p, row_p), (at_u, row_u) = parts
        # weight of each word, and the bias last
        w, first, second = np.append(np.zeros(len(used)), self.bias), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, steps + 1):
            sp = self._sigmoid(np.bincount(row_p, (w[:-1] * scale)[at_p], minlength=n) + w[-1])
            su = self._sigmoid(np.bincount(row_u, (w[:-1] * scale)[at_u], minlength=m) + w[-1])
            # the unlabelled risk as negatives, less what the positives among them add
            rest = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
            if rest >= 0:
                gp, gu = prior * (sp - 1) / n - prior * sp / n, su / m
            else:  # the difference cannot be negative: push it back up
                gp, gu = prior * sp / n, -su / m
            words = np.bincount(at_p, gp[row_p], minlength=len(used)) + np.bincount(at_u, gu[row_u], minlength=len(used))
            grad = np.append(words * scale, gp.sum() + gu.sum())
            grad[:-1] += DECAY * w[:-1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights[used] = w[:-1] * scale
        self.bias = float(w[-1])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        at, row = self._flat(rows)
        return self._sigmoid(np.bincount(row, self.weights[at], minlength=len(rows)) + self.bias)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on rows that are not held out.

    Labels serve to name the positives and to estimate the class prior; the
    unlabelled sample comes from all texts without regard to labels.  A
    document with several labels counts as toxic if one of them says so.
    """
    seen = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = seen.agg(F.avg("toxic")).first()[0]
    rows = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    positive = rows.join(seen.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    prior = min(max(float(share or 0), 1e-4), 0.9999)
    return Classifier(sample_features(positive, MOST_POSITIVE, 11), sample_features(rows, MOST_UNLABELLED, 12), prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Only the text goes into a score.  Empty and NULL texts get the score of a
    text without words.  Without any toxic label all scores are the prior, near
    0.  Rows are kept one for one; columns of the new names are replaced; an
    empty table gives an empty result.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(named, labels))
    base = docs.drop("held_out", "score", "predicted")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("score", pa.array(model.value.scores(feature_sets(batch.column(text))).astype(np.float64)))

    scored = base.mapInArrow(by_slice(text, work), base.withColumn("score", F.lit(None).cast("double")).schema)
    return scored.withColumns({"held_out": held_out(F.col(doc_id)), "predicted": (F.col("score") >= 0.5).cast("int")})
