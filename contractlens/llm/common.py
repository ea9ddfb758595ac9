"""Shared helpers: bounded slices of Arrow batches, word and shingle hashes, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.operators.scale import BROADCAST_BYTES, durable, measured_bytes

# A task looks at no more text than this at a time; each byte takes some 50 while its words are hashed.
SLICE_BYTES = 1 << 19

# Near duplicates: words in a shingle, and the least similarity in per cent.
SHINGLE = 5
PERCENT = 75

# Words are runs of anything but the ASCII white space characters.
ASCII_SPACE = r"\x20\x09-\x0D"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than ``most`` bytes of ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    begin = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        if end > begin:
            yield batch.slice(begin, end - begin)
        begin = end


def by_slice(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], most: int = SLICE_BYTES):
    """A function for ``mapInArrow`` that applies ``work`` to small slices."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                made = work(part)
                if made is not None and made.num_rows:
                    yield made

    return run


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice, one after another, and where each text's words begin (n + 1 offsets)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    return words, offsets


# a random value for each byte, and the same with A-Z taken as a-z
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_BASE = 0x9E3779B97F4A7C15


def word_hashes(words: pa.Array, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word (a polynomial of its bytes), the same on every executor; ``lower`` takes A-Z as a-z."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    values = (_LOWER if lower else _BYTES)[data] * powers[at]
    sums = np.zeros(n, np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):  # empty words have no bytes to add up
        sums[full] = np.add.reduceat(values, starts[full])
    return mixed(sums + lengths.astype(np.uint64))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (hashes ^ (hashes >> np.uint64(31))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def run_hashes(hashes: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``words`` neighbouring words; runs may cross texts."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = (h ^ hashes[j : j + n]) * _MIX[j % 5]
        h ^= h >> np.uint64(29)
    return mixed(h)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Per text its distinct 5-word shingles, sorted; shorter texts give their whole word sequence."""
    words, offsets = word_lists(texts)
    hashes = word_hashes(words, lower=True)
    runs = run_hashes(hashes)
    sets = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - begin >= SHINGLE:
            sets.append(np.unique(runs[begin : end - SHINGLE + 1]))
        elif end > begin:
            sets.append(run_hashes(hashes[begin:end], end - begin) ^ np.uint64(end - begin))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row's content as text; equal rows share it, nulls count."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x01", *parts))


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, Arrow batches of queries that are planned and run hold no more rows than this, for rows that carry long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def limited(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in ``wanted``.

    ``wanted`` is written and measured first: below the engine's bound it goes
    to the rows, which then do not move; above it both sides are shuffled.
    """
    wanted = durable(wanted.select(*keys).distinct())
    if measured_bytes(wanted) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, keys, "left_semi")
