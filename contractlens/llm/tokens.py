"""Byte-level BPE by overlapping chunks.

Long texts are cut into chunks that overlap on both sides.  Each chunk is
pre-tokenised by itself, in parallel.  Two neighbours scan the same overlap
from different starts; as every pre-token depends only on the text from its
begin on, they agree from the first boundary they share, and are stitched
there.  The pieces are then encoded one by one, frequent ones from memory, and
decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import by_slice
from contractlens.operators.scale import attach, durable

CHUNK = 16_384
OVERLAP = 1_024

# Distinct pieces whose ids a task remembers; others are encoded again.
REMEMBERED = 100_000


class Vocabulary:
    """Ranks of a byte-level BPE and the pattern that splits text before it."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = pa.array(by_id, pa.large_binary())
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        # joins the bytes of one piece by rank
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in a row, and how many each piece has; each distinct piece is merged once."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        known, found = self.known, []
        for piece in coded.dictionary.to_pylist():
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = ids
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        own = coded.indices.to_numpy()
        counts = lengths[own] if len(found) else np.zeros(0, np.int64)
        begin = (np.cumsum(lengths) - lengths)[own] if len(found) else counts
        at = np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        return flat[at], counts

    def decode(self, ids: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
        """The bytes of all ids in a row, and where those of each id begin (and the end)."""
        taken = self.bytes.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        return taken.buffers()[2], offsets


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def split(vocab: Vocabulary, text: str) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of a text, and where each ends."""
    pieces = vocab.pattern.findall(text)
    return pieces, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))


def meeting(left: np.ndarray, right: np.ndarray) -> int:
    """First boundary of both scans, or -1. The last of each may be cut and does not count."""
    common = np.intersect1d(left[:-1], right[:-1])
    return int(common[0]) if len(common) else -1


_LISTS = pa.list_(pa.int32())
_CHUNK = {"key": pa.string(), "k": pa.int32(), "stop": pa.int32(), "head": _LISTS, "head_n": _LISTS, "ids": _LISTS}
CHUNKS = "key string, k int, stop int, head array<int>, head_n array<int>, ids array<int>"


def _lists(values: np.ndarray, sizes) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _encode_chunks(path: str, pattern: str):
    """Chunk rows to ids up to where the next chunk takes over.

    A chunk sees ``OVERLAP`` characters before and after its own part.  It
    scans the part's end as its successor will, and so knows where the
    successor takes over (``stop``).  Its own first pieces, as far as there
    its predecessor may hand over, are told apart (``head``, with the number
    of ids of each), so that the ids before that place can be dropped.
    """

    def work(batch):
        vocab = vocabulary(path, pattern)
        pieces, counts, stops, heads = [], [], [], []
        ks, lasts = batch.column("k").to_pylist(), batch.column("last").to_pylist()
        for k, last, before, text in zip(ks, lasts, batch.column("before").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own, ends = split(vocab, text)
            stop = len(text)
            if k < last:
                begin = before + CHUNK - OVERLAP  # where the successor's text begins
                stop = meeting(ends[ends > begin], begin + split(vocab, text[begin:])[1])
            own = own[: int(np.searchsorted(ends, stop, "right"))]
            starts = np.concatenate([[0], ends])[: len(own)]
            heads.append(starts[starts < 2 * OVERLAP] if k else starts[:0])
            pieces += own
            counts.append(len(own))
            stops.append(stop)
        ids, n = vocab.encode(pieces)
        first = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(n)])
        head_n = [n[a : a + len(h)] for a, h in zip(first[:-1], heads, strict=True)]
        sizes = [len(h) for h in heads]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("key"), pa.array(ks, pa.int32()), pa.array(stops, pa.int32()),
                _lists(np.concatenate(heads), sizes), _lists(np.concatenate(head_n), sizes), _lists(ids, np.diff(total[first])),
            ],
            schema=pa.schema(list(_CHUNK.items())),
        )

    return work


def _encode_rows(path: str, pattern: str, text: str, keep_text: bool):
    """Add the ids of each whole text."""

    def work(batch):
        vocab = vocabulary(path, pattern)
        found = [vocab.pattern.findall(t) for t in pc.fill_null(batch.column(text), "").to_pylist()]
        ids, n = vocab.encode([*chain.from_iterable(found)])
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([0, *map(len, found)])
        made = batch.append_column("__ids", _lists(ids, np.diff(total[ends])))
        return made if keep_text else made.drop_columns([text])

    return by_slice(text, work)


def encode_long(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """``key, ids`` of rows ``key, text`` of any length, by overlapping chunks; equal rows are encoded once.

    ``ids`` is NULL where two neighbours share no boundary in an overlap (in a
    run of more than ``OVERLAP`` letters, say).
    """
    last = F.greatest(F.ceil(F.length("text") / CHUNK).cast("int") - 1, F.lit(0))
    chunks = texts.select("key", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    begin = F.greatest(F.col("k") * CHUNK - OVERLAP, F.lit(0))
    own = F.col("k") * CHUNK - begin
    part = F.substring(F.col("text"), begin + 1, own + F.lit(CHUNK + OVERLAP))
    cut = chunks.select("key", "k", "last", own.alias("before"), part.alias("text")).dropDuplicates(["key", "k"])
    done = cut.mapInArrow(by_slice("text", _encode_chunks(path, pattern)), CHUNKS)
    parts = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "stop", "head", "head_n", "ids"))).alias("parts"))

    def kept(p, i):
        """Ids of a chunk from where its predecessor stops, in its own coordinates."""
        stop = F.try_element_at(F.col("parts"), i)["stop"] - F.when(i == 1, CHUNK - OVERLAP).otherwise(CHUNK)
        pairs = F.filter(F.arrays_zip(p["head"].alias("at"), p["head_n"].alias("n")), lambda z: z["at"] < stop)
        before = F.aggregate(pairs, F.lit(0), lambda a, z: a + z["n"])
        return F.when(i == 0, p["ids"]).otherwise(F.slice(p["ids"], before + 1, F.size(p["ids"])))

    whole = F.flatten(F.transform("parts", kept))
    return parts.select("key", F.when(~F.exists("parts", lambda p: p["stop"] < 0), whole).alias("ids"))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with the token ids of each whole text in the column ``ids``.

    Texts up to a chunk are encoded where they are; only longer ones are cut,
    spread and joined back.  NULL and empty texts have no ids.  Rows are kept
    one for one; equal long texts are encoded once; a column named as the
    result is replaced.  Without ``keep_text`` the text is left out, and the
    ids of long texts need not move to their rows.  ``path`` must be readable
    on the executors.
    """
    df = df.drop(ids) if ids in df.columns and ids != text else df
    long = F.coalesce(F.length(text) > CHUNK, F.lit(False))
    out = df if keep_text else df.drop(text)
    schema = out.withColumn("__ids", F.lit(None).cast("array<int>")).schema
    encode_rows = _encode_rows(path, pattern, text, keep_text)
    far = df.where(long).withColumn("__key", F.concat(F.md5(text), F.lit("-"), F.length(text)))
    found = durable(encode_long(far.select(F.col("__key").alias("key"), F.col(text).alias("text")), path, pattern))
    found = found.select(F.col("key").alias("__key"), F.col("ids").alias("__ids"))
    done = found.where("__ids IS NOT NULL")
    if keep_text:
        joined = far.join(done, "__key")
    else:
        joined = attach(done, far.drop(text), ["__key"])
    made = df.where(~long).mapInArrow(encode_rows, schema).unionByName(joined.select(schema.names))
    lost = found.where("__ids IS NULL").select("__key")
    if not lost.isEmpty():
        made = made.unionByName(far.join(lost, "__key", "left_semi").select(df.columns).mapInArrow(encode_rows, schema))
    return made.withColumnRenamed("__ids", ids)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """``df`` with the concatenated bytes of each row's ids in the column ``data``; NULL ids give none."""

    def work(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                n = pc.fill_null(pc.list_value_length(part.column(at)), 0).to_numpy(zero_copy_only=False)
                raw, offsets = vocab.decode(part.column(at).flatten().to_numpy(zero_copy_only=False))
                ends = offsets[np.concatenate([[0], np.cumsum(n, dtype=np.int64)])].astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), raw])
                yield part.append_column(data, made)

    df = df.drop(data) if data in df.columns else df
    return df.mapInArrow(work, df.withColumn(data, F.lit(None).cast("binary")).schema)
