"""Exact n-gram Jaccard join by rare-first prefix filtering.

A text is the set of its distinct 5-word shingles.  All sets are put in one
global order, rare shingles first, where rarity is read from a fixed-size
count sketch of the whole corpus.  Two sets that reach the threshold share a
shingle within short prefixes of that order, so only prefix shingles are
joined.  Length and positional filters drop pairs in the join, a suffix filter
drops most others before the sets are compared, and each pair is compared
once.

Groups of copies are folded first: equal sets become one, and each shared
prefix shingle links its members to a few of them, not to each other.  What
is linked already needs no further pair; only prefix shingles whose members
still lie in different classes are joined in full, where the first shingle two
sets share must stand early enough in both, and parity sketches of the sets
show most that differ too much.  So no group is expanded into all its pairs,
and no link between classes is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.llm.common import PERCENT, SHINGLE, arrow_rows, by_slice, intersection, limited, mixed, shingle_sets
from contractlens.llm.components import components
from contractlens.operators.scale import Steps, durable

# Counters of the rarity sketch, in segments that are summed apart: 16 MB in
# all, whatever the corpus.  It only orders shingles; a fuller sketch costs speed.
COUNTERS = 1 << 22
SEGMENTS = 64

# A set's parity sketch: 64 bits in each of so many columns.
PARITIES = 8
PARITY = [f"p{k}" for k in range(PARITIES)]

# Rows that go to Python at a time; each carries a text, or two sets.
TEXT_ROWS = 512

# Rounds at most that link members of a shingle to a few of them before the full join.
STAR_ROUNDS = 3
OFFERS = 4


def prints(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit print of each set, by which equal sets are known; 0 for empty ones."""
    lengths = np.array([len(s) for s in sets], np.int64)
    values, full = np.zeros(len(sets), np.uint64), np.flatnonzero(lengths)
    if len(full):
        flat = mixed(np.concatenate(sets) + np.repeat(lengths, lengths).astype(np.uint64))
        values[full] = np.add.reduceat(flat, (np.cumsum(lengths) - lengths)[full])
    return values.view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set: of each of its bits, whether an odd number of the set's members fall on it.

    What two sets share cancels out between their sketches, so no more bits
    differ than members do.
    """
    bits = 64 * PARITIES
    odd = np.zeros((len(sets), bits), np.uint8)
    for row, own in zip(odd, sets, strict=True):
        row[:] = np.bincount((own >> np.uint64(22) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd, axis=1, bitorder="little").view("<i8").reshape(len(sets), PARITIES)


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, 2**31 - 1).astype("<i4").tobytes(), 1)


def _segments(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    packed = [_pack(c) for c in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "counts"])


SET_NAMES = ["key", "t", "n", "node", *PARITY]
SET_ROWS = ", ".join(f"{c} long" for c in SET_NAMES) + ", segment int, counts binary"


def _set_rows(text: str):
    """A row for each text; and, last, the segments of a sketch that counts the shingles of the task's sets."""

    def run(batches):
        counts, size = np.zeros(COUNTERS, np.int64), COUNTERS // SEGMENTS

        def work(part):
            sets = shingle_sets(part.column(text))
            if any(map(len, sets)):
                at, n = np.unique(np.concatenate(sets) & np.uint64(COUNTERS - 1), return_counts=True)
                counts[at.astype(np.int64)] += n
            columns = [part.column("key"), part.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints(sets))]
            columns += [pa.array(c) for c in np.ascontiguousarray(parities(sets).T)]
            return _row_batch(columns, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()))

        yield from by_slice(text, work)(batches)
        touched = {s: counts[s * size : (s + 1) * size] for s in range(SEGMENTS)}
        touched = {s: c for s, c in touched.items() if c.any()}
        if touched:
            found = _segments(touched)
            yield _row_batch([pa.nulls(len(touched), pa.int64())] * len(SET_NAMES), found.column(0), found.column(1))

    return run


def _row_batch(rows: list[pa.Array], segment: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows, segment, counts], names=[*SET_NAMES, "segment", "counts"])


def read_sets(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """In one pass over ``key, t, text``: ``key, t, n, node`` (size and print of each row's set) with its parities, and parts of the rarity sketch."""
    both = durable(docs.select("key", "t", text).mapInArrow(_set_rows(text), SET_ROWS))
    return both.where("segment IS NULL").select(*SET_NAMES), both.where("segment IS NOT NULL").select("segment", "counts")


def _sum_segments(batches):
    """Sum the counters of each segment; a task holds one array per segment it gets."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64)
            sums[segment] = sums[segment] + counts if segment in sums else counts
    if sums:
        yield _segments(sums)


def rarity(parts: DataFrame) -> np.ndarray:
    """Counters of how many sets hold a shingle of each residue, from all rows.

    The tasks' sketches are summed in two steps, so that no task sums more
    than a fraction of the parts of a segment.  The result has a fixed size.
    """
    schema = "segment int, counts binary"
    part = F.pmod(F.xxhash64("counts"), F.lit(16))
    halfway = parts.repartition(SEGMENTS, "segment", part).mapInArrow(_sum_segments, schema)
    counts, size = np.zeros(COUNTERS, np.int32), COUNTERS // SEGMENTS
    # at most one row per segment, 16 MB in all
    for row in halfway.repartition(SEGMENTS, "segment").mapInArrow(_sum_segments, schema).collect():
        counts[row.segment * size : (row.segment + 1) * size] = np.frombuffer(zlib.decompress(row.counts), "<i4")
    return counts


def prefix_length(n: np.ndarray | int):
    """Shingles of a set of ``n`` that a set reaching the threshold must share one of."""
    return n - (PERCENT * n + 99) // 100 + 1


# Prints of sets that a task remembers to have sent; others may be sent again.
REMEMBERED = 500_000


def _prefix_rows(text: str, counts):
    def run(batches):
        rare, sent = counts.value, set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nodes, shingles, sizes, places = [], [], [], []
            sets = shingle_sets(batch.column(text))
            for node, own in zip(prints(sets).tolist(), sets, strict=True):
                n = len(own)
                if not n or node in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(node)
                order = np.lexsort((own, rare[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                first = own[order[: prefix_length(n)]]
                nodes.append(np.full(len(first), node, np.int64))
                shingles.append(first.view(np.int64))
                sizes.append(np.full(len(first), n, np.int64))
                places.append(np.arange(len(first), dtype=np.int64))
            if not nodes:
                return None
            packed = (np.concatenate(sizes) << 32) | np.concatenate(places)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shingles)), pa.array(np.concatenate(nodes)), pa.array(packed)], names=["shingle", "node", "at"]
            )

        yield from by_slice(text, work)(batches)

    return run


def _may_reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and positional filter for a shingle at places ``i`` of ``n`` and ``j`` of ``m``.

    The sets agree at most in the smaller of what is left from these places
    on, and in what may lie before both.
    """
    most = F.least(n - i, m - j) + F.least(i, j)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (100 * most >= PERCENT * (n + m - most))


def _reach_from(n: Column, i: Column, m: Column, j: Column) -> Column:
    """May two sets whose first common shingle stands at places ``i`` of ``n`` and ``j`` of ``m`` reach the threshold?

    The first one passes this wherever the sets do, so a pair needs no other
    shingle to be found.
    """
    most = F.least(n - i, m - j)
    return 100 * most >= PERCENT * (n + m - most)


def _near_by_parity() -> Column:
    """May sets of ``n`` and ``m`` whose parities are ``p..`` and ``q..`` reach the threshold?

    At least as many members are in one set only as bits differ.
    """
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"q{p}"))) for p in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"q{PARITY[0]}"))))
    # the intersection is (n + m - apart) / 2 at most, the union (n + m + apart) / 2 at least
    return 100 * (F.col("n") + F.col("m") - apart) >= PERCENT * (F.col("n") + F.col("m") + apart)


def suffix_bound(a: np.ndarray, b: np.ndarray, parts: int = 16) -> int:
    """Upper bound of the intersection, from the sizes of the parts of both sets between common pivots."""
    if len(a) < parts or len(b) < parts:
        return min(len(a), len(b))
    pivots = a[np.arange(1, parts) * len(a) // parts]
    x = np.diff(np.concatenate([[0], np.searchsorted(a, pivots), [len(a)]]))
    y = np.diff(np.concatenate([[0], np.searchsorted(b, pivots), [len(b)]]))
    return int(np.minimum(x, y).sum())


def _verified(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            good = []
            for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                total, good_pair = len(a) + len(b), False
                if 100 * (most := suffix_bound(a, b)) >= PERCENT * (total - most):
                    both = intersection(a, b)
                    good_pair = 100 * both >= PERCENT * (total - both)
                good.append(good_pair)
            kept = part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            if kept.num_rows:
                yield kept


def _set_bytes(text: str):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(text))
        return pa.RecordBatch.from_arrays([pa.array(prints(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return by_slice(text, work)


def verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, text: str) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets reach the threshold; the sets are read from one text of each node."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = limited(docs, heads.join(needed, "node", "left_semi"), ["t"])
    sets = durable(texts.select(text).mapInArrow(_set_bytes(text), "node long, members binary").dropDuplicates(["node"]))
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")


def _with_class(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("class", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")


def _enough_shared(c: Column) -> Column:
    """May two sets of ``n`` and ``m`` that share at most ``c`` prefix shingles reach the threshold?

    Of the two prefixes, the shingles of the one that ends first in the global
    order can only be shared within the other prefix; so no more than ``c``
    and what lies behind one of the prefixes is shared.
    """
    behind = lambda n: F.floor((PERCENT * F.col(n) + 99) / 100) - 1
    most = c + F.greatest(behind("n"), behind("m"))
    return 100 * most >= PERCENT * (F.col("n") + F.col("m") - most)


def shared_prefixes(docs: DataFrame, text: str, counts) -> DataFrame:
    """``shingle, node, n, i`` of prefix shingles that two sets or more have in their prefixes."""
    prefixes = docs.select(text).mapInArrow(_prefix_rows(text, counts), "shingle long, node long, at long")
    shared = prefixes.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    rows = limited(prefixes, shared, ["shingle"])
    return rows.select("shingle", "node", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(2**32 - 1).alias("i")).distinct()


def _star_pairs(now: DataFrame, step: int) -> DataFrame:
    """``a, b`` of members of a shingle and a few of them, in each round others, that lie in other classes."""
    seeds = [F.xxhash64("node", F.lit(OFFERS * step + k)) for k in range(OFFERS)]
    firsts = F.array_distinct(F.array(*[F.min_by(F.struct("node", "class", "n", "i", "c"), seed) for seed in seeds]))
    offered = now.groupBy("shingle").agg(firsts.alias("h")).select("shingle", F.explode("h").alias("h")).select("shingle", "h.*")
    other = offered.select(
        "shingle", F.col("node").alias("b"), F.col("class").alias("b_class"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d")
    )
    near = (F.col("class") != F.col("b_class")) & _may_reach(F.col("n"), F.col("i"), F.col("m"), F.col("j")) & _enough_shared(F.least("c", "d"))
    met = now.select("shingle", F.col("node").alias("a"), "n", "i", "class", "c").join(other, "shingle").where(near)
    shared = met.groupBy("a", "b", "n", "m").agg(F.count("*").alias("both")).where(_enough_shared(F.col("both")))
    return shared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def all_pairs(now: DataFrame) -> DataFrame:
    """``a, b`` of all members of a shingle that lie in different classes and may reach the threshold."""
    other = now.select(
        "shingle", F.col("node").alias("b"), F.col("class").alias("b_class"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"),
        *[F.col(p).alias(f"q{p}") for p in PARITY],
    )
    near = (F.col("class") > F.col("b_class")) & _reach_from(F.col("n"), F.col("i"), F.col("m"), F.col("j")) & _enough_shared(F.least("c", "d"))
    met = now.withColumnRenamed("node", "a").join(other, "shingle").where(near & _near_by_parity())
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_classes(docs: DataFrame, heads: DataFrame, text: str, counts) -> DataFrame:
    """``node, root`` of nodes that are not the root of their class.

    Rounds of stars first: each prefix shingle offers its members a few of them,
    in each round others by a hash, so that members of one group meet the
    same few.  What they link is not paired again.  When a round links nothing,
    or after ``STAR_ROUNDS``, all members of different classes are joined.
    What only one round reads is removed when the round ends.
    """
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        rows = durable(shared_prefixes(docs, text, counts))
    links, roots, last = None, None, False
    for step in range(STAR_ROUNDS + 1):
        last = last or step == STAR_ROUNDS
        with Steps(docs.sparkSession) as steps:
            now = _with_class(rows, roots)
            least, most = F.min("class").alias("least"), F.max("class").alias("most")
            mixed = now.groupBy("shingle").agg(least, most).where("least < most").select("shingle")
            # no two sets share more prefix shingles than either has left here
            now = now.join(mixed, "shingle").withColumn("c", F.count("*").over(W.partitionBy("node")))
            if last:
                now = now.join(heads.select("node", *PARITY), "node")
            now = durable(now)
            pairs = durable(all_pairs(now) if last else _star_pairs(now, step))
            with arrow_rows(docs.sparkSession, TEXT_ROWS):
                found = None if pairs.isEmpty() else steps.keep(verified(pairs, docs, heads, text))
            if found is not None and not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                roots = steps.keep(components(links))
            elif not last:
                last = True
                continue
        if last:
            break
    return docs.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    Two texts link when 100 x intersection >= 75 x union of their shingle sets.
    Texts without words (NULL, empty, white space) have no shingles and link
    with nothing; their component is their own id.  Equal sets always link.
    Rows that share an id are judged by their own texts.  A NULL id is no
    node's smallest id; a class of NULL ids only has a NULL component.  An
    empty table gives an empty result.  Other columns are not returned.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    named = named.withColumn("t", F.xxhash64("key", "text"))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        sized, sketch = read_sets(named, "text")
    counts = docs.sparkSession.sparkContext.broadcast(rarity(sketch))
    with Steps(docs.sparkSession) as steps:
        # equal sets have equal parities
        first = F.min(F.struct(F.coalesce("key", F.lit(2**63 - 1)).alias("k"), "key", "t", *PARITY)).alias("h")
        heads = durable(sized.where("n > 0").groupBy("node").agg(first).select("node", "h.key", "h.t", *[f"h.{p}" for p in PARITY]))
        roots = link_classes(named.where("text IS NOT NULL"), heads, "text", counts)
        classes = steps.keep(_with_class(heads.select("node", "key"), roots))
    least = classes.groupBy("class").agg(F.min("key").alias("component"))
    found = classes.join(least, "class").select("node", "component")
    joined = sized.join(found, "node", "left")
    return joined.select(
        F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id")
    )


ORACLE = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + {SHINGLE - 1}], ' ') AS shingle
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
