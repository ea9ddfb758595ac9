"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length one.  A coarse quantiser puts each into one
inverted list; what remains is coded by product quantisation, one byte for each
subspace.  Each vector then probes the lists nearest to it: a table of the dot
products of its parts with all code words gives the approximate cosine to every
member by look-ups, and the members that come near the threshold are compared
exactly.  Lists are per label, and long ones are cut into blocks that meet
block by block, so no task holds a whole hot list.  A block reports counts and
a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.components import components
from contractlens.operators.scale import attach, durable

LEAST_COSINE = 0.93

# Vectors that the quantisers are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000

# Members or probes of a block.
BLOCK = 512

PARTS = 16
WORDS = 256

# Rounding of estimates in single precision.
ROUNDING = 1e-4

# Lists that a vector probes, for each root of the number of lists.
PROBE_ROOT = 1.5


def list_count(n: int) -> int:
    """Inverted lists for ``n`` vectors: about a quarter of the square root, a power of two."""
    return 2 ** max(2, min(12, round(math.log2(max(n, 1)) / 2) - 1))


def probe_count(lists: int) -> int:
    """Lists that a vector probes, of so many: eight, and more with the root of their number."""
    return min(lists, max(8, round(PROBE_ROOT * lists**0.5)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """``k`` centres (fewer if there are fewer points), by Lloyd's rounds from random points."""
    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres, np.float64)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = (sums[full] / counts[full, None]).astype(np.float32)
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


class Quantiser:
    """Coarse centres and the code words of the residuals' parts."""

    def __init__(self, sample: np.ndarray, lists: int) -> None:
        self.centres = kmeans(sample, lists)
        rest = sample - self.centres[_nearest(sample, self.centres)] if len(sample) else sample
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.words = [kmeans(rest[:, cut], WORDS) for cut in self.cuts]

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        half = (self.centres**2).sum(1) / 2
        count = min(count, len(self.centres))
        return np.argsort(half - x @ self.centres.T, axis=1, kind="stable")[:, :count]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        return np.stack([_nearest(rest[:, cut], words) for cut, words in zip(self.cuts, self.words, strict=True)], 1).astype(np.uint8)

    def least_estimates(self, members: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """For each member, the least approximate cosine that a vector at LEAST_COSINE or more of it can have."""
        coded = np.repeat(self.centres[list_no][None].astype(np.float64), len(codes), 0)
        for part, (cut, words) in enumerate(zip(self.cuts, self.words, strict=True)):
            coded[:, cut] += words[codes[:, part]]
        along = (coded * members).sum(1)
        across = np.sqrt(((coded - along[:, None] * members) ** 2).sum(1))
        at_least = LEAST_COSINE * along - math.sqrt(1 - LEAST_COSINE**2) * across
        return np.where(along >= 0, at_least, -np.hypot(along, across)) - ROUNDING

    def estimates(self, x: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of the rows of ``x`` with the coded members of a list."""
        total = np.repeat((x @ self.centres[list_no])[:, None], len(codes), 1)
        for part, (cut, words) in enumerate(zip(self.cuts, self.words, strict=True)):
            total += (x[:, cut] @ words.T)[:, codes[:, part]]
        return total


def _unit(vectors: list, size: int) -> np.ndarray:
    x = np.asarray(vectors, np.float64).reshape(len(vectors), size)
    # scaled first, so that neither very large nor very small vectors lose their length
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _packed(vectors: list, size: int) -> list[bytes]:
    """Each vector as bytes, in single precision where that says the same."""
    x = np.asarray(vectors, np.float64).reshape(len(vectors), size)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    same = (short == x).all(1)
    return [(s if k else v).tobytes() for s, v, k in zip(short, x, same.tolist(), strict=True)]


def _unpacked(rows: list[bytes], size: int) -> np.ndarray:
    return _unit([np.frombuffer(r, np.float32 if len(r) == 4 * size else np.float64) for r in rows], size)


def _index_rows(quantiser):
    """Each vector as a member of its own list, and as a probe of its nearest ones."""

    def run(batches):
        q = quantiser.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                x = _unit(part.column("v").to_pylist(), q.centres.shape[1])
                near = q.probes(x.astype(np.float32), probe_count(len(q.centres))).astype(np.int32)
                codes = q.codes(x.astype(np.float32), near[:, 0])
                n, p = near.shape
                rows = np.concatenate([np.arange(n), np.repeat(np.arange(n), p)])
                lists = np.concatenate([near[:, 0], near.ravel()]).astype(np.int32)
                code = pa.array([c.tobytes() for c in codes] + [None] * (n * p), pa.binary())
                raw = _packed(part.column("v").to_pylist(), x.shape[1])
                probed = pa.array([c.tobytes() for c in near] + [None] * (n * p), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(rows), pa.array(lists), part.column("node").take(rows),
                        part.column("copies").take(rows), code, pa.array([raw[i] for i in rows], pa.binary()),
                        pa.array(near[rows, 0]), probed,
                    ],
                    names=["label", "list", "node", "copies", "code", "x", "own", "probed"],
                )

    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _block_links(quantiser):
    """Links between the probes and the members of one block.

    Returns for each probe how many vectors it links to here (``n``, with
    ``b`` NULL), the same for members whose own probes do not reach the other
    side, and links that join all that is joined within the block.
    """

    def run(table: pa.Table) -> pa.Table:
        q = quantiser.value
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = _unpacked(table.column("x").to_pylist(), q.centres.shape[1])
        code = table.column("code")
        member = np.asarray(code.is_valid())
        none = _FOUND.empty_table()
        if member.all() or not member.any():
            return none
        codes = np.frombuffer(b"".join(c for c in code.to_pylist() if c is not None), np.uint8).reshape(int(member.sum()), -1)
        probes, members = x[~member], x[member]
        list_no = int(table.column("list")[0].as_py())
        rough = q.estimates(probes.astype(np.float32), list_no, codes)
        i, j = np.nonzero(rough >= q.least_estimates(members, list_no, codes))
        a, b = nodes[~member], nodes[member]
        differ = a[i] != b[j]
        i, j = i[differ], j[differ]
        exact = np.concatenate([(probes[i[k : k + 8192]] * members[j[k : k + 8192]]).sum(1) for k in range(0, len(i), 8192)] or [np.zeros(0)])
        good = exact >= LEAST_COSINE
        i, j = i[good], j[good]
        if not len(i):
            return none
        counts = np.bincount(i, weights=copies[member][j], minlength=len(a)).astype(np.int64)
        linked = np.flatnonzero(counts)
        # a member that does not probe the list of a probe cannot find it, so the link counts for it here
        probed = np.frombuffer(b"".join(r for r in table.column("probed").to_pylist() if r is not None), np.int32).reshape(len(b), -1)
        own = table.column("own").to_numpy()[~member]
        blind = ~np.concatenate([(probed[j[k : k + 8192]] == own[i[k : k + 8192], None]).any(1) for k in range(0, len(i), 8192)])
        back = np.bincount(j[blind], weights=copies[~member][i[blind]], minlength=len(b)).astype(np.int64)
        met = np.flatnonzero(back)
        joins = _forest(a[i], b[j])
        return pa.table(
            {
                "a": np.concatenate([a[linked], b[met], joins[:, 0]]),
                "b": pa.array([None] * (len(linked) + len(met)) + joins[:, 1].tolist(), pa.int64()),
                "n": pa.array(counts[linked].tolist() + back[met].tolist() + [None] * len(joins), pa.int64()),
            },
            schema=_FOUND,
        )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links of nodes to the smallest of their class, for the graph of the links ``a, b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.arange(len(nodes)) != label
    return np.stack([nodes[own], nodes[label[own]]], 1)


def usable(vectors: DataFrame, vec: str, label: str) -> DataFrame:
    """Rows whose vector can be compared: label, no NULL or non-finite component, not zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.where(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0))


def find_links(classes: DataFrame) -> DataFrame:
    """``a, b, n`` of ``_block_links`` for distinct vectors ``node, label, v, copies`` of one size."""
    spark = classes.sparkSession
    n, size = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "a long, b long, n long")
    sample = classes.orderBy(F.xxhash64(F.lit(1), "node")).limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    quantiser = spark.sparkContext.broadcast(Quantiser(_unit([r.v for r in sample], size).astype(np.float32), list_count(n)))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = classes.repartition(parts, "node").mapInArrow(
        _index_rows(quantiser), f"label {classes.schema['label'].dataType.simpleString()}, list int, node long, copies long, code binary, x binary, own int, probed binary"
    )
    rows = durable(rows)
    sizes = rows.groupBy("label", "list").agg(
        F.ceil(F.count("code") / BLOCK).cast("int").alias("members"), F.ceil((F.count("*") - F.count("code")) / BLOCK).cast("int").alias("probes")
    )
    cut = attach(rows, sizes.where("members > 0"), ["label", "list"])
    # a member goes to its own block against all blocks of probes, a probe the other way round
    block = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members = cut.where("code IS NOT NULL").withColumns({"mb": block("members", 1)}).withColumn("pb", every("probes"))
    probes = cut.where("code IS NULL").withColumns({"pb": block("probes", 2)}).withColumn("mb", every("members"))
    return members.unionByName(probes.select(members.columns)).groupBy("label", "list", "mb", "pb").applyInArrow(
        _block_links(quantiser), "a long, b long, n long"
    )


def vector_components(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``vectors``.

    Vectors of equal labels link when their cosine, in double precision, is at
    least 0.93.  Links below are never reported; of those above, only pairs
    can be missed where neither vector probes the other's list (recall is
    measured in the tests).  Equal vectors are indexed once and counted as
    often as they occur.  Vectors that are NULL, empty, zero or hold NULL or
    non-finite components, and those without label, link with nothing; so do
    vectors of different sizes.  A NULL id is never a component's smallest id.
    An empty table gives an empty result.
    """
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"), F.col(label).alias("label"))
    named = named.withColumn("node", F.xxhash64("label", "v"))
    good = durable(usable(named, "v", "label"))
    classes = durable(
        good.groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    )
    sizes = [r[0] for r in classes.select(F.size("v")).distinct().limit(1000).collect()]
    if len(sizes) == 1000:
        raise ValueError("vectors of a thousand sizes or more are not compared")
    found = None
    for size in sizes:
        part = find_links(classes.where(F.size("v") == size))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    found = durable(found)
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    joined = classes.select("node", "copies", "least").join(roots, "node", "left").join(counts, "node", "left")
    joined = durable(joined.select("node", "copies", "least", F.coalesce("root", "node").alias("root"), F.coalesce("others", F.lit(0)).alias("others")))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    per_node = joined.join(least, "root").select("node", "component", (F.col("others") + F.col("copies") - 1).alias("links"))
    compared = good.select("vec_id", "node").join(per_node, "node")
    rest = named.join(good.select("node").distinct(), "node", "left_anti")
    linked = compared.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, q, sqrt(list_sum([x * x FOR x IN q])) AS norm FROM (
    SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.q, b.q) >= 0.93 * a.norm * b.norm
),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.other
),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)
"""
