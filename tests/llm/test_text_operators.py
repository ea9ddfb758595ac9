"""Text operators against brute force, on the given small tables and on awkward rows."""

import base64
import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contractlens.llm import jaccard, licenses, mixing, passages, quality, tokens
from contractlens.llm.common import by_slice
from contractlens.llm.queries import RANKS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977} the {i}" for i in range(9000))
ROWS = [
    (1, None, "en", "s"), (2, "", "en", None), (3, "  \n\t ", None, "s"), (4, "a", "en", "s"), (5, "a b c d e f g", "en", "s"),
    (5, "a b c d e f g", "en", "s"), (6, "A B C D E F G", "de", "s"), (None, "a b c d e f g", "en", "s"), (7, LONG, "en", "t"),
    (8, LONG.replace("w5 ", "x5 "), "en", "t"), (9, "x" * 40_000, "en", "t"), (10, "Licensed under the MIT License. cc by nc", "en", "s"),
    (11, "　 é ü " * 50, "fr", "s"), (12, " ".join(["the same three"] * 60), "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lowered(text))


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    # columns that an operator might want for itself
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"n_words": F.lit("mine"), "ids": F.lit(1), "kept": F.lit("x"), "mix_copy": F.lit(0), "key": F.lit(0)})


def components(rows):
    """Smallest id reachable, by all pairs."""
    sets = []
    for i, text in rows:
        w = words(text)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(s), min(least[root(k)], default=None) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def test_jaccard_given(given):
    rows = [(r.doc_id, r.text) for r in given.collect()]
    assert sorted(map(tuple, jaccard.jaccard_components(given).collect()), key=repr) == components(rows)


def test_jaccard_awkward(spark, awkward):
    near = [(20 + k, " ".join(f"v{i}" for i in range(100) if i != 3 * k), "en", "s") for k in range(12)]
    df = awkward.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(near, SCHEMA))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=repr) == components(rows)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_of_copies_too_far_apart(spark, monkeypatch):
    """Copies of one text that do not reach each other are told apart before their sets are compared."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(120):
        w = [f"b{i}" for i in range(150)]
        for i in rng.choice(150, 1 if k % 10 == 0 else 4, replace=False):
            w[i] = f"x{k}_{i}"
        rows.append((k, " ".join(w)))
    compared, real = [], jaccard.verified

    def verified(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", verified)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == components(rows)
    assert compared[-1] < 1000, compared


def test_parities_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (rng.choice(3000, rng.integers(0, 600), replace=False).astype(np.uint64) << np.uint64(22) for _ in range(2))
        p, q = jaccard.parities([a, b])
        apart = sum(int(x).bit_count() for x in (p ^ q).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_passages(spark):
    rng = np.random.default_rng(1)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    shared, short, near = text(60), text(45), text(90)
    other = near.copy()
    other[45] = "changed"
    rows = [(1, [*text(40), *shared, *text(30)]), (2, [*text(10), *shared]), (3, [*shared, *text(200), *short]), (4, [*short, *text(80)]),
            (5, [*near, *text(20)]), (6, [*text(70), *other, *text(5)]), (7, text(300)), (8, shared), (9, None), (10, []), (None, shared), (8, shared)]
    df = spark.createDataFrame([(i, " ".join(t) if t is not None else None, 1) for i, t in rows], "doc_id long, text string, begin int")
    got = sorted(tuple(r)[:4] for r in passages.repeated_passages(df).collect())
    assert got == [(2, 1, 10, 60), (3, 1, 0, 60), (6, 5, 70, 90), (8, 1, 0, 60)]
    left = {(r.doc_id, r.text) for r in passages.drop_passages(df).collect()}
    kept = {i: " ".join(t) for i, t in rows if t is not None}
    assert {(1, kept[1]), (2, " ".join(rows[1][1][:10]) + " "), (4, kept[4]), (7, kept[7])} <= left
    assert 8 not in {i for i, _ in left} and (None, kept[None]) in left and (9, None) in left
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_compact_windows_cover_the_tree():
    rng = np.random.default_rng(2)
    for n in (10, 46, 200, 1000):
        h = rng.integers(0, 60 if n == 200 else 2**60, n).astype(np.uint64)
        at, first, last = passages.compact_windows(h, 12)
        want = []
        for i in range(n):
            a, b = i, i
            while a > 0 and h[a - 1] > h[i]:
                a -= 1
            while b < n - 1 and h[b + 1] >= h[i]:
                b += 1
            if b - a + 1 >= 12:
                want.append((i, a, b))
        assert list(zip(at.tolist(), first.tolist(), last.tolist(), strict=True)) == want


def encoder():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return P.path(RANKS), P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("keep_text", [True, False])
def test_tokens(spark, awkward, keep_text):
    path, pattern, exact = encoder()
    hard = [(100 + k, t, "en", "s") for k, t in enumerate(["a" * 60_000, " " * 50_000, ("ab 12,5 é\n" * 9000), "don't " * 8000 + "\n" * 3000, "x " + "\n" * 40_000 + "y"])]
    df = awkward.select("doc_id", "text", "lang", "source", "ids").union(spark.createDataFrame(hard, SCHEMA).withColumn("ids", F.lit(1)))
    coded = tokens.decode(tokens.encode(df, path, pattern, keep_text=keep_text), path, pattern)
    got = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.data)) for r in coded.collect())
    assert got == collections.Counter((r.doc_id, tuple(exact.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in df.collect())
    assert tokens.encode(df.limit(0), path, pattern).count() == 0


def base(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, given, awkward):
    for df in (given, awkward, awkward.limit(0)):
        judged = quality.judge(df)
        got = collections.Counter((r.doc_id, *(r[c] for c in quality.BASE), r.base_failed) for r in judged.collect())
        want = collections.Counter()
        for r in df.collect():
            b = base(r.text)
            want[(r.doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
        assert got == want
        assert judged.where("base_failed AND kept").count() == 0


def test_quality_fences_follow_the_group(spark):
    plain = " ".join(f"word{i}" for i in range(100))
    rows = [(i, plain + " #" * (i % 3), "en", "a") for i in range(200)] + [(1000 + i, plain + " #" * (40 + i % 3), "en", "b") for i in range(200)]
    rows += [(2000, plain + " #" * 45, "en", "a"), (2001, plain + " #" * 45, "en", "b")]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == {r[0] for r in rows} - {2000}


def test_bucket_is_monotone_and_narrow(spark):
    df = spark.range(0, 200_000, 7).withColumn("b", quality.bucket(F.col("id")))
    assert df.where("b > id OR id - b > id / 32").count() == 0


def test_licenses(spark, given, awkward):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for df in (given, awkward):
        for r, s in zip(df.select("doc_id", "text").collect(), licenses.scan_licenses(df).collect(), strict=True):
            w = pattern.findall(lowered(r.text))
            places, labels = [], set()
            for phrase, label in licenses.BASE.items():
                p = phrase.split()
                found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
                places += found
                labels |= {label} if found else set()
            assert (s.n_words, s.n_base, s.first_word, s.last_word, s.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
            assert labels <= set(s.labels.split(",")) and 0 <= s.score <= 1


def test_license_suppression(spark):
    text = "GNU Lesser General Public License, version 2.1. All rights reserved; Creative Commons Attribution-NonCommercial 4.0"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "all-rights-reserved,cc-by-nc-4.0,lgpl-2.1" and row.score == 1.0


def test_mixing(spark, awkward):
    rows = [(i, "x" * 10, "en", "big" if i % 10 else "small") for i in range(4000)] + [(9999, "x", "en", "tiny"), (10000, None, "en", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix_sources(df)
    mass = {r.source: r.m for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("m")).collect()}
    # three sources with mass, a third of the 40,001 characters each; the tiny one is 13,334 copies of one text
    assert all(abs(mass[s] - 13_334) < 1_500 for s in ("big", "small", "tiny")) and None not in mass
    keys = [r.mix_key for r in mixed.select("mix_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixing.mix_sources(awkward).columns[: len(awkward.columns) - 1] == [c for c in awkward.columns if c != "mix_copy"]
    assert mixing.mix_sources(df.limit(0)).count() == 0
    only = mixing.mix_sources(df, {"big": 1.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"big"}


def test_ids_hash(spark, sf):
    import __spark_entry__ as entry

    _, _, exact = encoder()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in entry.queries()["op5_tokens"](spark, sf).collect():
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_texts_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """However many rows a task has, neither the engine nor Python holds many texts, or their words, at once."""
    seen, write = [], jaccard.durable

    def durable(df):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return write(df)

    monkeypatch.setattr(jaccard, "durable", durable)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(1, 41)), "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        assert [tuple(r) for r in jaccard.jaccard_components(df).orderBy("doc_id").collect()] == [(0, 36, 0), (1, 36, 0), (2, 1, 2)]
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(seen) >= 3 and max(seen) <= 512
    batch = pa.record_batch([pa.array(["word " * 200] * 4000)], names=["text"])
    parts = list(by_slice("text", lambda part: part)([batch]))
    assert sum(p.num_rows for p in parts) == 4000 and max(p.num_rows for p in parts) * 1000 < 1 << 20
