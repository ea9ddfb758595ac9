"""Collocations against brute force, and on awkward rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from contractlens.llm import collocations as C

SCHEMA = "text string, lang string, word string, n long, h1 long, level string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=10, covered=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            if len(p) == 2 and any(q[i : i + 2] == p and 100 * many[q] >= covered * a for q in many if len(q) == 3 for i in (0, 1)):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in C.collocations(df, **how).collect())


def made(seed, n=150):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "İ", "x y", "\U0001d11e", "Ab"]
    common = ["new york city", "of the", "ad hoc", "of the order", "a a a", "p q", "p q r"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", ";", "!", "\x0b", "? "]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.3 else rng.choice(words, p=None) for _ in range(rng.integers(1, 60))]
        rows.append(("".join(p + marks[rng.integers(len(marks))] for p in parts), [None, "en", "EN", "und", ""][i % 5 if i % 2 else 1]))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == brute(rows) and len(brute(rows)) > 10
    assert run(spark, rows, least=3, covered=80) == brute(rows, least=3, covered=80)


def test_best_first(spark, monkeypatch):
    """With few phrases asked for, the frontier opens in several rounds and passes."""
    rows = made(3, 300)
    opened, real = [], C._open
    monkeypatch.setattr(C, "_open", lambda texts, seed, front, least: opened.append(front.count()) or real(texts, seed, front, least))
    monkeypatch.setattr(C, "MARGIN", 1)
    few = dict(top=12, least=2, covered=20)  # most pairs are dropped, so one round is not enough
    assert run(spark, rows, **few) == brute(rows, **few)
    assert len(opened) > 1
    monkeypatch.setattr(C, "OPEN", 7)
    assert run(spark, rows, **few) == brute(rows, **few)
    monkeypatch.setattr(C, "OPEN", 1 << 20)
    opened.clear()
    rows = [(t, "en") for t, _ in rows]
    assert run(spark, rows, top=5, least=2, covered=100) == brute(rows, top=5, least=2, covered=100)
    some = sum(opened)
    opened.clear()
    run(spark, rows, top=10**6, least=2)
    assert some < sum(opened)  # the rest of the pairs was never opened


def test_awkward_rows(spark):
    assert run(spark, []) == [] and run(spark, [(None, "en"), ("", None), (" \t.", "x")]) == []
    long = "Deep sea diver " * 30_000
    rows = [(long, "en"), *[("ties go by phrase, by phrase ties go", None)] * 40, ("z" * 200_000, "en"), (None, None), ("one two", "de")]
    assert run(spark, rows) == brute(rows)


def test_hot_words_and_exact_products(spark):
    rows = [("the the the cat " * 50, "en")] * 200 + [("the", "en")]
    assert run(spark, rows) == brute(rows)
    frame = spark.createDataFrame([(3_000_000_007, 3_000_000_011, 3_000_000_019), (10**12, 10**12, 10**12)], "a long, l long, r long")
    assert [r[0] for r in frame.select(C._score("a", "l", "r")).collect()] == [10**6 * a * a // (l * r) for a, l, r in [(3_000_000_007, 3_000_000_011, 3_000_000_019), (10**12, 10**12, 10**12)]]
