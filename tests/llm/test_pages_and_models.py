"""Extraction, archives, vectors, toxicity and the pipeline."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contractlens.llm import components, extraction, toxicity, vectors, warc
from contractlens.llm.markup import blocks

PAGE = "page_id long, url string, html string"
ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">'
    '<nav><ul><li><a href="/a">Menu</a></ul></nav><header>Site</header><div class="ad">Buy</div><!-- note -->'
    "<article><header><h1>Head &amp; line</h1></header><p>One <b>b</b>old&nbsp;\n text<br>next<p>Two<form>Mail</form>"
    '<div class="share-buttons">Share</div><aside>Beside</aside><p>Three &lt;x&gt;</article><section id="comments"><p>Nice!</section>'
    '<div role="alert">Cookies</div><footer>&copy; us</footer></body></html>'
)


def test_article_blocks(spark):
    rows = [(1, "http://h/1", ARTICLE), (2, None, None), (3, "::bad", ""), (1, "http://h/1", ARTICLE), (4, "http://h/4", "<article>open <p>end")]
    df = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash"))
    got = collections.Counter(tuple(r) for r in extraction.extract_main_text(df).collect())
    text = "Head & line One bold text next Two Three <x>"
    assert got == collections.Counter({(1, "http://h/1", text, len(text)): 2, (2, None, "", 0): 1, (3, "::bad", "", 0): 1, (4, "http://h/4", "open end", 8): 1})
    assert extraction.extract_main_text(df.limit(0)).count() == 0


def test_repeated_runs_of_a_host_go(spark):
    line = "read our other stories about many things today"
    page = lambda i: f"<body><div>{line}</div><div>story number {i} tells {i} unique things about {i}</div><p>{line} indeed</p></body>"
    rows = [(i, "http://one.example/x", page(i)) for i in range(5)] + [(9, "http://two.example/x", page(9))]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[3] == "story number 3 tells 3 unique things about 3"
    assert got[9].startswith(line)  # the only page of its host


@pytest.mark.parametrize("piece", ["<script ", "<!-- ", "<p title='", '<a b="', "<div>", "<div class=ad>", "</div>", "<", "<li>", "<td>"])
def test_markup_is_linear(piece):
    import time

    begin = time.perf_counter()
    blocks(piece * (200_000 // len(piece)))
    assert time.perf_counter() - begin < 2


def test_archives(spark, tmp_path):
    long = "p" * 99 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a/\r\nX: 1", long), (3, None, long), (9, "u", long), (3, None, long), (None, "n", long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "q" * 3_000_000)]
    df = spark.createDataFrame(rows, PAGE).withColumn("record_type", F.lit("clash")).repartition(3)
    got = collections.Counter(tuple(r) for r in warc.archive_round_trip(df, str(tmp_path / "w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect())
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == long and i != 3
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None, None if again else html or "")] += 1
    assert got == want
    index = spark.read.parquet(str(tmp_path / "w/index"))
    some = warc.read_records(index.where("page_id IN (4, 9)")).collect()
    assert sorted((r.page_id, r.record_type) for r in some) == [(4, "response"), (9, "revisit")]
    assert warc.archive_round_trip(df.limit(0), str(tmp_path / "none")).count() == 0


def brute_links(rows):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if v is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        unit[k] = np.asarray(v, float) / np.linalg.norm(v)
    links = collections.defaultdict(set)
    for a in unit:
        for b in unit:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a].add(b)
    return links


def test_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        centre = rng.normal(size=16)
        for _ in range(1 + i % 4):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.12).tolist(), i % 3))
    rows += [(len(rows) + k, rows[7][1], rows[7][2]) for k in range(40)]  # copies
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None], 1), (5003, [float("nan")] * 16, 1), (5004, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5005, [], 1), (5006, [3.0, 4.0], 1), (5006, [6.0, 8.0], 1), (5007, [1e-200] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in vectors.vector_components(df).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    links = brute_links(rows)
    assert sum(map(len, got.values())) == len(rows)
    total = found = 0
    for k, (i, _, _) in enumerate(rows):
        n = max(x[0] for x in got[i])
        total, found = total + len(links[k]), found + min(n, len(links[k]))
        assert n <= len(links[k])
    assert found >= 0.98 * total
    assert vectors.vector_components(df.limit(0)).count() == 0


def test_vector_recall_on_given_noise(spark):
    """Recall against brute force with the parameters in use, on 64 dimensions."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    near = np.repeat(base[:200], 3, 0) + rng.normal(size=(600, 64)) * 0.25
    x = np.concatenate([base, near])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = (u @ u.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vectors.vector_components(df).collect()}
    assert exact.sum() > 500 and sum(min(got[i], exact[i]) for i in got) >= 0.9 * exact.sum() and all(got[i] <= exact[i] for i in got)


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (350, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.zipf(1.3, 120) % 3000)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 10 == 0
        rows.append((i, text() + (" Vile, scorn. nasty" if bad else "")))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "vile scorn nasty"), (2002, "vile scorn nasty"), (2002, "vile scorn nasty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 1500:
            assert r.predicted == int(r.doc_id % 10 == 0)
    assert {r.predicted for r in got if r.doc_id == 2002} == {1} and {r.predicted for r in got if r.text in (None, "")} == {0}
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0
    assert toxicity.score_toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.durable(stage(spark, docs, sf))
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        docs = out
    assert all(r.text == given[r.doc_id].text or len(r.text) < len(given[r.doc_id].text) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_the_fit_makes_the_ranking():
    rng = np.random.default_rng(5)
    usual = lambda: rng.integers(0, 400, 30)
    toxic = lambda: np.unique(np.append(usual(), rng.integers(500, 505, 2))).astype(np.int32)
    clean = lambda: np.unique(usual()).astype(np.int32)
    positive, unlabelled = [toxic() for _ in range(200)], [toxic() if k % 10 == 0 else clean() for k in range(2000)]
    bad, good = [toxic() for _ in range(200)], [clean() for _ in range(200)]
    fitted, unfitted = (toxicity.Classifier(positive, unlabelled, 0.1, steps) for steps in (toxicity.STEPS, 0))
    auc = lambda m: (m.scores(bad)[:, None] > m.scores(good)[None]).mean() + (m.scores(bad)[:, None] == m.scores(good)[None]).mean() / 2
    assert auc(unfitted) == 0.5 and auc(fitted) > 0.99


def test_scores_do_not_depend_on_partitions_or_repeated_ids(spark):
    rows = [(k % 90, f"word{k % 7} word{k % 5} " + ("vile awful" if k % 3 == 0 else "kind plain") + f" x{k}") for k in range(120)]
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [{(r.doc_id, r.text): r.score for r in toxicity.score_toxicity(d, marks).collect()} for d in (docs.repartition(7), docs.coalesce(1).orderBy("text"))]
    assert scores[0] == scores[1] and len(scores[0]) == 120
