"""Links count for both ends, and recall with many lists."""

import numpy as np

from contractlens.llm import vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(rng, n, size, low, high):
    base = unit(rng.normal(size=(n, size)))
    u = rng.normal(size=base.shape)
    u = unit(u - (u * base).sum(1, keepdims=True) * base)
    c = rng.uniform(low, high, n)[:, None]
    return base, c * base + np.sqrt(1 - c * c) * u


def test_links_count_for_both_ends(spark, monkeypatch):
    """With a single probe, most links are found from one side at best."""
    monkeypatch.setattr(vectors, "probe_count", lambda lists: 3)
    rng = np.random.default_rng(21)
    base, near = pairs_at(rng, 1500, 24, 0.931, 0.95)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r.vec_id: r for r in vectors.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.asarray([r[1] for r in rows])
    exact = (unit(x) @ unit(x).T >= 0.93).sum(1) - 1
    joined = [i for i in range(1500) if got[i].component_id == got[1500 + i].component_id]
    assert 0 < len(joined) and all(got[i].n_links == got[1500 + i].n_links == 1 for i in joined if exact[i] == exact[1500 + i] == 1)
    assert all(r.n_links > 0 for r in got.values() if not r.kept)


def test_codes_lose_no_link():
    rng = np.random.default_rng(22)
    base, near = pairs_at(rng, 400, 64, 0.93, 0.94)
    q = vectors.Quantiser(unit(rng.normal(size=(1000, 64))).astype(np.float32), 32)
    lists = q.probes(base.astype(np.float32), 1)[:, 0]
    codes = q.codes(base.astype(np.float32), lists)
    for k in range(400):
        one = slice(k, k + 1)
        assert q.estimates(near[one].astype(np.float32), lists[k], codes[one])[0, 0] >= q.least_estimates(base[one], lists[k], codes[one])[0]


def test_recall_with_many_lists():
    """Vectors without any structure, and lists fitted on others: a pair is found if either side probes the other's list."""
    rng = np.random.default_rng(23)
    base, near = pairs_at(rng, 2000, 64, 0.93, 0.95)
    sample = unit(rng.normal(size=(20_000, 64))).astype(np.float32)
    for lists in (128, 1024, 4096):
        q = vectors.Quantiser.__new__(vectors.Quantiser)
        q.centres = vectors.kmeans(sample, lists, rounds=3)
        a, b = (q.probes(x.astype(np.float32), vectors.probe_count(lists)) for x in (base, near))
        found = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
        assert found.mean() >= 0.995, (lists, found.mean())
