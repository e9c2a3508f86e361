"""The numeric kernels against brute force and known results."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presencia.kernels import clustering, curves, factor
from presencia.operators.enrich import hypergeometric_tail


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=9))
def test_kmeans_is_optimal(values):
    x = np.array(values, float)
    labels = clustering.kmeans_1d(x, 3)
    cost = lambda parts: sum(((p - p.mean()) ** 2).sum() for p in parts if len(p))
    uniq = np.unique(x)
    cuts = [()] if len(uniq) < 2 else list(itertools.combinations(uniq[1:], min(2, len(uniq) - 1)))
    best = min(cost([x[np.searchsorted(c, x, "right") == i] for i in range(len(c) + 1)]) for c in cuts)
    assert cost([x[labels == k] for k in range(3)]) == pytest.approx(best, abs=1e-9)
    assert all(a <= b for a, b in itertools.pairwise(labels[np.argsort(x, kind="stable")]))


def test_kmeans_of_many_values_is_fast():
    x = np.random.default_rng(0).random(60_000)
    labels = clustering.kmeans_1d(x, 3)
    assert np.bincount(labels).tolist() == pytest.approx([20_000] * 3, rel=0.05)


def _ward_plain(points):
    groups, n, out, ids = [[i] for i in range(len(points))], len(points), [], list(range(len(points)))
    while len(groups) > 1:
        best = None
        for i, j in itertools.combinations(range(len(groups)), 2):
            a, b = points[groups[i]], points[groups[j]]
            d = math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(a.mean(0) - b.mean(0))
            if best is None or d < best[0] - 1e-12:
                best = (d, i, j)
        d, i, j = best
        out.append((d, len(groups[i]) + len(groups[j]), frozenset(groups[i] + groups[j])))
        merged = groups[i] + groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
    del n, ids
    return out


def test_ward_joins_what_costs_least():
    points = np.random.default_rng(3).normal(size=(18, 3))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    links = clustering.ward(d)
    plain = _ward_plain(points)
    assert links[:, 2] == pytest.approx([p[0] for p in plain]) and links[:, 3].tolist() == [p[1] for p in plain]
    assert [frozenset(m) for m in clustering.members(links)[18:]] == [p[2] for p in plain]
    labels = clustering.cut_tree(links, links[-3, 2])
    assert labels.max() == 3 and labels[0] == 1
    c = clustering.cophenetic(links)
    assert c.max() == pytest.approx(links[-1, 2]) and (np.diag(c) == 0).all()
    assert len(clustering.ward(np.zeros((1, 1)))) == 0


def test_elbow():
    assert clustering.elbow_index(np.array([1, 1, 1, 1, 1, 50, 100])) == 4
    assert clustering.elbow_index(np.array([3.0])) == 0


def test_density_clusters_of_blobs_and_noise():
    rnd = np.random.default_rng(5)
    blobs = np.concatenate([rnd.normal(c, 0.3, (60, 2)) for c in ((0, 0), (8, 8), (0, 9))] + [rnd.uniform(-15, 25, (12, 2))])
    labels, validity = clustering.hdbscan(blobs, 15, 5)
    assert labels.max() == 2 and validity > 0.3
    for k in range(3):
        part = labels[60 * k : 60 * k + 60]
        assert (part == np.bincount(part[part >= 0]).argmax()).mean() > 0.85
    assert (labels[180:] == -1).mean() > 0.5
    assert clustering.silhouette(blobs[:180], np.repeat([0, 1, 2], 60)) > 0.8
    assert clustering.hdbscan(blobs[:1], 5, 5)[0].tolist() == [-1]


def test_nnls_unit_case_and_optimality():
    l = np.array([[0.5, 0.3], [0.2, 0.7]])
    got = np.stack([factor.nnls(l.T @ l, l.T @ e) for e in np.eye(2)], 1)
    assert np.diag(got) == pytest.approx([0.5 / 0.29, 0.7 / 0.58]) and got[0, 1] == got[1, 0] == 0
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = rnd.normal(size=(12, 5)), rnd.normal(size=12)
        x = factor.nnls(a.T @ a, a.T @ b)
        grad = a.T @ (a @ x - b)
        assert (x >= 0).all() and (grad > -1e-7).all() and abs(grad @ x) < 1e-6
    assert factor.nnls(np.zeros((2, 2)), np.zeros(2)).tolist() == [0, 0]


def test_nmf_recovers_planted_blocks():
    x = np.zeros((60, 30))
    for k in range(3):
        x[20 * k : 20 * k + 20, 10 * k : 10 * k + 10] = 1
    w, h, steps = factor.nmf(x, 3)
    assert steps < 2000 and (w >= 0).all() and (h >= 0).all() and np.abs(w @ h - x).max() < 1e-2
    assert len(set(w.argmax(1))) == 3 and all(len(set(w.argmax(1)[20 * k : 20 * k + 20])) == 1 for k in range(3))
    w5, h5, _ = factor.nmf(x, 5, 300)
    assert np.linalg.norm(x - w5 @ h5) < 0.1


def test_mca_inertia_of_a_table():
    x = np.random.default_rng(2).integers(0, 2, (50, 4))
    z = np.concatenate([x, 1 - x], 1).astype(float)
    p = z / z.sum()
    r, c = p.sum(1), p.sum(0)
    s = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), compute_uv=False)
    burt = factor.mca_inertia(z.T @ z, 4)
    assert np.sqrt(burt) * 0 + burt == pytest.approx(s[:4] ** 4, abs=1e-9) or burt == pytest.approx(s[:4] ** 2, abs=1e-9)


def test_heaps_and_golden_section():
    lam, kappa = curves.heaps(120 * np.arange(1, 40) ** 0.37)
    assert (lam, kappa) == (pytest.approx(0.37, abs=1e-5), pytest.approx(120, rel=1e-4))
    assert curves.heaps(np.zeros(5)) == (0.0, 0.0)
    assert curves.golden_section(lambda x: (x - 2) ** 2, 0, 5) == pytest.approx(2, abs=1e-6)


def test_dual_power_fit_follows_the_curve():
    n = 51
    x = np.arange(1, n)
    y = np.cumsum(900 * x**-1.8 + 400 * (n - x) ** -2.2 + 2)
    fit = curves.dual_power(x, y)
    assert fit["r_squared"] > 0.98 and 1 < fit["inflection"] < n - 1
    assert 0 < fit["unique_max"] < fit["inflection"] < fit["core_min"] <= n - 1


def test_hypergeometric_tail():
    exact = lambda n, f, q, k: sum(math.comb(f, i) * math.comb(n - f, q - i) for i in range(k, min(f, q) + 1)) / math.comb(n, q)
    for n, f, q in ((20, 7, 5), (50, 1, 30), (10, 10, 3), (9, 4, 8)):
        for k in range(0, min(f, q) + 2):
            assert hypergeometric_tail(n, f, q, k) == pytest.approx(exact(n, f, q, k), abs=1e-12)
    assert hypergeometric_tail(2000, 320, 80, 20) == pytest.approx(exact(2000, 320, 80, 20), rel=1e-9)


def test_embedding_keeps_groups_together():
    from presencia.kernels import embedding

    rnd = np.random.default_rng(2)
    x = np.concatenate([(rnd.random((40, 60)) < p).astype(float) for p in (np.r_[np.full(30, 0.9), np.full(30, 0.05)], np.r_[np.full(30, 0.05), np.full(30, 0.9)])])
    y = embedding.densmap(x, 8)
    assert y.shape == (80, 3) and np.isfinite(y).all() and (embedding.densmap(x, 8) == y).all()
    within = np.linalg.norm(y[:40] - y[:40].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:40].mean(0) - y[40:].mean(0)) > 2 * within
    i, j, w = embedding.fuzzy_graph(embedding.cosine_distances(x), 8)
    assert (i < j).all() and (w > 0).all() and (w <= 1).all()
    assert embedding.densmap(x[:3], 8).tolist() == [[0, 0, 0]] * 3
