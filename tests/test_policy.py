"""The learnt policy against numpy, over the whole small tables and several epochs."""

import math

import numpy as np
import pytest

from siftwork.operators import policy
from siftwork.plans import QUERIES
from siftwork.plans.fragments import features
from siftwork.plans.policy import EPOCHS, PRICE, outcomes


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8])
def test_jacobi_is_numpys(n):
    rng = np.random.default_rng(n)
    for scale in (1e-12, 1.0, 1e9):
        a = rng.normal(size=(n, n)) * scale
        for m in (a @ a.T, np.diag(np.arange(n, dtype=float)) * scale, np.ones((n, n)) * scale, np.zeros((n, n))):
            values, q = policy.jacobi(m)
            assert np.allclose(np.sort(values), np.linalg.eigvalsh(m), rtol=1e-9, atol=1e-9 * max(1e-300, np.abs(m).max()))
            assert np.allclose(q @ np.diag(values) @ q.T, m, rtol=1e-9, atol=1e-9 * max(1e-300, np.abs(m).max())) and np.allclose(q.T @ q, np.eye(n), atol=1e-9)


def root(c):
    values, q = np.linalg.eigh(c)
    return q @ np.diag(1 / np.sqrt(np.abs(values) + 1e-6)) @ q.T


def plain(rows, chosen, rewards):
    """[(weights, temperature, covariance)] after each epoch; rows (id, tokens, four features)."""
    x, tokens = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float)
    w = prior = np.array([0.30, 0.25, 0.25, 0.20])
    trace, tau, norm, c, out = np.zeros(len(x)), 2.0, 0.0, 1e-4 * np.eye(4), []
    for epoch in range(EPOCHS):
        a = np.array([float(r[0] in chosen[epoch]) for r in rows])
        p = 1 / (1 + np.exp(-(x @ w - PRICE * tokens) / max(tau, 0.01)))
        worth = np.maximum(0.01, x[:, 3])
        share = np.where(a > 0, np.clip(worth / max(0.01, (worth * a).sum()), 0.1, 3.0), 1.0)
        trace = 0.7 * trace + (a - p) * p * (1 - p) / max(tau, 0.01)
        g = (share * trace * rewards[epoch]) @ x
        size = np.sqrt((g * g).sum())
        tau = 2.0 if norm > 1e-8 and size > 3 * norm else max(0.1, tau * 0.998)
        norm = 0.95 * norm + 0.05 * size
        g = g - 0.10 / (1 + epoch / 50) * (w - prior)
        c = 0.95 * c + 0.05 * np.outer(g, g)
        w = np.clip(w + 0.01 * root(c) @ g, 0.05, 0.8)
        w = w / w.sum()
        out.append((w, tau, c))
    return out


def test_epochs_are_numpys(spark, sf):
    rewards, chosen = outcomes(spark, sf)
    by = [{r.doc_id for r in chosen.where(f"epoch = {e}").collect()} for e in range(EPOCHS)]
    rows = [(r.doc_id, r.tokens, r.recency, r.frequency, r.semantic, r.entropy) for r in features(spark, sf).collect()]
    assert len(set(rewards.values())) > 3 and all(by)
    want = plain(rows, by, rewards)
    got = sorted(QUERIES["lrn8_policy_update"](spark, sf).collect())
    for r, (w, tau, _) in zip(got, want, strict=True):
        assert np.allclose([r.recency, r.frequency, r.semantic, r.entropy], w, atol=1e-7) and abs(r.temperature - tau) < 1e-9
        assert abs(sum(r[1:5]) - 1) < 1e-9
    state = QUERIES["lrn9_spectral_state"](spark, sf).collect()
    for e, (_, _, c) in enumerate(want):
        values = np.linalg.eigvalsh(c)
        mine = sorted((r for r in state if r.epoch == e), key=lambda r: r.direction)
        assert np.allclose([r.energy for r in mine], np.abs(values)[::-1] / np.abs(values).sum(), rtol=1e-6)
        assert mine[0].condition == pytest.approx(math.sqrt(max(values.max(), 1e-10) / max(values.min(), 1e-10)), rel=1e-6)


def test_a_step_is_damped_where_gradients_vary():
    """Noise in one direction makes its steps small; a steady direction keeps its own."""
    p, rng = policy.Policy(), np.random.default_rng(0)
    for _ in range(200):
        p, step = policy.whitened(p, np.array([0.1, rng.normal() * 10, 0.0, 0.0]))
    _, step = policy.whitened(p, np.array([0.1, 0.1, 0.0, 0.0]))
    assert step[0] > 10 * abs(step[1]) and p.condition > 10 and abs(sum(p.energy) - 1) < 1e-9


def test_temperature_and_empty(spark):
    p = policy.Policy(temperature=1.0, norm=1.0)
    assert policy.cooled(p, 3.1, 5, None) == 2.0 and policy.cooled(p, 2.0, 5, None) == 0.998
    wanted = min(2.0, max(0.1, 8.0 / (5 * math.log(2)) * 0.5))
    assert policy.cooled(p, 1.0, 5, 8.0) == pytest.approx(0.9 + 0.1 * wanted)
    none = spark.createDataFrame([], "id long, tokens long, recency double, frequency double, semantic double, entropy double, trace double, chosen boolean")
    assert policy.update(p, policy.credited(none, p, 0.0), 1.0) is p


def test_eigenvalues_of_odd_matrices(spark):
    rows = [([2.0, 0.0, 0.0, 1.0],), ([5.0],), (None,), ([1.0, 2.0],), ([float("nan")] * 4,)]
    got = [r[0] for r in spark.createDataFrame(rows, "m array<double>").coalesce(1).select(policy.eigenvalues("m")).collect()]
    assert got == [[2.0, 1.0], [5.0], None, None, None]


def plain_alpha(hits):
    alpha = was = 2.0
    mean = had = 0.0
    for n, h in enumerate(hits, 1):
        mean = 0.95 * mean + 0.05 * bool(h)
        if n % 50 == 0:
            step = 0.05 * (mean - had) / (alpha - was) if abs(alpha - was) > 1e-6 else 0.1
            alpha, was, had = min(8.0, max(0.5, alpha + step)), alpha, mean
    return round(alpha, 6), round(mean, 6), len(hits)


def test_alpha_is_the_fold(spark, sf):
    """The query over all orders; a key that is null, nulls for hits, keys of one outcome and of many."""
    by = {}
    for r in spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").collect():
        by.setdefault(r.o_custkey // 10, []).append(r.o_orderpriority[0] in "12")
    got = {r.cache: (r.alpha, r.hits, r.n) for r in QUERIES["lrn34_adaptive_alpha"](spark, sf).collect()}
    assert got == {k: plain_alpha(v) for k, v in by.items()} and len({a for a, _, _ in got.values()}) > 3
    rng = np.random.default_rng(3)
    rows = [(k, n, None if rng.random() < 0.1 else bool(rng.random() < 0.2 + n / 900)) for k, size in ((None, 120), (1, 1), (2, 700), (3, 49)) for n in range(size)]
    found = {r.k: (round(r.alpha, 6), round(r.hits, 6), r.n) for r in policy.adaptive_alpha(spark.createDataFrame(rows, "k long, at long, hit boolean"), "k", "at", "hit").collect()}
    assert found == {k: plain_alpha([h for x, _, h in rows if x == k]) for k in (None, 1, 2, 3)}
