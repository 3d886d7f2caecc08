"""Cosine search: single precision tells what is far, double precision measures the rest."""

import numpy as np
import pytest

from gearwatch.operators import vectors


def exact(q, c, keep, floor, own):
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.round(q @ c.T / size, 9)
    if own:
        np.fill_diagonal(score, np.nan)
    out = []
    for i, row in enumerate(score):
        order = sorted((-s, j) for j, s in enumerate(row) if np.isfinite(s) and (floor is None or s >= floor))[:keep]
        out += [(i, j, -s) for s, j in order]
    return out


@pytest.mark.parametrize("floor", [None, 0.15, 0.8])
@pytest.mark.parametrize("own", [False, True])
def test_sieve_finds_what_full_products_find(monkeypatch, floor, own):
    rng = np.random.default_rng(3)
    c = rng.standard_normal((3000, 24)) * np.exp(rng.standard_normal((3000, 1)) * 8)
    c[100] = c[2000] = c[7] * 3  # equal scores
    c[50] = 0
    q = c[:600].copy() if own else np.vstack([rng.standard_normal((598, 24)), np.zeros((1, 24)), c[7:8]])
    full, compare = [], vectors.Best._compare
    monkeypatch.setattr(vectors.Best, "_compare", lambda self, block, ids, *more: full.append(ids[0]) or compare(self, block, ids, *more))
    best = vectors.Best(np.arange(len(q)), q, 5, floor, "cosine", own)
    for at in range(0, len(c), 500):
        best.add(np.arange(at, at + 500), c[at : at + 500])
    got = [(int(q), int(i), float(s)) for f in best.result() for q, i, s in f[["q", "id", "score"]].itertuples(index=False)]
    want = exact(q, c, 5, floor, own)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in want], atol=2e-9)
    if floor != 0.8:
        assert set(full) == {0}  # every slice was compared in full before
