"""What the classifiers learn, against plain versions: the boosted tables term by term, the machines against their optimum."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest

from antibiogram.llm import langid, quality_gam


def place(cuts, v):
    return sum(c <= v for c in cuts)


def cut_points(values, k):
    return sorted({float(np.quantile(values, q / k)) for q in range(1, k)})


def best_cut(g, h, ridge):
    """(gain, bins before the cut) over ordered bins, by trying every cut."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    found = [(value(0, k) + value(k, len(g)) - value(0, len(g)), k) for k in range(1, len(g))]
    return max(found, key=lambda f: (round(f[0], 12), -f[1])) if found else (0.0, 0)


def tree(g, h, ridge):
    parts = [(0, len(g))]
    while len(parts) < 3:
        gains = [(best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts]
        (gain, k), a, b = max(gains, key=lambda x: x[0][0])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    return [next(sum(g[a:b]) / (sum(h[a:b]) + ridge) for a, b in parts if a <= i < b) for i in range(len(g))]


def pair_tree(g, h, ridge):
    """Two levels over cells: the first feature's cut, then the second's on either side; and the other way round."""
    best = None
    for flip in (False, True):
        a, b = ([list(r) for r in zip(*m, strict=True)] if flip else m for m in (g, h))
        k = best_cut([sum(r) for r in a], [sum(r) for r in b], ridge)[1]
        out, total = [[0.0] * len(a[0]) for _ in a], 0.0
        for rows in (range(k), range(k, len(a))):
            if not rows:
                continue
            across = [sum(a[i][j] for i in rows) for j in range(len(a[0]))], [sum(b[i][j] for i in rows) for j in range(len(a[0]))]
            m = best_cut(*across, ridge)[1]
            for cols in (range(m), range(m, len(a[0]))):
                if cols:
                    s, t = sum(across[0][j] for j in cols), sum(across[1][j] for j in cols)
                    total += s * s / (t + ridge)
                    for i in rows:
                        for j in cols:
                            out[i][j] = s / (t + ridge)
        if best is None or total > best[0] + 1e-12:
            best = (total, [list(r) for r in zip(*out, strict=True)] if flip else out)
    return best


def boosted(x, y, rounds, rate, n_bins, n_pairs, pair_rounds, ridge):
    n, d = len(x), len(x[0])
    columns = [[r[j] for r in x] for j in range(d)]
    cuts, coarse = [cut_points(c, n_bins) for c in columns], [cut_points(c, 8) for c in columns]
    start = math.log(sum(y) / (n - sum(y)))
    tables, z = [[0.0] * (len(c) + 1) for c in cuts], [start] * n
    chances = lambda: [1 / (1 + math.exp(-v)) for v in z]
    for _ in range(rounds):
        for j in range(d):
            p, at = chances(), [place(cuts[j], r[j]) for r in x]
            g, h = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for i in range(n):
                g[at[i]] += y[i] - p[i]
                h[at[i]] += p[i] * (1 - p[i])
            step = tree(g, h, ridge)
            tables[j] = [t + rate * s for t, s in zip(tables[j], step, strict=True)]
            z = [v + rate * step[at[i]] for i, v in enumerate(z)]

    def cells(a, b):
        p = chances()
        g = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
        h = [list(r) for r in g]
        for i, r in enumerate(x):
            u, v = place(coarse[a], r[a]), place(coarse[b], r[b])
            g[u][v] += y[i] - p[i]
            h[u][v] += p[i] * (1 - p[i])
        return g, h

    chosen = sorted(combinations(range(d), 2), key=lambda ab: -pair_tree(*cells(*ab), ridge)[0])[:n_pairs]
    pairs = {ab: np.zeros((len(coarse[ab[0]]) + 1, len(coarse[ab[1]]) + 1)) for ab in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            step = np.array(pair_tree(*cells(a, b), ridge)[1])
            pairs[a, b] += rate * step
            z = [v + rate * step[place(coarse[a], r[a]), place(coarse[b], r[b])] for v, r in zip(z, x, strict=True)]
    return start, tables, pairs


@pytest.mark.parametrize("seed", range(4))
def test_boosted_tables_by_hand(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 3))
    x[:, 2] = np.round(x[:, 2])  # few values, so that quantiles coincide
    y = ((x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + 0.3 * rng.normal(size=90)) > 0).astype(float)
    how = {"rounds": 4, "rate": 0.3, "n_bins": 6, "n_pairs": 2, "pair_rounds": 3, "ridge": 1.0}
    m = quality_gam.fit(x, y, **how)
    start, tables, pairs = boosted(x.tolist(), y.tolist(), **how)
    assert m.intercept == pytest.approx(start)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(m.tables, tables, strict=True))
    assert [(i, j) for i, j, _ in m.pairs] == list(pairs) and all(np.allclose(t, pairs[i, j], atol=1e-9) for i, j, t in m.pairs)


def loss(w, x, y, cost):
    """Half the weights' square and the weighted squared hinge, which the machine minimises."""
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    margin = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
    return 0.5 * w @ w + cost * (weight * margin**2).sum()


@pytest.mark.parametrize("seed", range(4))
def test_machine_reaches_its_optimum(seed):
    """Against plain gradient descent on the loss, which is convex and smooth."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 5))
    y = np.where(x @ rng.normal(size=5) + 0.5 * rng.normal(size=120) > 0.6, 1.0, -1.0)
    cost = 0.5
    got = langid.fit_svm(x.astype(np.float32), y, cost, epochs=200).astype(float)
    xb, w = np.hstack([x, np.ones((120, 1))]), np.zeros(6)
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    step = 1 / (1 + 2 * cost * np.linalg.norm(xb * np.sqrt(weight)[:, None], 2) ** 2)
    for _ in range(20_000):
        w -= step * (w - 2 * cost * xb.T @ (weight * y * np.maximum(0, 1 - y * (xb @ w))))
    assert loss(got, x, y, cost) <= loss(w, x, y, cost) * 1.001 + 1e-6 and np.allclose(got, w, atol=2e-2)
    assert (np.sign(xb @ got) == np.sign(xb @ w)).mean() > 0.98
