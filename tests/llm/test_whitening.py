"""Whitening against numpy over the whole matrix."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antibiogram.llm import whitening
from antibiogram.llm.queries import op13_embedding_whitening


def by_hand(rows, scale=256, k=4):
    """id, x, projections by component of the rows that remain, and n, sums, explained."""
    kept = [(i, tuple(math.floor(float(c) * scale) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}), dtype=object)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = np.array([s / n for s in total])
    c = fit.astype(float) - mean
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return kept, n, total, mean, e, u, float(np.trace(c.T @ c / n))


def compare(got, rows, **more):
    kept, n, total, mean, e, u, trace = by_hand(rows, **more)
    want = {}
    for i, x in kept:
        want.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))), []).append((np.array(x, float) - mean) @ u / np.sqrt(e))
    by_row = {}
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / trace) < 1e-9 and 0 <= r.identity_error < 1e-9
        by_row.setdefault((r.vec_id, int(r.deviation)), []).append((r.component, r.whitened))
    assert set(by_row) == set(want) and len(got) == len(kept) * len(e)
    sign = np.zeros(len(e))
    for key, values in by_row.items():
        for c in range(len(e)):
            a = sorted(w for k, w in values if k == c + 1)
            for s in (1, -1):
                if np.allclose(a, sorted(s * w[c] for w in want[key]), atol=1e-8):
                    break
            else:
                raise AssertionError((key, c))
            if abs(a[0]) > 1e-6:
                assert sign[c] in (0, s)
                sign[c] = s


def vectors(seed, n, dim, spread=0.2):
    r = random.Random(seed)
    return [(k, [r.gauss(0, spread * (1 + d / dim)) for d in range(dim)]) for k in range(n)]


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit("mine") for c in ("_id", "x", "v", "n", "component", "label", "row_block")})


@pytest.mark.parametrize(("dim", "tile", "block_bytes"), [(12, 5, 800), (12, 32, 1 << 20), (7, 1, 1), (3, 2, 100)])
def test_whiten(spark, dim, tile, block_bytes):
    rows = vectors(dim, 150, dim)
    rows += [(k, v) for k, v in rows[:40]] + [(900 + k, rows[0][1]) for k in range(60)]
    rows += [(None, rows[3][1]), (None, None), (500, None), (501, []), (502, [None] * dim), (503, [float("nan")] + [0.0] * (dim - 1)), (504, [float("inf")] * dim), (505, [0.1] * (dim + 1)), (506, [-0.0] * dim)]
    plain = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows if i != 505]
    compare(whitening.whiten(frame(spark, rows).repartition(5), tile=tile, block_bytes=block_bytes).collect(), plain, k=min(4, dim))


def test_wide_numbers_are_exact(spark):
    rows = [(k, [v * 1e12 for v in x]) for k, x in vectors(2, 30, 5)]
    got = whitening.whiten(frame(spark, rows, "double")).collect()
    compare(got, rows)
    assert max(r.deviation for r in got) > 1 << 63


def test_flat_directions(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)} and {r.identity_error < 1e-9 for r in got} == {True}
    assert {round(r.explained, 9) for r in got} == {0.0, 1.0}
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.5])] * 3)).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        out = whitening.whiten(frame(spark, rows))
        assert out.isEmpty() and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query_over_embeddings(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = op13_embedding_whitening(spark, sf_dir)
    assert dict(out.dtypes)["deviation"] == "bigint"
    compare(out.collect(), rows)
