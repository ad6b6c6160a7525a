"""Language id, quality and mixing: held-out accuracy on the given tables, and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import ODD, docs, prose
from pyspark.sql import functions as F

from antibiogram.llm import langid, mixing, quality_gam
from antibiogram.llm.common import read

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    import os

    if not os.path.isdir(SMALL):
        pytest.skip(f"no tables in {SMALL}")
    return read(spark, SMALL, "documents"), read(spark, SMALL, "labels")


def test_language_held_out(spark, tables):
    out = langid.identify(tables[0]).join(tables[0].select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert n > 200 and right >= 0.98 * n
    assert out.where("score < 0 OR score > 1").isEmpty()


def test_language_edges(spark, tables):
    odd = docs(spark, [(k, t, None, None) for k, t in enumerate(ODD)] + [(None, "the and of the", "en", None), (5, "the and", None, None)], clash=True)
    both = odd.select("doc_id", "text", "lang").unionByName(tables[0].select("doc_id", "text", "lang").limit(300))
    got = langid.identify(both)
    assert got.count() == both.count() and got.where("doc_id IS NULL").first().lang_pred in ("en", "de", "fr", "es")
    alone = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd).collect()}  # nothing to learn from
    assert set(alone.values()) == {("und", 0.0)}
    only = langid.identify(docs(spark, [(k, t, "en", None) for k, t in enumerate(ODD)], clash=True)).collect()
    assert {r.doc_id for r in only if r.lang_pred == "und"} == {0, 1, 2, 9, 10}
    assert langid.identify(odd.limit(0)).isEmpty()


def test_vector_in_pieces(monkeypatch):
    text = prose(3, 4000) + " ñandú"
    whole = langid.vector(text)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert np.allclose(langid.vector(text), whole, atol=1e-6) and abs(np.linalg.norm(whole) - 1) < 1e-5


def test_labels_and_ids_are_no_inputs(spark, tables):
    d = tables[0].limit(200)
    plain = {r.doc_id: r.lang_pred for r in langid.identify(d).collect()}
    blind = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang"))).withColumn("source", F.lit("x"))
    assert {r.doc_id: r.lang_pred for r in langid.identify(blind).collect()} == plain


def test_quality_held_out(spark, tables):
    out = quality_gam.quality_scores(*tables).join(tables[1], "doc_id").where("held_out")
    n, right = out.count(), out.where("quality = predicted").count()
    assert n > 60 and right >= 0.95 * n and out.where("quality = 1 AND predicted = 0").count() <= 0.03 * n


def test_quality_edges(spark, tables):
    labels = tables[1]
    odd = docs(spark, [*[(k, t, None, None) for k, t in enumerate(ODD)], (None, "some words", None, None)], clash=True)
    none = labels.limit(0)
    assert all(r.score == pytest.approx(1.0, abs=1e-4) and r.predicted == 1 for r in quality_gam.quality_scores(odd, none).collect())
    zeros = spark.createDataFrame([(k, 0, 0) for k in range(len(ODD))], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality_gam.quality_scores(odd, zeros).collect()} == {0}
    got = quality_gam.quality_scores(tables[0].select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id IS NULL")), labels)
    assert got.count() == tables[0].count() + 1 and got.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert quality_gam.quality_scores(odd.limit(0), labels).isEmpty()
    kept = quality_gam.quality_filter(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x, y)
    assert {(0, 1)} <= {(i, j) for i, j, _ in m.pairs}
    z = rng.random((1000, 3))
    right = ((m.score(z) > 0.5) == ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5))).mean()
    assert right > 0.9


def rates_by_hand(tokens, p, target, there, rounds):
    """Plain projected gradient, without momentum."""
    r = np.ones(len(tokens))
    for _ in range(rounds):
        step = ((tokens * r) @ p - target) / there
        r = np.clip(r - p @ step, 0, 1)
    return r


@pytest.mark.parametrize(("sharp", "feasible"), [(0.01, True), (0.2, False)])
def test_solver(spark, sharp, feasible):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([sharp] * 3, 500)
    tokens = rng.integers(0, 1000, 500)
    there, weights = tokens @ p, {"a": 0.7, "b": 0.2, "c": 0.1}
    rows = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    steps, target, reached = mixing.solve(rows, ["a", "b", "c"], weights)
    got = np.array([r[0] for r in rows.select(mixing.rate_column("p", steps, 1.0)).collect()])
    assert np.allclose((tokens * got) @ p, reached) and got.min() >= 0 and got.max() <= 1
    loss = lambda r: (((tokens * r) @ p - target) ** 2 / there).sum()
    least = loss(rates_by_hand(tokens, p, target, there, 5000))
    assert loss(got) - least <= 2e-3 * (loss(np.ones(len(tokens))) - least)
    assert not feasible or np.all(np.abs(reached - target) <= 2e-2 * target)


def test_votes_by_hand():
    """Of one-versus-one machines the class with most votes, ties by margins, against plain loops."""
    rng = np.random.default_rng(2)
    names = np.array(["d", "b", "a", "c"])[rng.integers(0, 4, 200)]
    x = rng.normal(size=(200, 6)).astype(np.float32) + (names[:, None] == np.array(["a", "b", "c", "d", "a", "b"])) * 2
    votes = langid.fit_votes(x, names)
    for v in x[:60]:
        won, sums = {c: 0 for c in "abcd"}, {c: 0.0 for c in "abcd"}
        for (i, j), w in zip(votes.pairs, votes.weights, strict=True):
            m = sum(float(p) * float(q) for p, q in zip(w[:-1], v, strict=True)) + float(w[-1])
            won["abcd"[i] if m >= 0 else "abcd"[j]] += 1
            sums["abcd"[i]] += m
            sums["abcd"[j]] -= m
        got, score = votes.best(v)
        assert got == max("abcd", key=lambda c: (won[c], round(sums[c], 4))) and 0 <= score <= 1
    assert np.mean([votes.best(v)[0] == n for v, n in zip(x, names, strict=True)]) > 0.8


def test_family_first(spark):
    """The language is sought only in the family that won, and the score is the product of both."""
    rng = np.random.default_rng(4)
    texts = {lang: ["".join(rng.choice(list(letters), 40)) for _ in range(20)] for lang, letters in (("en", "abc "), ("de", "abd "), ("fr", "xyz "), ("es", "xyw "))}
    x = np.array([langid.vector(t) for ts in texts.values() for t in ts])
    model = langid.fit(x, np.array([n for n, ts in texts.items() for _ in ts], object))
    assert model.families.classes == ["germanic", "romance"] and model.within["romance"].classes == ["es", "fr"]
    for t in (t for ts in texts.values() for t in ts):
        family, p = model.families.best(langid.vector(t))
        lang, q = model.within[family].best(langid.vector(t))
        assert model.predict(t) == (lang, p * q) and lang in langid.FAMILIES[family]


def test_gam_score_by_hand():
    """A score is the sum of one entry of each table, against plain loops over bins."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    m = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), rounds=20, pair_rounds=5)
    cell = lambda cuts, v: sum(c <= v for c in cuts)
    for v, got in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.intercept + sum(t[cell(c, y)] for t, c, y in zip(m.tables, m.cuts, v, strict=True))
        z += sum(t[cell(m.coarse[i], v[i]), cell(m.coarse[j], v[j])] for i, j, t in m.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


NAMES = ["a", "b", "c"]


def pure(spark, sizes, each=100):
    """Documents of one domain each: as many tokens of a domain as ``sizes`` says."""
    p = np.eye(len(sizes)).tolist()
    return spark.createDataFrame([(each, p[k]) for k, n in enumerate(sizes) for _ in range(n // each)], "tokens long, p array<double>")


def test_scarce_domain(spark):
    """A domain that is scarce sets the total, and the shares are those asked for; or, if told so, another stays whole."""
    rows, weights = pure(spark, [90000, 9500, 500]), {"a": 0.5, "b": 0.25, "c": 0.25}
    steps, target, reached = mixing.solve(rows, NAMES, weights)
    assert np.allclose(target, [1000, 500, 500]) and np.allclose(reached, target, rtol=2e-3)
    rates = {tuple(r.p): r.rate for r in rows.select("p", mixing.rate_column("p", steps, 1.0).alias("rate")).distinct().collect()}
    assert rates[1.0, 0.0, 0.0] == pytest.approx(1 / 90, rel=0.01) and rates[0.0, 1.0, 0.0] == pytest.approx(1 / 19, rel=0.01) and rates[0.0, 0.0, 1.0] == 1
    _, target, reached = mixing.solve(rows, NAMES, weights, whole="a")
    assert np.allclose(target, [90000, 9500, 500]) and np.allclose(reached, target)
    _, target, reached = mixing.solve(rows, NAMES, weights, max_rate=4.0)
    assert np.allclose(target, [4000, 2000, 2000]) and np.allclose(reached, target, rtol=2e-3)
    _, target, _ = mixing.solve(pure(spark, [1000, 1000, 0]), NAMES, weights)  # nothing of c
    assert np.allclose(target, [1000, 500, 0])


def test_impossible_mix(spark):
    """Documents that all are half a and half b cannot be mixed: the optimum is returned, and the miss is reported."""
    rows = spark.createDataFrame([(100, [0.5, 0.5])] * 50, "tokens long, p array<double>")
    steps, target, reached = mixing.solve(rows, ["a", "b"], {"a": 0.9, "b": 0.1})
    r = rows.select(mixing.rate_column("p", steps, 1.0).alias("r")).first().r
    least = min(np.linspace(0, 1, 1001), key=lambda x: ((2500 * x - target) ** 2).sum())
    assert abs(r - least) < 0.01 and np.allclose(reached, [2500 * r] * 2) and abs(reached[0] - target[0]) > 500


@pytest.mark.parametrize("whole", [None, "a"])
def test_cells_stand_for_documents(spark, whole):
    """The solver over cells gives rates whose totals, over the documents' own posteriors, are those of the solver over them."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.1, 0.1, 0.05], 3000)
    tokens = rng.integers(0, 1000, 3000)
    rows = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    weights = {"a": 0.6, "b": 0.25, "c": 0.15}
    cells = mixing.binned(rows, 3)
    assert cells.count() <= 33 * 34 // 2 and np.allclose(mixing.totals(cells, 3, F.lit(1.0))[0], tokens @ p)
    steps, target, _ = mixing.solve(cells, NAMES, weights, whole=whole)
    reached = mixing.totals(rows, 3, mixing.rate_column("p", steps, 1.0))[0]
    direct = mixing.solve(rows, NAMES, weights, whole=whole)
    assert np.allclose(target, direct[1]) and np.all(np.abs(reached - direct[2]) <= 0.01 * target)


def test_rows_are_judged_by_themselves(spark, tables):
    """Two texts of one id, and of none, each have their own verdict."""
    labels = tables[1]
    bad = tables[0].join(labels.where("quality = 0 AND toxic = 0"), "doc_id").select("text").limit(20)
    good = tables[0].join(labels.where("quality = 1 AND toxic = 0"), "doc_id").select("text").limit(20)
    for i in (5, None):
        both = bad.unionByName(good).withColumn("doc_id", F.lit(i).cast("long"))
        d = tables[0].select("doc_id", "text").unionByName(both.select("doc_id", "text"))
        rates = mixing.mix(d, labels, mixing.label_domain(), mixing.WEIGHTS)
        mine = rates.where(F.col("doc_id").eqNullSafe(F.lit(i)))
        assert mine.count() >= 40 and mine.select("rate").distinct().count() > 1
        kept = mixing.mixed(d, labels, mixing.label_domain(), mixing.WEIGHTS)
        assert kept.where(F.col("doc_id").eqNullSafe(F.lit(i))).count() == mine.agg(F.sum("copies")).first()[0]


def test_mixing(spark, tables):
    d, labels = tables
    out = mixing.mix(d, labels, mixing.label_domain(), mixing.WEIGHTS)
    assert out.count() == d.count() and out.where("copies NOT IN (0, 1) OR rate < 0 OR rate > 1").isEmpty()
    got = {r.what: r.copies for r in out.join(labels, "doc_id").groupBy(mixing.label_domain().alias("what")).agg(F.avg("copies").alias("copies")).collect()}
    assert got["clean"] > 0.98 and got["toxic"] < 0.85 and got["low"] < 0.7
    expected = out.agg(*[F.sum(F.expr(f"tokens * rate * p_{k}")).alias(k) for k in mixing.WEIGHTS]).first().asDict()
    assert all(abs(v / sum(expected.values()) - mixing.WEIGHTS[k]) < 0.005 for k, v in expected.items())
    said = {r.domain: (r.domain_target, r.domain_reached) for r in out.select("domain", "domain_target", "domain_reached").distinct().collect()}
    assert all(v == pytest.approx(said[k][1]) and v == pytest.approx(said[k][0], rel=0.02) for k, v in expected.items())
    half = mixing.mix(d, labels, mixing.label_domain(), mixing.WEIGHTS, tokens=F.length("text"))
    assert half.join(d, "doc_id").where("tokens <> length(text)").isEmpty()
    wide = d.withColumns({"_copies": F.lit(1), "n": F.lit(1), "_again": F.lit(1)})
    for most in (1.0, 2.0):
        copies = {r.doc_id: r.copies for r in mixing.mix(wide, labels, mixing.label_domain(), mixing.WEIGHTS, most).collect()}
        whole = mixing.mixed(wide, labels, mixing.label_domain(), mixing.WEIGHTS, max_rate=most)
        came = {r.doc_id: r["count"] for r in whole.groupBy("doc_id").count().collect()}
        assert whole.columns == wide.columns and came == {i: n for i, n in copies.items() if n} and max(came.values()) <= most
    assert max(came.values()) == 2
    odd = docs(spark, [*[(k, t, None, None) for k, t in enumerate(ODD)], (None, "some words", None, None), (3, "a", None, None)], clash=True)
    none = labels.limit(0)
    assert {r.rate for r in mixing.mix(odd, none, mixing.label_domain(), mixing.WEIGHTS).collect()} == {1.0}
    same = mixing.mixed(odd, none, mixing.label_domain(), mixing.WEIGHTS)
    assert same.columns == odd.columns and same.count() == odd.count()
    assert mixing.mix(odd.limit(0), labels, mixing.label_domain(), mixing.WEIGHTS).isEmpty()
