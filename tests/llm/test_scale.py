"""What must hold at size: filters after the line rules, bounds of what models learn from, hot keys, names and keys of any kind."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F
from test_dedup import roots_by_hand

from antibiogram.llm import common, exact_dedup, license_scan, licenses, line_rules, merkle, mixing, quality_gam, simhash


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_stay_above_the_counts(spark):
    """A filter on a verdict is not moved into the counts, whose windows would be hashed and sorted again for each word."""
    long = prose(1, 20_000)
    df = docs(spark, [(k, long if k == 3 else prose(k, 400), None, "h") for k in range(40)])
    whole = line_rules.line_rules(df)
    assert plan_of(whole.where("kept")).count("xxhash64") <= plan_of(whole).count("xxhash64")
    took = []
    for run in (lambda: whole.collect(), lambda: whole.where("kept").collect(), lambda: line_rules.line_filter(df).collect()):
        t = time.perf_counter()
        rows = run()
        took.append(time.perf_counter() - t)
    assert len(rows) == whole.where("kept").count() >= 39 and max(took[1:]) < 3 * took[0] + 5


def test_training_rows_are_bounded(spark, monkeypatch):
    """One id on very many rows: at most ``max_rows`` are gathered, and of both labels."""
    rows = [(1, prose(k, 30), None, None) for k in range(3000)] + [(k, prose(k, 30), None, None) for k in range(2, 400)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 400)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality_gam, "fit", lambda x, y, **k: seen.update(gam=(len(x), set(y))) or None)
    quality_gam.train(df, labels, max_rows=100)
    monkeypatch.setattr(mixing, "fit", lambda s, x, y, names, **k: seen.update(mix=(len(x), set(y))) or None)
    mixing.train(df, labels, mixing.label_domain(), max_rows=100)
    assert seen["gam"] == (100, {0.0, 1.0}) and seen["mix"][0] == 100 and len(seen["mix"][1]) == 2


def test_no_held_out_row_is_learnt_from(spark, monkeypatch):
    df = docs(spark, [(k, f"t{k} " + prose(k, 30), None, None) for k in range(200)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    n = df.where(common.may_learn()).count()
    seen = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y, **k: seen.append(len(x)))
    quality_gam.train(df, labels)
    assert seen == [n] and n < 200


def test_bitmap_lets_all_and_few_others_pass(spark):
    rows = spark.range(40_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("_h"), "id")
    wanted = rows.where("id % 16 = 3")
    passed = exact_dedup._maybe_in(rows, wanted.select("_h"), 2500)
    assert passed.columns == ["_h", "id"] and wanted.join(passed, "id", "left_anti").isEmpty()
    assert 2500 <= passed.count() <= 2500 + 37_500 // 8
    assert exact_dedup._maybe_in(rows, wanted.select("_h"), 2500, max_bits=1 << 15).count() < 8000


def test_unique_texts_do_not_move(spark):
    """With more repeated hashes than may be broadcast, the texts that are compared are those of repeated hashes and few more."""
    rows = [(k, prose(k // 2 if k < 400 else k, 20), None, None) for k in range(4000)]
    df = docs(spark, rows)
    twice = Counter(t for _, t, *_ in rows)
    got = exact_dedup.exact_groups(df, few=0)
    assert got.where("NOT kept").count() == sum(n - 1 for n in twice.values())
    texts = df.select(F.col("text").alias("_t")).withColumn("_h", exact_dedup.content_hash(F.col("_t")))
    sizes = texts.groupBy("_h").count().where("count > 1").select("_h")
    moved = exact_dedup._maybe_in(texts, sizes, sizes.count())
    assert moved.count() <= sum(n for n in twice.values() if n > 1) + 4000 // 8


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def test_sub_keys_meet(spark):
    """Two fingerprints of one key at most 3 bits apart share a sub-key."""
    r = random.Random(8)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randrange(1, 4)):
            b ^= 1 << k
        pairs.append((signed(a), signed(b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    keyed = df.select("a", "b", F.explode(F.array_intersect(simhash.block_keys("a"), simhash.block_keys("b"))).alias("key"))
    assert keyed.select("a", "b").distinct().count() == 300
    assert keyed.where(~F.arrays_overlap(simhash.sub_keys("a"), simhash.sub_keys("b"))).isEmpty()


@pytest.mark.parametrize("split", [2, 100])
def test_links_of_hot_keys(spark, split):
    """Fingerprints of a few keys, split or not, link what all pairs would."""
    r = random.Random(split)
    low = [r.getrandbits(31) << 33 for _ in range(2)]
    prints = {signed(low[k % 2] | (r.getrandbits(9) << r.choice([0, 12, 24]))) for k in range(260)}
    links = simhash.links(spark.createDataFrame([(fp,) for fp in prints], "fp long"), chunk=16, few=2, split=split)
    found = dict(map(tuple, common.components(links).collect()))
    assert {k: found.get(k, k) for k in prints} == roots_by_hand({k: k % (1 << 64) for k in prints})


def test_a_hundred_thousand_on_one_key(spark, monkeypatch):
    """One key's fingerprints are dealt in bounded groups: no group comes near the number of them."""
    n = 100_000
    g = np.random.default_rng(5)
    rest = np.unique(g.integers(0, 1 << 33, n))
    key = 0x5A5A5A5 << 33
    df = spark.createDataFrame([(signed(int(x) | key),) for x in rest], "fp long")
    keyed = df.select("fp", F.explode(simhash.block_keys()).alias("key"))
    hot = keyed.groupBy("key").count().where("count > 4096")
    below = keyed.join(F.broadcast(hot), "key", "left_semi").select("fp", "key", F.explode(simhash.sub_keys()).alias("sub"))
    largest = below.groupBy("key", "sub").count().agg(F.max("count")).first()[0]
    assert hot.agg(F.max("count")).first()[0] == len(rest) and largest < 200
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in map(tuple, simhash.links(df).collect()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    bits = np.array(sorted(int(x) for x in rest), np.uint64)
    n_near = 0
    for x in bits[:: len(bits) // 200]:
        for y in bits[np.bitwise_count(bits ^ x) <= 3]:
            assert find(signed(int(x) | key)) == find(signed(int(y) | key))
            n_near += int(x != y)
    assert n_near


def test_lookup_deals_rows_of_one_id(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = common.lookup(rows, sizes, "k", "n", F.monotonically_increasing_id(), 20_000)
    parts = got.where("k = -1").groupBy("_salt").count().collect()
    assert got.count() == 20_000 and len(parts) > 100 and max(r["count"] for r in parts) < 200


def test_names_with_dots_and_ticks(spark, sf_dir):
    rows = [(k, ("Menu line here\n" if k % 2 else "") + prose(k % 40, 80), None, "h") for k in range(80)]
    odd = {"a.b": "x", "c`d": "y", "_row.c0": "z", "text.more": "w"}
    df = docs(spark, rows).withColumns({c: F.lit(v) for c, v in odd.items()})
    for out in (line_rules.without_common_lines(df), line_rules.line_filter(df, min_words=1)):
        assert out.columns == df.columns and {tuple(r[c] for c in odd) for r in out.collect()} == {tuple(odd.values())}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    assert mixing.mixed(df, labels, mixing.label_domain(), mixing.WEIGHTS, whole="clean").columns == df.columns
    import corpus_pipeline

    kept = df
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
        assert name == "pack" or kept.columns == df.columns


def test_audit_of_text_keys(spark):
    keys = [*map(str, range(40)), "page-a", "page-b", "7x", "", None, "-3", "9" * 30]
    pages = spark.createDataFrame([(k, f"u{k}", f"body of {k}") for k in keys], "page_id string, url string, html string")
    bad = pages.where("coalesce(page_id, 'none') <> '5'").withColumn("html", F.when(F.col("page_id").isin("page-a", "11"), "altered").otherwise(F.col("html"))).unionByName(pages.where("page_id IS NULL OR page_id = '7x'"))
    got = merkle.audit(merkle.tree(pages, 16), merkle.tree(bad, 16)).collect()
    assert Counter(r.status for r in got) == {"missing": 1, "corrupt": 2, "extra": 2}
    assert merkle.audit(merkle.tree(pages, 16), merkle.tree(pages.repartition(3), 16)).isEmpty()


def test_audit_of_a_hot_slot(spark, monkeypatch):
    monkeypatch.setattr(merkle, "KEY_ROWS", 10)
    pages = spark.range(60).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    bad = pages.withColumn("html", F.when(F.col("html").isin("7", "8"), F.lit("bad")).otherwise(F.col("html")))
    got = merkle.audit(merkle.tree(pages, 16), merkle.tree(bad, 16)).collect()
    assert sorted((r.status, r.warc_file == merkle.NULL_FILE) for r in got) == [("corrupt", False), ("corrupt", True)]


def every_end(units, t, threshold):
    """``find`` with each start aligned to every later end."""
    need, reach = threshold * t.words - 1e-9, 2 * len(t.units)
    own, phrases = set(t.units), {" ".join(p) for p in t.phrases}
    starts = license_scan._may_start(units, t, reach, need)
    out, parts = [], [(0, len(units))]
    while parts:
        at, stop = parts.pop()
        for s in [s for s in starts if at <= s < stop]:
            found = None
            for e in range(s + 1, min(stop, s + reach) + 1):
                if units[e - 1] not in own:
                    continue
                pairs = license_scan.align(units[s:e], t.units)
                size = sum(units[s + i].count(" ") + 1 for i, _ in pairs)
                if size >= need and phrases <= {t.units[j] for _, j in pairs}:
                    one = (s + pairs[0][0], s + pairs[-1][0] + 1, size)
                    if found is None or (-size, one[1] - one[0]) < (-found[2], found[1] - found[0]):
                        found = one
            if found:
                out.append(found)
                parts += [(s, found[0]), (found[1], stop)]
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_license_ends_are_all_looked_at(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(24)]
    text = " ".join(r.choice(words) for _ in range(26)) + " [[blue sky license]] " + " ".join(r.choice(words) for _ in range(12))
    t = license_scan.template("T", text)
    n = 0
    for _ in range(25):
        parts = []
        for _ in range(r.randrange(1, 4)):
            copy = [u for u in t.units if r.random() > 0.08]
            for _ in range(r.randrange(8)):
                copy.insert(r.randrange(len(copy)), r.choice([*words, "noise", "blue sky license"]))
            parts += copy + [r.choice(["noise", *words]) for _ in range(r.randrange(12))]
        got = license_scan.find(parts, t, 0.8)
        assert got == every_end(parts, t, 0.8)
        n += len(got)
    assert n > 10


def test_shuffled_license_words_are_fast():
    r = random.Random(1)
    mit = next(t for n, t in licenses.templates() if n == "MIT")
    known = [license_scan.template(*t) for t in licenses.templates()]
    words = " ".join(r.choices(mit.replace("[[", "").replace("]]", "").split(), k=4000))
    t = time.perf_counter()
    license_scan.scan(words, known)
    assert time.perf_counter() - t < 6
