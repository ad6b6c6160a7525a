"""Patterns of isolates from one row an isolate, against those from the tests."""

from __future__ import annotations

import random
import re

import fixtures
import pytest

from antibiogram.operators import detect, profiles

DRUGS = ("Ampicillin", "Amoxicillin", "Ceftriaxone", "Cefotaxime", "Ciprofloxacin", "Gentamicin", "Tobramycin", "Doxycycline", "Erythromycin", "é drug", "A, B", "A", "B", None)


def odd_tests(spark, seed: int, drugs=DRUGS):
    """Random tests with repeated and missing drugs, organisms, samples, dates and isolates; no two of an isolate share date and drug
    but with the same organism."""
    rng = random.Random(seed)
    rows, seen = [], {}
    for _ in range(1500):
        isolate = rng.choice([None, "I0", *[f"I{k}" for k in range(120)]])
        drug, day = rng.choice(drugs), rng.choice([None, "2024-01-18", "2024-02-03", "1965-05-05"])
        organism = seen.setdefault((isolate, drug, day), rng.choice(["E. coli", "Salmonella", "Vibrio", None]))
        sample = seen.setdefault((isolate, drug, day, "sample"), rng.choice(["S1", "S2", None]))
        rows.append((sample, isolate, organism, drug, rng.choice(["R", "R", "S", "I", None]), day))
    return fixtures.tests(spark, rows)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def pairs(p, ast):
    return [
        (p.multi_resistance(), detect.multi_resistance(ast)),
        (p.multi_resistance(1), detect.multi_resistance(ast, 1)),
        (p.mdr(), detect.mdr(ast)),
        (p.mdr(1), detect.mdr(ast, 1)),
        (p.cross_resistance(), detect.cross_resistance(ast)),
        (p.co_resistance(1), detect.co_resistance(ast, 1)),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_from_the_tests(spark, seed):
    ast = odd_tests(spark, seed)
    for got, want in pairs(profiles.Profiles(ast), ast):
        assert got.columns == want.columns
        assert rows_of(got) == rows_of(want) != []


@pytest.mark.parametrize("repeats", [True, False])
def test_kept_and_read(spark, tmp_path, repeats):
    ast = odd_tests(spark, 6)
    if not repeats:
        ast = spark.createDataFrame(ast.dropDuplicates(["dataset_id", "isolate_id", "antibiotic"]).collect(), ast.schema)
    profiles.Profiles(ast).write(str(tmp_path))
    for got, want in pairs(profiles.Profiles.read(ast, str(tmp_path)), ast):
        assert got.columns == want.columns and rows_of(got) == rows_of(want) != []


def test_more_drugs_than_a_word_holds(spark):
    ast = odd_tests(spark, 3, tuple(f"Drug {k:03}" for k in range(150)) + DRUGS)
    p = profiles.Profiles(ast)
    assert len(p.words) == 3
    for got, want in pairs(p, ast):
        assert rows_of(got) == rows_of(want)


def test_too_many_names_and_empty_tables(spark, monkeypatch):
    ast = odd_tests(spark, 4)
    monkeypatch.setattr(profiles, "FEW_DRUGS", 5)
    p = profiles.Profiles(ast)
    assert not p.few
    for got, want in pairs(p, ast):
        assert rows_of(got) == rows_of(want)
    none = profiles.Profiles(ast.where("false"))
    for got, want in pairs(none, ast.where("false")):
        assert got.columns == want.columns and rows_of(got) == []


def test_one_exchange_and_fixed_buffers(spark):
    ast = odd_tests(spark, 5)
    p = profiles.Profiles(ast)
    for df in (p.multi_resistance(), p.cross_resistance()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_isolates_meet_in_partitions_by_the_tests_number(spark, tmp_path, monkeypatch):
    from antibiogram.sources import mart

    ast, parts, small = odd_tests(spark, 7), "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(mart, "TASK_ROWS", 100)
    before = spark.conf.get(parts), spark.conf.get(small)
    try:
        spark.conf.set(small, "false")
        profiles.Profiles(ast).write(str(tmp_path))
    finally:
        spark.conf.set(small, before[1])
    assert len(list(tmp_path.glob("isolates/part-*"))) == 16 and spark.conf.get(parts) == before[0] == "4"
    for got, want in pairs(profiles.Profiles.read(ast, str(tmp_path)), ast):
        assert rows_of(got) == rows_of(want) != []
