"""Fixed values and file formats against what is written out here, not against the library's own constants."""

from __future__ import annotations

import fixtures
import pytest
from pyspark.sql import functions as F

from antibiogram.functions import interpret as ip
from antibiogram.operators import compare, detect, rates, score
from antibiogram.plans import gaps
from antibiogram.sources import io

#: organism, antibiotic, guideline, MIC bounds of S, I and R, zone bounds of S, I and R.
BREAKPOINTS = [
    ("Enterobacteriaceae", "Amoxicillin", "CLSI", (8, 16, 16, 32), (20, 14, 19, 13)),
    ("Enterobacteriaceae", "Ampicillin", "CLSI", (8, None, None, 16), (17, None, None, 16)),
    ("Enterobacteriaceae", "Ceftazidime", "CLSI", (4, 8, 8, 16), (21, 18, 20, 17)),
    ("Enterobacteriaceae", "Ceftazidime", "EUCAST", (1, 2, 4, 8), (23, 20, 22, 19)),
    ("Enterobacteriaceae", "Cefotaxime", "CLSI", (1, 2, 2, 4), (26, 23, 25, 22)),
    ("Enterobacteriaceae", "Cefotaxime", "EUCAST", (1, 2, 2, 4), (23, 20, 22, 19)),
    ("Enterobacteriaceae", "Ciprofloxacin", "EUCAST", (0.25, 0.5, 0.5, 1), (21, 16, 20, 15)),
    ("Enterobacteriaceae", "Gentamicin", "CLSI", (4, 8, 8, 16), (15, 13, 14, 12)),
    ("Enterobacteriaceae", "Gentamicin", "EUCAST", (2, 4, 4, 8), (16, 13, 15, 12)),
    ("Enterobacteriaceae", "Tetracycline", "CLSI", (4, 8, 8, 16), (15, 12, 14, 11)),
    ("Enterobacteriaceae", "Tetracycline", "EUCAST", (1, 2, 2, 4), (16, 13, 15, 12)),
    ("Staphylococcus aureus", "Methicillin", "EUCAST", (2, None, None, 4), (10, None, None, 9)),
    ("Staphylococcus aureus", "Ciprofloxacin", "CLSI", (1, 2, 2, 4), (21, 16, 20, 15)),
    ("Staphylococcus aureus", "Ciprofloxacin", "EUCAST", (0.5, 1, 1, 2), (22, 19, 21, 18)),
    ("Staphylococcus aureus", "Gentamicin", "EUCAST", (1, 2, 2, 4), (16, 13, 15, 12)),
    ("Enterococcus spp.", "Ampicillin", "CLSI", (8, None, None, 16), (17, None, None, 16)),
    ("Enterococcus spp.", "Ampicillin", "EUCAST", (4, None, None, 8), (17, None, None, 16)),
    ("Enterococcus spp.", "Vancomycin", "EUCAST", (4, 8, 16, 32), (15, 10, 14, 9)),
    ("Pseudomonas aeruginosa", "Ceftazidime", "CLSI", (8, 16, 16, 32), (18, 15, 17, 14)),
    ("Pseudomonas aeruginosa", "Ciprofloxacin", "EUCAST", (0.5, 1, 1, 2), (21, 16, 20, 15)),
    ("Pseudomonas aeruginosa", "Gentamicin", "CLSI", (4, 8, 8, 16), (16, 13, 15, 12)),
    ("Acinetobacter spp.", "Ceftazidime", "EUCAST", (4, 8, 8, 16), (18, 15, 17, 14)),
    ("Acinetobacter spp.", "Ciprofloxacin", "CLSI", (1, 2, 2, 4), (21, 16, 20, 15)),
]


def test_breakpoints():
    have = {(r["organism"], r["antibiotic"], r["guideline"], r["method"]): (r["s"], r["i_low"], r["i_high"], r["r"]) for r in ip.rules()}
    assert len(have) == 68
    for organism, antibiotic, guideline, mic, zone in BREAKPOINTS:
        assert have[organism, antibiotic, guideline, "MIC"] == mic and have[organism, antibiotic, guideline, "DD"] == zone


def test_interpreters_mechanism_comes_first(spark):
    """What the interpreter suspects is kept before a screen's finding of the same mechanism; others stay beside it."""
    drugs = [("Ceftazidime", 32.0), ("Cefotaxime", 8.0)]
    ast = spark.createDataFrame([("D", "s", "i", "Escherichia coli", a, "R", "MIC", "CLSI", None, v, None) for a, v in drugs], fixtures.AST)
    screened = detect.mechanisms(ast).collect()
    assert [(r.resistance_mechanism, r.confidence, r.resistant_antibiotics, r.total_tests) for r in screened] == [("ESBL", "High", 2, 2)]
    told = ip.interpret(ast).withColumn("interpretation_confidence", F.lit("told"))
    assert [(r.resistance_mechanism, r.confidence) for r in detect.mechanisms(told).collect()] == [("ESBL", "told")]
    other = told.withColumn("suspected_mechanism", F.lit("VRE"))
    assert sorted(r.resistance_mechanism for r in detect.mechanisms(other).collect()) == ["ESBL", "VRE"]


def test_tests_without_a_result(spark):
    ast = fixtures.tests(spark, [("s1", "i1", "o", "a", "R", None), ("s1", "i2", "o", "a", None, None), ("s1", "i3", "p", "b", None, None)])
    at = {r.sample_id: (r.resistant_count, r.total_count) for r in rates.sample_rates(ast).collect()}
    assert at == {"s1": (1, 3)}  # rows, not results
    assert [(r.organism, r.total) for r in rates.sir_table(ast, "organism", "antibiotic").collect()] == [("o", 1)]
    assert [(r.organism, r.total_tests, r.resistance_rate) for r in rates.report_rates(ast, "organism").collect()] == [("o", 1, 100.0), ("p", 0, None)]
    assert score.insights(ast).first().top_organism_rate == 50.0


def test_the_other_categorys_rate_is_looked_up_among_all(spark):
    """An antibiotic that is among one category's first ones shows the other's rate even if it is far down there."""
    samples = fixtures.samples(spark, [("h", None, None, "HUMAN", None, None), ("a", None, None, "ANIMAL", None, None)])
    ast = fixtures.tests(spark, [("h", "1", "o", "x", "R", None), ("h", "2", "o", "y", "S", None), ("a", "3", "o", "y", "R", None), ("a", "4", "o", "x", "R", None), ("a", "5", "o", "x", "S", None)])
    found = compare.category_antibiotics(ast, samples, "HUMAN", "ANIMAL", top=1)
    assert sorted((r.antibiotic, r.rate_a, r.rate_b) for r in found.collect()) == [("x", 100.0, 50.0), ("y", 0.0, 100.0)]


def test_gaps_are_there(spark, sf_dir):
    from antibiogram.sources import adapter

    samples, ast = gaps.tables(adapter.samples(spark, sf_dir), adapter.tests(spark, sf_dir))
    for df, cols in ((samples, ("region", "district", "source_category", "source_type")), (ast, ("organism", "antibiotic", "result", "test_date", "isolate_id"))):
        lacking = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count("*").alias("n")).first()
        assert all(0 < lacking[c] < lacking["n"] / 2 for c in cols)
