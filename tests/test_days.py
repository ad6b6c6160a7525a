"""Distinct counts from bitmaps by day, against those from the tests."""

from __future__ import annotations

import random

import fixtures
import pytest
from pyspark.sql import functions as F

from antibiogram.operators import days, rates, score
from antibiogram.sources.merging import Folders

DAYS = [None, "1969-12-31", "2024-01-18", "2024-01-19", "2024-02-03", "2024-02-20"]


def odd_tests(spark, seed: int, n: int = 2000):
    rng = random.Random(seed)
    pick = lambda prefix, k: rng.choice([None, *[f"{prefix}{x}" for x in range(k)]])
    return fixtures.tests(spark, [(pick("S", 300), pick("I", 50), pick("O", 40), pick("A", 70), rng.choice(["R", "S", "I", None]), rng.choice(DAYS)) for _ in range(n)])


def by_day(ast):
    return ast.groupBy(F.col("test_date").alias("day")).agg(*[F.countDistinct(k).alias(k) for k in days.KINDS])


def test_batches_add_up(spark, tmp_path):
    path, ast = str(tmp_path), odd_tests(spark, 1)
    late = F.coalesce(F.col("test_date") >= "2024-02-01", F.lit(False))
    assert days.add(path, ast.where(~late), "a") and days.add(path, ast.where(late), "b")
    assert not days.add(path, ast, "b")
    d = days.Days.read(spark, path)
    assert d.distinct_counts().collect() == rates.distinct_counts(ast).collect()
    assert sorted(d.distinct("day").collect(), key=str) == sorted(by_day(ast).collect(), key=str)
    part = d.where(F.col("day").between("2024-01-19", "2024-02-10"))
    assert part.distinct_counts().collect() == rates.distinct_counts(ast.where(F.col("test_date").between("2024-01-19", "2024-02-10"))).collect()
    numbers = spark.read.parquet(f"{path}/numbers")
    assert numbers.count() == numbers.select("kind", "value").distinct().count() == numbers.select("number").distinct().count()
    samples = fixtures.samples(spark, [("S1", "x", "y", "FOOD", 1.0, None), ("S2", "x", "y", "FOOD", None, None)])
    assert score.kpis_of(samples, d.activity("2024-02-20")).collect() == score.kpis(samples, ast, "2024-02-20").collect()


@pytest.mark.parametrize("table", ["numbers", "bits", "counts"])
def test_a_batch_that_ended_is_written_anew(spark, tmp_path, monkeypatch, table):
    path, ast = str(tmp_path), odd_tests(spark, 2)
    days.add(path, ast.limit(500), "a")
    before = days.Days.read(spark, path).distinct_counts().collect()
    from pyspark.sql.readwriter import DataFrameWriter

    whole = DataFrameWriter.parquet

    def ends(self, to, *args, **kwargs):
        if f"/{table}/" in to:
            raise RuntimeError("ended")
        return whole(self, to, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", ends)
    with pytest.raises(RuntimeError, match="ended"):
        days.add(path, ast, "b")
    monkeypatch.undo()
    assert days.Days.read(spark, path).distinct_counts().collect() == before
    assert days.add(path, ast, "b")
    d = days.Days.read(spark, path)
    assert d.distinct_counts().collect() == rates.distinct_counts(ast).collect()
    assert Folders(spark, path).names("counts", "batch=") == ["a", "b"]


def test_empty(spark, tmp_path):
    path, none = str(tmp_path), odd_tests(spark, 3, 10).where("false")
    for _ in range(2):
        d = days.Days.read(spark, path)
        assert d.distinct_counts().collect() == rates.distinct_counts(none).collect()
        assert tuple(d.activity("2024-02-20").first()) == (0, 0, 0, 0)
        days.add(path, none, "a")


def test_no_rows_are_multiplied(spark, tmp_path):
    path = str(tmp_path)
    days.add(path, odd_tests(spark, 4), "a")
    assert "Expand" not in days.Days.read(spark, path).distinct_counts()._jdf.queryExecution().optimizedPlan().toString()
