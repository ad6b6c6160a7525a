"""Filters, semi-joins and previews. ``None`` for a selection means no constraint; an empty one selects nothing unless said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rates import KEYS

Chosen = Sequence[str] | None


def chosen(df: DataFrame, **selections: Chosen) -> DataFrame:
    """Rows whose columns are in their selections; a null value is in none."""
    for col, values in selections.items():
        if values is not None:
            df = df.where(F.col(col).isin(list(values)))
    return df


def of_samples(ast: DataFrame, samples: DataFrame) -> DataFrame:
    """Tests whose sample is among ``samples``."""
    return ast.join(samples.select(*KEYS), list(KEYS), "left_semi")


def orphans(ast: DataFrame, samples: DataFrame) -> DataFrame:
    """Tests without a sample."""
    return ast.join(samples.select(*KEYS), list(KEYS), "left_anti")


def overview(ast: DataFrame, samples: DataFrame, categories: Chosen = None, regions: Chosen = None, districts: Chosen = None, sites: Chosen = None, sources: Chosen = None, organisms: Chosen = None, antibiotics: Chosen = None) -> tuple[DataFrame, DataFrame]:
    """(samples, tests) of a dashboard selection. An empty selection of categories, regions or districts lifts the whole
    sample filter, one of organisms or antibiotics the filter of both."""
    if not any(s is not None and not len(s) for s in (categories, regions, districts)):
        samples = chosen(samples, source_category=categories, region=regions, district=districts, site_type=sites, source_type=sources)
    if not any(s is not None and not len(s) for s in (organisms, antibiotics)):
        ast = chosen(ast, organism=organisms, antibiotic=antibiotics)
    return samples, of_samples(ast, samples)


def report(ast: DataFrame, samples: DataFrame, organisms: Chosen = None, antibiotics: Chosen = None, first: str | None = None, last: str | None = None, **dims: Chosen) -> DataFrame:
    """Tests of a report: sample dimensions, organisms and antibiotics, dates from first to last, both included."""
    ast = chosen(of_samples(ast, chosen(samples, **dims)), organism=organisms, antibiotic=antibiotics)
    return between(ast, first, last)


def between(ast: DataFrame, first: str | None, last: str | None, date: str = "test_date") -> DataFrame:
    if first is not None:
        ast = ast.where(F.col(date) >= F.lit(first).cast("date"))
    if last is not None:
        ast = ast.where(F.col(date) <= F.lit(last).cast("date"))
    return ast


def located(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def located_numbers(samples: DataFrame) -> DataFrame:
    """Samples whose coordinates are numbers, as numbers."""
    return located(samples.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")}))


def options(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, sorted, without null."""
    return df.select(F.col(col).cast("string").alias("value")).dropna().distinct().orderBy("value")


def group(ast: DataFrame, samples: DataFrame, categories: Sequence[str] = (), regions: Sequence[str] = ()) -> DataFrame:
    """Tests of a custom group; here an empty selection is no constraint."""
    return of_samples(ast, chosen(samples, source_category=categories or None, region=regions or None))


def preview(ast: DataFrame, n: int = 100) -> DataFrame:
    cols = ("sample_id", "isolate_id", "organism", "antibiotic", "result", "test_date")
    return ast.select(*cols).orderBy("isolate_id", "antibiotic").limit(n)


def recent(ast: DataFrame, n: int = 100) -> DataFrame:
    return ast.orderBy(F.desc("test_date"), "isolate_id", "antibiotic").limit(n)
