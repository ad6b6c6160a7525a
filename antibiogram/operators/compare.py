"""Side-by-side comparisons: two groups, several items of a dimension, two periods, one pair over a variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antibiogram.functions.exprs import n_of, percent

from .filters import between, group
from .rates import known, report_rates, top_per_group, with_dims


def _rate(hit: Column) -> Column:
    return F.coalesce(percent(F.count_if(hit & (F.col("result") == "R")), F.count_if(hit)), F.lit(0.0))


def two_categories(ast: DataFrame, samples: DataFrame, a: str, b: str) -> DataFrame:
    """One row: tests and R% of categories a and b, and a - b."""
    rows = with_dims(ast, samples, "source_category")
    is_a, is_b = F.col("source_category") == a, F.col("source_category") == b
    out = rows.agg(F.count_if(is_a).alias("tests_a"), F.count_if(is_b).alias("tests_b"), _rate(is_a).alias("rate_a"), _rate(is_b).alias("rate_b"))
    return out.withColumn("difference", F.col("rate_a") - F.col("rate_b"))


def category_antibiotics(ast: DataFrame, samples: DataFrame, a: str, b: str, top: int = 10) -> DataFrame:
    """The most resisted antibiotics of either category (2 digits) and the other's rate of the same, 0 where it was not tested
    there. Only tests with an organism and a result count."""
    rows = known(with_dims(ast, samples, "source_category").where(F.col("source_category").isin(a, b)), "organism", "result")
    ranked = top_per_group(report_rates(rows, "source_category", "antibiotic", digits=2), "source_category", "antibiotic", None)
    side = lambda c: F.coalesce(F.max(F.when(F.col("source_category") == c, F.col("resistance_rate"))), F.lit(0.0))
    out = ranked.groupBy("antibiotic").agg(side(a).alias("rate_a"), side(b).alias("rate_b"), F.min("rank").alias("_best"))
    return out.where(F.col("_best") <= top).drop("_best")


def two_periods(ast: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """One row: tests and R% of two windows, both ends included, second - first and its trend."""
    inside = lambda w: F.coalesce(F.col("test_date").between(F.lit(w[0]).cast("date"), F.lit(w[1]).cast("date")), F.lit(False))
    out = ast.agg(F.count_if(inside(first)).alias("tests_1"), F.count_if(inside(second)).alias("tests_2"), _rate(inside(first)).alias("rate_1"), _rate(inside(second)).alias("rate_2"))
    change = F.col("rate_2") - F.col("rate_1")
    return out.withColumns({"difference": change, "trend": F.when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("stable")})


def period_organisms(ast: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """R% (1 digit) of organisms tested in both windows, the largest change first."""
    side = lambda w, k: report_rates(between(ast, *w), "organism", whole="*").select("organism", F.col("resistance_rate").alias(f"rate_{k}"))
    out = side(first, 1).join(side(second, 2), "organism").withColumn("change", F.round(F.col("rate_2") - F.col("rate_1"), 1))
    return out.orderBy(F.desc(F.abs("change")), "organism")


def compare_by(ast: DataFrame, dim: str, items: Sequence[str] | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Items of a dimension: rate (1 digit), counts and their percentages; items without tests have no row."""
    rows = ast if samples is None else with_dims(ast, samples, dim)
    if items is not None:
        rows = rows.where(F.col(dim).isin(list(items)))
    n = F.count("*")
    out = known(rows, dim).groupBy(F.col(dim).alias("item")).agg(
        percent(n_of("R"), n, 1).alias("resistance_rate"), n.alias("total"), *[n_of(r).alias(r) for r in ("R", "S", "I")], *[percent(n_of(r), n).alias(f"percent_{r}") for r in ("R", "S", "I")]
    )
    return out.orderBy(F.desc("resistance_rate"), "item")


def compare_top(ast: DataFrame, dim: str, within: str, samples: DataFrame | None = None, top: int = 5) -> DataFrame:
    """For each item, its organisms or antibiotics with the highest R% (1 digit)."""
    rows = ast if samples is None else with_dims(ast, samples, dim)
    return top_per_group(report_rates(rows, dim, within, digits=1, whole="*"), dim, within, top)


def first_items(ast: DataFrame, dim: str, n: int) -> DataFrame:
    """The dashboard's default selection: the first n items in alphabetical order."""
    return ast.select(dim).where(F.col(dim).isNotNull()).distinct().orderBy(dim).limit(n)


def cross(ast: DataFrame, samples: DataFrame, organism: str, antibiotic: str, variable: str) -> DataFrame:
    """One organism and antibiotic over a sample variable, or over ``month`` of collection."""
    rows = ast.where((F.col("organism") == organism) & (F.col("antibiotic") == antibiotic))
    if variable == "month":
        rows = with_dims(rows, samples, "collection_date").withColumn("month", F.date_format("collection_date", "yyyy-MM"))
        return compare_by(rows, "month")
    return compare_by(rows, variable, samples=samples)


def custom_groups(ast: DataFrame, samples: DataFrame, a: dict, b: dict) -> DataFrame:
    """One row: tests and R% of two custom groups, which may overlap, and b - a."""
    one = lambda g, k: group(ast, samples, **g).agg(F.count("*").alias(f"tests_{k}"), F.coalesce(percent(n_of("R"), F.count("*")), F.lit(0.0)).alias(f"rate_{k}"))
    return one(a, "a").join(F.broadcast(one(b, "b"))).withColumn("difference", F.col("rate_b") - F.col("rate_a"))  # one row each


def overview_metrics(ast: DataFrame, samples: DataFrame) -> DataFrame:
    t = ast.agg(percent(n_of("R"), F.count("*"), 1).alias("resistance_rate"), F.count("*").alias("tests"), F.countDistinct("organism").alias("organisms"))
    return t.join(F.broadcast(samples.agg(F.countDistinct("sample_id").alias("samples"))))  # one row each
