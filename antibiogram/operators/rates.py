"""Resistance rates by any dimension. Null dimensions have no row; ties are in order of the dimension.

A test without a result counts where an operator speaks of rows, and not where it speaks of results; a group of which no
test has a result has no row in the tables of S, I and R.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antibiogram.functions.exprs import n_of, percent

KEYS = ("dataset_id", "sample_id")


def with_dims(ast: DataFrame, samples: DataFrame, *dims: str) -> DataFrame:
    """Tests with columns of their sample; a test without a sample has nulls. Only the named columns are carried."""
    return ast.join(samples.select(*KEYS, *dims), list(KEYS), "left")


def known(df: DataFrame, *dims: str) -> DataFrame:
    for d in dims:
        df = df.where(F.col(d).isNotNull())
    return df


def stats(ast: DataFrame) -> DataFrame:
    """One row: tests, counts and unrounded rates of S, I and R over all rows."""
    n = F.count("*")
    return ast.agg(
        n.alias("total_tests"),
        n_of("R").alias("resistant_count"),
        n_of("I").alias("intermediate_count"),
        n_of("S").alias("susceptible_count"),
        percent(n_of("R"), n).alias("resistance_rate"),
        percent(n_of("I"), n).alias("intermediate_rate"),
        percent(n_of("S"), n).alias("susceptibility_rate"),
    )


def sir_table(ast: DataFrame, *dims: str) -> DataFrame:
    """S, I, R, total = S + I + R and their percentages (2 digits), most resistant first."""
    out = known(ast, *dims).groupBy(*dims).agg(n_of("S").alias("susceptible"), n_of("I").alias("intermediate"), n_of("R").alias("resistant"))
    total = F.col("susceptible") + F.col("intermediate") + F.col("resistant")
    out = out.withColumn("total", total).where(F.col("total") > 0)
    for name in ("susceptible", "intermediate", "resistant"):
        out = out.withColumn(f"percent_{name}", percent(F.col(name), F.col("total"), 2))
    return out.orderBy(F.desc("percent_resistant"), *dims)


def antibiotic_rates(ast: DataFrame, top: int | None = None) -> DataFrame:
    """antibiotic, resistant, total (S + I + R), resistance_rate (2 digits), highest first."""
    out = known(ast, "organism", "antibiotic").groupBy("antibiotic").agg(n_of("R").alias("resistant"), F.count_if(F.col("result").isin("S", "I", "R")).alias("total"))
    out = out.where(F.col("total") > 0).withColumn("resistance_rate", percent(F.col("resistant"), F.col("total"), 2)).orderBy(F.desc("resistance_rate"), "antibiotic")
    return out.limit(top) if top else out


def shares(ast: DataFrame, *dims: str) -> DataFrame:
    """Unrounded percentages of R, I and S among a group's S, I and R."""
    n = F.count_if(F.col("result").isin("S", "I", "R"))
    return known(ast, *dims).groupBy(*dims).agg(n.alias("total"), *[percent(n_of(r), n).alias(r) for r in ("R", "I", "S")]).where(F.col("total") > 0)


def place_table(ast: DataFrame, *dims: str, top: int | None = None) -> DataFrame:
    """total (rows with a result), S, I, R and percent_resistant (2 digits), highest first; of a frame without ``result`` all are 0."""
    given = "result" in ast.columns
    if not given:
        ast = ast.withColumn("result", F.lit(None).cast("string"))
    out = known(ast, *dims).groupBy(*dims).agg(
        F.count("result").alias("total"), n_of("S").alias("susceptible"), n_of("I").alias("intermediate"), n_of("R").alias("resistant"), F.coalesce(percent(n_of("R"), F.count("result"), 2), F.lit(0.0)).alias("percent_resistant")
    )
    out = (out.where(F.col("total") > 0) if given else out).orderBy(F.desc("percent_resistant"), *dims)
    return out.limit(top) if top else out


def distribution(ast: DataFrame) -> DataFrame:
    """result, count, percentage (1 digit) of the grand total, label and the order S, I, R."""
    out = known(ast, "result").groupBy("result").agg(F.count("*").alias("count"))
    whole = F.sum("count").over(Window.partitionBy())  # a handful of rows: one a result
    label = F.when(F.col("result") == "S", "Susceptible").when(F.col("result") == "I", "Intermediate").when(F.col("result") == "R", "Resistant").otherwise(F.col("result"))
    order = F.when(F.col("result") == "S", 0).when(F.col("result") == "I", 1).when(F.col("result") == "R", 2).otherwise(3)
    return out.select("result", "count", percent(F.col("count"), whole, 1).alias("percentage"), label.alias("label"), order.alias("nth")).orderBy("nth", "result")


def heatmap(ast: DataFrame, organisms: int = 8, antibiotics: int = 10) -> DataFrame:
    """organism x antibiotic percent_resistant, 0 where untested: the first names of each in alphabetical order.

    The names become the pivot's columns, so they are looked up first: at most ``antibiotics`` strings."""
    judged = known(ast, "organism", "antibiotic").where(F.col("result").isin("S", "I", "R"))
    names = [r[0] for r in judged.select("antibiotic").distinct().orderBy("antibiotic").limit(antibiotics).collect()]
    if not names:
        return judged.select("organism").distinct()
    cells = [
        F.coalesce(
            percent(F.count_if((F.col("antibiotic") == a) & (F.col("result") == "R")), F.count_if((F.col("antibiotic") == a) & F.col("result").isin("S", "I", "R")), 2),
            F.lit(0.0),
        ).alias(a)
        for a in names
    ]
    return judged.groupBy("organism").agg(*cells).orderBy("organism").limit(organisms)


def comparison(ast: DataFrame, dim: str) -> DataFrame:
    """dim x result counts, total and the rates of R and S (2 digits) of the total."""
    n = F.count("result")
    out = known(ast, dim).groupBy(dim).agg(
        *[n_of(r).alias(r) for r in ("R", "I", "S")], n.alias("total"), percent(n_of("R"), n, 2).alias("resistance_rate"), percent(n_of("S"), n, 2).alias("susceptibility_rate")
    )
    return out.where(F.col("total") > 0)


def result_counts(ast: DataFrame, dataset_id: str | None = None) -> DataFrame:
    rows = ast if dataset_id is None else ast.where(F.col("dataset_id") == dataset_id)
    return rows.groupBy("organism", "antibiotic", "result").agg(F.count("*").alias("count"))


def report_rates(ast: DataFrame, *dims: str, digits: int = 1, whole: str = "result") -> DataFrame:
    """total_tests (rows with a result; with ``whole="*"`` all rows), resistant_count, resistance_rate, highest first."""
    n = F.count(whole)
    out = known(ast, *dims).groupBy(*dims).agg(n.alias("total_tests"), n_of("R").alias("resistant_count"), percent(n_of("R"), n, digits).alias("resistance_rate"))
    return out.orderBy(F.desc("resistance_rate"), *dims)


def report_rates_of(ast: DataFrame, samples: DataFrame, *dims: str, digits: int = 1) -> DataFrame:
    """``report_rates`` of each of these dimensions, of tests or of their samples: (dimension, value, total_tests, resistant_count,
    resistance_rate), all by one pass over the tests, one join and one aggregation."""
    rows = with_dims(ast, samples, *[d for d in dims if d not in ast.columns]).select(*dims, "result")
    which = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dims])
    n = F.count("result")
    out = rows.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        which.alias("dimension"), value.alias("value"), n.alias("total_tests"), n_of("R").alias("resistant_count"), percent(n_of("R"), n, digits).alias("resistance_rate")
    )
    return known(out, "value").select("dimension", "value", "total_tests", "resistant_count", "resistance_rate").orderBy("dimension", F.desc("resistance_rate"), "value")


def top_per_group(rates: DataFrame, group: str, item: str, n: int | None, rate: str = "resistance_rate") -> DataFrame:
    """The n items of each group with the highest rate (all, if there is no n), and their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(rate), item)
    out = rates.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.where(F.col("rank") <= n)


def sample_rates(ast: DataFrame) -> DataFrame:
    """Of each sample its R rows, its rows and the former's share of the latter."""
    n = F.count("*")
    return known(ast, "sample_id").groupBy(*KEYS).agg(n_of("R").alias("resistant_count"), n.alias("total_count"), percent(n_of("R"), n).alias("resistance_rate"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return known(df, *cols).groupBy(*cols).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *cols)


def distinct_counts(ast: DataFrame) -> DataFrame:
    return ast.agg(F.countDistinct("organism").alias("organisms"), F.countDistinct("antibiotic").alias("antibiotics"), F.countDistinct("sample_id").alias("samples"))


def period(date: str, kind: str):
    """Label of the date's month (2025-01), quarter (2025 Q1) or year (2025)."""
    c = F.col(date)
    if kind == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit(" Q"), F.quarter(c).cast("string"))
    return F.date_format(c, {"month": "yyyy-MM", "year": "yyyy"}[kind])


def rate_range(rates: DataFrame, dim: str) -> DataFrame:
    return rates.agg(F.min("resistance_rate").alias("lowest"), F.max("resistance_rate").alias("highest")).select(F.lit(dim).alias("dimension"), "lowest", "highest")


def date_range(ast: DataFrame) -> DataFrame:
    return ast.agg(F.min("test_date").alias("first_date"), F.max("test_date").alias("last_date"), F.count("test_date").alias("dated_tests"))


def most_frequent(ast: DataFrame, dim: str, n: int = 5, avoid_above: float = 50) -> DataFrame:
    """The n most tested values of a dimension, their R% (1 digit) and whether to avoid them."""
    rate = percent(n_of("R"), F.count("*"))
    out = known(ast, dim).groupBy(dim).agg(F.count("*").alias("count"), F.round(rate, 1).alias("resistance_rate"), F.when(rate > avoid_above, "Avoid").otherwise("Use").alias("advice"))
    return out.orderBy(F.desc("count"), dim).limit(n)


def most_sampled(samples: DataFrame, dim: str = "region", n: int = 5) -> DataFrame:
    """The n values of a dimension that most samples come from."""
    return known(samples, dim).groupBy(dim).agg(F.count("*").alias("count")).orderBy(F.desc("count"), dim).limit(n)
