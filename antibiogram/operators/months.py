"""Counts of dated tests by dataset and month: what trends, seasons and forecasts are made of.

As a stored table it is kept up to date dataset by dataset: ``refresh`` counts the named datasets alone and replaces their rows,
so an upload, a merge or a deletion costs one dataset's scan, and a query reads a few rows a dataset and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from antibiogram.functions.exprs import n_of, percent

from .rates import known, period

SCHEMA = "dataset_id string, month date, tests long, rated long, s long, i long, r long"
COUNTS = ("tests", "rated", "s", "i", "r")


def counts(ast: DataFrame) -> DataFrame:
    """dataset_id, month (its first day), tests, those with a result, and those with S, I and R."""
    return known(ast, "test_date").groupBy("dataset_id", F.trunc("test_date", "MM").alias("month")).agg(
        F.count("*").alias("tests"), F.count("result").alias("rated"), *[n_of(x.upper()).alias(x) for x in ("s", "i", "r")]
    )


def refresh(path: str, ast: DataFrame, *dataset_ids: str) -> None:
    """Counts these datasets anew. Each also has a row without a month, so that one without dated tests is replaced as well."""
    spark = ast.sparkSession
    empty = spark.createDataFrame([(d, None, 0, 0, 0, 0, 0) for d in dataset_ids], SCHEMA)
    rows = counts(ast.where(F.col("dataset_id").isin(*dataset_ids))).unionByName(empty)
    rows.coalesce(1).write.partitionBy("dataset_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read(spark: SparkSession, path: str, *dataset_ids: str) -> DataFrame:
    """The stored counts, of all datasets if none is named."""
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("month").isNotNull())
    return rows.where(F.col("dataset_id").isin(*dataset_ids)) if dataset_ids else rows


def trend(months: DataFrame, kind: str = "month") -> DataFrame:
    """Percentages of R, I and S (of S + I + R) for each period with dated tests, in order."""
    sums = {c: F.sum(c) for c in ("r", "i", "s")}
    n = sums["r"] + sums["i"] + sums["s"]
    out = months.groupBy(period("month", kind).alias("period")).agg(n.alias("total"), *[percent(x, n).alias(c.upper()) for c, x in sums.items()])
    return out.where(F.col("total") > 0).orderBy("period")


def seasons(months: DataFrame) -> DataFrame:
    """Dry (November to March) and wet season: tests and R%; 0 without rows."""
    dry = F.month("month").isin(11, 12, 1, 2, 3)
    of = lambda c, season: F.coalesce(F.sum(F.when(season, F.col(c))), F.lit(0))
    rate = lambda season: F.coalesce(percent(of("r", season), of("tests", season)), F.lit(0.0))
    return months.agg(of("tests", dry).alias("dry_tests"), of("tests", ~dry).alias("wet_tests"), rate(dry).alias("dry_rate"), rate(~dry).alias("wet_rate"))


def forecast(months: DataFrame, periods: int = 3) -> DataFrame:
    """A least-squares line through the monthly R% (months with tests only, numbered 0, 1, ...) and its next values; one
    row with an error where there are under 3 dated tests or 2 months."""
    rates = months.groupBy("month").agg(percent(F.sum("r"), F.sum("rated")).alias("rate"), F.sum("tests").alias("n"))
    numbered = rates.withColumn("x", (F.row_number().over(Window.orderBy("month")) - 1).cast("double"))  # one row a month
    line = numbered.agg(
        F.regr_slope("rate", "x").alias("slope"), F.regr_intercept("rate", "x").alias("intercept"), F.count("*").alias("months"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )
    error = F.when(F.col("n") < 3, "Insufficient data for forecast").when(F.col("months") < 2, "Insufficient monthly data for forecast")
    ahead = F.when(error.isNull(), F.sequence(F.lit(1), F.lit(periods))).otherwise(F.array(F.lit(None).cast("int")))
    value = F.round(F.col("slope") * (F.col("months") - 1 + F.col("months_ahead")) + F.col("intercept"), 2)
    ok = F.col("error").isNull()
    return line.withColumn("error", error).withColumn("months_ahead", F.explode(ahead)).select(
        "months_ahead",
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))).alias("predicted_resistance_rate"),
        F.when(ok, F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")).alias("trend"),
        F.when(ok, F.round("slope", 4)).alias("trend_slope"),
        F.when(ok, F.when(F.col("months") >= 6, "moderate").otherwise("low")).alias("confidence"),
        "error",
    )
