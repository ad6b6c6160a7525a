"""The dataset registry, and merging a dataset into a main one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc("uploaded_at"), "dataset_id")


def main(datasets: DataFrame, country: str | None = None) -> DataFrame:
    rows = datasets.where(F.col("is_country_main"))
    return newest(rows if country is None else rows.where(F.col("country") == country))


def by_uploader(datasets: DataFrame, email: str) -> DataFrame:
    return newest(datasets.where(F.col("uploaded_by") == email))


def visible(datasets: DataFrame) -> DataFrame:
    """Without those of the administrator, however the name is written."""
    return newest(datasets.where(F.lower(F.trim(F.coalesce("uploaded_by", F.lit("")))) != "admin"))


def set_main(datasets: DataFrame, dataset_id: str, is_main: bool, country: str | None = None) -> DataFrame:
    """The registry with the flag of one dataset set; other mains stay. A country given is set with the flag, and without
    the flag only where none is."""
    own = F.col("dataset_id") == dataset_id
    named = F.lit(country).cast("string")
    place = F.coalesce(named, "country") if is_main else F.coalesce("country", named)
    return datasets.withColumns({"is_country_main": F.when(own, F.lit(is_main)).otherwise(F.col("is_country_main")), "country": F.when(own, place).otherwise(F.col("country"))})


def _blank(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col)) == "", F.lit(True))


def _numbered(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """Rows numbered from 1 in this order. Only the counts of equal keys pass through one task; rows are numbered among those
    of their key."""
    keys = df.groupBy(*order).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    starts = keys.select(*[F.col(c).alias(f"_{c}") for c in order], F.coalesce(before, F.lit(0)).alias("_first"))
    on = F.lit(True)
    for c in order:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    nth = F.row_number().over(Window.partitionBy(*order).orderBy(F.lit(0)))
    return df.withColumn("_nth", nth).join(starts, on).withColumn(name, F.col("_first") + F.col("_nth")).drop("_nth", "_first", *[f"_{c}" for c in order])


def _named(df: DataFrame, col: str, source: str, kind: str, order: tuple[str, ...]) -> DataFrame:
    """``source-id``; blank ids are numbered ``source-kind-k`` in the given order. Only blank rows are numbered."""
    filled = df.where(~_blank(col)).withColumn(col, F.concat(F.lit(f"{source}-"), F.col(col)))
    blank = _numbered(df.where(_blank(col)), order, "_k").withColumn(col, F.concat(F.lit(f"{source}-{kind}-"), F.col("_k").cast("string"))).drop("_k")
    return filled.unionByName(blank)


def upsert(old: DataFrame, new: DataFrame, *key: str, parts: int | None = None) -> DataFrame:
    """Rows of both; of a key the new one. ``parts``: how many partitions they meet in, where Spark's own number is not meant."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    both = both if parts is None else both.repartition(parts, *key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new")))
    return both.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth", "_new")


def merge(samples: DataFrame, ast: DataFrame, datasets: DataFrame, source: str, into: str, parts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, tests, registry) of dataset ``into`` after copying ``source`` into it under prefixed ids; ``parts`` as in ``upsert``."""
    of = lambda df, d: df.where(F.col("dataset_id") == d)
    s, a = of(samples, source), of(ast, source)
    moved_s = _named(s, "sample_id", source, "sample", ("region", "district", "collection_date")).withColumn("dataset_id", F.lit(into))
    # A test without a sample id belongs to the last of the samples without one; where there is none, to the bare prefix.
    blanks = s.where(_blank("sample_id")).agg(F.count("*").alias("_blanks"))
    nameless = F.when(F.col("_blanks") > 0, F.concat(F.lit(f"{source}-sample-"), F.col("_blanks").cast("string"))).otherwise(f"{source}-")
    linked = a.join(F.broadcast(blanks)).withColumn("sample_id", F.when(_blank("sample_id"), nameless).otherwise(F.concat(F.lit(f"{source}-"), F.col("sample_id")))).drop("_blanks")
    moved_a = _named(linked, "isolate_id", source, "isolate", ("organism", "antibiotic", "test_date")).withColumn(
        "dataset_id", F.lit(into)
    )
    added = s.agg(F.countDistinct("sample_id").alias("_s")).join(F.broadcast(a.agg(F.count("*").alias("_a"))))  # one row each
    registry = datasets.join(F.broadcast(added)).withColumns(
        {c: F.when(F.col("dataset_id") == into, F.col(c) + F.col(x)).otherwise(F.col(c)) for c, x in (("rows_samples", "_s"), ("rows_tests", "_a"))}
    )
    return upsert(of(samples, into), moved_s, "dataset_id", "sample_id", parts=parts), upsert(of(ast, into), moved_a, "dataset_id", "isolate_id", "antibiotic", parts=parts), registry.drop("_s", "_a")
