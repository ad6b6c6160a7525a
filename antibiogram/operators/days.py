"""Tests by dataset and day, with bitmaps of the organisms, antibiotics and samples that occur: exact distinct counts that add up.

Each different value has a number, given once and kept; a value's number is a bit of the bitmaps (32,768 bits each) of the days it
occurs on. The distinct values of any days and datasets are the bits of their bitmaps taken together, so such a count reads
neither tests nor values again, and several of them need no rows multiplied. Numbers follow the first day of a value, so the samples
of a day lie in few bitmaps.

``add`` takes a batch of tests (an upload, a day): values that have no number yet get the next ones. Its counts are written last
and mark it whole: a batch that ended before is written anew by the same call, one that is whole is not added again. One batch
at a time.

Null values have no bit; tests without a date are those of a day null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antibiogram.functions.exprs import n_of
from antibiogram.sources.merging import Folders

KINDS = ("organism", "antibiotic", "sample_id")
NUMBERS = "kind string, value string, number long, batch string"
BITS = "dataset_id string, day date, kind string, bucket long, bits binary, batch string"
COUNTS = "dataset_id string, day date, tests long, r long, i long, s long, batch string"
#: A partition's numbers begin at a multiple of this.
SHIFT = 33


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The batches that are whole."""
    folders = Folders(spark, path)
    return [name for name in folders.names("counts", "batch=") if folders.exists(f"counts/batch={name}/_SUCCESS")]


def _read(spark: SparkSession, path: str, table: str, schema: str, batches: list[str]) -> DataFrame:
    """A table's rows of these batches; only their folders are read."""
    columns = schema.rpartition(",")[0]
    if not batches:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*[f"{path}/{table}/batch={b}" for b in batches])


def add(path: str, ast: DataFrame, batch: str) -> bool:
    """Adds a batch of tests; False if it is there already."""
    spark = ast.sparkSession
    done = _batches(spark, path)
    if batch in done:
        return False
    write = lambda df, table: df.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch}")
    day = F.col("test_date").alias("day")
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])).alias("v")
    seen = ast.select("dataset_id", day, values).select("dataset_id", "day", "v.*").where(F.col("value").isNotNull()).distinct()
    known = _read(spark, path, "numbers", NUMBERS, done)
    new = seen.groupBy("kind", "value").agg(F.min("day").alias("_first")).join(known, ["kind", "value"], "left_anti")
    last = known.agg(F.max("number")).first()[0]
    base = 0 if last is None else ((last >> SHIFT) + 1) << SHIFT
    # The number of a row is that of its partition and place, so numbers are written before they are used.
    ordered = new.repartitionByRange("kind", "_first", F.xxhash64("value")).select("kind", "value", (F.monotonically_increasing_id() + F.lit(base)).alias("number"))
    write(ordered, "numbers")
    numbered = seen.join(_read(spark, path, "numbers", NUMBERS, [*done, batch]), ["kind", "value"])
    number = F.col("number")
    write(numbered.groupBy("dataset_id", "day", "kind", F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")), "bits")
    write(ast.groupBy("dataset_id", day).agg(F.count("*").alias("tests"), *[n_of(x.upper()).alias(x) for x in ("r", "i", "s")]).coalesce(1), "counts")
    return True


class Days:
    """The stored days, of all datasets and days unless ``where`` narrows them."""

    def __init__(self, counts: DataFrame, bits: DataFrame):
        self.counts, self.bits = counts, bits

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Days:
        done = _batches(spark, path)
        return cls(_read(spark, path, "counts", COUNTS, done), _read(spark, path, "bits", BITS, done))

    def where(self, condition) -> Days:
        """Days that meet a condition on ``dataset_id`` and ``day``."""
        return Days(self.counts.where(condition), self.bits.where(condition))

    def distinct(self, *by: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
        """Of each group of ``by`` (``dataset_id``, ``day``; none: one row) how many different values of each kind occur. A group
        without any value has no row."""
        bits = self.bits.where(F.col("kind").isin(*kinds)).groupBy(*by, "kind", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("_n"))
        return bits.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("_n"))), F.lit(0)).alias(k) for k in kinds])

    def distinct_counts(self) -> DataFrame:
        """As ``rates.distinct_counts``."""
        names = {"organism": "organisms", "antibiotic": "antibiotics", "sample_id": "samples"}
        return self.distinct().withColumnsRenamed(names)

    def activity(self, as_of: str) -> DataFrame:
        """One row: tests, organisms, antibiotics, tests of the 30 days before a date and later; what ``score.kpis`` needs of tests."""
        recent = F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), 30), F.col("tests"))), F.lit(0))
        tests = self.counts.agg(F.coalesce(F.sum("tests"), F.lit(0)).alias("total_tests_performed"), recent.alias("tests_last_30_days"))
        names = self.distinct(kinds=("organism", "antibiotic")).withColumnsRenamed({"organism": "organisms_identified", "antibiotic": "antibiotics_tested"})
        return tests.join(F.broadcast(names))  # one row each
