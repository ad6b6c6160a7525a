"""Samples and tests as bucketed tables, so that tests meet their samples without a shuffle.

Both tables are dealt into the same number of buckets by (dataset_id, sample_id) and sorted by it within each; a join on these
columns reads bucket beside bucket. ``buckets`` should keep a bucket of tests at some hundred megabytes; a later ``append``
deals its rows into the same buckets.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("dataset_id", "sample_id")
TABLES = ("samples", "tests")
#: Tests that a bucket should hold at most.
BUCKET_ROWS = 8_000_000
#: Rows that a task should sort at most, whatever the tables' size, where their number is known before they are dealt.
TASK_ROWS = 500_000


def buckets_for(n_tests: int, at_least: int, rows: int = BUCKET_ROWS) -> int:
    """A number of buckets for so many tests, a multiple of ``at_least`` (the cores that should have work)."""
    return at_least * max(1, -(-n_tests // (rows * at_least)))


@contextlib.contextmanager
def shuffle_partitions(spark: SparkSession, parts: int) -> Iterator[None]:
    """Within it rows meet in so many partitions, fewer only where Spark finds them small: for aggregations, whose rows are combined
    before they are dealt, so that no ``repartition`` may come before."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(parts))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(name: str, path: str, samples: DataFrame, tests: DataFrame, buckets: int, mode: str = "overwrite") -> None:
    """Tables ``name_samples`` and ``name_tests`` under ``path``: each task writes one bucket's file. Rows that are dealt by the keys into as many
    partitions already are not dealt again."""
    for table, df in zip(TABLES, (samples, tests), strict=True):
        writer = df.repartition(buckets, *KEYS).write.mode(mode).bucketBy(buckets, *KEYS).sortBy(*KEYS)
        writer.option("path", f"{path}/{table}").saveAsTable(f"{name}_{table}")


def append(name: str, path: str, samples: DataFrame, tests: DataFrame) -> None:
    """Further rows, in the buckets of those that are there."""
    spark = samples.sparkSession
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name}_tests").where(F.col("col_name") == "Num Buckets").first()
    write(name, path, samples, tests, int(found.data_type), "append")


def read(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """(samples, tests)."""
    return spark.table(f"{name}_samples"), spark.table(f"{name}_tests")


def drop(spark: SparkSession, name: str) -> None:
    """The tables' entries in the catalog; their files stay where they were written."""
    for table in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
