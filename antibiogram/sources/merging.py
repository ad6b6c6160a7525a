"""A merge of one stored dataset into another, written so that it happens once and whole.

The merged tables are first staged beside the store's, then a marker tells that they are whole, then the folders of the target
dataset are exchanged: samples, tests and, last, its registry row. Whatever ends the process, the same call finishes the merge:
without the marker it stages anew, with it it only moves what still is staged, so nothing is merged from tables that are merged
already. A finished merge leaves a marker under its name, and the same call again does nothing.

Readers see the target's old tables or its new ones, and between a folder's removal and its exchange none; the registry row is
that of the old tables until all is there. One merge into a target at a time: two would stage from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, io, mart

STAGED, DONE = "_staged", "_merged"


class Folders:
    """Files of any store that Spark's Hadoop configuration reaches."""

    def __init__(self, spark: SparkSession, top: str):
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str, prefix: str) -> list[str]:
        """What follows the prefix in the names of a folder's entries, in order; none if there is no such folder."""
        if not self.exists(name):
            return []
        entries = [e.getPath().getName() for e in self._fs.listStatus(self._path(name))]
        return sorted(e.removeprefix(prefix) for e in entries if e.startswith(prefix))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def mark(self, name: str) -> None:
        self._fs.create(self._path(name), True).close()

    def move(self, name: str, to: str) -> None:
        """``name`` takes the place of ``to``."""
        self._fs.delete(self._path(to), True)
        self._fs.mkdirs(self._path(to).getParent())
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} could not be moved to {to}")


def stage(spark: SparkSession, path: str, at: str, source: str, into: str) -> tuple[int, int]:
    """Writes the merged tables of ``into`` under ``at``; how many samples and tests the source has."""
    samples, ast, registry = (io.scan(spark, path, t) for t in ("samples", "ast_results", "datasets"))
    added = [df.where(F.col("dataset_id") == source).count() for df in (samples, ast)]
    parts = mart.buckets_for(added[1] + io.scan(spark, path, "ast_results", into).count(), int(spark.conf.get("spark.sql.shuffle.partitions")), mart.TASK_ROWS)
    merged: tuple[DataFrame, DataFrame, DataFrame] = catalog.merge(samples, ast, registry, source, into, parts)
    for table, df in zip(io.TABLES, merged, strict=True):
        own = df.where(F.col("dataset_id") == into)
        with io.unsorted_writes(spark):
            io.conform(own, io.TABLES[table]).write.partitionBy("dataset_id").mode("overwrite").parquet(f"{at}/{table}")
    return added[0], added[1]


def merge_stored(spark: SparkSession, path: str, source: str, into: str, name: str | None = None) -> bool:
    """Merges dataset ``source`` into ``into`` in the store; False if a merge of this name is finished already. ``name`` tells one
    merge of the two from another. An empty source is an error, as is a target that the registry does not list."""
    folders, name = Folders(spark, path), name or f"{source}-into-{into}"
    if folders.exists(f"{DONE}/{name}"):
        return False
    at = f"{STAGED}/{name}"
    if not folders.exists(f"{at}/whole"):
        folders.delete(at)
        if io.scan(spark, path, "datasets", into).isEmpty():
            raise ValueError(f"no dataset {into!r}")
        if not any(stage(spark, path, f"{path}/{at}", source, into)):
            folders.delete(at)
            raise ValueError(f"dataset {source!r} is empty")
        folders.mark(f"{at}/whole")
    for table in ("samples", "ast_results", "datasets"):
        staged = f"{at}/{table}/dataset_id={into}"
        if folders.exists(staged):
            folders.move(staged, f"{table}/dataset_id={into}")
    folders.mark(f"{DONE}/{name}")
    folders.delete(at)
    return True
