"""What several corpus operators share: tables, checkpoints, skew-safe lookups, row verdicts and components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract of this subpackage, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
#: Keys of a set that may be broadcast: about 40 bytes each, so 10 MB at most.
FEW_KEYS = 250_000
#: Rows of one key that a single task may get in ``lookup``.
KEY_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """This package as a zip for the executors' Python, once for each application, as ``--py-files`` would send it."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "antibiogram_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Before Python runs in tasks: they get this package, and, since rows are whole documents here, fewer rows at a time.

    Only Spark's own default is replaced; any other number is the user's and stays.
    """
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000" and spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, rows)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master, where driver and tasks share one disk, may do
    without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Paths that ``table`` wrote and nobody dropped yet, each with what deletes it.
_TABLES: dict[str, object] = {}


def table(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: cuts lineage, survives lost executors,
    and stays columnar, so later reads take only the columns they need.

    The folder stays while a result may still read it: until ``drop_tables`` or the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _TABLES:
        atexit.register(drop_tables)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _TABLES[path] = (hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> list[str]:
    """The tables that are still there, in the order in which they were written."""
    return list(_TABLES)


def drop_tables(paths: list[str] | None = None) -> None:
    """Deletes the folders of these tables, or of all that this process wrote; frames that read them are of no use then."""
    for path in list(_TABLES) if paths is None else paths:
        found = _TABLES.pop(path, None)
        if found is not None:
            found[0].delete(found[1], True)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that models never learn from; a null id counts as not held out (and is never learned from either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def may_learn(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~is_held_out(doc_id)


def named(col: str) -> Column:
    """The column of exactly this name, whatever its characters."""
    return F.col("`" + col.replace("`", "``") + "`")


def unit_hash(*cols: str) -> Column:
    """A number in [0, 1) that depends on the row's own values alone."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(1 << 40)) / float(1 << 40)


def lookup(rows: DataFrame, classes: DataFrame, key: str, size: str, spread: Column, n_rows: int) -> DataFrame:
    """``rows`` with the columns of ``classes`` (one row a ``key``, ``size`` = rows that have it), plus ``_salt``.

    A key of more than ``KEY_ROWS`` rows, or of a thousandth of all rows where that is less, is dealt over as many
    partitions as it has such shares, by the hash of ``spread``, so what one task gets of a key is bounded whatever the
    input. ``spread`` must tell a key's rows apart, and be the same whenever they are read. There are at most n_rows / share
    such keys; the share is large enough for their list to be broadcast.
    """
    share = max(min(max(n_rows // 1000, 16), KEY_ROWS), n_rows // FEW_KEYS)
    parts = F.ceil(F.col(size) / share).cast("int")
    hot = F.broadcast(classes.where(F.col(size) > share).select(key, parts.alias("_hot")))
    salted = (
        rows.withColumn("_spread", spread)
        .join(hot, key, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_spread"), F.col("_hot")), F.lit(0)).cast("int"))
        .drop("_hot", "_spread")
    )
    salts = F.sequence(F.lit(0), F.when(F.col(size) > share, parts - 1).otherwise(F.lit(0)))
    return salted.join(classes.withColumn("_salt", F.explode(salts)).hint("shuffle_hash"), [key, "_salt"])


def text_key(text: Column) -> Column:
    """128 bits that stand for a text in ``without``; null is a text of its own."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("+"), text), F.lit("-"))))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, tied: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose (id, text) is among ``gone`` (_id, _k), all columns kept; each row is judged by itself.

    Of the rows of one (id, text) among ``tied`` a single one stays, any of them (they may differ in other columns). The
    pairs are broadcast where they are few; else the rows meet them in one shuffle by (id, text).
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key = rows[names[docs.columns.index(id_col)]], text_key(rows[names[docs.columns.index(text_col)]])
    rows = rows.select("*", key[0].alias("_i"), key[1].alias("_t"))

    def keyed(pairs: DataFrame) -> tuple[DataFrame, Column]:
        pairs = table(pairs.select("_id", "_k").distinct())
        few = pairs.count() <= FEW_KEYS
        return (F.broadcast(pairs) if few else pairs), rows["_i"].eqNullSafe(pairs["_id"]) & (rows["_t"] == pairs["_k"])

    pairs, on = keyed(gone)
    left = rows.join(pairs, on, "left_anti")
    if tied is not None and not tied.isEmpty():
        pairs, on = keyed(tied)
        once = rows.join(pairs, on, "left_semi").dropDuplicates(["_i", "_t"])
        left = left.join(pairs, on, "left_anti").unionByName(once)
    return left.select(*names).toDF(*docs.columns)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the smallest node that it reaches.

    Each round every node points to the smallest id among itself and its neighbours, and the links that remain join the
    neighbours to that id (large star, then small star), so paths shrink by powers; rounds follow the logarithm of the
    longest path. The links stay a table in the shared folder; the driver sees two numbers a round. Links of a node with
    very many, such as the root of a large component, are dealt over partitions (``lookup``).
    """
    spark = links.sparkSession
    edges = table(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    n = edges.count()
    if not n:
        return spark.createDataFrame([], f"node {dict(links.dtypes)['a']}, root {dict(links.dtypes)['a']}")
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.sum((F.col("b") > F.col("a")).cast("long")).alias("n"))
        up = lookup(both.where(F.col("b") > F.col("a")), low.where("n > 0"), "a", "n", F.col("b"), n)
        large = table(up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # every link now goes from a larger to a smaller id; small star: link a's smaller neighbours to its smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = lookup(large, low, "a", "n", F.col("b"), n)
        star = joined.select("a", F.col("m").alias("b")).union(joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = table(star.distinct())
        was, n = n, new.count()
        done = n == was and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
