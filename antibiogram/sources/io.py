"""Files in and out: sheets of text, workbooks, dataset tables partitioned by dataset_id, the template."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workbook
from .schema import AST, DATASETS, REQUIRED, SAMPLES
from .workbook import sheet_names as sheet_names


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Both sheets of the uploaded workbooks under a path (a file or a folder) as text, with row_no (the row's number in the
    sheet). A workbook that lacks one of them is an error; ``sheet_names`` tells before."""
    return {sheet: workbook.read_sheet(spark, path, sheet) for sheet in REQUIRED}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as text from CSV, with row_no where the file has no such column (order within the file, not gapless)."""
    df = spark.read.csv(path, header=True)
    return df if "row_no" in df.columns else df.withColumn("row_no", F.monotonically_increasing_id() + 2)


def conform(df: DataFrame, schema) -> DataFrame:
    """The schema's columns: cast where they are, null where they are not, NaN as null."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.when(~F.isnan(c), c) if f.dataType.typeName() == "double" else c).alias(f.name))
    return df.select(*out)


TABLES = {"samples": SAMPLES, "ast_results": AST, "datasets": DATASETS}


#: Datasets of which a writing task keeps a file open; only rows of further ones are sorted.
OPEN_FILES = 8


@contextlib.contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Within it a task writes rows to their datasets' files as they come. Else Spark sorts all rows of a task by dataset first,
    and such a task may read 128 MB of files, tens of millions of rows."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def put(path: str, table: str, df: DataFrame) -> None:
    """Rows of whole datasets into a table of the store; each dataset replaces what an earlier attempt left of it."""
    with unsorted_writes(df.sparkSession):
        conform(df, TABLES[table]).write.partitionBy("dataset_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{table}")


def listed(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of the datasets that the registry lists. It has a row a dataset, so it is broadcast: by dataset, rows would meet in as
    many tasks as there are datasets."""
    return df.join(F.broadcast(registry.select("dataset_id")), "dataset_id", "left_semi")


def write_datasets(path: str, registry: DataFrame, samples: DataFrame, ast: DataFrame) -> None:
    """The datasets that the registry lists, a write a table whatever their number: samples, tests and then the registry, so
    that a dataset is listed only once it is whole. The registry's counts are those of the written files."""
    spark = registry.sparkSession
    counts = registry.drop("rows_samples", "rows_tests")
    for table, df, rows in (("samples", samples, "rows_samples"), ("ast_results", ast, "rows_tests")):
        put(path, table, listed(df, registry))
        n = scan(spark, path, table).groupBy("dataset_id").agg(F.count("*").alias(rows))
        counts = counts.join(n, "dataset_id", "left").withColumn(rows, F.coalesce(rows, F.lit(0)))
    put(path, "datasets", counts)


def write_dataset(path: str, dataset_id: str, name: str, samples: DataFrame, ast: DataFrame, by: str, at: str, country: str | None = None, main: bool = False) -> None:
    """One dataset, as ``write_datasets`` does."""
    own = F.lit(dataset_id)
    registry = samples.sparkSession.createDataFrame([(dataset_id, name, by, at, None, None, country, main)], DATASETS)
    write_datasets(path, registry, samples.withColumn("dataset_id", own), ast.withColumn("dataset_id", own))


def scan(spark: SparkSession, path: str, table: str, dataset_id: str | None = None) -> DataFrame:
    """A table, or one dataset's partition of it."""
    schema = TABLES[table]
    df = spark.read.schema(schema).parquet(f"{path}/{table}").select(schema.names)
    return df if dataset_id is None else df.where(F.col("dataset_id") == dataset_id)


def delete_dataset(spark: SparkSession, path: str, dataset_id: str) -> None:
    """Tests, samples, then the registry row: a dataset's folder of each table."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in ("ast_results", "samples", "datasets"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/dataset_id={dataset_id}")
        folder.getFileSystem(conf).delete(folder, True)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def health(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many datasets the store lists."""
    return scan(spark, path, "datasets").agg(F.count("*").alias("datasets"))


def store_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under the one that the cluster names, or, on a local master without one, a
    temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="store-")
    return f"{named}/store-{uuid.uuid4().hex}"


def template(spark: SparkSession) -> dict[str, DataFrame]:
    """The example upload: three samples and three tests."""
    # The rows of the example.
    samples = [
        ("SAMPLE_001", "2024-01-15", "Ashanti", "Kumasi", "Water Treatment Plant", "ENVIRONMENT", "treated_water", "", "treated_water", "6.6326", "-1.6243"),
        ("SAMPLE_002", "2024-01-20", "Greater Accra", "Accra", "Retail Market", "FOOD", "raw_chicken", "chicken", "", "5.6037", "-0.1870"),
        ("SAMPLE_003", "2024-01-25", "Eastern", "Koforidua", "Hospital Lab", "HUMAN", "clinical_specimen", "", "", "6.1256", "-0.3597"),
    ]
    tests = [
        ("SAMPLE_001", "ISO_001", "E. coli", "Ampicillin", "R", "DD", "CLSI", "2024-01-20", None, "15.0"),
        ("SAMPLE_001", "ISO_002", "E. coli", "Ciprofloxacin", "S", "DD", "EUCAST", "2024-01-20", None, "28.0"),
        ("SAMPLE_002", "ISO_003", "Salmonella", "Ampicillin", "I", "MIC", "CLSI", "2024-01-22", "0.5", None),
    ]
    frame = lambda rows, sheet: spark.createDataFrame([(*r, k) for k, r in enumerate(rows, 2)], ", ".join(f"{c} string" for c in REQUIRED[sheet]) + ", row_no long")
    return {"samples": frame(samples, "samples"), "ast_results": frame(tests, "ast_results")}


def write_template(spark: SparkSession, path: str) -> None:
    """The example upload as a workbook with both sheets, in the folder ``path``."""
    workbook.write_workbooks(template(spark), path, order="row_no")
