"""Surveillance tables derived from the driver's order tables.

``samples`` is orders with their customer's place, ``tests`` is line items with their order; ``tests`` keeps one row for
each (isolate, antibiotic), ``raw_tests`` all. ``SQL`` is the same for the oracle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORGANISMS = (
    "Escherichia coli", "Klebsiella pneumoniae", "Salmonella enterica", "Enterobacter cloacae", "Staphylococcus aureus",
    "Pseudomonas aeruginosa", "Acinetobacter baumannii", "Enterococcus faecalis", "Proteus mirabilis", "Citrobacter freundii",
)
ANTIBIOTICS = (
    "Ampicillin", "Amoxicillin", "Ceftazidime", "Cefotaxime", "Ceftriaxone", "Cefepime", "Imipenem", "Meropenem", "Gentamicin",
    "Amikacin", "Ciprofloxacin", "Levofloxacin", "Tetracycline", "Doxycycline", "Erythromycin", "Azithromycin", "Oxacillin",
    "Methicillin", "Vancomycin", "Sulfamethoxazole", "Trimethoprim", "Chloramphenicol", "Clindamycin", "Colistin",
)
SITES = {"O": "Hospital", "F": "Farm", "P": "Market"}
CATEGORIES = {"HOUSEHOLD": "HUMAN", "BUILDING": "ENVIRONMENT", "FURNITURE": "FOOD", "MACHINERY": "ANIMAL", "AUTOMOBILE": "AQUACULTURE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _mapped(col: str, names: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(F.col(col) == kv[0], kv[1]), names.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def _dataset(key: str) -> Column:
    return F.concat(F.lit("DS"), (F.col(key) % 4).cast("string"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    located = F.col("o_custkey") % 10 != 0
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows and 5: fixed by the source
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _dataset("o_orderkey").alias("dataset_id"),
            F.col("o_orderkey").cast("string").alias("sample_id"),
            F.col("o_orderdate").cast("date").alias("collection_date"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("district"),
            _mapped("o_orderstatus", SITES).alias("site_type"),
            _mapped("c_mktsegment", CATEGORIES).alias("source_category"),
            F.col("o_orderpriority").alias("source_type"),
            F.when(located, 4.5 + (F.col("n_nationkey") % 5) * 1.4).alias("latitude"),
            F.when(located, -3.0 + (F.col("n_nationkey") % 4) * 1.0).alias("longitude"),
        )
    )


def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows with the names of their order's sample, dealt by them."""
    return df.withColumns({"dataset_id": _dataset(key), "sample_id": F.col(key).cast("string")}).repartition(parts, "dataset_id", "sample_id")


def raw_tests(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Line items with their order; with ``parts``, both are dealt into so many partitions by (dataset_id, sample_id) before any
    of the texts is made, and the result is dealt likewise."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if parts is None:
        rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"dataset_id": _dataset("l_orderkey"), "sample_id": F.col("l_orderkey").cast("string")})
    else:
        rows = _dealt(li, "l_orderkey", parts).join(_dealt(o, "o_orderkey", parts), ["dataset_id", "sample_id"])
    base = 4 * (F.col("o_custkey") % 10)
    q = F.col("l_quantity")
    mic = F.col("l_linestatus") == "F"
    return rows.select(
        "dataset_id",
        "sample_id",
        F.col("sample_id").alias("isolate_id"),
        _one_of(ORGANISMS, F.col("o_custkey") % 10).alias("organism"),
        _one_of(ANTIBIOTICS, F.col("l_partkey") % 24).alias("antibiotic"),
        F.when(q <= 5 + base, "R").when(q <= 9 + base, "I").otherwise("S").alias("result"),
        F.when(mic, "MIC").otherwise("DD").alias("method"),
        F.when(F.col("l_suppkey") % 2 == 0, "CLSI").otherwise("EUCAST").alias("guideline"),
        F.col("l_shipdate").cast("date").alias("test_date"),
        F.when(mic, q / 4).alias("mic_value"),
        F.when(~mic, q).alias("zone_diameter"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
    )


def tests(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One row for each isolate and antibiotic. Rows are dealt by the columns that join them with their samples, so the same
    exchange serves this and that join, and a filter on either column reaches the scan. ``parts`` as in ``raw_tests``: then
    line items are moved only once."""
    first = Window.partitionBy("dataset_id", "sample_id", "isolate_id", "antibiotic").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = raw_tests(spark, sf_dir, parts)
    rows = rows.repartition("dataset_id", "sample_id") if parts is None else rows
    return rows.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") == 1).drop("_nth", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def datasets(samples: DataFrame, tests: DataFrame) -> DataFrame:
    """The registry: one row a dataset, counted from the two tables."""
    s = samples.groupBy("dataset_id").agg(F.count("*").alias("rows_samples"))
    t = tests.groupBy("dataset_id").agg(F.count("*").alias("rows_tests"))
    k = F.substring("dataset_id", 3, 9).cast("int")
    return s.join(t, "dataset_id").select(
        "dataset_id",
        F.concat(F.lit("Dataset "), k.cast("string")).alias("dataset_name"),
        F.when(k == 0, " Admin ").when(k == 1, "a@lab.org").otherwise("b@lab.org").alias("uploaded_by"),
        F.concat(F.lit("2025-01-0"), (k + 1).cast("string")).alias("uploaded_at"),
        "rows_samples",
        "rows_tests",
        F.when(k < 2, "Ghana").when(k == 2, "Togo").alias("country"),
        (k % 2 == 0).alias("is_country_main"),
    )


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _sql_case(col: str, names: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


SQL = f"""
WITH samples AS (
  SELECT 'DS' || (o_orderkey % 4) AS dataset_id, CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(o_orderdate AS DATE) AS collection_date,
         r_name AS region, n_name AS district, {_sql_case("o_orderstatus", SITES)} AS site_type,
         {_sql_case("c_mktsegment", CATEGORIES)} AS source_category, o_orderpriority AS source_type,
         CASE WHEN o_custkey % 10 <> 0 THEN 4.5E0 + (n_nationkey % 5) * 1.4E0 END AS latitude,
         CASE WHEN o_custkey % 10 <> 0 THEN -3.0E0 + (n_nationkey % 4) * 1.0E0 END AS longitude
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw_ast AS (
  SELECT 'DS' || (l_orderkey % 4) AS dataset_id, CAST(l_orderkey AS VARCHAR) AS sample_id, CAST(l_orderkey AS VARCHAR) AS isolate_id,
         ({_sql_list(ORGANISMS)})[CAST(o_custkey % 10 AS INTEGER) + 1] AS organism,
         ({_sql_list(ANTIBIOTICS)})[CAST(l_partkey % 24 AS INTEGER) + 1] AS antibiotic,
         CASE WHEN l_quantity <= 5 + 4 * (o_custkey % 10) THEN 'R' WHEN l_quantity <= 9 + 4 * (o_custkey % 10) THEN 'I' ELSE 'S' END AS result,
         CASE WHEN l_linestatus = 'F' THEN 'MIC' ELSE 'DD' END AS method, CASE WHEN l_suppkey % 2 = 0 THEN 'CLSI' ELSE 'EUCAST' END AS guideline,
         CAST(l_shipdate AS DATE) AS test_date, CASE WHEN l_linestatus = 'F' THEN l_quantity / 4 END AS mic_value,
         CASE WHEN l_linestatus <> 'F' THEN l_quantity END AS zone_diameter, l_linenumber, l_partkey, l_suppkey, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ast AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isolate_id, antibiotic ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM raw_ast)
  WHERE nth = 1),
datasets AS (
  SELECT s.dataset_id, 'Dataset ' || k AS dataset_name, CASE k WHEN 0 THEN ' Admin ' WHEN 1 THEN 'a@lab.org' ELSE 'b@lab.org' END AS uploaded_by,
         '2025-01-0' || (k + 1) AS uploaded_at, rows_samples, rows_tests,
         CASE WHEN k < 2 THEN 'Ghana' WHEN k = 2 THEN 'Togo' END AS country, k % 2 = 0 AS is_country_main
  FROM (SELECT dataset_id, CAST(substr(dataset_id, 3) AS INTEGER) AS k, count(*) AS rows_samples FROM samples GROUP BY dataset_id) s
  JOIN (SELECT dataset_id, count(*) AS rows_tests FROM ast GROUP BY dataset_id) t ON s.dataset_id = t.dataset_id)
"""
