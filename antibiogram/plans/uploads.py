"""Two sheets with every kind of fault, made from the order tables: what the upload rules are queried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antibiogram.sources import adapter


def _every(key: str, n: int):
    return F.col(key) % n == 5


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return adapter.table(spark, sf_dir, "orders").select(
        (k + 2).alias("row_no"),
        F.when(_every("o_orderkey", 113), "1").otherwise(k.cast("string")).alias("sample_id"),
        F.when(_every("o_orderkey", 101), "2024-13-01").when(_every("o_orderkey", 7), "2024-1-5").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("collection_date"),
        F.when(_every("o_orderkey", 109), "  ").otherwise(F.concat(F.lit(" R"), (F.col("o_custkey") % 5).cast("string"))).alias("region"),
        F.concat(F.lit("D"), (F.col("o_custkey") % 25).cast("string")).alias("district"),
        F.lit("Hospital").alias("site_type"),
        F.when(_every("o_orderkey", 97), F.concat(F.lit("PET"), (k % 3).cast("string"))).when(_every("o_orderkey", 91), " ").otherwise("HUMAN").alias("source_category"),
        F.col("o_orderpriority").alias("source_type"),
        F.lit("").alias("food_matrix"),
        F.lit("").alias("environment_matrix"),
        F.when(_every("o_orderkey", 103), "abc").when(_every("o_orderkey", 107), "95").otherwise("5").alias("latitude"),
        F.when(_every("o_orderkey", 206), "").otherwise("-1").alias("longitude"),
    )


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return adapter.table(spark, sf_dir, "lineitem").select(
        (k * 10 + F.col("l_linenumber")).alias("row_no"),
        F.when(_every("l_orderkey", 89), F.concat(F.lit("LOST"), k.cast("string"))).otherwise(k.cast("string")).alias("sample_id"),
        k.cast("string").alias("isolate_id"),
        F.when(_every("l_orderkey", 83), "nan").otherwise("Escherichia coli").alias("organism"),
        F.concat(F.lit("A"), (F.col("l_partkey") % 24).cast("string")).alias("antibiotic"),
        F.when(_every("l_orderkey", 97), F.concat(F.lit("X"), (k % 3).cast("string"))).when(_every("l_orderkey", 91), "").otherwise("S").alias("result"),
        F.when(_every("l_orderkey", 101), "ETEST").when(_every("l_orderkey", 79), "nan").otherwise("MIC").alias("method"),
        F.when(_every("l_orderkey", 103), "BSAC").when(_every("l_orderkey", 73), F.lit(None)).otherwise("CLSI").alias("guideline"),
        F.when(_every("l_orderkey", 107), "01/02/2024").when(_every("l_orderkey", 7), "2024-01-5").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("test_date"),
        F.when(_every("l_orderkey", 109), "abc").otherwise("1").alias("mic_value"),
        F.when(_every("l_orderkey", 113), "n/a").otherwise("20").alias("zone_diameter"),
    )


def file_no(sheet: str):
    """Which of eight workbooks a row of the sheet is written to: that of its order."""
    order = F.col("row_no") - 2 if sheet == "samples" else F.floor(F.col("row_no") / 10)
    return (order % 8).cast("string")


def _cell(key: str, *cases: tuple[int, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {n} = 5 THEN {value}" for n, value in cases) + f" ELSE {otherwise} END"


_O, _L = "o_orderkey", "l_orderkey"
#: sheet -> SQL of its cells; samples with their rows in the eight workbooks (lines of an order may have one number).
SHEET_SQL = {
    "samples": f"""SELECT row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) + 1 AS row_no, {_cell(_O, (113, "'1'"), otherwise="CAST(o_orderkey AS VARCHAR)")} AS sample_id,
        {_cell(_O, (101, "'2024-13-01'"), (7, "'2024-1-5'"), otherwise="strftime(o_orderdate, '%Y-%m-%d')")} AS collection_date,
        {_cell(_O, (109, "'  '"), otherwise="' R' || (o_custkey % 5)")} AS region, 'D' || (o_custkey % 25) AS district, 'Hospital' AS site_type,
        {_cell(_O, (97, "'PET' || (o_orderkey % 3)"), (91, "' '"), otherwise="'HUMAN'")} AS source_category, o_orderpriority AS source_type,
        CAST(NULL AS VARCHAR) AS food_matrix, CAST(NULL AS VARCHAR) AS environment_matrix,
        {_cell(_O, (103, "'abc'"), (107, "'95'"), otherwise="'5'")} AS latitude, {_cell(_O, (206, "NULL"), otherwise="'-1'")} AS longitude FROM orders""",
    "ast_results": f"""SELECT {_cell(_L, (89, "'LOST' || l_orderkey"), otherwise="CAST(l_orderkey AS VARCHAR)")} AS sample_id, CAST(l_orderkey AS VARCHAR) AS isolate_id,
        {_cell(_L, (83, "'nan'"), otherwise="'Escherichia coli'")} AS organism, 'A' || (l_partkey % 24) AS antibiotic,
        {_cell(_L, (97, "'X' || (l_orderkey % 3)"), (91, "NULL"), otherwise="'S'")} AS result, {_cell(_L, (101, "'ETEST'"), (79, "'nan'"), otherwise="'MIC'")} AS method,
        {_cell(_L, (103, "'BSAC'"), (73, "NULL"), otherwise="'CLSI'")} AS guideline,
        {_cell(_L, (107, "'01/02/2024'"), (7, "'2024-01-5'"), otherwise="strftime(l_shipdate, '%Y-%m-%d')")} AS test_date,
        {_cell(_L, (109, "'abc'"), otherwise="'1'")} AS mic_value, {_cell(_L, (113, "'n/a'"), otherwise="'20'")} AS zone_diameter FROM lineitem""",
}

#: rule -> SQL over ``orders`` or ``lineitem``; each gives row_no and value.
SQL = {
    "v_s_dup": "SELECT min(o_orderkey + 2) AS row_no, id AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 113 = 5 THEN '1' ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders) GROUP BY id HAVING count(*) > 1",
    "v_s_cat": "SELECT min(o_orderkey + 2) AS row_no, CASE WHEN o_orderkey % 97 = 5 THEN 'PET' || (o_orderkey % 3) ELSE '' END AS value FROM orders WHERE o_orderkey % 97 = 5 OR o_orderkey % 91 = 5 GROUP BY 2",
    "v_s_date": "SELECT min(o_orderkey + 2) AS row_no, '2024-13-01' AS value FROM orders WHERE o_orderkey % 101 = 5 HAVING count(*) > 0",
    "v_s_coord_range": "SELECT o_orderkey + 2 AS row_no, '95, -1' AS value FROM orders WHERE o_orderkey % 107 = 5 AND o_orderkey % 103 <> 5 AND o_orderkey % 206 <> 5",
    "v_s_coord_num": "SELECT min(o_orderkey + 2) AS row_no, 'abc' AS value FROM orders WHERE o_orderkey % 103 = 5 AND o_orderkey % 206 <> 5 HAVING count(*) > 0",
    "v_s_req": "SELECT min(o_orderkey + 2) AS row_no, 'region' AS value FROM orders WHERE o_orderkey % 109 = 5 HAVING count(*) > 0",
    "v_a_dup": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, l_orderkey || ' / A' || (l_partkey % 24) AS value FROM lineitem GROUP BY 2 HAVING count(*) > 1",
    "v_a_result": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, CASE WHEN l_orderkey % 97 = 5 THEN 'X' || (l_orderkey % 3) ELSE '' END AS value FROM lineitem WHERE l_orderkey % 97 = 5 OR l_orderkey % 91 = 5 GROUP BY 2",
    "v_a_method": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, CASE WHEN l_orderkey % 101 = 5 THEN 'ETEST' ELSE '' END AS value FROM lineitem WHERE l_orderkey % 101 = 5 OR l_orderkey % 79 = 5 GROUP BY 2",
    "v_a_guideline": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, CASE WHEN l_orderkey % 103 = 5 THEN 'BSAC' ELSE '' END AS value FROM lineitem WHERE l_orderkey % 103 = 5 OR l_orderkey % 73 = 5 GROUP BY 2",
    "v_a_date": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, '01/02/2024' AS value FROM lineitem WHERE l_orderkey % 107 = 5 HAVING count(*) > 0",
    "v_a_orphan": """SELECT min(row_no) AS row_no, id AS value
        FROM (SELECT l_orderkey * 10 + l_linenumber AS row_no, CASE WHEN l_orderkey % 89 = 5 THEN 'LOST' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS id FROM lineitem)
        WHERE id NOT IN (SELECT CASE WHEN o_orderkey % 113 = 5 THEN '1' ELSE CAST(o_orderkey AS VARCHAR) END FROM orders) GROUP BY id""",
    "v_a_req": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, 'organism' AS value FROM lineitem WHERE l_orderkey % 83 = 5 HAVING count(*) > 0",
    "v_a_mic_num": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, 'abc' AS value FROM lineitem WHERE l_orderkey % 109 = 5 HAVING count(*) > 0",
    "v_a_zone_num": "SELECT min(l_orderkey * 10 + l_linenumber) AS row_no, 'n/a' AS value FROM lineitem WHERE l_orderkey % 113 = 5 HAVING count(*) > 0",
}
