"""Upload rules: each gives rows (rule_id, sheet, row_no, value). All columns are text, with ``row_no`` beside them.

``''``, ``nan`` and ``None`` count as missing. Rules that name the first offender only do so; others name each, or each
distinct value with its first row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antibiogram.functions.exprs import RESULTS
from antibiogram.sources.schema import GUIDELINES, METHODS, REQUIRED, SOURCE_CATEGORIES

OUT = "rule_id string, sheet string, row_no long, value string"


def trimmed(df: DataFrame) -> DataFrame:
    """Headers and texts without surrounding white space; missing words as nulls.

    Texts are trimmed as rows of a generator: what is computed from them later is not merged with the trimming, which would be
    repeated wherever a text is used, in code too long to be compiled."""
    cells = [(F.trim(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")).alias(f"c{k}") for k, (name, kind) in enumerate(df.dtypes)]
    rows = df.select(F.inline(F.array(F.struct(*cells))))
    out = []
    for k, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"c{k}")
        out.append((F.when(~c.isin("", "nan", "None"), c) if kind == "string" else c).alias(name.strip()))
    return rows.select(*out)


def missing_columns(df: DataFrame, sheet: str) -> list[str]:
    """Required columns that the sheet lacks, before its headers are trimmed."""
    return sorted(set(REQUIRED[sheet]) - set(df.columns))


def _is_bad_number(col: str) -> Column:
    return F.col(col).isNotNull() & F.col(col).try_cast("double").isNull()


def _outside(col: str, allowed: tuple[str, ...]) -> tuple[str, list[tuple[Column, Column]]]:
    """A missing value is outside too, and is reported as an empty one."""
    return "value", [(~F.coalesce(F.col(col).isin(*allowed), F.lit(False)), F.coalesce(F.col(col), F.lit("")))]


def _bad_date(col: str) -> tuple[str, list[tuple[Column, Column]]]:
    """Year, month and day in this order; months and days may have one digit."""
    shaped = F.col(col).rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$")
    day = F.when(shaped, F.col(col)).try_cast("date")
    return "first", [(F.col(col).isNotNull() & day.isNull(), F.col(col))]


def _bad_numbers(*cols: str) -> tuple[str, list[tuple[Column, Column]]]:
    """Of several columns only rows that have all of them are judged."""
    there = F.lit(True)
    for c in cols:
        there = there & F.col(c).isNotNull()
    value = F.coalesce(*[F.when(_is_bad_number(c), F.col(c)) for c in cols])
    return "first", [(there & value.isNotNull(), value)]


def _blank(*cols: str) -> tuple[str, list[tuple[Column, Column]]]:
    """Rows with nothing in a required column: of the first such column only."""
    return "column", [(F.col(c).isNull(), F.lit(c)) for c in cols]


def _out_of_range() -> tuple[str, list[tuple[Column, Column]]]:
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    bad = lat.isNotNull() & lon.isNotNull() & ~(lat.between(-90, 90) & lon.between(-180, 180))
    return "row", [(bad, F.concat_ws(", ", "latitude", "longitude"))]


#: rule -> (sheet, what a report names, [(whether a row is at fault, the value that is reported)]). What a report names:
#: each ``row``, each distinct ``value`` with its first row, the ``first`` row, or the first row of the first ``column``.
ROW_RULES: dict[str, tuple[str, Callable[[], tuple[str, list[tuple[Column, Column]]]]]] = {
    "v_s_cat": ("samples", lambda: _outside("source_category", SOURCE_CATEGORIES)),
    "v_s_date": ("samples", lambda: _bad_date("collection_date")),
    "v_s_coord_range": ("samples", _out_of_range),
    "v_s_coord_num": ("samples", lambda: _bad_numbers("latitude", "longitude")),
    "v_s_req": ("samples", lambda: _blank("sample_id", "region", "district")),
    "v_a_result": ("ast_results", lambda: _outside("result", RESULTS)),
    "v_a_method": ("ast_results", lambda: _outside("method", METHODS)),
    "v_a_guideline": ("ast_results", lambda: _outside("guideline", GUIDELINES)),
    "v_a_date": ("ast_results", lambda: _bad_date("test_date")),
    "v_a_req": ("ast_results", lambda: _blank("sample_id", "isolate_id", "organism", "antibiotic")),
    "v_a_mic_num": ("ast_results", lambda: _bad_numbers("mic_value")),
    "v_a_zone_num": ("ast_results", lambda: _bad_numbers("zone_diameter")),
}
#: rule -> (sheet, key): rules that look at several rows. Rows with one key meet; which of their groups is at fault, and what is
#: reported of it, ``_table_faults`` tells.
TABLE_RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_s_dup": ("samples", ("sample_id",)),
    "v_a_dup": ("ast_results", ("isolate_id", "antibiotic")),
    "v_a_orphan": ("ast_results", ("sample_id",)),
}
RULES = {name: sheet for rules in (ROW_RULES, TABLE_RULES) for name, (sheet, _) in rules.items()}


#: What of an entry's place in a sheet is its row; the rest is the case of its rule.
ROWS = 1 << 48


def _entry(name: str, first: Column, second: Column, case: int = 0, is_test: bool = False) -> Column:
    """What a row adds to a group of a rule: two texts that name the group, and its place, of which the least is reported."""
    place = F.coalesce(F.col("row_no").cast("long"), F.lit(ROWS - 1)) + F.lit(case * ROWS)
    return F.struct(
        F.lit(list(RULES).index(name)).alias("rule"), first.cast("string").alias("first"), second.cast("string").alias("second"), place.alias("place"), F.lit(is_test).alias("is_test")
    )


def _entries(df: DataFrame, sheet: str, names: list[str]) -> DataFrame:
    """The entries of one sheet's rows: its keys for rules that look at several rows, and its faults. Which faults a row has is
    found once, as bits of a number; only rows that have some make entries of them."""
    keys, bad, faults = [], [], []
    for name in (n for n in names if n in TABLE_RULES):
        own, key = TABLE_RULES[name]
        if own == sheet or name == "v_a_orphan":  # whose samples are looked for in the other sheet
            second = F.col(key[1]) if len(key) > 1 else F.lit(None)
            entry = _entry(name, F.col(key[0]), second, is_test=sheet == "ast_results")
            keys.append(entry if len(key) > 1 else F.when(F.col(key[0]).isNotNull(), entry))
    for name in (n for n in names if n in ROW_RULES and RULES[n] == sheet):
        kind, cases = ROW_RULES[name][1]()
        for case, (is_bad, value) in enumerate(cases):
            k = len(bad)
            bad.append(F.when(is_bad, F.lit(1 << k)).otherwise(0))
            faults.append(F.when(F.col("_bad").bitwiseAND(1 << k) != 0, _entry(name, F.col("row_no") if kind == "row" else value, value if kind == "row" else F.lit(None), case)))
    df = df.withColumn("_bad", reduce(lambda a, b: a + b, bad, F.lit(0)))
    if keys:
        entries = F.when(F.col("_bad") != 0, F.array(*keys, *faults)).otherwise(F.array(*keys)) if faults else F.array(*keys)
    else:
        df, entries = df.where(F.col("_bad") != 0), F.array(*faults)
    return df.select(F.explode(entries).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def rules(names: list[str], samples: DataFrame, ast: DataFrame) -> DataFrame:
    """rule_id, sheet, row_no and value of what these rules find: each sheet is read once, and one aggregation serves all.

    A key that repeats is a duplicate; a test's sample is lost if no entry of its group came from the samples. Of a rule that
    names the first offender alone the first group is taken, from the few that are left."""
    sheets = {"samples": samples, "ast_results": ast}
    read = [s for s in sheets if s in {RULES[n] for n in names} or "v_a_orphan" in names]
    entries = [_entries(trimmed(sheets[s]), s, names) for s in read]
    both = entries[0].unionByName(entries[1]) if len(entries) > 1 else entries[0]
    groups = both.groupBy("rule", "first", "second").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.bool_and("is_test").alias("lost"))
    numbers = lambda which: [k for k, n in enumerate(RULES) if which(n)]
    is_one = lambda which: F.col("rule").isin(*numbers(which))
    kinds = {n: ROW_RULES[n][1]()[0] for n in ROW_RULES}
    at_fault = F.when(is_one(lambda n: n in ("v_s_dup", "v_a_dup")), F.col("n") > 1).when(F.col("rule") == list(RULES).index("v_a_orphan"), F.col("lost")).otherwise(True)
    single = is_one(lambda n: kinds.get(n) in ("first", "column"))
    found = groups.where(at_fault).withColumn("_of", F.when(single, F.col("rule")).otherwise(-1)).withColumn("_group", F.when(~single, F.struct("first", "second")))
    least = found.groupBy("_of", "rule", "_group").agg(F.min(F.struct("place", "first", "second")).alias("f"))
    value = F.when(is_one(lambda n: kinds.get(n) == "row"), F.col("f.second")).otherwise(F.concat_ws(" / ", "f.first", "f.second"))
    sheet = F.when(is_one(lambda n: RULES[n] == "samples"), "samples").otherwise("ast_results")
    row_no = F.pmod("f.place", F.lit(ROWS))
    name = F.element_at(F.array(*[F.lit(n) for n in RULES]), F.col("rule") + 1)
    return least.select(name.alias("rule_id"), sheet.alias("sheet"), F.when(row_no < ROWS - 1, row_no).alias("row_no"), value.alias("value"))


def rule(name: str, samples: DataFrame, ast: DataFrame) -> DataFrame:
    return rules([name], samples, ast)


def structure(spark: SparkSession, samples: DataFrame | None, ast: DataFrame | None) -> DataFrame:
    """Missing sheets, empty sheets and missing columns: what stops an upload before its rows are read."""
    rows = []
    for sheet, df in (("samples", samples), ("ast_results", ast)):
        if df is None:
            rows.append(("src_excel_structure", sheet, None, "missing sheet"))
            continue
        if df.isEmpty():
            rows.append(("v_empty", sheet, None, "empty sheet"))
        rows += [("v_s_cols" if sheet == "samples" else "v_a_cols", sheet, None, c) for c in missing_columns(df, sheet)]
    return spark.createDataFrame(rows, OUT)


def validate(spark: SparkSession, samples: DataFrame | None, ast: DataFrame | None) -> DataFrame:
    """All violations; those of rows only if the structure is sound."""
    found = structure(spark, samples, ast)
    if not found.isEmpty():
        return found
    return rules(list(RULES), samples, ast)
