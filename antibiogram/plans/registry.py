"""Every query by name, and the SQL that it is compared with.

An entry is (function of the tables, SQL body); the SQL reads the adapter's CTEs ``samples``, ``ast``, ``raw_ast`` and
``datasets``. Arrays and maps are flattened to text or rows, since the comparison is by value.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antibiogram.functions import interpret as ip
from antibiogram.operators import compare, days, detect, filters, months, profiles, rates, score, validate
from antibiogram.sources import adapter, catalog, io, mart, merging, workbook

from . import assistant, gaps, uploads


_STORES: dict[tuple, str] = {}


def _delete_folders(spark: SparkSession) -> None:
    for path in _STORES.values():
        with contextlib.suppress(Exception):  # the JVM may have ended before
            io.delete_folder(spark, path)


def _mart_name(path: str) -> str:
    return "mart_" + path.rpartition("-")[2]


class Tables:
    """The tables of one directory, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def _mart(self) -> tuple[DataFrame, DataFrame]:
        """(samples, tests) as bucketed tables, written from the order tables once in an application."""

        def write(path: str) -> None:
            cores = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = mart.buckets_for(adapter.table(self.spark, self.dir, "lineitem").count(), cores, mart.TASK_ROWS)
            mart.write(_mart_name(path), path, adapter.samples(self.spark, self.dir), adapter.tests(self.spark, self.dir, buckets), buckets)

        return mart.read(self.spark, _mart_name(self.folder("mart", write)))

    @property
    def samples(self) -> DataFrame:
        return self._mart[0]

    @property
    def ast(self) -> DataFrame:
        return self._mart[1]

    @cached_property
    def datasets(self) -> DataFrame:
        return adapter.datasets(self.samples, self.ast)

    @property
    def months(self) -> DataFrame:
        """The stored counts by month, one refresh a dataset."""

        def write(path: str) -> None:
            for d in [r.dataset_id for r in self.datasets.select("dataset_id").collect()]:  # a row a dataset
                months.refresh(path, self.ast, d)

        return months.read(self.spark, self.folder("months", write))

    @cached_property
    def days(self) -> days.Days:
        """The stored days, in two batches."""

        def write(path: str) -> None:
            early = F.coalesce(F.col("test_date") < BATCHES, F.lit(False))
            for batch, which in (("early", early), ("late", ~early)):
                days.add(path, self.ast.where(which), batch)

        return days.Days.read(self.spark, self.folder("days", write))

    @cached_property
    def profiles(self) -> profiles.Profiles:
        """The stored isolates, aggregated once in an application."""
        return profiles.Profiles.read(self.ast, self.folder("profiles", lambda path: profiles.Profiles(self.ast).write(path)))

    def folder(self, use: str, write: Callable[[str], None], anew: bool = False) -> str:
        """A folder that ``write`` fills once in an application, or anew with each call; deleted at the end of the process."""
        key = (self.spark.sparkContext.applicationId, self.dir, use)
        if anew and key in _STORES:
            io.delete_folder(self.spark, _STORES.pop(key))
        if key not in _STORES:
            if not _STORES:
                atexit.register(_delete_folders, self.spark)
            path = io.store_folder(self.spark)
            write(path)
            _STORES[key] = path
        return _STORES[key]

    def store(self, use: str = "scan", anew: bool = False) -> str:
        """A store of all datasets."""
        return self.folder(use, lambda path: io.write_datasets(path, self.datasets, self.samples, self.ast), anew)

    def merged_store(self) -> str:
        """A store in which DS1 was merged into DS0, by a call that is made twice."""

        def write(path: str) -> None:
            io.write_datasets(path, self.datasets, self.samples, self.ast)
            if not merging.merge_stored(self.spark, path, "DS1", "DS0") or merging.merge_stored(self.spark, path, "DS1", "DS0"):
                raise RuntimeError("a merge happens once")

        return self.folder("merge", write)

    def uploaded(self, sheet: str) -> DataFrame:
        """A sheet of eight uploaded workbooks, in further files where they are too large for one, written from the order tables and
        read again."""

        def write(path: str) -> None:
            sheets = {"samples": uploads.samples(self.spark, self.dir), "ast_results": uploads.tests(self.spark, self.dir)}
            workbook.write_workbooks({s: df.withColumn("file", F.concat(F.lit("upload-"), uploads.file_no(s))) for s, df in sheets.items()}, path, "file", "row_no", continued=True)

        return io.read_workbook(self.spark, self.folder("uploads", write))[sheet]

    def scan(self, table: str, dataset_id: str | None = None) -> DataFrame:
        """The stored table, as far as the adapter has its columns."""
        names = {"samples": self.samples, "ast_results": self.ast}[table].columns
        return io.scan(self.spark, self.store(), table, dataset_id).select(names)

    def by(self, *dims: str) -> DataFrame:
        return rates.with_dims(self.ast, self.samples, *dims)


Entry = tuple[Callable[[Tables], DataFrame], str]
J = "ast LEFT JOIN samples s ON ast.dataset_id = s.dataset_id AND ast.sample_id = s.sample_id"
R, I, S = (f"count(*) FILTER (WHERE result = '{x}')" for x in "RIS")
AS_OF = "1998-08-15"
BATCHES = "1995-06-01"
P1, P2 = ("1994-01-01", "1995-06-30"), ("1995-06-30", "1996-12-31")
GROUPS = {"a": {"categories": ("HUMAN", "FOOD")}, "b": {"regions": ("ASIA", "EUROPE")}}


def _rate(digits: int | None, part: str = R, whole: str = "count(*)") -> str:
    x = f"100.0E0 * {part} / {whole}"
    return x if digits is None else f"round({x}, {digits})"


def _sir(*dims: str) -> str:
    d = ", ".join(dims)
    return f"""SELECT *, susceptible + intermediate + resistant AS total,
      round(100.0E0 * susceptible / (susceptible + intermediate + resistant), 2) AS percent_susceptible,
      round(100.0E0 * intermediate / (susceptible + intermediate + resistant), 2) AS percent_intermediate,
      round(100.0E0 * resistant / (susceptible + intermediate + resistant), 2) AS percent_resistant
      FROM (SELECT {d}, {S} AS susceptible, {I} AS intermediate, {R} AS resistant FROM ast GROUP BY {d})"""


def _shares(dim: str, source: str) -> str:
    return f"SELECT {dim}, count(*) AS total, {_rate(None)} AS R, {_rate(None, I)} AS I, {_rate(None, S)} AS S FROM {source} GROUP BY {dim}"


def _place(*dims: str, limit: int | None = None) -> str:
    d = ", ".join(dims)
    last = f" ORDER BY percent_resistant DESC, {d} LIMIT {limit}" if limit else ""
    return f"SELECT {d}, count(*) AS total, {S} AS susceptible, {I} AS intermediate, {R} AS resistant, {_rate(2)} AS percent_resistant FROM {J} GROUP BY {d}{last}"


def _report(*dims: str, source: str = J, digits: int = 1) -> str:
    d = ", ".join(dims)
    return f"SELECT {d}, count(*) AS total_tests, {R} AS resistant_count, {_rate(digits)} AS resistance_rate FROM {source} GROUP BY {d}"


def _top(source: str, group: str, item: str, n: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY resistance_rate DESC, {item}) AS rank FROM ({source})) WHERE rank <= {n}"


def _items(dim: str, source: str = J, where: str = "") -> str:
    return f"""SELECT {dim} AS item, {_rate(1)} AS resistance_rate, count(*) AS total, {R} AS R, {S} AS S, {I} AS I,
      {_rate(None)} AS percent_R, {_rate(None, S)} AS percent_S, {_rate(None, I)} AS percent_I FROM {source} {where} GROUP BY {dim}"""


def _first(dim: str, n: int, table: str = "ast") -> str:
    return f"(SELECT DISTINCT {dim} FROM {table} ORDER BY {dim} LIMIT {n})"


def _lit(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _has(col: str, names) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{n.lower()}')" for n in names) + ")"


def _screened(drugs, extra: str = "TRUE") -> str:
    return "CAST(" + " + ".join(f"max(CASE WHEN contains(lower(antibiotic), '{d.lower()}') AND {extra} THEN 1 ELSE 0 END)" for d in drugs) + " AS BIGINT)"


FLAGS = f"""(SELECT dataset_id, isolate_id, min(organism) AS organism,
  {_screened(detect.ESBL[1])} AS et, {_screened(detect.ESBL[1], "result = 'R'")} AS er, {_screened(detect.CARBAPENEMS)} AS ct, {_screened(detect.CARBAPENEMS, "result = 'R'")} AS cr,
  {_screened(detect.AMPC[1])} AS pt, {_screened(detect.AMPC[1], "result = 'R'")} AS pr,
  bool_or({_has("antibiotic", ("oxacillin", "methicillin"))} AND result = 'R') AS mr, bool_or(contains(lower(antibiotic), 'vancomycin') AND result = 'R') AS vr,
  bool_or(contains(lower(antibiotic), 'vancomycin') AND result = 'I') AS vi FROM ast GROUP BY dataset_id, isolate_id)"""
ONE = "CAST(1 AS BIGINT)"


def _screen(mechanism: str, confidence: str, r: str, t: str, where: str, nth: int = 0) -> str:
    extra = f", {nth} AS nth" if nth else ""
    return f"SELECT dataset_id, isolate_id, organism, {mechanism} AS resistance_mechanism, {confidence} AS confidence, {r} AS resistant_antibiotics, {t} AS total_tests{extra} FROM {FLAGS} WHERE {where}"


AUREUS = "contains(lower(organism), 'staphylococcus aureus')"
SCREENS = {
    "d_esbl": ("'ESBL'", "CASE WHEN er = et THEN 'High' ELSE 'Moderate' END", "er", "et", f"{_has('organism', detect.ESBL[0])} AND et >= 2 AND er >= 2"),
    "d_carb": ("'Carbapenemase'", "'High'", "cr", "ct", "cr >= 1"),
    "d_mrsa": ("'MRSA'", "'High'", ONE, ONE, f"{AUREUS} AND mr"),
    "d_ampc": ("'AmpC'", "CASE WHEN pr = pt THEN 'High' ELSE 'Moderate' END", "pr", "pt", f"{_has('organism', detect.AMPC[0])} AND pt >= 2 AND pr >= 2"),
    "d_vrsa": ("CASE WHEN vr THEN 'VRSA' ELSE 'VISA' END", "'High'", ONE, ONE, f"{AUREUS} AND (vr OR vi)"),
}
RULES_SQL = "(VALUES " + ", ".join(
    f"({r['nth']}, '{r['organism']}', '{r['antibiotic']}', '{r['guideline']}', '{r['method']}', {r['s']}, {r['i_low'] or 'NULL'}, {r['i_high'] or 'NULL'}, {r['r']})" for r in ip.rules()
) + ") AS b(nth, org, abx, g, m, s, lo, hi, r)"


def _org_sql(mode: str, pattern: str = "org", name: str = "organism") -> str:
    genus = "FALSE" if mode == "reference" else f"starts_with(lower({name}), lower(replace({pattern}, ' spp.', '')))"
    return f"CASE WHEN {pattern} LIKE '% spp.' THEN {genus} WHEN {pattern} = 'Enterobacteriaceae' THEN {_has(name, ip.ENTEROBACTERIACEAE)} ELSE contains(lower({name}), lower({pattern})) END"


def _interpret_sql(mode: str) -> str:
    mech = "(VALUES " + ", ".join(f"({k}, '{name}', '{o}', '{a}')" for k, (name, orgs, abx, _) in enumerate(ip.MECHANISMS) for o in orgs for a in abx) + ") AS m(k, mechanism, org, abx)"
    return f"""
    , v AS (SELECT *, CASE method WHEN 'MIC' THEN mic_value ELSE zone_diameter END AS x FROM ast),
    hit AS (SELECT isolate_id, antibiotic, arg_min(s, b.nth) AS s, arg_min(coalesce(lo, 1e9), b.nth) AS lo, arg_min(coalesce(hi, -1e9), b.nth) AS hi, arg_min(r, b.nth) AS r
            FROM v JOIN {RULES_SQL} ON b.g = v.guideline AND b.m = v.method AND {_org_sql(mode)} AND contains(lower(antibiotic), lower(abx)) GROUP BY isolate_id, antibiotic),
    res AS (SELECT v.*, hit.isolate_id IS NOT NULL AS found,
              CASE WHEN hit.isolate_id IS NULL OR x IS NULL THEN 'Unknown'
                   WHEN method = 'MIC' THEN CASE WHEN x >= r THEN 'R' WHEN x BETWEEN lo AND hi THEN 'I' WHEN x <= s THEN 'S' ELSE 'Unknown' END
                   ELSE CASE WHEN x >= s THEN 'S' WHEN x BETWEEN lo AND hi THEN 'I' WHEN x <= r THEN 'R' ELSE 'Unknown' END END AS interpreted_result
            FROM v LEFT JOIN hit ON v.isolate_id = hit.isolate_id AND v.antibiotic = hit.antibiotic),
    mech AS (SELECT isolate_id, antibiotic, arg_min(mechanism, k) AS mechanism FROM res JOIN {mech} ON interpreted_result = 'R' AND {_org_sql(mode)} AND contains(lower(antibiotic), lower(abx)) GROUP BY isolate_id, antibiotic),
    full_res AS (SELECT res.dataset_id, res.isolate_id, organism, res.antibiotic, result, interpreted_result, guideline || '_2025' AS interpretation_guideline, mechanism AS suspected_mechanism,
      CASE WHEN NOT found THEN 'No breakpoint available' WHEN x IS NULL THEN 'Invalid test method or missing value' WHEN mechanism = 'AmpC' THEN 'Moderate - confirmatory test recommended' ELSE 'High' END AS interpretation_confidence
      FROM res LEFT JOIN mech ON res.isolate_id = mech.isolate_id AND res.antibiotic = mech.antibiotic)
    """


INTERPRETED = ("dataset_id", "isolate_id", "organism", "antibiotic", "result", "interpreted_result", "interpretation_guideline", "suspected_mechanism", "interpretation_confidence")
SCREENED = " UNION ALL ".join(_screen(*x, nth=k) for k, x in enumerate(SCREENS.values(), 1))
CROSS = " UNION ALL ".join(f"SELECT dataset_id, isolate_id, organism, result, '{c}' AS antibiotic_class FROM ast WHERE {_has('antibiotic', d)}" for c, d in detect.CROSS_CLASSES.items())
CLASS_CASE = "CASE antibiotic " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in detect.DRUG_CLASSES.items()) + " ELSE 'Other' END"
MDR = f"""SELECT dataset_id, isolate_id, count(DISTINCT {CLASS_CASE}) AS resistant_drug_classes, min(organism) AS organism, min(sample_id) AS sample_id
  FROM ast WHERE result = 'R' GROUP BY dataset_id, isolate_id HAVING count(DISTINCT {CLASS_CASE}) >= 3"""
RISK = f"""SELECT organism, CAST(least(p, 100) AS BIGINT) AS risk_score, CASE WHEN p >= 70 THEN 'CRITICAL' WHEN p >= 50 THEN 'HIGH' WHEN p >= 30 THEN 'MODERATE' ELSE 'LOW' END AS risk_level,
  round(rate, 2) AS resistance_rate, n AS test_count, k AS antibiotic_diversity,
  concat_ws('; ', CASE WHEN rate > 70 THEN 'Very high resistance rate (>70%)' WHEN rate > 50 THEN 'High resistance rate (>50%)' WHEN rate > 30 THEN 'Moderate resistance rate (>30%)' END,
    CASE WHEN n > 100 THEN 'Significant data volume (>100 tests)' END, CASE WHEN k > 10 THEN 'High antibiotic diversity' END) AS risk_factors
  FROM (SELECT *, CASE WHEN rate > 70 THEN 40 WHEN rate > 50 THEN 30 WHEN rate > 30 THEN 20 ELSE 0 END + CASE WHEN n > 100 THEN 20 WHEN n > 50 THEN 15 WHEN n > 20 THEN 10 ELSE 0 END
          + CASE WHEN k > 10 THEN 40 WHEN k > 5 THEN 25 WHEN k > 2 THEN 15 ELSE 0 END AS p
        FROM (SELECT organism, {_rate(None)} AS rate, count(*) AS n, count(DISTINCT antibiotic) AS k FROM ast GROUP BY organism))"""
SAMPLE_RATE = f"SELECT dataset_id, sample_id, {R} AS resistant_count, count(*) AS total_count, {_rate(None)} AS resistance_rate FROM ast GROUP BY dataset_id, sample_id"
POINTS = f"""SELECT s.dataset_id, s.sample_id, latitude, longitude, region, district, source_category, source_type, coalesce(resistant_count, 0) AS resistant_count, coalesce(total_count, 0) AS total_count,
  coalesce(resistance_rate, 0.0E0) AS resistance_rate FROM samples s LEFT JOIN ({SAMPLE_RATE}) r ON s.dataset_id = r.dataset_id AND s.sample_id = r.sample_id WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""
MONTHS = f"SELECT *, CAST(row_number() OVER (ORDER BY m) - 1 AS DOUBLE) AS x FROM (SELECT date_trunc('month', test_date) AS m, {_rate(None)} AS rate FROM ast WHERE test_date IS NOT NULL GROUP BY 1)"
DRY = "month(test_date) IN (11, 12, 1, 2, 3)"
CASE_HALF = "(SELECT *, row_number() OVER (ORDER BY test_date, isolate_id, antibiotic) AS rn, count(*) OVER () // 2 AS half FROM ast WHERE test_date IS NOT NULL)"
TREND_LABEL = {"month": "strftime(test_date, '%Y-%m')", "quarter": "year(test_date) || ' Q' || quarter(test_date)", "year": "CAST(year(test_date) AS VARCHAR)"}
MERGED = """(SELECT 'DS0' AS dataset_id, CASE WHEN dataset_id = 'DS1' THEN 'DS1-' || sample_id ELSE sample_id END AS sample_id, {} FROM {} WHERE dataset_id IN ('DS0', 'DS1'))"""
MERGED_REGISTRY = "SELECT * REPLACE (CASE WHEN dataset_id = 'DS0' THEN rows_samples + (SELECT rows_samples FROM datasets WHERE dataset_id = 'DS1') ELSE rows_samples END AS rows_samples, CASE WHEN dataset_id = 'DS0' THEN rows_tests + (SELECT rows_tests FROM datasets WHERE dataset_id = 'DS1') ELSE rows_tests END AS rows_tests) FROM datasets"
RANGE = " UNION ALL ".join(f"SELECT '{d}' AS dimension, min(resistance_rate) AS lowest, max(resistance_rate) AS highest FROM ({_report(d)})" for d in ("region", "source_category"))
OPTIONS = {"region": "samples", "district": "samples", "site_type": "samples", "source_category": "samples", "source_type": "samples", "organism": "ast", "antibiotic": "ast"}
REPORT_SQL = """SELECT ast.isolate_id, ast.antibiotic, ast.result, ast.test_date FROM ast WHERE organism IN ('Escherichia coli', 'Staphylococcus aureus') AND test_date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'
  AND EXISTS (SELECT 1 FROM samples s WHERE s.sample_id = ast.sample_id AND s.dataset_id = ast.dataset_id AND region IN ('ASIA', 'AFRICA') AND source_category = 'HUMAN')"""
ALT = "CASE antibiotic " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in score.ALTERNATIVES.items()) + " ELSE ['Consult specialist'] END"
BURDEN = f"SELECT source_category, {R} AS r, count(*) AS n FROM {J} GROUP BY source_category"
REPORT_DIMS = ("organism", "antibiotic", "region", "district", "source_category", "site_type", "source_type")
RECENT_COLS = ("isolate_id", "antibiotic", "organism", "result", "test_date")


ASKED = ("resistance rate of this bacteria", "best treatment", "mechanism behind it", "weather")


def _merged_sql(columns: str, table: str) -> str:
    """All stored rows, and those of DS1 once more as DS0's."""
    ids = "CASE WHEN new THEN 'DS0' ELSE dataset_id END AS dataset_id, CASE WHEN new THEN 'DS1-' || sample_id ELSE sample_id END AS sample_id"
    return f"SELECT {ids}, {columns} FROM (SELECT *, FALSE AS new FROM {table} UNION ALL SELECT *, TRUE FROM {table} WHERE dataset_id = 'DS1')"


def _template_used(t: Tables) -> DataFrame:
    """The template's tests as read back from its workbook, with how often the tables have their antibiotics."""
    path = t.folder("template", lambda p: io.write_template(t.spark, p))
    tests = io.read_workbook(t.spark, path)["ast_results"].select("sample_id", "isolate_id", "antibiotic", "result", "mic_value", "zone_diameter", "row_no")
    seen = t.ast.groupBy("antibiotic").agg(F.count("*").alias("tests"), F.count_if(F.col("result") == "R").alias("resistant"))
    return tests.join(seen, "antibiotic", "left").withColumn("tests", F.coalesce("tests", F.lit(0)))


def _deleted(t: Tables) -> DataFrame:
    """What is left of a store of its own, from which one dataset was deleted."""
    path = t.store("delete", anew=True)
    io.delete_dataset(t.spark, path, "DS2")
    return io.scan(t.spark, path, "ast_results").groupBy("dataset_id").agg(F.count("*").alias("tests"))


def _burden_rows(t: Tables) -> DataFrame:
    b = score.burden(t.samples, t.ast)
    return b.select("total_resistant_tests", "total_tests", "overall_resistance_rate", "public_health_impact", F.explode("resistance_by_category").alias("source_category", "category_rate"))


def _options(t: Tables) -> DataFrame:
    out = None
    for col, table in OPTIONS.items():
        one = filters.options(t.ast if table == "ast" else t.samples, col).select(F.lit(col).alias("filter"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def _heatmap_rows(t: Tables) -> DataFrame:
    h = rates.heatmap(t.ast)
    names = [c for c in h.columns if c != "organism"]
    return h.unpivot("organism", names, "antibiotic", "percent_resistant")


def _recent_period(t: Tables) -> DataFrame:
    return filters.between(t.ast, *P1).select(*RECENT_COLS)


def _interpreted(mode: str) -> Entry:
    return (lambda t: ip.interpret(t.ast, mode).select(*INTERPRETED), _interpret_sql(mode) + f"SELECT {', '.join(INTERPRETED)} FROM full_res")


def _filled(t: Tables) -> DataFrame:
    some = t.ast.withColumn("result", F.when(F.col("method") == "MIC", F.col("result")))
    return ip.fill_results(some, "intended").groupBy("organism", "antibiotic", "result", "auto_interpreted").agg(F.count("*").alias("count"))


def _dim(name: str) -> Entry:
    inside = name in ("organism", "antibiotic")
    return (lambda t: rates.report_rates(t.ast if inside else t.by(name), name), _report(name, source="ast" if inside else J))


def _multi(dim: str, n: int) -> Entry:
    inside = dim in ("organism", "antibiotic")
    table = "ast" if inside else "samples"

    def run(t: Tables) -> DataFrame:
        items = compare.first_items(t.ast if inside else t.samples, dim, n)
        rows = (t.ast if inside else t.by(dim)).join(F.broadcast(items), dim, "left_semi")
        return compare.compare_by(rows, dim)

    return (run, _items(dim, "ast" if inside else J, f"WHERE {dim} IN {_first(dim, n, table)}"))


def _group_top(dim: str, within: str) -> Entry:
    inside = dim in ("organism", "antibiotic")
    return (lambda t: compare.compare_top(t.ast if inside else t.by(dim), dim, within), _top(_report(dim, within, source="ast" if inside else J), dim, within, 5))


def _cross(variable: str, column: str | None = None) -> Entry:
    sql = _items(column or variable, J, "WHERE organism = 'Escherichia coli' AND antibiotic = 'Ciprofloxacin'")
    return (lambda t: compare.cross(t.ast, t.samples, "Escherichia coli", "Ciprofloxacin", variable), sql)


def _validation(name: str) -> Entry:
    sheet = validate.RULES[name]
    return (
        lambda t: validate.rule(name, uploads.samples(t.spark, t.dir), uploads.tests(t.spark, t.dir)),
        f"SELECT '{name}' AS rule_id, '{sheet}' AS sheet, CAST(row_no AS BIGINT) AS row_no, value FROM ({uploads.SQL[name]})",
    )


def _all_rules(t: Tables) -> DataFrame:
    return validate.validate(t.spark, uploads.samples(t.spark, t.dir), uploads.tests(t.spark, t.dir))


def _merged(t: Tables, k: int) -> DataFrame:
    return catalog.merge(t.samples, t.ast, t.datasets, "DS1", "DS0")[k]


ENTRIES: dict[str, Entry] = {
    # sources and catalog
    "scan_samples": (lambda t: t.scan("samples", "DS1"), "SELECT * FROM samples WHERE dataset_id = 'DS1'"),
    "scan_ast": (lambda t: t.scan("ast_results", "DS1"), "SELECT * EXCLUDE (l_linenumber, l_partkey, l_suppkey, l_quantity, nth) FROM ast WHERE dataset_id = 'DS1'"),
    "scan_all_samples": (lambda t: t.scan("samples"), "SELECT * FROM samples"),
    "scan_all_ast": (lambda t: t.scan("ast_results"), "SELECT * EXCLUDE (l_linenumber, l_partkey, l_suppkey, l_quantity, nth) FROM ast"),
    "cat_datasets": (lambda t: catalog.newest(t.datasets), "SELECT * FROM datasets"),
    "cat_main": (lambda t: catalog.main(t.datasets, "Ghana"), "SELECT * FROM datasets WHERE is_country_main AND country = 'Ghana'"),
    "cat_by_uploader": (lambda t: catalog.by_uploader(t.datasets, "b@lab.org"), "SELECT * FROM datasets WHERE uploaded_by = 'b@lab.org'"),
    "cat_visible": (lambda t: catalog.visible(t.datasets), "SELECT * FROM datasets WHERE lower(trim(uploaded_by)) <> 'admin'"),
    "upd_main": (
        lambda t: catalog.set_main(t.datasets, "DS3", True, "Benin"),
        "SELECT * REPLACE (CASE WHEN dataset_id = 'DS3' THEN TRUE ELSE is_country_main END AS is_country_main, CASE WHEN dataset_id = 'DS3' THEN 'Benin' ELSE country END AS country) FROM datasets",
    ),
    "sink_dataset": (
        lambda t: io.scan(t.spark, t.store(), "datasets").select("dataset_id", "dataset_name", "rows_samples", "rows_tests", "country", "is_country_main"),
        "SELECT dataset_id, dataset_name, rows_samples, rows_tests, country, is_country_main FROM datasets",
    ),
    "del_dataset": (_deleted, "SELECT dataset_id, count(*) AS tests FROM ast WHERE dataset_id <> 'DS2' GROUP BY dataset_id"),
    "src_health": (lambda t: io.health(t.spark, t.store()), "SELECT count(*) AS datasets FROM datasets"),
    "sink_template": (
        _template_used,
        """SELECT x.*, coalesce(tests, 0) AS tests, resistant FROM (VALUES
          ('SAMPLE_001', 'ISO_001', 'Ampicillin', 'R', NULL, '15.0', CAST(2 AS BIGINT)), ('SAMPLE_001', 'ISO_002', 'Ciprofloxacin', 'S', NULL, '28.0', 3), ('SAMPLE_002', 'ISO_003', 'Ampicillin', 'I', '0.5', NULL, 4))
          AS x(sample_id, isolate_id, antibiotic, result, mic_value, zone_diameter, row_no)
        LEFT JOIN (SELECT antibiotic, count(*) AS tests, count(*) FILTER (WHERE result = 'R') AS resistant FROM ast GROUP BY antibiotic) t ON t.antibiotic = x.antibiotic""",
    ),
    "src_excel_load": (lambda t: t.uploaded("samples"), uploads.SHEET_SQL["samples"]),
    "src_excel_load_tests": (lambda t: t.uploaded("ast_results").drop("row_no"), uploads.SHEET_SQL["ast_results"]),
    "agg_report_dims": (
        lambda t: rates.report_rates_of(t.ast, t.samples, *REPORT_DIMS),
        " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, total_tests, resistant_count, resistance_rate FROM ({_report(d)})" for d in REPORT_DIMS),
    ),
    "v_empty": (
        lambda t: validate.structure(t.spark, uploads.samples(t.spark, t.dir).limit(0), uploads.tests(t.spark, t.dir)),
        "SELECT 'v_empty' AS rule_id, 'samples' AS sheet, CAST(NULL AS BIGINT) AS row_no, 'empty sheet' AS value",
    ),
    "v_s_cols": (
        lambda t: validate.structure(t.spark, uploads.samples(t.spark, t.dir).drop("region", "latitude"), uploads.tests(t.spark, t.dir)),
        "SELECT 'v_s_cols' AS rule_id, 'samples' AS sheet, CAST(NULL AS BIGINT) AS row_no, unnest(['latitude', 'region']) AS value",
    ),
    "v_a_cols": (
        lambda t: validate.structure(t.spark, uploads.samples(t.spark, t.dir), uploads.tests(t.spark, t.dir).withColumnRenamed("result", " result ")),
        "SELECT 'v_a_cols' AS rule_id, 'ast_results' AS sheet, CAST(NULL AS BIGINT) AS row_no, 'result' AS value",
    ),
    "src_excel_structure": (
        lambda t: validate.structure(t.spark, None, uploads.tests(t.spark, t.dir)),
        "SELECT 'src_excel_structure' AS rule_id, 'samples' AS sheet, CAST(NULL AS BIGINT) AS row_no, 'missing sheet' AS value",
    ),
    "a_route": (
        lambda t: assistant.routed(t.datasets.select(F.concat(F.lit("What is the "), F.element_at(F.array(*[F.lit(q) for q in ASKED]), F.substring("dataset_id", 3, 9).cast("int") + 1)).alias("question"))),
        "SELECT 'What is the ' || q AS question, topic FROM (VALUES (0, 'resistance rate of this bacteria', 'summary'), (1, 'best treatment', 'antibiotic'), (2, 'mechanism behind it', 'explain'), (3, 'weather', 'fallback')) AS x(k, q, topic)",
    ),
    "a_assessment": (
        lambda t: assistant.assessment(t.ast, "organism"),
        f"""SELECT organism, total_tests, round(rate, 1) AS resistance_rate, susceptible_rate, intermediate_rate,
          CASE WHEN rate > 75 THEN 'CRITICAL' WHEN rate > 50 THEN 'HIGH' WHEN rate > 30 THEN 'MODERATE' ELSE 'CONTROLLED' END AS status,
          CASE WHEN rate > 75 THEN 'CRITICAL RISK' WHEN rate > 50 THEN 'HIGH RISK' WHEN rate > 30 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS risk,
          CASE WHEN rate > 75 THEN 'Immediate intervention required' WHEN rate > 50 THEN 'Urgent action needed' WHEN rate > 30 THEN 'Active surveillance and intervention'
            ELSE 'Continue current practices' END AS action
          FROM (SELECT organism, count(*) AS total_tests, {_rate(None)} AS rate, {_rate(1, S)} AS susceptible_rate, {_rate(1, I)} AS intermediate_rate FROM ast GROUP BY organism)""",
    ),
    "merge_main": (lambda t: _merged(t, 2), MERGED_REGISTRY),
    "merge_main_stored": (lambda t: io.scan(t.spark, t.merged_store(), "datasets"), MERGED_REGISTRY),
    "u_merge_samples_stored": (
        lambda t: io.scan(t.spark, t.merged_store(), "samples").select("dataset_id", "sample_id", "collection_date", "region", "district", "latitude"),
        _merged_sql("collection_date, region, district, latitude", "samples"),
    ),
    "u_merge_stored": (
        lambda t: io.scan(t.spark, t.merged_store(), "ast_results").select("dataset_id", "sample_id", "isolate_id", "antibiotic", "result", "mic_value"),
        _merged_sql("CASE WHEN dataset_id = 'DS1' AND new THEN 'DS1-' || isolate_id ELSE isolate_id END AS isolate_id, antibiotic, result, mic_value", "ast"),
    ),
    "u_merge_samples": (lambda t: _merged(t, 0).select("dataset_id", "sample_id", "region", "district"), "SELECT * FROM " + MERGED.format("region, district", "samples")),
    "u_merge": (
        lambda t: _merged(t, 1).select("dataset_id", "sample_id", "isolate_id", "antibiotic", "result"),
        "SELECT * FROM " + MERGED.format("CASE WHEN dataset_id = 'DS1' THEN 'DS1-' || isolate_id ELSE isolate_id END AS isolate_id, antibiotic, result", "ast"),
    ),
    # filters and joins
    "f_overview": (
        lambda t: filters.overview(t.ast, t.samples, categories=("HUMAN", "FOOD"), regions=("ASIA", "EUROPE"), organisms=adapter.ORGANISMS[:4])[1].select("isolate_id", "antibiotic", "result"),
        f"SELECT isolate_id, antibiotic, result FROM {J} WHERE source_category IN ('HUMAN', 'FOOD') AND region IN ('ASIA', 'EUROPE') AND organism IN {_lit(adapter.ORGANISMS[:4])}",
    ),
    "f_trends": (
        lambda t: filters.chosen(t.ast, organism=adapter.ORGANISMS[:2], antibiotic=adapter.ANTIBIOTICS[:5]).select("isolate_id", "antibiotic", "result"),
        f"SELECT isolate_id, antibiotic, result FROM ast WHERE organism IN {_lit(adapter.ORGANISMS[:2])} AND antibiotic IN {_lit(adapter.ANTIBIOTICS[:5])}",
    ),
    "f_report": (
        lambda t: filters.report(t.ast, t.samples, organisms=("Escherichia coli", "Staphylococcus aureus"), first="1994-01-01", last="1995-12-31", region=("ASIA", "AFRICA"), source_category=("HUMAN",)).select("isolate_id", "antibiotic", "result", "test_date"),
        REPORT_SQL,
    ),
    "f_period": (_recent_period, f"SELECT {', '.join(RECENT_COLS)} FROM ast WHERE test_date BETWEEN DATE '{P1[0]}' AND DATE '{P1[1]}'"),
    "f_coords": (lambda t: filters.located(t.samples).select("sample_id", "latitude", "longitude"), "SELECT sample_id, latitude, longitude FROM samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL"),
    "f_coords_num": (
        lambda t: filters.located_numbers(uploads.samples(t.spark, t.dir)).select("row_no", "latitude", "longitude").where(F.col("latitude").isNotNull()),
        "SELECT o_orderkey + 2 AS row_no, CASE WHEN o_orderkey % 107 = 5 THEN 95.0E0 ELSE 5.0E0 END AS latitude, -1.0E0 AS longitude FROM orders WHERE o_orderkey % 103 <> 5 AND o_orderkey % 206 <> 5",
    ),
    "f_options": (_options, " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS filter, {c} AS value FROM {t}" for c, t in OPTIONS.items())),
    "f_group": (lambda t: filters.group(t.ast, t.samples, categories=("HUMAN",), regions=("ASIA",)).select("isolate_id", "antibiotic", "result"), f"SELECT isolate_id, antibiotic, result FROM {J} WHERE source_category = 'HUMAN' AND region = 'ASIA'"),
    "p_preview": (lambda t: filters.preview(t.ast), "SELECT sample_id, isolate_id, organism, antibiotic, result, test_date FROM ast ORDER BY isolate_id, antibiotic LIMIT 100"),
    "p_recent": (lambda t: filters.recent(t.ast).select(*RECENT_COLS), f"SELECT {', '.join(RECENT_COLS)} FROM ast ORDER BY test_date DESC, isolate_id, antibiotic LIMIT 100"),
    "j_dim_left": (lambda t: t.by("region", "district", "source_category").groupBy("region", "district", "source_category").agg(F.count("*").alias("tests")), f"SELECT region, district, source_category, count(*) AS tests FROM {J} GROUP BY ALL"),
    "j_semi": (lambda t: filters.of_samples(t.ast, t.samples.where(F.col("region") == "ASIA")).select("isolate_id", "antibiotic"), f"SELECT isolate_id, antibiotic FROM {J} WHERE region = 'ASIA'"),
    "j_anti": (lambda t: filters.orphans(t.ast, t.samples.where(F.col("region") != "ASIA")).select("isolate_id", "antibiotic"), f"SELECT isolate_id, antibiotic FROM {J} WHERE region = 'ASIA'"),
    "j_agg_left": (
        lambda t: t.samples.select("dataset_id", "sample_id").join(rates.sample_rates(t.ast), ["dataset_id", "sample_id"], "left").fillna(0),
        f"SELECT s.dataset_id, s.sample_id, coalesce(resistant_count, 0) AS resistant_count, coalesce(total_count, 0) AS total_count, coalesce(resistance_rate, 0.0E0) AS resistance_rate FROM samples s LEFT JOIN ({SAMPLE_RATE}) r ON s.dataset_id = r.dataset_id AND s.sample_id = r.sample_id",
    ),
    "j_rule": _interpreted("intended"),
    # aggregations
    "agg_stats": (lambda t: rates.stats(t.ast), f"SELECT count(*) AS total_tests, {R} AS resistant_count, {I} AS intermediate_count, {S} AS susceptible_count, {_rate(None)} AS resistance_rate, {_rate(None, I)} AS intermediate_rate, {_rate(None, S)} AS susceptibility_rate FROM ast"),
    "agg_org_abx": (lambda t: rates.sir_table(t.ast, "organism", "antibiotic"), _sir("organism", "antibiotic")),
    "agg_abx_rates": (lambda t: rates.antibiotic_rates(t.ast), f"SELECT antibiotic, {R} AS resistant, count(*) AS total, {_rate(2)} AS resistance_rate FROM ast GROUP BY antibiotic"),
    "agg_top_abx": (lambda t: rates.antibiotic_rates(t.ast, 30), f"SELECT antibiotic, {R} AS resistant, count(*) AS total, {_rate(2)} AS resistance_rate FROM ast GROUP BY antibiotic ORDER BY resistance_rate DESC, antibiotic LIMIT 30"),
    "agg_category": (lambda t: rates.shares(t.by("source_category"), "source_category"), _shares("source_category", J)),
    "agg_source_type": (lambda t: rates.shares(t.by("source_type"), "source_type"), _shares("source_type", J)),
    "agg_region": (lambda t: rates.place_table(t.by("region"), "region"), _place("region")),
    "agg_district": (lambda t: rates.place_table(t.by("district"), "district", top=10), _place("district", limit=10)),
    "agg_district_region": (lambda t: rates.place_table(t.by("district", "region"), "district", "region"), _place("district", "region")),
    "agg_distribution": (
        lambda t: rates.distribution(t.ast),
        "SELECT result, count(*) AS count, round(100.0E0 * count(*) / sum(count(*)) OVER (), 1) AS percentage, CASE result WHEN 'S' THEN 'Susceptible' WHEN 'I' THEN 'Intermediate' ELSE 'Resistant' END AS label, CASE result WHEN 'S' THEN 0 WHEN 'I' THEN 1 ELSE 2 END AS nth FROM ast GROUP BY result",
    ),
    "agg_heatmap": (
        _heatmap_rows,
        f"SELECT o.organism, a.antibiotic, coalesce(p, 0.0E0) AS percent_resistant FROM {_first('organism', 8)} o CROSS JOIN {_first('antibiotic', 10)} a LEFT JOIN (SELECT organism, antibiotic, {_rate(2)} AS p FROM ast GROUP BY organism, antibiotic) x ON x.organism = o.organism AND x.antibiotic = a.antibiotic",
    ),
    "agg_cmp_org": (lambda t: rates.comparison(t.ast, "organism"), f"SELECT organism, {R} AS R, {I} AS I, {S} AS S, count(*) AS total, {_rate(2)} AS resistance_rate, {_rate(2, S)} AS susceptibility_rate FROM ast GROUP BY organism"),
    "agg_cmp_abx": (lambda t: rates.comparison(t.ast, "antibiotic"), f"SELECT antibiotic, {R} AS R, {I} AS I, {S} AS S, count(*) AS total, {_rate(2)} AS resistance_rate, {_rate(2, S)} AS susceptibility_rate FROM ast GROUP BY antibiotic"),
    "agg_db_counts": (lambda t: rates.result_counts(t.ast, "DS1"), "SELECT organism, antibiotic, result, count(*) AS count FROM ast WHERE dataset_id = 'DS1' GROUP BY ALL"),
    **{f"agg_report_{d}": _dim(d) for d in ("organism", "antibiotic", "region", "source_category", "district", "site_type", "source_type")},
    "agg_org_top_abx": (
        lambda t: rates.top_per_group(rates.report_rates(t.ast.join(score.high_risk(t.ast).select("organism"), "organism", "left_semi"), "organism", "antibiotic", digits=2, whole="*"), "organism", "antibiotic", 3),
        _top(_report("organism", "antibiotic", source=f"(SELECT * FROM ast WHERE organism IN (SELECT organism FROM ast GROUP BY organism HAVING {_rate(2)} >= 50))", digits=2), "organism", "antibiotic", 3),
    ),
    "agg_group_top5": _group_top("region", "organism"),
    "agg_group_top5_abx": _group_top("source_category", "antibiotic"),
    "agg_sample_rate": (lambda t: rates.sample_rates(t.ast), SAMPLE_RATE),
    "agg_value_counts": (
        lambda t: rates.value_counts(t.profiles.cross_resistance(), "antibiotic_class", "cross_resistance_level"),
        f"SELECT antibiotic_class, cross_resistance_level, count(*) AS count FROM (SELECT antibiotic_class, CASE WHEN {R} = count(*) THEN 'High' ELSE 'Moderate' END AS cross_resistance_level FROM ({CROSS}) GROUP BY dataset_id, isolate_id, antibiotic_class HAVING {R} >= 2) GROUP BY ALL",
    ),
    "agg_mech_summary": (
        lambda t: rates.value_counts(detect.mechanisms(t.ast), "organism", "resistance_mechanism", "confidence"),
        f"SELECT organism, resistance_mechanism, confidence, count(*) AS count FROM ({SCREENED}) GROUP BY ALL",
    ),
    "agg_nunique": (lambda t: t.days.distinct_counts(), "SELECT count(DISTINCT organism) AS organisms, count(DISTINCT antibiotic) AS antibiotics, count(DISTINCT sample_id) AS samples FROM ast"),
    **{f"agg_trend_{k}": (lambda t, k=k: months.trend(t.months, k), _shares("period", f"(SELECT *, {v} AS period FROM ast WHERE test_date IS NOT NULL)")) for k, v in TREND_LABEL.items()},
    "agg_rate_range": (lambda t: rates.rate_range(rates.report_rates(t.by("region"), "region"), "region").unionByName(rates.rate_range(rates.report_rates(t.by("source_category"), "source_category"), "source_category")), RANGE),
    "agg_season": (
        lambda t: months.seasons(t.months),
        f"SELECT count(*) FILTER (WHERE {DRY}) AS dry_tests, count(*) FILTER (WHERE NOT {DRY}) AS wet_tests, 100.0E0 * count(*) FILTER (WHERE {DRY} AND result = 'R') / count(*) FILTER (WHERE {DRY}) AS dry_rate, 100.0E0 * count(*) FILTER (WHERE NOT {DRY} AND result = 'R') / count(*) FILTER (WHERE NOT {DRY}) AS wet_rate FROM ast",
    ),
    "agg_date_range": (lambda t: rates.date_range(t.ast), "SELECT min(test_date) AS first_date, max(test_date) AS last_date, count(test_date) AS dated_tests FROM ast"),
    **{
        f"agg_topn_{d}": (
            lambda t, d=d: rates.most_frequent(t.ast, d),
            f"SELECT {d}, count(*) AS count, {_rate(1)} AS resistance_rate, CASE WHEN {_rate(None)} > 50 THEN 'Avoid' ELSE 'Use' END AS advice FROM ast GROUP BY {d} ORDER BY count DESC, {d} LIMIT 5",
        )
        for d in ("organism", "antibiotic")
    },
    "agg_topn_region": (lambda t: rates.most_sampled(t.samples), "SELECT region, count(*) AS count FROM samples GROUP BY region ORDER BY count DESC, region LIMIT 5"),
    # interpretation
    "i_interpret": _interpreted("reference"),
    "i_mech": (
        lambda t: rates.value_counts(ip.interpret(t.ast, "intended"), "organism", "suspected_mechanism"),
        _interpret_sql("intended") + "SELECT organism, suspected_mechanism, count(*) AS count FROM full_res WHERE suspected_mechanism IS NOT NULL GROUP BY ALL",
    ),
    "i_apply": (
        _filled,
        _interpret_sql("intended")
        + """SELECT organism, antibiotic, CASE WHEN method = 'MIC' THEN f.result WHEN interpreted_result IN ('S', 'I', 'R') THEN interpreted_result END AS result,
             method <> 'MIC' AND interpreted_result IN ('S', 'I', 'R') AS auto_interpreted, count(*) AS count
             FROM (SELECT full_res.*, v.method FROM full_res JOIN v ON full_res.isolate_id = v.isolate_id AND full_res.antibiotic = v.antibiotic) f GROUP BY ALL""",
    ),
    # detectors
    **{name: (lambda t, k=name[2:]: detect.screen(t.ast, k), _screen(*x)) for name, x in SCREENS.items()},
    "d_mechanisms": (lambda t: detect.mechanisms(t.ast), f"SELECT * EXCLUDE (nth, k) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, isolate_id, resistance_mechanism ORDER BY nth) AS k FROM ({SCREENED})) WHERE k = 1"),
    "d_cross": (
        lambda t: t.profiles.cross_resistance(),
        f"SELECT dataset_id, isolate_id, antibiotic_class, min(organism) AS organism, {R} AS resistant_antibiotics, count(*) AS total_antibiotics, CASE WHEN {R} = count(*) THEN 'High' ELSE 'Moderate' END AS cross_resistance_level FROM ({CROSS}) GROUP BY dataset_id, isolate_id, antibiotic_class HAVING {R} >= 2",
    ),
    "d_multi": (
        lambda t: t.profiles.multi_resistance(),
        "SELECT dataset_id, isolate_id, min(organism) AS organism, count(DISTINCT antibiotic) FILTER (WHERE result = 'R') AS resistant_count, count(DISTINCT antibiotic) AS total_tested, round(100.0E0 * count(DISTINCT antibiotic) FILTER (WHERE result = 'R') / count(DISTINCT antibiotic), 1) AS resistance_percentage, 'MDR' AS resistance_level FROM ast GROUP BY dataset_id, isolate_id HAVING count(DISTINCT antibiotic) FILTER (WHERE result = 'R') >= 3",
    ),
    "d_mdr": (lambda t: t.profiles.mdr(), MDR),
    "d_cores": (
        lambda t: t.profiles.co_resistance(),
        "SELECT antibiotic_combination, count(*) AS count FROM (SELECT string_agg(antibiotic, ', ' ORDER BY antibiotic) AS antibiotic_combination FROM ast WHERE result = 'R' GROUP BY dataset_id, isolate_id) GROUP BY ALL HAVING count(*) >= 5",
    ),
    "d_alerts": (
        lambda t: detect.alerts(t.ast),
        f"""SELECT 'overall' AS type, 'HIGH' AS severity, {_rate(1)} AS value, NULL AS what FROM ast HAVING {_rate(None)} > 30
            UNION ALL SELECT 'mdr', 'HIGH', CAST(count(*) AS DOUBLE), NULL FROM ({MDR}) HAVING count(*) > 0
            UNION ALL SELECT * FROM (SELECT 'combination', 'MEDIUM', percent_resistant, organism || ' / ' || antibiotic FROM ({_sir("organism", "antibiotic")}) WHERE percent_resistant > 50 AND total >= 10 ORDER BY percent_resistant DESC, organism, antibiotic LIMIT 1)""",
    ),
    "d_alternatives": (
        lambda t: score.alternatives(t.ast),
        f""", hr AS (SELECT organism, risk_level, resistance_rate AS organism_rate FROM ({RISK}) WHERE resistance_rate >= 50 ORDER BY resistance_rate DESC, organism LIMIT 15),
            tops AS ({_top(_report("organism", "antibiotic", source="ast", digits=9), "organism", "antibiotic", 3)}),
            alt AS (SELECT organism, string_agg(DISTINCT x, ', ' ORDER BY x) AS alternatives FROM (SELECT organism, x, row_number() OVER (PARTITION BY organism ORDER BY x) AS n FROM (SELECT DISTINCT organism, unnest({ALT}) AS x FROM tops)) WHERE n <= 3 GROUP BY organism)
            SELECT tops.organism, risk_level, organism_rate, string_agg(antibiotic, ', ' ORDER BY rank) AS at_risk, alternatives
            FROM tops JOIN hr ON tops.organism = hr.organism JOIN alt ON alt.organism = hr.organism GROUP BY tops.organism, risk_level, organism_rate, alternatives""",
    ),
    # scores
    "s_trend": (
        lambda t: score.half_trend(t.ast),
        f"""SELECT CASE WHEN c > 5 THEN 'increasing' WHEN c < -5 THEN 'decreasing' ELSE 'stable' END AS trend, round(a, 2) AS first_half_rate, round(b, 2) AS second_half_rate, round(c, 2) AS change, CASE WHEN c > 5 THEN 'HIGH' WHEN c > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
            FROM (SELECT *, b - a AS c FROM (SELECT 100.0E0 * count(*) FILTER (WHERE rn <= half AND result = 'R') / count(*) FILTER (WHERE rn <= half) AS a, 100.0E0 * count(*) FILTER (WHERE rn > half AND result = 'R') / count(*) FILTER (WHERE rn > half) AS b FROM {CASE_HALF}))""",
    ),
    "s_emerging": (
        lambda t: score.emerging(t.ast),
        f"SELECT organism, antibiotic, {_rate(2)} AS resistance_rate, count(*) AS tests, CASE WHEN {_rate(None)} > 80 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM ast WHERE test_date >= (SELECT max(test_date) FROM ast) - 90 GROUP BY organism, antibiotic HAVING {_rate(None)} > 60 AND count(*) >= 5",
    ),
    "s_quality": (
        lambda t: score.data_quality(t.samples, t.ast),
        "SELECT ns AS total_samples, nt AS total_tests, nc AS samples_with_coordinates, nd AS tests_with_dates, round(100.0E0 * nd / nt, 2) AS completeness_score, concat_ws('; ', CASE WHEN 100.0E0 * nc / ns < 50 THEN 'Low geographic data coverage' END, CASE WHEN 100.0E0 * nd / nt < 80 THEN 'Missing test dates' END) AS data_quality_issues FROM (SELECT count(*) AS ns, count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS nc FROM samples), (SELECT count(*) AS nt, count(test_date) AS nd FROM ast)",
    ),
    "s_risk": (lambda t: score.organism_risk(t.ast), RISK),
    "s_high_risk": (lambda t: score.high_risk(t.ast), f"SELECT * FROM ({RISK}) WHERE resistance_rate >= 50"),
    "s_recommend": (
        lambda t: score.recommendations(t.ast),
        "SELECT antibiotic, round(rate, 2) AS susceptibility_rate, tests, CASE WHEN rate > 80 THEN 'PREFERRED' WHEN rate > 60 THEN 'GOOD' WHEN rate > 40 THEN 'CAUTION' ELSE 'AVOID' END AS recommendation, CASE WHEN rate > 80 THEN 1 WHEN rate > 60 THEN 2 WHEN rate > 40 THEN 3 ELSE 4 END AS priority "
        f"FROM (SELECT antibiotic, {_rate(None, S)} AS rate, count(*) AS tests FROM ast GROUP BY antibiotic HAVING count(*) >= 5)",
    ),
    "s_burden": (
        _burden_rows,
        f"""SELECT tr AS total_resistant_tests, tn AS total_tests, 100.0E0 * tr / tn AS overall_resistance_rate, CASE WHEN 100.0E0 * tr / tn > 50 THEN 'CRITICAL - Urgent intervention needed' WHEN 100.0E0 * tr / tn > 30 THEN 'HIGH - Enhanced surveillance recommended' WHEN 100.0E0 * tr / tn > 15 THEN 'MODERATE - Continued monitoring' ELSE 'LOW - Maintain current practices' END AS public_health_impact,
            source_category, round(100.0E0 * r / n, 2) AS category_rate FROM ({BURDEN}) b, (SELECT CAST(sum(r) AS BIGINT) AS tr, CAST(sum(n) AS BIGINT) AS tn FROM ({BURDEN})) WHERE source_category IS NOT NULL""",
    ),
    "s_forecast": (
        lambda t: months.forecast(t.months),
        f"""SELECT i AS months_ahead, greatest(0.0E0, least(100.0E0, round(slope * (m - 1 + i) + b, 2))) AS predicted_resistance_rate, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, round(slope, 4) AS trend_slope, CASE WHEN m >= 6 THEN 'moderate' ELSE 'low' END AS confidence, CAST(NULL AS VARCHAR) AS error
            FROM (SELECT regr_slope(rate, x) AS slope, regr_intercept(rate, x) AS b, count(*) AS m FROM ({MONTHS})), (VALUES (1), (2), (3)) p(i)""",
    ),
    "s_kpis": (
        lambda t: score.kpis_of(t.samples, t.days.activity(AS_OF)),
        f"SELECT ns AS total_samples_collected, nt AS total_tests_performed, round(nt / ns, 2) AS tests_per_sample, o AS organisms_identified, a AS antibiotics_tested, r AS tests_last_30_days, CASE WHEN r > 0 THEN 'active' ELSE 'inactive' END AS testing_trend, 100.0E0 * nl / ns AS geographic_coverage FROM (SELECT count(*) AS ns, count(latitude) AS nl FROM samples), (SELECT count(*) AS nt, count(DISTINCT organism) AS o, count(DISTINCT antibiotic) AS a, count(*) FILTER (WHERE test_date >= DATE '{AS_OF}' - 30) AS r FROM ast)",
    ),
    "s_insights": (
        lambda t: score.insights(t.ast),
        f"""SELECT round(r, 2) AS resistance_rate, CASE WHEN r > 40 THEN 'HIGH' WHEN r > 20 THEN 'MODERATE' ELSE 'LOW' END AS risk, CASE WHEN r > 30 THEN 'CRITICAL' WHEN r > 15 THEN 'ELEVATED' ELSE 'ACCEPTABLE' END AS assessment,
            o.organism AS top_organism, o.resistance_rate AS top_organism_rate, a.antibiotic AS top_antibiotic, a.resistance_rate AS top_antibiotic_rate, o.resistance_rate > 50 AS act_on_organism, a.resistance_rate > 40 AS restrict_antibiotic, r > s AS more_resistant_than_susceptible, o.resistance_rate > 60 AS organism_of_concern
            FROM (SELECT {_rate(None)} AS r, {_rate(None, S)} AS s FROM ast), (SELECT * FROM ({_report("organism", source="ast", digits=2)}) ORDER BY resistance_rate DESC, organism LIMIT 1) o, (SELECT * FROM ({_report("antibiotic", source="ast", digits=2)}) ORDER BY resistance_rate DESC, antibiotic LIMIT 1) a""",
    ),
    "s_map": (lambda t: score.resistance_map(t.samples, t.ast), f"SELECT *, CASE WHEN resistance_rate > 50 THEN 'red' WHEN resistance_rate > 30 THEN 'orange' ELSE 'green' END AS color, greatest(5.0E0, least(20.0E0, total_count / 2)) AS radius FROM ({POINTS})"),
    "s_point_map": (lambda t: score.point_map(t.samples, t.ast), POINTS),
    # comparisons
    "c_category": (
        lambda t: compare.two_categories(t.ast, t.samples, "HUMAN", "ANIMAL"),
        f"SELECT *, rate_a - rate_b AS difference FROM (SELECT count(*) FILTER (WHERE source_category = 'HUMAN') AS tests_a, count(*) FILTER (WHERE source_category = 'ANIMAL') AS tests_b, 100.0E0 * count(*) FILTER (WHERE source_category = 'HUMAN' AND result = 'R') / count(*) FILTER (WHERE source_category = 'HUMAN') AS rate_a, 100.0E0 * count(*) FILTER (WHERE source_category = 'ANIMAL' AND result = 'R') / count(*) FILTER (WHERE source_category = 'ANIMAL') AS rate_b FROM {J})",
    ),
    "j_full_topk": (
        lambda t: compare.category_antibiotics(t.ast, t.samples, "HUMAN", "ANIMAL"),
        f", best AS (SELECT *, row_number() OVER (PARTITION BY source_category ORDER BY resistance_rate DESC, antibiotic) AS rank FROM ({_report('source_category', 'antibiotic', digits=2)})) SELECT coalesce(a.antibiotic, b.antibiotic) AS antibiotic, coalesce(a.resistance_rate, 0.0E0) AS rate_a, coalesce(b.resistance_rate, 0.0E0) AS rate_b FROM (SELECT * FROM best WHERE source_category = 'HUMAN') a FULL JOIN (SELECT * FROM best WHERE source_category = 'ANIMAL') b ON a.antibiotic = b.antibiotic WHERE a.rank <= 10 OR b.rank <= 10",
    ),
    "c_period": (
        lambda t: compare.two_periods(t.ast, P1, P2),
        "SELECT *, rate_2 - rate_1 AS difference, CASE WHEN rate_2 > rate_1 THEN 'increasing' WHEN rate_2 < rate_1 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT "
        + ", ".join(f"count(*) FILTER (WHERE {w}) AS tests_{k}, 100.0E0 * count(*) FILTER (WHERE {w} AND result = 'R') / count(*) FILTER (WHERE {w}) AS rate_{k}" for k, w in ((k, f"test_date BETWEEN DATE '{p[0]}' AND DATE '{p[1]}'") for k, p in ((1, P1), (2, P2))))
        + " FROM ast)",
    ),
    "j_inner_keys": (
        lambda t: compare.period_organisms(t.ast, P1, P2),
        "SELECT a.organism, a.resistance_rate AS rate_1, b.resistance_rate AS rate_2, round(b.resistance_rate - a.resistance_rate, 1) AS change FROM "
        + " JOIN ".join(f"({_report('organism', source=f'''(SELECT * FROM ast WHERE test_date BETWEEN DATE '{p[0]}' AND DATE '{p[1]}')''')}) {n}" for n, p in (("a", P1), ("b", P2)))
        + " ON a.organism = b.organism",
    ),
    "c_region": (lambda t: compare.compare_by(t.ast, "region", ("ASIA", "EUROPE", "AFRICA"), t.samples), _items("region", J, "WHERE region IN ('ASIA', 'EUROPE', 'AFRICA')")),
    "c_source_type": (lambda t: compare.compare_by(t.ast, "source_type", None, t.samples), _items("source_type")),
    "c_multi_region": _multi("region", 5),
    "c_multi_organism": _multi("organism", 5),
    "c_multi_antibiotic": _multi("antibiotic", 8),
    "c_multi_category": _multi("source_category", 5),
    "c_multi_source_type": _multi("source_type", 5),
    "c_cross_region": _cross("region"),
    "c_cross_district": _cross("district"),
    "c_cross_source_type": _cross("source_type"),
    "c_cross_category": _cross("source_category"),
    "c_cross_month": _cross("month", "strftime(collection_date, '%Y-%m')"),
    "c_custom": (
        lambda t: compare.custom_groups(t.ast, t.samples, GROUPS["a"], GROUPS["b"]),
        f"SELECT *, rate_b - rate_a AS difference FROM (SELECT count(*) AS tests_a, {_rate(None)} AS rate_a FROM {J} WHERE source_category IN ('HUMAN', 'FOOD')), (SELECT count(*) AS tests_b, {_rate(None)} AS rate_b FROM {J} WHERE region IN ('ASIA', 'EUROPE'))",
    ),
    "m_overview": (lambda t: compare.overview_metrics(t.ast, t.samples), f"SELECT {_rate(1)} AS resistance_rate, count(*) AS tests, count(DISTINCT organism) AS organisms, (SELECT count(DISTINCT sample_id) FROM samples) AS samples FROM ast"),
    # tables with gaps
    **{name: (lambda t, run=run: run(*gaps.tables(t.samples, t.ast)), gaps.SQL + sql) for name, (run, sql) in gaps.QUERIES.items()},
    # upload rules
    **{name: _validation(name) for name in validate.RULES},
    "v_all": (_all_rules, " UNION ALL ".join(_validation(name)[1] for name in validate.RULES)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(Tables(spark, sf_dir))) for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"{adapter.SQL} {body}" for name, (_, body) in ENTRIES.items()}
