"""Operators on hand-made rows: expectations worked out from the definitions."""

from __future__ import annotations

import fixtures
import pytest
from pyspark.sql import functions as F

from antibiogram.functions import interpret as ip
from antibiogram.functions.exprs import ladder
from antibiogram.operators import compare, detect, filters, months, rates, score, validate
from antibiogram.plans import assistant, report
from antibiogram.sources import catalog, io


@pytest.fixture(scope="module")
def quick(spark):
    return fixtures.tests(spark, fixtures.QUICK_TESTS), fixtures.samples(spark, fixtures.QUICK_SAMPLES)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_stats(quick):
    r = rates.stats(quick[0]).first()
    assert (r.total_tests, r.resistant_count, r.intermediate_count, r.susceptible_count) == (10, 5, 1, 4)
    assert (r.resistance_rate, r.intermediate_rate, r.susceptibility_rate) == (50.0, 10.0, 40.0)


def test_places(quick):
    ast, samples = quick
    found = rates.place_table(rates.with_dims(ast, samples, "region"), "region")
    assert rows(found, "region", "percent_resistant") == [("Central", 100.0), ("Ashanti", 57.14), ("Greater Accra", 0.0)]
    assert rows(rates.place_table(rates.with_dims(ast, samples, "district"), "district", top=2), "district", "percent_resistant") == [("Cape Coast", 100.0), ("Kumasi", 80.0)]
    assert rows(rates.place_table(rates.with_dims(ast, samples, "region").drop("result"), "region"), "total", "percent_resistant") == [(0, 0.0)] * 3


def test_detectors(quick):
    ast, _ = quick
    assert rows(detect.mdr(ast), "isolate_id", "resistant_drug_classes") == [("ISO_002", 3)]
    assert rows(detect.multi_resistance(ast), "isolate_id", "resistant_count", "resistance_percentage", "resistance_level") == [("ISO_002", 3, 100.0, "MDR")]
    assert rows(detect.co_resistance(ast, 1), "antibiotic_combination", "count") == [("Ampicillin", 1), ("Ampicillin, Gentamicin, Tetracycline", 1), ("Methicillin", 1)]
    assert detect.co_resistance(ast).isEmpty() and detect.mechanisms(ast).isEmpty() and detect.cross_resistance(ast).isEmpty()
    assert rows(detect.alerts(ast), "type", "severity", "value") == [("overall", "HIGH", 50.0), ("mdr", "HIGH", 1.0)]


def test_scores(quick):
    ast, samples = quick
    risk = {r.organism: (r.risk_score, r.risk_level) for r in score.organism_risk(ast).collect()}
    assert risk["E. coli"] == (55, "HIGH") and risk["Staphylococcus"] == (40, "MODERATE")
    assert rows(months.trend(months.counts(ast)), "period", "R") == [("2024-01", pytest.approx(400 / 7)), ("2024-02", pytest.approx(100 / 3))]
    f = months.forecast(months.counts(ast)).collect()
    assert len(f) == 3 and {(r.confidence, r.trend, r.error) for r in f} == {("low", "decreasing", None)}
    b = score.burden(samples, ast).first()
    assert b.total_tests == 10 and b.resistance_by_category == {"FOOD": 83.33, "ENVIRONMENT": 0.0}
    assert b.public_health_impact.startswith("HIGH")
    q = score.data_quality(samples, ast).first()
    assert (q.samples_with_coordinates, q.completeness_score, q.data_quality_issues) == (3, 100.0, "")
    k = score.kpis(samples, ast, "2024-02-20").first()
    assert (k.tests_last_30_days, k.testing_trend, k.tests_per_sample) == (5, "active", 2.5)


def test_high_risk(spark):
    def made(*organisms):
        n = iter(range(100))
        return fixtures.tests(spark, [(f"S{next(n)}", f"I{next(n)}", o, a, r, None) for o, a, results in organisms for r in results])

    one = made(("E. coli", "Ampicillin", "RRS"), ("S. aureus", "Methicillin", "RR"), ("K. pneumoniae", "Ceftriaxone", "RRRR"))
    assert rows(score.high_risk(one), "organism", "resistance_rate", "risk_score", "risk_level") == [
        ("K. pneumoniae", 100.0, 40, "MODERATE"), ("S. aureus", 100.0, 40, "MODERATE"), ("E. coli", 66.67, 30, "MODERATE")
    ]
    two = made(("E. coli", "Ampicillin", "RR"), ("S. aureus", "Methicillin", "RRS"), ("K. pneumoniae", "Ceftriaxone", "R"))
    assert rows(score.high_risk(two), "organism", "resistance_rate") == [("E. coli", 100.0), ("K. pneumoniae", 100.0), ("S. aureus", 66.67)]


@pytest.mark.parametrize(
    ("steps", "otherwise", "strict"),
    [([(70, "a"), (50, "b"), (30, "c")], "d", True), ([(70, "a"), (50, "b"), (30, "c")], "d", False), ([(80, "a"), (60, "b"), (40, "c")], "d", True), ([(5, "a"), (0, "b")], "c", True)],
)
def test_ladders(spark, steps, otherwise, strict):
    eps = 1e-6
    df = spark.createDataFrame([(x,) for limit, _ in steps for x in (limit - eps, float(limit), limit + eps)], "x double").select("x", ladder(F.col("x"), steps, otherwise, strict).alias("y"))
    for x, y in df.collect():
        assert y == next((name for limit, name in steps if (x > limit if strict else x >= limit)), otherwise)


CASES = [
    ("Escherichia coli", "Ceftazidime", "MIC", 16.0, "CLSI", ("R", "ESBL", "High"), None),
    ("Escherichia coli", "Ceftazidime", "MIC", 4.0, "CLSI", ("S", None, "High"), None),
    ("Escherichia coli", "Ceftazidime", "MIC", 4.0, "eucast", ("I", None, "High"), None),
    ("Klebsiella pneumoniae", "Cefotaxime", "DD", 24.0, "CLSI", ("I", None, "High"), None),
    ("Klebsiella pneumoniae", "Cefotaxime", "DD", 24.0, "EUCAST", ("S", None, "High"), None),
    ("Escherichia coli", "Amoxicillin", "MIC", 12.0, "CLSI", ("Unknown", None, "High"), None),
    ("Escherichia coli", "Ampicillin", "DD", 16.5, "CLSI", ("Unknown", None, "High"), None),
    ("Staphylococcus aureus", "Methicillin", "DD", 9.0, "CLSI", ("R", "MRSA", "High"), None),
    ("Pseudomonas aeruginosa", "Ceftazidime", "MIC", 32.0, "CLSI", ("R", "AmpC", "Moderate - confirmatory test recommended"), None),
    ("Enterococcus faecalis", "Vancomycin", "MIC", 64.0, "CLSI", ("Unknown", None, "No breakpoint available"), ("R", "VRE", "High")),
    ("Acinetobacter baumannii", "Ciprofloxacin", "MIC", 4.0, "CLSI", ("Unknown", None, "No breakpoint available"), ("R", None, "High")),
    ("E. coli", "Ampicillin", "MIC", 32.0, "CLSI", ("Unknown", None, "No breakpoint available"), None),
    ("Escherichia  coli", "Ampicillin", "MIC", None, "CLSI", ("Unknown", None, "Invalid test method or missing value"), None),
    ("Escherichia coli", "Ampicillin", "MIC", float("nan"), "CLSI", ("Unknown", None, "High"), ("Unknown", None, "Invalid test method or missing value")),
    ("Escherichia coli", "Ampicillin", "ETEST", 3.0, "CLSI", ("Unknown", None, "Invalid test method or missing value"), None),
    ("Escherichia coli", "Ampicillin", "MIC", 3.0, "BSAC", ("Unknown", None, "Unsupported guideline"), None),
    (None, None, None, None, None, ("Unknown", None, "Unsupported guideline"), None),
]


@pytest.mark.parametrize("mode", ["reference", "intended"])
def test_interpreter(spark, mode):
    made = spark.createDataFrame(
        [("D", "s", str(k), o, a, None, m, g, None, v if m == "MIC" else None, v if m == "DD" else None) for k, (o, a, m, v, g, *_) in enumerate(CASES)], fixtures.AST
    )
    got = {int(r.isolate_id): (r.interpreted_result, r.suspected_mechanism, r.interpretation_confidence) for r in ip.interpret(made, mode).collect()}
    for k, (*_, as_reference, as_intended) in enumerate(CASES):
        assert got[k] == (as_intended if mode == "intended" and as_intended else as_reference), CASES[k]
    filled = {int(r.isolate_id): (r.result, r.auto_interpreted) for r in ip.fill_results(made, mode).collect()}
    assert filled[0] == ("R", True) and filled[5] == (None, False)


def test_parse_bound():
    assert ip.parse_bound("<=8") == ("<=", [8.0]) and ip.parse_bound(">=0.5") == (">=", [0.5])
    assert ip.parse_bound("14-19") == ("range", [14.0, 19.0]) and ip.parse_bound("16") == ("=", [16.0]) and ip.parse_bound(None) is None


def test_template_is_valid_and_each_fault_is_found(spark):
    good = io.template(spark)
    s, a = good["samples"], good["ast_results"]
    assert validate.validate(spark, s, a).isEmpty()
    first = F.col("row_no") == 2
    put = lambda df, col, value: df.withColumn(col, F.when(first, value).otherwise(F.col(col)))
    faults = {
        "v_s_dup": (s.union(s.where(first)), a), "v_s_cat": (put(s, "source_category", "PET"), a), "v_s_date": (put(s, "collection_date", "2024-13-01"), a),
        "v_s_coord_range": (put(s, "latitude", "91"), a), "v_s_coord_num": (put(s, "latitude", "abc"), a), "v_s_req": (put(s, "region", " "), a), "v_a_dup": (s, a.union(a.where(first))),
        "v_a_result": (s, put(a, "result", "X")), "v_a_method": (s, put(a, "method", "ETEST")), "v_a_guideline": (s, put(a, "guideline", "BSAC")), "v_a_date": (s, put(a, "test_date", "1.2.2024")),
        "v_a_orphan": (s, put(a, "sample_id", "LOST")), "v_a_req": (s, put(a, "organism", "")), "v_a_mic_num": (s, put(a, "mic_value", "abc")), "v_a_zone_num": (s, put(a, "zone_diameter", "abc")),
    }
    assert set(faults) == set(validate.RULES)
    for name, (x, y) in faults.items():
        found = validate.validate(spark, x, y).collect()
        assert [(r.rule_id, r.row_no) for r in found] == [(name, 2)], name
    assert rows(validate.validate(spark, None, a), "rule_id") == [("src_excel_structure",)]
    assert rows(validate.validate(spark, s.limit(0), a), "rule_id") == [("v_empty",)]
    assert rows(validate.validate(spark, s.drop("region"), a), "rule_id", "value") == [("v_s_cols", "region")]
    assert rows(validate.validate(spark, s, a.withColumnRenamed("result", " result ")), "rule_id", "value") == [("v_a_cols", "result")]


def test_filters(quick):
    ast, samples = quick
    assert filters.overview(ast, samples, categories=(), regions=("Central",))[0].count() == 4  # an empty selection lifts the filter
    assert filters.overview(ast, samples, regions=("Central",))[1].count() == 1
    assert filters.group(ast, samples, categories=("FOOD",), regions=("Ashanti",)).count() == 5
    assert filters.report(ast, samples, first="2024-01-19", last="2024-02-08").count() == 7
    assert rows(filters.options(samples, "region"), "value") == [("Ashanti",), ("Central",), ("Greater Accra",)]
    assert filters.orphans(ast, samples.where("sample_id <> 'SAM_004'")).count() == 1 and filters.located(samples).count() == 3


def test_half_trend_against_sorting(spark, quick):
    ordered = sorted(fixtures.QUICK_TESTS, key=lambda r: (r[5], r[1], r[3]))
    half = len(ordered) // 2
    share = lambda part: round(100 * sum(r[4] == "R" for r in part) / len(part), 2)
    r = score.half_trend(quick[0]).first()
    assert (r.first_half_rate, r.second_half_rate) == (share(ordered[:half]), share(ordered[half:]))
    assert r.trend == "decreasing" and r.risk_level == "LOW"
    assert score.half_trend(fixtures.tests(spark, fixtures.QUICK_TESTS[:1])).first().trend == "insufficient_data"
    same_day = fixtures.tests(spark, [("s", f"i{k}", "o", "a", "R" if k < 3 else "S", "2024-01-01") for k in range(7)])
    assert (lambda x: (x.first_half_rate, x.second_half_rate))(score.half_trend(same_day).first()) == (100.0, 0.0)


def test_half_trend_splits_a_hot_day(spark):
    """One day holds nearly all rows, a third of them of one key, some without an isolate or a result."""
    rows = [("s", f"i{k % 997:04d}" if k % 3 else None, "o", "a" if k % 2 else None, (None, "R", "S", "R", "I")[k % 5], "2024-01-02") for k in range(3000)]
    rows += [("s", "x", "o", "a", "R", "2024-01-01")] * 7 + [("s", "x", "o", "a", "S", "2024-01-03")] * 4
    rank = lambda x: (x is not None, x or "")
    ordered = sorted(rows, key=lambda r: (r[5], rank(r[1]), rank(r[3]), rank(r[4])))
    half = len(rows) // 2
    share = lambda part: round(100 * sum(r[4] == "R" for r in part) / len(part), 2)
    for keys in (1_000_000, 100):  # put in order at once, and narrowed to a part before
        r = score.half_trend(fixtures.tests(spark, rows), keys).first()
        assert (r.first_half_rate, r.second_half_rate) == (share(ordered[:half]), share(ordered[half:]))


def test_empty_frames(spark):
    ast, samples = fixtures.tests(spark, []), fixtures.samples(spark, [])
    assert rates.stats(ast).first().total_tests == 0
    assert months.forecast(months.counts(ast)).first().error == "Insufficient data for forecast"
    for df in (detect.mechanisms(ast), detect.mdr(ast), score.emerging(ast), score.high_risk(ast), months.trend(months.counts(ast)), compare.compare_by(ast, "region", None, samples), rates.heatmap(ast)):
        assert df.isEmpty()


def test_merge_and_registry(spark, tmp_path):
    mine = fixtures.tests(spark, [("a", "i1", "o", "x", "R", None), ("b", "i2", "o", "x", "S", None)])
    theirs = fixtures.tests(spark, [("a", "i1", "o", "x", "S", None), ("a", None, "o", "y", "R", None), ("a", " ", "p", "y", "R", None)]).withColumn("dataset_id", F.lit("E"))
    s = fixtures.samples(spark, [("a", None, None, None, None, None)])
    registry = spark.createDataFrame([("D", 1, 2), ("E", 1, 3)], "dataset_id string, rows_samples long, rows_tests long")
    ms, ma, mr = catalog.merge(s.union(s.withColumn("dataset_id", F.lit("E"))), mine.union(theirs), registry, "E", "D")
    assert sorted(r.isolate_id for r in ma.collect()) == ["E-i1", "E-isolate-1", "E-isolate-2", "i1", "i2"]
    assert sorted(r.sample_id for r in ms.collect()) == ["E-a", "a"] and {r.dataset_id: r.rows_tests for r in mr.collect()} == {"D": 5, "E": 3}
    again = catalog.upsert(ma, ma.withColumn("result", F.lit("I")), "dataset_id", "isolate_id", "antibiotic")
    assert again.count() == 5 and {r.result for r in again.collect()} == {"I"}


def test_write_scan_delete(spark, quick, tmp_path):
    path = str(tmp_path / "store")
    for d in ("one", "two"):
        io.write_dataset(path, d, d.title(), quick[1], quick[0], "a@lab.org", "2025-01-01")
    assert io.scan(spark, path, "ast_results", "one").count() == 10 and io.scan(spark, path, "samples").count() == 8
    assert "PartitionFilters: [isnotnull(dataset_id" in io.scan(spark, path, "ast_results", "one")._jdf.queryExecution().toString()
    io.delete_dataset(spark, path, "one")
    assert io.scan(spark, path, "ast_results").count() == 10 and rows(io.scan(spark, path, "datasets"), "dataset_id") == [("two",)]


def test_write_is_idempotent(spark, quick, tmp_path):
    path = str(tmp_path / "again")
    for _ in range(2):
        io.write_dataset(path, "one", "One", quick[1], quick[0], "a@lab.org", "2025-01-01")
    assert io.scan(spark, path, "ast_results").count() == 10 and io.scan(spark, path, "datasets").count() == 1
    r = io.scan(spark, path, "datasets").first()
    assert (r.rows_samples, r.rows_tests) == (4, 10) and io.health(spark, path).first().datasets == 1


def test_blanks_short_dates_and_half_coordinates(spark):
    """What an upload may hold and the generated tables do not."""
    good = io.template(spark)
    s, a = good["samples"], good["ast_results"]
    put = lambda df, col, value: df.withColumn(col, F.when(F.col("row_no") == 2, F.lit(value)).otherwise(F.col(col)))
    for x, y, rule in ((s, put(a, "result", " "), "v_a_result"), (s, put(a, "method", None), "v_a_method"), (s, put(a, "guideline", "nan"), "v_a_guideline"), (put(s, "source_category", ""), a, "v_s_cat")):
        assert rows(validate.validate(spark, x, y), "rule_id", "row_no", "value") == [(rule, 2, "")]
    assert validate.validate(spark, put(s, "collection_date", "2024-1-5"), put(a, "test_date", "2024-01-5")).isEmpty()
    for date in ("24-01-05", "2024-01-05 10:00", "2024-02-30", "2024/01/05"):
        assert rows(validate.validate(spark, put(s, "collection_date", date), a), "rule_id") == [("v_s_date",)]
    half = put(put(s, "latitude", "abc"), "longitude", None)
    assert validate.validate(spark, half, a).isEmpty() and rows(validate.validate(spark, put(s, "latitude", "abc"), a), "value") == [("abc",)]


def test_merge_links_blank_samples(spark):
    """A test without a sample id belongs to the last renamed sample without one."""
    s = fixtures.samples(spark, [("a", "R", "D", None, None, None), (None, "A", "D", None, None, None), (" ", "B", "D", None, None, None)]).withColumn("dataset_id", F.lit("E"))
    t = fixtures.tests(spark, [("a", "i1", "o", "x", "S", None), (None, "i2", "o", "x", "R", None), ("", "i3", "o", "x", "R", None)]).withColumn("dataset_id", F.lit("E"))
    registry = spark.createDataFrame([("D", 0, 0), ("E", 3, 3)], "dataset_id string, rows_samples long, rows_tests long")
    ms, ma, _ = catalog.merge(s, t, registry, "E", "D")
    assert sorted(rows(ms, "sample_id", "region")) == [("E-a", "R"), ("E-sample-1", "A"), ("E-sample-2", "B")]
    assert sorted(rows(ma, "isolate_id", "sample_id")) == [("E-i1", "E-a"), ("E-i2", "E-sample-2"), ("E-i3", "E-sample-2")]


def test_overview_lifts_both_filters(quick):
    ast, samples = quick
    assert filters.overview(ast, samples, organisms=(), antibiotics=("Ampicillin",))[1].count() == 10
    assert filters.overview(ast, samples, organisms=("E. coli",), antibiotics=("Ampicillin",))[1].count() == 2


def test_adapter_deals_rows_once(spark, sf_dir):
    """One exchange serves the window and the join with the samples, and the dataset's filter is below both."""
    from antibiogram.sources import adapter

    plan = adapter.tests(spark, sf_dir).where("dataset_id = 'DS1'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("= DS1")
    joined = rates.with_dims(adapter.tests(spark, sf_dir), adapter.samples(spark, sf_dir).hint("merge"), "region")._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(dataset_id" in x and "sample_id" in x for x in joined.split("\n")) == 2


def test_set_main(spark):
    d = spark.createDataFrame([("a", None, False), ("b", "Togo", True)], "dataset_id string, country string, is_country_main boolean")
    assert sorted(rows(catalog.set_main(d, "a", True, "Ghana"), *d.columns)) == [("a", "Ghana", True), ("b", "Togo", True)]
    assert sorted(rows(catalog.set_main(d, "b", False, "Ghana"), *d.columns)) == [("a", None, False), ("b", "Togo", False)]


def test_report_and_assistant(quick):
    text = report.markdown(*quick)
    assert "## Forecast" in text and "| Central | 1 | 1 | 100.0 |" in text
    assert [assistant.topic(q) for q in ("Give me an overview", "In general?", "Which drug?", "why so?", "Any threat?", "hello")] == ["fallback", "summary", "antibiotic", "explain", "risk", "fallback"]
    assert assistant.answer("which bacteria", *quick).first().organism == "E. coli"
    assert rows(assistant.answer("hotspots", *quick), "region", "count")[0] == ("Ashanti", 2)
    assert rows(assistant.answer("Any risk?", *quick), "total_tests", "resistance_rate", "status", "risk", "action") == [(10, 50.0, "MODERATE", "MODERATE RISK", "Active surveillance and intervention")]
    assert assistant.answer("in general", quick[0].where("result = 'R'"), quick[1]).first().status == "CRITICAL" and assistant.answer("?", quick[0].limit(0), quick[1]).first().status == "CONTROLLED"
    html = report.html(*quick, title="A & B")
    assert "<h1>A &amp; B</h1>" in html and "<h2>Forecast</h2>" in html and "<td>Central</td><td>1</td><td>1</td><td>100.0</td>" in html


def test_stream(spark, quick, tmp_path):
    from antibiogram.streaming.alerts import stream_alerts

    path = str(tmp_path / "tests")
    quick[0].write.parquet(path)
    stream = spark.readStream.schema(fixtures.AST).parquet(path)
    q = stream_alerts(stream, above=50, min_tests=1).writeStream.format("memory").queryName("alerts").outputMode("complete").start()
    try:
        q.processAllAvailable()
        found = {(r.organism, r.antibiotic) for r in spark.table("alerts").collect()}
    finally:
        q.stop()
    assert ("E. coli", "Ampicillin") in found and ("Vibrio", "Ampicillin") not in found


def test_invariants(spark, sf_dir):
    from antibiogram.sources import adapter

    ast = adapter.tests(spark, sf_dir)
    r = rates.stats(ast).first()
    assert r.resistance_rate + r.intermediate_rate + r.susceptibility_rate == pytest.approx(100)
    m = detect.mechanisms(ast)
    assert m.count() == m.select("dataset_id", "isolate_id", "resistance_mechanism").distinct().count()


def test_months_are_kept_up_to_date(spark, quick, tmp_path):
    """A refreshed dataset is counted anew, the others stay as they were; what is read equals counting all tests."""
    path, ast = str(tmp_path / "months"), quick[0]
    two = ast.unionByName(ast.withColumn("dataset_id", F.lit("E")))
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    months.refresh(path, two, "D", "E")
    assert same(months.read(spark, path), months.counts(two))
    changed = two.where("dataset_id = 'D'").unionByName(two.where("dataset_id = 'E' AND result = 'R'").withColumn("test_date", F.add_months("test_date", 1)))
    months.refresh(path, changed.withColumn("result", F.when(F.col("dataset_id") != "E", F.col("result"))), "E")
    assert same(months.read(spark, path, "D"), months.counts(two.where("dataset_id = 'D'")))
    e = months.read(spark, path, "E").collect()
    assert {(str(r.month), r.tests, r.rated, r.r) for r in e} == {("2024-02-01", 4, 0, 0), ("2024-03-01", 1, 0, 0)}
    months.refresh(path, two.limit(0), "E", "new")
    assert months.read(spark, path, "E", "new").isEmpty() and months.read(spark, path).count() == 2
    assert rows(months.trend(months.read(spark, path)), "period") == rows(months.trend(months.counts(ast)), "period")
    plan = months.trend(months.read(spark, path, "D"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("FileScan") == 1


def test_alerts_come_once_and_survive_a_restart(spark, tmp_path):
    from antibiogram.streaming.alerts import once_alerts

    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def batch(*results):
        fixtures.tests(spark, [("s", "i", "E. coli", drug, r, "2024-01-01") for drug, rs in results for r in rs] + [("s", "i", None, "x", "R", None)]).coalesce(1).write.mode("append").parquet(src)
        q = once_alerts(spark.readStream.schema(fixtures.AST).parquet(src), above=50, min_tests=3).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted((r.antibiotic, r.tests, r.resistance_rate) for r in spark.read.schema("organism string, antibiotic string, tests long, resistance_rate double").parquet(out).collect())

    assert batch(("a", "RRS"), ("b", "RR")) == [("a", 3, 66.67)]
    assert batch(("a", "R"), ("b", "SS")) == [("a", 3, 66.67)]  # still above; b at its limit
    assert batch(("a", "SS"), ("b", "R")) == [("a", 3, 66.67), ("b", 5, 60.0)]
    assert batch(("a", "RR")) == [("a", 3, 66.67), ("a", 8, 62.5), ("b", 5, 60.0)]  # was at the limit meanwhile


def test_bucketed_tables_meet_without_a_shuffle(spark, sf_dir, tmp_path):
    from antibiogram.sources import adapter, mart

    samples, tests = adapter.samples(spark, sf_dir), adapter.tests(spark, sf_dir)
    own = F.col("dataset_id") == "DS1"
    try:
        mart.write("bucketed", str(tmp_path / "mart"), samples.where(~own), tests.where(~own), 4)
        mart.append("bucketed", str(tmp_path / "mart"), samples.where(own), tests.where(own))
        s, t = mart.read(spark, "bucketed")
        joined = rates.with_dims(t, s.hint("merge"), "region")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert t.exceptAll(tests).isEmpty() and s.exceptAll(samples).isEmpty() and t.count() == tests.count() and s.count() == samples.count()
        assert joined.where("region IS NULL").isEmpty()
    finally:
        mart.drop(spark, "bucketed")
    assert [mart.buckets_for(n, 8) for n in (0, 10, 8_000_000 * 8, 8_000_000 * 8 + 1, 10**10)] == [8, 8, 8, 16, 1256]


def test_upload_rules_read_each_sheet_once(spark, sf_dir):
    from antibiogram.plans import uploads

    found = validate.rules(list(validate.RULES), uploads.samples(spark, sf_dir), uploads.tests(spark, sf_dir))
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2  # the second has the faults alone


def test_duplicate_keys_with_gaps(spark):
    """Keys of several columns are compared column by column, missing ones included."""
    good = io.template(spark)
    a = spark.createDataFrame([("SAMPLE_001", i, "o", x, "R", "MIC", "CLSI", None, None, None, k) for k, (i, x) in enumerate([("p / q", "r"), ("p", "q / r"), (None, "z"), ("z", None), ("d", "d"), ("d", "d")])], good["ast_results"].schema)
    assert rows(validate.rule("v_a_dup", good["samples"], a), "row_no", "value") == [(4, "d / d")]


def test_half_trend_reads_the_tests_twice(spark, sf_dir):
    from antibiogram.sources import adapter

    ast = adapter.tests(spark, sf_dir)
    plan = score.half_trend(ast)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1  # the counts by day were a job of their own


def test_one_pass_for_all_dimensions(spark, quick):
    dims = ("organism", "antibiotic", "region", "district", "source_category")
    ast, samples = quick
    out = rates.report_rates_of(ast, samples, *dims)
    for d in dims:
        one = rates.report_rates(ast if d in ast.columns else rates.with_dims(ast, samples, d), d)
        assert rows(out.where(F.col("dimension") == d), "value", "total_tests", "resistant_count", "resistance_rate") == rows(one, d, "total_tests", "resistant_count", "resistance_rate")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("mode", ["reference", "intended"])
def test_names_matched_once_or_row_by_row(spark, sf_dir, mode):
    from antibiogram.functions import interpret as ip
    from antibiogram.sources import adapter

    ast = adapter.tests(spark, sf_dir).withColumn("organism", F.when(F.col("isolate_id") % 7 != 0, F.col("organism"))).withColumn("method", F.when(F.col("isolate_id") % 5 != 0, F.col("method")))
    by_name, by_row = ip.interpret(ast, mode), ip.interpret(ast, mode, few_names=3)
    assert by_name.columns == by_row.columns and by_name.exceptAll(by_row).isEmpty() and by_name.count() == by_row.count() == ast.count()


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_items_are_dealt_once_for_the_bucketed_tables(spark, sf_dir):
    """Into as many partitions as their number asks for, and not again for the window or the buckets."""
    from antibiogram.sources import adapter, mart

    raw = lambda: adapter.tests(spark, sf_dir, 9)
    plan = _executed(raw().repartition(9, *mart.KEYS))
    assert plan.count("Exchange hashpartitioning") == 2  # line items, orders
    assert plan.count("hashpartitioning(dataset_id") == 2 and "9), REPARTITION_BY_NUM" in plan
    assert raw().exceptAll(adapter.tests(spark, sf_dir)).isEmpty() and raw().count() == adapter.tests(spark, sf_dir).count()
    assert [mart.buckets_for(n, 12, mart.TASK_ROWS) for n in (0, 6_000_000, 36_000_000, 216_000_000)] == [12, 12, 72, 432]


def test_rows_do_not_meet_by_dataset(spark, tmp_path):
    """The registry is broadcast however large it is thought to be, and no task sorts its rows by dataset."""
    from antibiogram.sources import io

    name = "spark.sql.maxConcurrentOutputFileWriters"
    ast = spark.range(200).select(F.concat(F.lit("D"), (F.col("id") % 12).cast("string")).alias("dataset_id"), F.col("id").cast("string").alias("isolate_id"))
    registry = ast.where("dataset_id <> 'D3'").groupBy("dataset_id").agg(F.count("*").alias("rows_tests")).withColumn("dataset_name", F.col("dataset_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastHashJoin" in _executed(io.listed(ast, registry))
        with io.unsorted_writes(spark):
            assert spark.conf.get(name) == str(io.OPEN_FILES)
        assert spark.conf.get(name, None) in (None, "0")
        io.write_datasets(str(tmp_path), registry, ast, ast)  # more datasets than a task has files open
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    back = io.scan(spark, str(tmp_path), "ast_results").select("dataset_id", "isolate_id")
    assert back.exceptAll(ast.where("dataset_id <> 'D3'")).isEmpty() and back.count() == 200 - 17
    assert {r.rows_tests for r in io.scan(spark, str(tmp_path), "datasets").collect()} == {16, 17}


def test_merged_rows_meet_in_partitions_by_their_number(spark):
    rows = spark.range(50).select("id", (F.col("id") * 2).alias("x"))
    both = catalog.upsert(rows, rows.withColumn("x", F.lit(0).cast("long")).where("id < 20"), "id", parts=9)
    assert "9), REPARTITION_BY_NUM" in _executed(both) and both.agg(F.sum("x"), F.count("*")).first()[:] == (sum(2 * i for i in range(20, 50)), 50)


def test_distinct_drugs_multiply_no_rows(spark):
    ast = fixtures.tests(spark, [*fixtures.QUICK_TESTS, ("SAM_001", "ISO_002", "Zymomonas", "Ampicillin", "R", "2024-01-18"), ("SAM_001", "ISO_002", "Z", None, "R", None)])
    assert "Expand" not in _executed(detect.multi_resistance(ast))
    assert [tuple(r) for r in detect.multi_resistance(ast).select("isolate_id", "organism", "resistant_count", "total_tested").collect()] == [("ISO_002", "Zymomonas", 3, 3)]


def test_rows_of_a_store_stay_in_their_tasks(spark, tmp_path):
    """A dataset's rows are written by every task that has some; a deleted dataset is gone and the others are whole."""
    from antibiogram.sources import io

    ast = spark.range(0, 240, 1, 6).select(F.concat(F.lit("D"), (F.col("id") % 3).cast("string")).alias("dataset_id"), F.col("id").cast("string").alias("isolate_id"))
    registry = spark.createDataFrame([(f"D{k}", f"Dataset {k}") for k in range(3)], "dataset_id string, dataset_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        io.write_datasets(str(tmp_path), registry, ast, ast)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for table in ("samples", "ast_results"):
        assert [len(list(tmp_path.glob(f"{table}/dataset_id=D{k}/part-*"))) for k in range(3)] == [6, 6, 6]
    io.delete_dataset(spark, str(tmp_path), "D2")
    assert sorted(io.scan(spark, str(tmp_path), "ast_results").groupBy("dataset_id").count().collect()) == [("D0", 80), ("D1", 80)]


def test_queries_over_tables_in_more_buckets_than_shuffle_partitions(spark, sf_dir, tmp_path, monkeypatch):
    """A bucket holds the tests that a task should sort, whatever the tables' size, and the rows are the same."""
    from antibiogram.plans import registry
    from antibiogram.sources import mart

    names = ("agg_group_top5", "i_apply", "agg_heatmap", "agg_report_region", "gaps_abx_rates", "d_cores")
    want = {n: sorted(map(str, registry.queries()[n](spark, sf_dir).collect())) for n in names}
    monkeypatch.setattr(mart, "TASK_ROWS", 400, raising=False)
    again = tmp_path / "again"  # another path, of which nothing is stored
    again.symlink_to(sf_dir)
    t = registry.Tables(spark, str(again))
    n_tests = t.ast.count()
    files = t.ast.groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count")).first()
    assert files[0] > int(spark.conf.get("spark.sql.shuffle.partitions")) and n_tests > 800 and files[1] < 800
    assert {n: sorted(map(str, registry.queries()[n](spark, str(again)).collect())) for n in names} == want
