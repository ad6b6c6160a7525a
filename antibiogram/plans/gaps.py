"""Queries over tables with gaps: dimensions, results, dates, drugs and isolates that are not known.

The generated tables have none of these, so gaps are made by rule. An antibiotic and an organism are left without any
result. Each query's SQL is written out here, with what a missing value means for it, and shares nothing with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antibiogram.operators import compare, detect, filters, months, profiles, rates, score


def _unless(gap: Column, col: str) -> Column:
    return F.when(~gap, F.col(col)).alias(col)


def tables(samples: DataFrame, ast: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.col("sample_id").cast("long")
    m = n + F.length("antibiotic")
    of_samples = {"region": n % 7 == 3, "source_category": n % 11 == 5, "source_type": n % 9 == 2, "district": n % 8 == 1, "longitude": n % 6 == 2}
    no_result = (m % 5 == 0) | (F.col("antibiotic") == "Vancomycin") | (F.col("organism") == "Enterococcus faecalis")
    of_tests = {"result": no_result, "organism": m % 13 == 4, "test_date": m % 6 == 1, "isolate_id": n % 17 == 2, "antibiotic": m % 19 == 7}
    holed = lambda df, gaps: df.select(*[_unless(gaps[c], c) if c in gaps else c for c in df.columns])
    return holed(samples, of_samples), holed(ast, of_tests)


SQL = """
, gs AS (SELECT * REPLACE (
    CASE WHEN CAST(sample_id AS BIGINT) % 7 <> 3 THEN region END AS region, CASE WHEN CAST(sample_id AS BIGINT) % 11 <> 5 THEN source_category END AS source_category,
    CASE WHEN CAST(sample_id AS BIGINT) % 9 <> 2 THEN source_type END AS source_type, CASE WHEN CAST(sample_id AS BIGINT) % 8 <> 1 THEN district END AS district,
    CASE WHEN CAST(sample_id AS BIGINT) % 6 <> 2 THEN longitude END AS longitude) FROM samples),
ga AS (SELECT * EXCLUDE (m) REPLACE (
    CASE WHEN m % 5 <> 0 AND antibiotic <> 'Vancomycin' AND organism <> 'Enterococcus faecalis' THEN result END AS result, CASE WHEN m % 13 <> 4 THEN organism END AS organism,
    CASE WHEN m % 6 <> 1 THEN test_date END AS test_date, CASE WHEN CAST(sample_id AS BIGINT) % 17 <> 2 THEN isolate_id END AS isolate_id, CASE WHEN m % 19 <> 7 THEN antibiotic END AS antibiotic)
  FROM (SELECT *, CAST(sample_id AS BIGINT) + length(antibiotic) AS m FROM ast)),
gj AS (SELECT ga.*, region, district, source_category, source_type FROM ga LEFT JOIN gs ON ga.dataset_id = gs.dataset_id AND ga.sample_id = gs.sample_id)
"""
R, I, S = (f"count(*) FILTER (WHERE result = '{x}')" for x in "RIS")
SIR = "count(*) FILTER (WHERE result IN ('S', 'I', 'R'))"
RATE = f"100.0E0 * {R} / count(*)"  # of all rows
RATED = f"100.0E0 * {R} / nullif(count(result), 0)"  # of the rows with a result
MDR_CLASS = """CASE WHEN antibiotic IN ('Ampicillin', 'Cephalosporin', 'Ceftriaxone', 'Amoxicillin', 'Penicillin') THEN 'Beta-lactams'
  WHEN antibiotic IN ('Ciprofloxacin', 'Norfloxacin', 'Ofloxacin') THEN 'Quinolones' WHEN antibiotic IN ('Gentamicin', 'Streptomycin') THEN 'Aminoglycosides'
  WHEN antibiotic IN ('Tetracycline', 'Doxycycline') THEN 'Tetracyclines' WHEN antibiotic = 'Sulfamethoxazole' THEN 'Sulfonamides' WHEN antibiotic = 'Chloramphenicol' THEN 'Phenicols'
  WHEN antibiotic = 'Trimethoprim' THEN 'Folate antagonists' WHEN antibiotic IN ('Clindamycin', 'Erythromycin', 'Azithromycin') THEN 'Macrolides' ELSE 'Other' END"""
MDR = f"""SELECT dataset_id, isolate_id, count(DISTINCT {MDR_CLASS}) AS resistant_drug_classes, max(organism) AS organism, max(sample_id) AS sample_id
  FROM ga WHERE result = 'R' AND isolate_id IS NOT NULL GROUP BY dataset_id, isolate_id HAVING count(DISTINCT {MDR_CLASS}) >= 3"""
PAIRS = f"""SELECT organism, antibiotic, {S} AS susceptible, {I} AS intermediate, {R} AS resistant, {SIR} AS total, round(100.0E0 * {S} / {SIR}, 2) AS percent_susceptible,
  round(100.0E0 * {I} / {SIR}, 2) AS percent_intermediate, round(100.0E0 * {R} / {SIR}, 2) AS percent_resistant
  FROM ga WHERE organism IS NOT NULL AND antibiotic IS NOT NULL AND result IS NOT NULL GROUP BY organism, antibiotic"""
P1, P2 = ("1994-01-01", "1995-06-30"), ("1995-06-30", "1996-12-31")


def _shares(dim: str, source: str) -> str:
    return f"SELECT {dim}, count(*) AS total, 100.0E0 * {R} / count(*) AS R, 100.0E0 * {I} / count(*) AS I, 100.0E0 * {S} / count(*) AS S FROM {source} WHERE {dim} IS NOT NULL AND result IS NOT NULL GROUP BY {dim}"


def _reported(dim: str) -> str:
    return f"SELECT {dim}, count(result) AS total_tests, {R} AS resistant_count, round({RATED}, 1) AS resistance_rate FROM gj WHERE {dim} IS NOT NULL GROUP BY {dim}"


def _by_rows(dims: str, where: str, digits: int = 1) -> str:
    return f"SELECT {dims}, count(*) AS total_tests, {R} AS resistant_count, round({RATE}, {digits}) AS resistance_rate FROM gj WHERE {where} GROUP BY {dims}"


def _by(s: DataFrame, a: DataFrame, *dims: str) -> DataFrame:
    return rates.with_dims(a, s, *dims)


def _burden(s: DataFrame, a: DataFrame) -> DataFrame:
    return score.burden(s, a).select("total_resistant_tests", "total_tests", "overall_resistance_rate", F.explode("resistance_by_category").alias("source_category", "category_rate"))


def _heatmap(s: DataFrame, a: DataFrame) -> DataFrame:
    h = rates.heatmap(a)
    return h.unpivot("organism", [c for c in h.columns if c != "organism"], "antibiotic", "percent_resistant")


def _options(s: DataFrame, a: DataFrame) -> DataFrame:
    found = [filters.options(df, c).select(F.lit(c).alias("filter"), "value") for df, c in ((s, "region"), (s, "source_type"), (a, "organism"), (a, "antibiotic"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


QUERIES: dict[str, tuple[Callable[[DataFrame, DataFrame], DataFrame], str]] = {
    "gaps_stats": (
        lambda s, a: rates.stats(a),
        f"SELECT count(*) AS total_tests, {R} AS resistant_count, {I} AS intermediate_count, {S} AS susceptible_count, {RATE} AS resistance_rate, 100.0E0 * {I} / count(*) AS intermediate_rate, 100.0E0 * {S} / count(*) AS susceptibility_rate FROM ga",
    ),
    "gaps_org_abx": (lambda s, a: rates.sir_table(a, "organism", "antibiotic"), PAIRS),
    "gaps_abx_rates": (
        lambda s, a: rates.antibiotic_rates(a),
        "SELECT antibiotic, CAST(sum(resistant) AS BIGINT) AS resistant, CAST(sum(total) AS BIGINT) AS total, round(100.0E0 * sum(resistant) / sum(total), 2) AS resistance_rate FROM (" + PAIRS + ") GROUP BY antibiotic",
    ),
    "gaps_category": (lambda s, a: rates.shares(_by(s, a, "source_category"), "source_category"), _shares("source_category", "gj")),
    "gaps_trend_month": (lambda s, a: months.trend(months.counts(a)), _shares("period", "(SELECT *, strftime(test_date, '%Y-%m') AS period FROM ga)")),
    "gaps_region": (
        lambda s, a: rates.place_table(_by(s, a, "region"), "region"),
        f"SELECT region, count(*) AS total, {S} AS susceptible, {I} AS intermediate, {R} AS resistant, round({RATE}, 2) AS percent_resistant FROM gj WHERE region IS NOT NULL AND result IS NOT NULL GROUP BY region",
    ),
    "gaps_distribution": (
        lambda s, a: rates.distribution(a).select("result", "count", "percentage"),
        "SELECT result, count(*) AS count, round(100.0E0 * count(*) / sum(count(*)) OVER (), 1) AS percentage FROM ga WHERE result IS NOT NULL GROUP BY result",
    ),
    "gaps_heatmap": (
        _heatmap,
        f""", p AS ({PAIRS}) SELECT o.organism, x.antibiotic, coalesce(percent_resistant, 0.0E0) AS percent_resistant FROM (SELECT DISTINCT organism FROM p ORDER BY organism LIMIT 8) o
            CROSS JOIN (SELECT DISTINCT antibiotic FROM p ORDER BY antibiotic LIMIT 10) x LEFT JOIN p ON p.organism = o.organism AND p.antibiotic = x.antibiotic""",
    ),
    "gaps_cmp_abx": (
        lambda s, a: rates.comparison(a, "antibiotic"),
        f"SELECT antibiotic, {R} AS R, {I} AS I, {S} AS S, count(*) AS total, round({RATE}, 2) AS resistance_rate, round(100.0E0 * {S} / count(*), 2) AS susceptibility_rate FROM ga WHERE antibiotic IS NOT NULL AND result IS NOT NULL GROUP BY antibiotic",
    ),
    "gaps_db_counts": (lambda s, a: rates.result_counts(a), "SELECT organism, antibiotic, result, count(*) AS count FROM ga GROUP BY ALL"),
    "gaps_report_antibiotic": (lambda s, a: rates.report_rates(a, "antibiotic"), _reported("antibiotic")),
    "gaps_report_district": (lambda s, a: rates.report_rates(_by(s, a, "district"), "district"), _reported("district")),
    "gaps_group_top5": (
        lambda s, a: compare.compare_top(a, "region", "organism", s),
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY resistance_rate DESC, organism) AS rank FROM (" + _by_rows("region, organism", "region IS NOT NULL AND organism IS NOT NULL") + ")) WHERE rank <= 5",
    ),
    "gaps_season": (
        lambda s, a: months.seasons(months.counts(a)).select("dry_tests", "wet_tests", "dry_rate"),
        "SELECT count(*) FILTER (WHERE d) AS dry_tests, count(*) FILTER (WHERE NOT d) AS wet_tests, 100.0E0 * count(*) FILTER (WHERE d AND result = 'R') / count(*) FILTER (WHERE d) AS dry_rate FROM (SELECT *, month(test_date) IN (11, 12, 1, 2, 3) AS d FROM ga WHERE test_date IS NOT NULL)",
    ),
    "gaps_topn_organism": (
        lambda s, a: rates.most_frequent(a, "organism").select("organism", "count", "resistance_rate"),
        f"SELECT organism, count(*) AS count, round({RATE}, 1) AS resistance_rate FROM ga WHERE organism IS NOT NULL GROUP BY organism ORDER BY count DESC, organism LIMIT 5",
    ),
    "gaps_topn_region": (lambda s, a: rates.most_sampled(s), "SELECT region, count(*) AS count FROM gs WHERE region IS NOT NULL GROUP BY region ORDER BY count DESC, region LIMIT 5"),
    "gaps_options": (_options, " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS filter, {c} AS value FROM {t} WHERE {c} IS NOT NULL" for t, c in (("gs", "region"), ("gs", "source_type"), ("ga", "organism"), ("ga", "antibiotic")))),
    "gaps_overview": (
        lambda s, a: filters.overview(a, s, categories=("HUMAN", "FOOD"), regions=("ASIA", "EUROPE"))[1].groupBy("dataset_id").agg(F.count("*").alias("tests")),
        "SELECT dataset_id, count(*) AS tests FROM gj WHERE source_category IN ('HUMAN', 'FOOD') AND region IN ('ASIA', 'EUROPE') GROUP BY dataset_id",
    ),
    "gaps_full_topk": (
        lambda s, a: compare.category_antibiotics(a, s, "HUMAN", "ANIMAL"),
        f""", best AS (SELECT *, row_number() OVER (PARTITION BY source_category ORDER BY resistance_rate DESC, antibiotic) AS rank FROM (SELECT source_category, antibiotic, round({RATE}, 2) AS resistance_rate
              FROM gj WHERE source_category IN ('HUMAN', 'ANIMAL') AND organism IS NOT NULL AND antibiotic IS NOT NULL AND result IS NOT NULL GROUP BY source_category, antibiotic))
            SELECT coalesce(x.antibiotic, y.antibiotic) AS antibiotic, coalesce(x.resistance_rate, 0.0E0) AS rate_a, coalesce(y.resistance_rate, 0.0E0) AS rate_b FROM (SELECT * FROM best WHERE source_category = 'HUMAN') x
            FULL JOIN (SELECT * FROM best WHERE source_category = 'ANIMAL') y ON x.antibiotic = y.antibiotic WHERE x.rank <= 10 OR y.rank <= 10""",
    ),
    "gaps_inner_keys": (
        lambda s, a: compare.period_organisms(a, P1, P2),
        "SELECT x.organism, x.resistance_rate AS rate_1, y.resistance_rate AS rate_2, round(y.resistance_rate - x.resistance_rate, 1) AS change FROM "
        + " JOIN ".join("(" + _by_rows("organism", f"organism IS NOT NULL AND test_date BETWEEN DATE '{p[0]}' AND DATE '{p[1]}'") + f") {n}" for n, p in (("x", P1), ("y", P2)))
        + " ON x.organism = y.organism",
    ),
    "gaps_c_region": (
        lambda s, a: compare.compare_by(a, "region", None, s).select("item", "resistance_rate", "total"),
        "SELECT region AS item, resistance_rate, total_tests AS total FROM (" + _by_rows("region", "region IS NOT NULL") + ")",
    ),
    "gaps_multi": (
        lambda s, a: profiles.Profiles(a).multi_resistance().drop("organism"),
        "SELECT dataset_id, isolate_id, r AS resistant_count, n AS total_tested, round(100.0E0 * r / n, 1) AS resistance_percentage, 'MDR' AS resistance_level FROM (SELECT dataset_id, isolate_id, count(DISTINCT antibiotic) FILTER (WHERE result = 'R') AS r, count(DISTINCT antibiotic) AS n FROM ga WHERE isolate_id IS NOT NULL GROUP BY ALL) WHERE r >= 3",
    ),
    "gaps_mdr": (lambda s, a: detect.mdr(a), MDR),
    "gaps_cross": (
        lambda s, a: detect.cross_resistance(a).where("antibiotic_class = 'Tetracyclines'").drop("organism"),
        f"SELECT dataset_id, isolate_id, 'Tetracyclines' AS antibiotic_class, {R} AS resistant_antibiotics, count(*) AS total_antibiotics, CASE WHEN {R} = count(*) THEN 'High' ELSE 'Moderate' END AS cross_resistance_level FROM ga WHERE antibiotic IN ('Tetracycline', 'Doxycycline') AND isolate_id IS NOT NULL GROUP BY ALL HAVING {R} >= 2",
    ),
    "gaps_cores": (
        lambda s, a: detect.co_resistance(a, 2),
        "SELECT antibiotic_combination, count(*) AS count FROM (SELECT string_agg(antibiotic, ', ' ORDER BY antibiotic) AS antibiotic_combination FROM ga WHERE result = 'R' AND isolate_id IS NOT NULL AND antibiotic IS NOT NULL GROUP BY dataset_id, isolate_id) GROUP BY ALL HAVING count(*) >= 2",
    ),
    "gaps_alerts": (
        lambda s, a: detect.alerts(a, overall=5),
        f"""SELECT 'overall' AS type, 'HIGH' AS severity, round({RATE}, 1) AS value, NULL AS what FROM ga HAVING {RATE} > 5 UNION ALL SELECT 'mdr', 'HIGH', CAST(count(*) AS DOUBLE), NULL FROM ({MDR}) HAVING count(*) > 0
            UNION ALL SELECT * FROM (SELECT 'combination', 'MEDIUM', percent_resistant, organism || ' / ' || antibiotic FROM ({PAIRS}) WHERE percent_resistant > 50 AND total >= 10 ORDER BY percent_resistant DESC, organism, antibiotic LIMIT 1)""",
    ),
    "gaps_trend": (
        lambda s, a: score.half_trend(a).select("first_half_rate", "second_half_rate"),
        """SELECT round(100.0E0 * count(*) FILTER (WHERE rn <= half AND result = 'R') / count(*) FILTER (WHERE rn <= half), 2) AS first_half_rate, round(100.0E0 * count(*) FILTER (WHERE rn > half AND result = 'R') / count(*) FILTER (WHERE rn > half), 2) AS second_half_rate
            FROM (SELECT *, row_number() OVER (ORDER BY test_date, isolate_id NULLS FIRST, antibiotic NULLS FIRST, result NULLS FIRST) AS rn, count(*) OVER () // 2 AS half FROM ga WHERE test_date IS NOT NULL)""",
    ),
    "gaps_emerging": (
        lambda s, a: score.emerging(a, days=1000, above=30, min_tests=2).drop("severity"),
        f"SELECT organism, antibiotic, round({RATED}, 2) AS resistance_rate, count(result) AS tests FROM ga WHERE test_date >= (SELECT max(test_date) FROM ga) - 1000 AND organism IS NOT NULL AND antibiotic IS NOT NULL GROUP BY organism, antibiotic HAVING {RATED} > 30 AND count(result) >= 2",
    ),
    "gaps_quality": (
        lambda s, a: score.data_quality(s, a).select("samples_with_coordinates", "tests_with_dates", "completeness_score"),
        "SELECT (SELECT count(*) FROM gs WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS samples_with_coordinates, count(test_date) AS tests_with_dates, round(100.0E0 * count(test_date) / count(*), 2) AS completeness_score FROM ga",
    ),
    "gaps_risk": (
        lambda s, a: score.organism_risk(a).select("organism", "resistance_rate", "test_count", "antibiotic_diversity"),
        f"SELECT organism, round({RATE}, 2) AS resistance_rate, count(*) AS test_count, count(DISTINCT antibiotic) AS antibiotic_diversity FROM ga WHERE organism IS NOT NULL GROUP BY organism",
    ),
    "gaps_recommend": (
        lambda s, a: score.recommendations(a).select("antibiotic", "susceptibility_rate", "tests"),
        f"SELECT antibiotic, round(100.0E0 * {S} / count(*), 2) AS susceptibility_rate, count(*) AS tests FROM ga WHERE antibiotic IS NOT NULL AND result IS NOT NULL GROUP BY antibiotic HAVING count(*) >= 5",
    ),
    "gaps_burden": (
        _burden,
        f"SELECT (SELECT {R} FROM ga) AS total_resistant_tests, (SELECT count(*) FROM ga) AS total_tests, (SELECT {RATE} FROM ga) AS overall_resistance_rate, source_category, round({RATE}, 2) AS category_rate FROM gj WHERE source_category IS NOT NULL GROUP BY source_category",
    ),
    "gaps_insights": (
        lambda s, a: score.insights(a).select("resistance_rate", "top_organism", "top_organism_rate", "top_antibiotic", "top_antibiotic_rate"),
        "SELECT (SELECT round(" + RATE + ", 2) FROM ga) AS resistance_rate, x.organism AS top_organism, x.resistance_rate AS top_organism_rate, y.antibiotic AS top_antibiotic, y.resistance_rate AS top_antibiotic_rate FROM "
        + ", ".join(f"(SELECT * FROM ({_by_rows(d, f'{d} IS NOT NULL', 2)}) ORDER BY resistance_rate DESC, {d} LIMIT 1) {n}" for d, n in (("organism", "x"), ("antibiotic", "y"))),
    ),
    "gaps_map": (
        lambda s, a: score.resistance_map(s, a).select("dataset_id", "sample_id", "resistant_count", "total_count", "resistance_rate", "radius"),
        f"""SELECT gs.dataset_id, gs.sample_id, coalesce(r, 0) AS resistant_count, coalesce(n, 0) AS total_count, coalesce(100.0E0 * r / n, 0.0E0) AS resistance_rate, greatest(5.0E0, least(20.0E0, coalesce(n, 0) / 2)) AS radius
            FROM gs LEFT JOIN (SELECT dataset_id, sample_id, {R} AS r, count(*) AS n FROM ga GROUP BY ALL) x ON gs.dataset_id = x.dataset_id AND gs.sample_id = x.sample_id WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
    ),
}
