"""Scores, trends, forecasts and indicators. Thresholds are those of the reference, which differ from operator to operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antibiogram.functions.exprs import ladder, n_of, percent

from .rates import KEYS, known, report_rates, sample_rates, top_per_group, with_dims

# What may be given instead of an antibiotic.
ALTERNATIVES = {
    "Fluoroquinolone": ("Cephalosporin", "Macrolide", "Beta-lactam"),
    "Azithromycin": ("Fluoroquinolone", "Cephalosporin", "Tetracycline"),
    "Tetracycline": ("Fluoroquinolone", "Macrolide", "Cephalosporin"),
    "Ampicillin": ("Cephalosporin", "Fluoroquinolone", "Macrolide"),
    "Cephalosporin": ("Fluoroquinolone", "Macrolide", "Carbapenems"),
    "Macrolide": ("Fluoroquinolone", "Cephalosporin", "Tetracycline"),
    "Trimethoprim-sulfamethoxazole": ("Fluoroquinolone", "Cephalosporin", "Macrolide"),
}
# What is said of an organism's rate, its tests and its antibiotics, and of the burden, above these percentages.
RATE_FACTORS = [(70, "Very high resistance rate (>70%)"), (50, "High resistance rate (>50%)"), (30, "Moderate resistance rate (>30%)")]
VOLUME_FACTOR = "Significant data volume (>100 tests)"
DIVERSITY_FACTOR = "High antibiotic diversity"
IMPACTS = [(50, "CRITICAL - Urgent intervention needed"), (30, "HIGH - Enhanced surveillance recommended"), (15, "MODERATE - Continued monitoring")]
LOW_IMPACT = "LOW - Maintain current practices"


#: Keys that a single task may put in order.
ORDERED_KEYS = 1_000_000
#: Into how many parts a day of more rows is split before any of its keys are put in order.
SPLITS = 256


def _with_before(counts: DataFrame, *order: str) -> DataFrame:
    """Counts with how many rows come before each in this order. One row a day, part or key, in one task."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))


def _middle_part(day: DataFrame, take: int, counted: list[Column], sums: list[int]) -> tuple[DataFrame, int]:
    """The part of a day in which its rank ``take`` lies, and the rank in it; the other parts are added to ``sums``.

    Parts begin at keys of the day drawn by hash, so they are the same however often they are computed. The driver gets
    at most SPLITS keys and as many counts."""
    drawn = day.groupBy(F.pmod(F.xxhash64("key"), F.lit(SPLITS))).agg(F.max_by("key", F.xxhash64("key", F.lit(1))).alias("key"))
    names = ("isolate_id", "antibiotic", "result")
    points = F.array(*[F.struct(*[F.lit(key[n]).cast("string").alias(n) for n in names]) for _, key in drawn.collect()])
    parted = day.withColumn("part", F.size(F.filter(points, lambda p: p < F.col("key"))))
    middle = None
    for part, n, r in sorted(map(tuple, parted.groupBy("part").agg(*counted).collect())):
        if middle is None and take < n:
            middle = part
            continue
        half = 0 if middle is None else 2
        sums[half] += n
        sums[half + 1] += r
        take -= n if middle is None else 0
    return (day.limit(0) if middle is None else parted.where(F.col("part") == middle)), take


def half_trend(ast: DataFrame, ordered_keys: int = ORDERED_KEYS) -> DataFrame:
    """Mean R% of the later half of dated tests against the earlier one, in order of (test_date, isolate_id, antibiotic, result).

    The halves meet at rank n div 2. A job counts days and finds the one that holds that rank; the frame returned reads that day
    alone, whose distinct keys with their counts are put in order. A day of more than ``ordered_keys`` rows is first narrowed
    to one of SPLITS parts, so no task orders a hot day."""
    rows = known(ast, "test_date").select("test_date", "result", F.struct("isolate_id", "antibiotic", "result").alias("key"))
    counted = [F.count("*").alias("n"), n_of("R").alias("r")]
    days = _with_before(rows.groupBy("test_date").agg(*counted), "test_date").withColumn("take", F.floor(F.sum("n").over(Window.partitionBy()) / 2))
    is_cut = (F.col("before") <= F.col("take")) & (F.col("before") + F.col("n") > F.col("take"))
    early, late = F.col("before") < F.col("take"), F.col("before") >= F.col("take")
    found = days.agg(
        F.max(F.when(is_cut, F.struct("test_date", F.col("n").alias("n"), (F.col("take") - F.col("before")).alias("take")))).alias("cut"),
        *[F.coalesce(F.sum(F.when(side & ~is_cut, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k, side in ((1, early), (2, late)) for c in ("n", "r")],
    ).first()  # one row, of counts by day
    sums, take, day = [found.n1, found.r1, found.n2, found.r2], 0, rows.limit(0)
    if found.cut is not None:
        take, day = found.cut.take, rows.where(F.col("test_date") == F.lit(found.cut.test_date))
        if found.cut.n > ordered_keys:
            day, take = _middle_part(day, take, counted, sums)
    keys = _with_before(day.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("key.result") == "R").alias("r")), "key")
    first = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(take) - F.col("before")))  # of a key's rows, which are alike
    first_r = F.when(F.col("r") > 0, first).otherwise(0)
    halves = keys.select(first.alias("n1"), first_r.alias("r1"), (F.col("n") - first).alias("n2"), (F.col("r") - first_r).alias("r2"))
    out = halves.agg(*[(F.coalesce(F.sum(c), F.lit(0)) + F.lit(s)).alias(c) for c, s in zip(("n1", "r1", "n2", "r2"), sums, strict=True)])
    change = percent(F.col("r2"), F.col("n2")) - percent(F.col("r1"), F.col("n1"))
    enough = F.col("n1") + F.col("n2") >= 2
    return out.select(
        F.when(~enough, "insufficient_data").when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable").alias("trend"),
        F.when(enough, F.round(percent(F.col("r1"), F.col("n1")), 2)).alias("first_half_rate"),
        F.when(enough, F.round(percent(F.col("r2"), F.col("n2")), 2)).alias("second_half_rate"),
        F.when(enough, F.round(change, 2)).alias("change"),
        F.when(enough, ladder(change, [(5, "HIGH"), (0, "MEDIUM")], "LOW")).alias("risk_level"),
    )


def emerging(ast: DataFrame, days: int = 90, above: float = 60, min_tests: int = 5, critical: float = 80) -> DataFrame:
    """organism x antibiotic of the last days with R% above the limit, highest first."""
    rows = known(ast, "test_date")
    last = rows.agg(F.max("test_date").alias("last"))  # one row
    recent = known(rows.join(F.broadcast(last)).where(F.col("test_date") >= F.date_sub("last", days)), "organism", "antibiotic")
    out = recent.groupBy("organism", "antibiotic").agg(F.count("result").alias("tests"), percent(n_of("R"), F.count("result")).alias("rate"))
    out = out.where((F.col("rate") > above) & (F.col("tests") >= min_tests))
    return out.select("organism", "antibiotic", F.round("rate", 2).alias("resistance_rate"), "tests", F.when(F.col("rate") > critical, "CRITICAL").otherwise("HIGH").alias("severity")).orderBy(
        F.desc("resistance_rate"), "organism", "antibiotic"
    )


def data_quality(samples: DataFrame, ast: DataFrame) -> DataFrame:
    """One row: how many samples have coordinates and tests dates, completeness, and the issues found."""
    s = samples.agg(F.count("*").alias("total_samples"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("samples_with_coordinates"))
    t = ast.agg(F.count("*").alias("total_tests"), F.count("test_date").alias("tests_with_dates"))
    low = F.when(percent(F.col("samples_with_coordinates"), F.col("total_samples")) < 50, "Low geographic data coverage")
    undated = F.when(percent(F.col("tests_with_dates"), F.col("total_tests")) < 80, "Missing test dates")
    return s.join(F.broadcast(t)).select(  # one row each
        "total_samples", "total_tests", "samples_with_coordinates", "tests_with_dates",
        percent(F.col("tests_with_dates"), F.greatest("total_tests", F.lit(1)), 2).alias("completeness_score"),
        F.array_join(F.array_compact(F.array(low, undated)), "; ").alias("data_quality_issues"),
    )


def organism_risk(ast: DataFrame) -> DataFrame:
    """Risk score and level of every organism, with the factors behind it."""
    out = known(ast, "organism").groupBy("organism").agg(percent(n_of("R"), F.count("*")).alias("rate"), F.count("*").alias("test_count"), F.countDistinct("antibiotic").alias("antibiotic_diversity"))
    rate, n, k = F.col("rate"), F.col("test_count"), F.col("antibiotic_diversity")
    points = ladder(rate, [(70, 40), (50, 30), (30, 20)], 0) + ladder(n, [(100, 20), (50, 15), (20, 10)], 0) + ladder(k, [(10, 40), (5, 25), (2, 15)], 0)
    factors = F.array(
        ladder(rate, RATE_FACTORS, None),
        F.when(n > 100, VOLUME_FACTOR),
        F.when(k > 10, DIVERSITY_FACTOR),
    )
    return out.select(
        "organism", F.least(points, F.lit(100)).cast("long").alias("risk_score"), ladder(points, [(70, "CRITICAL"), (50, "HIGH"), (30, "MODERATE")], "LOW", strict=False).alias("risk_level"),
        F.round(rate, 2).alias("resistance_rate"), "test_count", "antibiotic_diversity", F.array_join(F.array_compact(factors), "; ").alias("risk_factors"),
    )


def high_risk(ast: DataFrame, threshold: float = 50) -> DataFrame:
    return organism_risk(ast).where(F.col("resistance_rate") >= threshold).orderBy(F.desc("resistance_rate"), "organism")


def recommendations(ast: DataFrame, min_tests: int = 5) -> DataFrame:
    """Antibiotics by S%, with what is advised."""
    out = known(ast, "antibiotic").groupBy("antibiotic").agg(percent(n_of("S"), F.count("result")).alias("rate"), F.count("result").alias("tests")).where(F.col("tests") >= min_tests)
    steps = [(80, ("PREFERRED", 1)), (60, ("GOOD", 2)), (40, ("CAUTION", 3))]
    label = ladder(F.col("rate"), [(a, b[0]) for a, b in steps], "AVOID")
    rank = ladder(F.col("rate"), [(a, b[1]) for a, b in steps], 4)
    return out.select("antibiotic", F.round("rate", 2).alias("susceptibility_rate"), "tests", label.alias("recommendation"), rank.alias("priority")).orderBy(F.desc("susceptibility_rate"), "antibiotic")


def burden(samples: DataFrame, ast: DataFrame) -> DataFrame:
    """One row: resistant tests, tests, overall R%, R% by category (a map) and the impact; tests of no category count in the
    totals only."""
    by = with_dims(ast, samples, "source_category").groupBy("source_category").agg(n_of("R").alias("r"), F.count("*").alias("n"))
    entry = F.when(F.col("source_category").isNotNull(), F.struct("source_category", percent(F.col("r"), F.col("n"), 2)))
    rate = percent(F.sum("r"), F.sum("n"))
    return by.agg(F.sum("r").alias("total_resistant_tests"), F.sum("n").alias("total_tests"), rate.alias("overall_resistance_rate"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("resistance_by_category")).withColumn(
        "public_health_impact",
        ladder(F.col("overall_resistance_rate"), IMPACTS, LOW_IMPACT),
    )


def kpis(samples: DataFrame, ast: DataFrame, as_of: str) -> DataFrame:
    """One row of indicators as of a date: counts, diversity, tests of the last 30 days (no upper end), coverage."""
    recent = F.count_if(F.col("test_date") >= F.date_sub(F.lit(as_of).cast("date"), 30))
    t = ast.agg(F.count("*").alias("total_tests_performed"), F.countDistinct("organism").alias("organisms_identified"), F.countDistinct("antibiotic").alias("antibiotics_tested"), recent.alias("tests_last_30_days"))
    return kpis_of(samples, t)


def kpis_of(samples: DataFrame, activity: DataFrame) -> DataFrame:
    """``kpis`` from the row that tells of the tests."""
    s = samples.agg(F.count("*").alias("total_samples_collected"), F.count("latitude").alias("_with_latitude"))
    n = F.greatest("total_samples_collected", F.lit(1))
    return s.join(F.broadcast(activity)).select(  # one row each
        "total_samples_collected", "total_tests_performed", F.round(F.col("total_tests_performed") / n, 2).alias("tests_per_sample"), "organisms_identified", "antibiotics_tested", "tests_last_30_days",
        F.when(F.col("tests_last_30_days") > 0, "active").otherwise("inactive").alias("testing_trend"), percent(F.col("_with_latitude"), n).alias("geographic_coverage"),
    )


def insights(ast: DataFrame) -> DataFrame:
    """One row: risk, assessment, the most resistant organism and antibiotic, and what follows from them."""
    rate = percent(n_of("R"), F.count("*"))
    one = ast.agg(rate.alias("resistance_rate"), percent(n_of("S"), F.count("*")).alias("susceptibility_rate"))
    top = lambda dim: report_rates(ast, dim, digits=2, whole="*").limit(1).select(F.col(dim).alias(f"top_{dim}"), F.col("resistance_rate").alias(f"top_{dim}_rate"))
    out = one.join(F.broadcast(top("organism"))).join(F.broadcast(top("antibiotic")))  # one row each
    r = F.col("resistance_rate")
    return out.select(
        F.round("resistance_rate", 2).alias("resistance_rate"), ladder(r, [(40, "HIGH"), (20, "MODERATE")], "LOW").alias("risk"), ladder(r, [(30, "CRITICAL"), (15, "ELEVATED")], "ACCEPTABLE").alias("assessment"),
        "top_organism", "top_organism_rate", "top_antibiotic", "top_antibiotic_rate", (F.col("top_organism_rate") > 50).alias("act_on_organism"), (F.col("top_antibiotic_rate") > 40).alias("restrict_antibiotic"),
        (r > F.col("susceptibility_rate")).alias("more_resistant_than_susceptible"), (F.col("top_organism_rate") > 60).alias("organism_of_concern"),
    )


def point_map(samples: DataFrame, ast: DataFrame) -> DataFrame:
    """Located samples with their R% (0 without tests) and dimensions."""
    rows = samples.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).join(sample_rates(ast), list(KEYS), "left")
    return rows.select(
        *KEYS, "latitude", "longitude", "region", "district", "source_category", "source_type", F.coalesce("resistant_count", F.lit(0)).alias("resistant_count"), F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("resistance_rate", F.lit(0.0)).alias("resistance_rate"),
    )


def resistance_map(samples: DataFrame, ast: DataFrame) -> DataFrame:
    """``point_map`` with a colour (red above 50, orange above 30, green) and a radius (half the tests, 5 to 20)."""
    return point_map(samples, ast).withColumns(
        {"color": ladder(F.col("resistance_rate"), [(50, "red"), (30, "orange")], "green"), "radius": F.greatest(F.lit(5.0), F.least(F.lit(20.0), F.col("total_count") / 2))}
    )


def alternatives(ast: DataFrame, organisms: int = 15, antibiotics: int = 3, keep: int = 3) -> DataFrame:
    """For the first high-risk organisms: their most resisted antibiotics and the first alternatives in alphabetical order."""
    names = high_risk(ast).limit(organisms).select("organism", F.col("resistance_rate").alias("organism_rate"), "risk_level")
    top = top_per_group(report_rates(ast, "organism", "antibiotic", digits=9, whole="*"), "organism", "antibiotic", antibiotics)
    pairs = [x for k, v in ALTERNATIVES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    instead = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("antibiotic")), F.array(F.lit("Consult specialist")))
    rows = top.withColumn("_instead", instead).join(F.broadcast(names), "organism")
    return rows.groupBy("organism", "risk_level", "organism_rate").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "antibiotic"))), lambda x: x["antibiotic"]), ", ").alias("at_risk"),
        F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_instead")))), 1, keep), ", ").alias("alternatives"),
    )
