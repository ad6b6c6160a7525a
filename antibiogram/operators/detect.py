"""Resistance patterns of isolates: mechanisms, cross-resistance, multi-drug resistance, combinations, alerts.

Everything about an isolate comes from one aggregation by (dataset_id, isolate_id); its organism is that of its first row
by (test_date, antibiotic).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antibiogram.functions.exprs import has, n_of, percent

from .rates import known, sir_table

ISOLATE = ("dataset_id", "isolate_id")
# Genera and drugs of the screens.
ESBL = (("escherichia", "klebsiella", "enterobacter", "salmonella", "proteus", "citrobacter"), ("Ceftazidime", "Cefotaxime", "Ceftriaxone", "Cefpodoxime"))
AMPC = (("enterobacter", "citrobacter", "serratia", "pseudomonas", "acinetobacter"), ("Ceftazidime", "Cefotaxime", "Ceftriaxone", "Cefepime"))
CARBAPENEMS = ("Imipenem", "Meropenem", "Ertapenem", "Doripenem")
# Classes within which resistance tends to go together.
CROSS_CLASSES = {
    "Penicillins": ("Amoxicillin", "Ampicillin", "Penicillin", "Piperacillin"),
    "Cephalosporins_1st": ("Cefazolin", "Cephalexin"),
    "Cephalosporins_2nd": ("Cefuroxime", "Cefaclor"),
    "Cephalosporins_3rd": ("Ceftazidime", "Cefotaxime", "Ceftriaxone", "Cefpodoxime"),
    "Cephalosporins_4th": ("Cefepime",),
    "Carbapenems": ("Imipenem", "Meropenem", "Ertapenem"),
    "Aminoglycosides": ("Gentamicin", "Tobramycin", "Amikacin"),
    "Fluoroquinolones": ("Ciprofloxacin", "Levofloxacin", "Ofloxacin"),
    "Tetracyclines": ("Tetracycline", "Doxycycline"),
    "Macrolides": ("Erythromycin", "Clarithromycin", "Azithromycin"),
    "Sulphonamides": ("Sulfamethoxazole", "Trimethoprim"),
    "Glycopeptides": ("Vancomycin", "Teicoplanin"),
}
# Drug class of an antibiotic; what is not listed is "Other".
DRUG_CLASSES = {
    "Ampicillin": "Beta-lactams",
    "Cephalosporin": "Beta-lactams",
    "Ceftriaxone": "Beta-lactams",
    "Amoxicillin": "Beta-lactams",
    "Penicillin": "Beta-lactams",
    "Ciprofloxacin": "Quinolones",
    "Norfloxacin": "Quinolones",
    "Ofloxacin": "Quinolones",
    "Gentamicin": "Aminoglycosides",
    "Streptomycin": "Aminoglycosides",
    "Tetracycline": "Tetracyclines",
    "Doxycycline": "Tetracyclines",
    "Sulfamethoxazole": "Sulfonamides",
    "Chloramphenicol": "Phenicols",
    "Trimethoprim": "Folate antagonists",
    "Clindamycin": "Macrolides",
    "Erythromycin": "Macrolides",
    "Azithromycin": "Macrolides",
}
COLUMNS = ("organism", "resistance_mechanism", "confidence", "resistant_antibiotics", "total_tests")


def first_organism() -> Column:
    return F.min_by("organism", F.struct(F.col("test_date").isNull(), "test_date", "antibiotic"))


def first_known(col: str) -> Column:
    """The first value of a column that is there, in order of (test_date, antibiotic)."""
    return F.min_by(col, F.struct(F.col(col).isNull(), F.col("test_date").isNull(), "test_date", "antibiotic"))


def _screened(drugs: tuple[str, ...], resistant: bool = False) -> Column:
    """How many of the drugs the isolate was tested with (or resisted)."""
    hit = lambda d: has("antibiotic", d) & (F.coalesce(F.col("result") == "R", F.lit(False)) if resistant else F.lit(True))
    return sum((F.max(hit(d).cast("int")) for d in drugs), F.lit(0)).cast("long")


def isolate_flags(ast: DataFrame) -> DataFrame:
    """One row an isolate with what all mechanism screens need."""
    r, i = F.coalesce(F.col("result") == "R", F.lit(False)), F.coalesce(F.col("result") == "I", F.lit(False))
    return known(ast, "isolate_id").groupBy(*ISOLATE).agg(
        first_organism().alias("organism"),
        _screened(ESBL[1]).alias("esbl_tested"),
        _screened(ESBL[1], True).alias("esbl_r"),
        _screened(CARBAPENEMS).alias("carb_tested"),
        _screened(CARBAPENEMS, True).alias("carb_r"),
        _screened(AMPC[1]).alias("ampc_tested"),
        _screened(AMPC[1], True).alias("ampc_r"),
        F.bool_or(has("antibiotic", "oxacillin", "methicillin") & r).alias("mrsa_r"),
        F.bool_or(has("antibiotic", "vancomycin") & r).alias("vanco_r"),
        F.bool_or(has("antibiotic", "vancomycin") & i).alias("vanco_i"),
    )


def screens() -> dict[str, tuple[Column, Column, Column, Column, Column]]:
    """By screen, over ``isolate_flags``: whether it fires, mechanism, confidence, resistant drugs, tests."""
    one, aureus = F.lit(1).cast("long"), has("organism", "staphylococcus aureus")
    confident = lambda k: F.when(F.col(f"{k}_r") == F.col(f"{k}_tested"), "High").otherwise("Moderate")
    both = lambda k, genera: has("organism", *genera) & (F.col(f"{k}_tested") >= 2) & (F.col(f"{k}_r") >= 2)
    return {
        "esbl": (both("esbl", ESBL[0]), F.lit("ESBL"), confident("esbl"), F.col("esbl_r"), F.col("esbl_tested")),
        "carb": (F.col("carb_r") >= 1, F.lit("Carbapenemase"), F.lit("High"), F.col("carb_r"), F.col("carb_tested")),
        "mrsa": (aureus & F.col("mrsa_r"), F.lit("MRSA"), F.lit("High"), one, one),
        "ampc": (both("ampc", AMPC[0]), F.lit("AmpC"), confident("ampc"), F.col("ampc_r"), F.col("ampc_tested")),
        "vrsa": (aureus & (F.col("vanco_r") | F.col("vanco_i")), F.when(F.col("vanco_r"), "VRSA").otherwise("VISA"), F.lit("High"), one, one),
    }


def screen(ast: DataFrame, name: str) -> DataFrame:
    """Isolates that one screen (esbl, carb, mrsa, ampc, vrsa) finds."""
    fires, mechanism, confidence, resistant, tests = screens()[name]
    return isolate_flags(ast).where(fires).select(
        *ISOLATE, "organism", mechanism.alias("resistance_mechanism"), confidence.alias("confidence"), resistant.alias("resistant_antibiotics"), tests.alias("total_tests")
    )


def mechanisms(ast: DataFrame) -> DataFrame:
    """All findings, the interpreter's first, then the screens in order; one row an (isolate, mechanism), the first kept."""
    rows = [
        F.when(fires, F.struct(F.lit(k).alias("priority"), m.alias("resistance_mechanism"), c.alias("confidence"), r.alias("resistant_antibiotics"), t.alias("total_tests")))
        for k, (fires, m, c, r, t) in enumerate(screens().values(), 1)
    ]
    found = isolate_flags(ast).select(*ISOLATE, "organism", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).select(*ISOLATE, "organism", "f.*")
    if "suspected_mechanism" in ast.columns:
        own = known(ast, "isolate_id", "suspected_mechanism").groupBy(*ISOLATE, F.col("suspected_mechanism").alias("resistance_mechanism")).agg(
            first_organism().alias("organism"), F.lit(0).alias("priority"), F.min_by("interpretation_confidence", F.struct(F.col("test_date").isNull(), "test_date", "antibiotic")).alias("confidence"),
            n_of("R").alias("resistant_antibiotics"), F.count("*").alias("total_tests"),
        )
        found = found.unionByName(own)
    nth = F.row_number().over(Window.partitionBy(*ISOLATE, "resistance_mechanism").orderBy("priority"))
    return found.withColumn("_nth", nth).where(F.col("_nth") == 1).select(*ISOLATE, *COLUMNS)


def cross_resistance(ast: DataFrame) -> DataFrame:
    """Isolates with two or more tests and two or more R rows within a class; rows count, not distinct drugs."""
    classes = F.filter(F.array(*[F.when(has("antibiotic", *drugs), F.lit(name)) for name, drugs in CROSS_CLASSES.items()]), lambda c: c.isNotNull())
    rows = known(ast, "isolate_id").select(*ISOLATE, "organism", "result", "test_date", "antibiotic", F.explode(classes).alias("antibiotic_class"))
    out = rows.groupBy(*ISOLATE, "antibiotic_class").agg(first_organism().alias("organism"), n_of("R").alias("resistant_antibiotics"), F.count("*").alias("total_antibiotics"))
    level = F.when(F.col("resistant_antibiotics") == F.col("total_antibiotics"), "High").otherwise("Moderate")
    return out.where(F.col("resistant_antibiotics") >= 2).withColumn("cross_resistance_level", level)


def multi_resistance(ast: DataFrame, min_resistances: int = 3) -> DataFrame:
    """Isolates that resist at least so many distinct antibiotics. An isolate's tests meet by antibiotic first, so that no row is
    multiplied for the two distinct counts."""
    order = F.struct(F.col("test_date").isNull(), "test_date", "antibiotic", "organism")
    drugs = known(ast, "isolate_id").groupBy(*ISOLATE, "antibiotic").agg(F.min(order).alias("_first"), F.bool_or(F.col("result") == "R").alias("_r"))
    out = drugs.groupBy(*ISOLATE).agg(
        F.min("_first")["organism"].alias("organism"), F.count_if(F.col("_r") & F.col("antibiotic").isNotNull()).alias("resistant_count"), F.count("antibiotic").alias("total_tested")
    )
    r = F.col("resistant_count")
    return out.where(r >= min_resistances).withColumns(
        {"resistance_percentage": percent(r, F.col("total_tested"), 1), "resistance_level": F.when(r >= 3, "MDR").otherwise("Multi-drug resistant")}
    )


def drug_class(col: str = "antibiotic") -> Column:
    pairs = [F.lit(x) for kv in DRUG_CLASSES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.lit("Other"))


def mdr(ast: DataFrame, resistance_threshold: int = 3) -> DataFrame:
    """Isolates resistant in at least so many drug classes, most first."""
    rows = known(ast, "isolate_id").where(F.col("result") == "R").withColumn("_class", drug_class())
    out = rows.groupBy(*ISOLATE).agg(
        F.countDistinct("_class").alias("resistant_drug_classes"), first_known("organism").alias("organism"), first_known("sample_id").alias("sample_id")
    )
    return out.where(F.col("resistant_drug_classes") >= resistance_threshold).orderBy(F.desc("resistant_drug_classes"), *ISOLATE)


def co_resistance(ast: DataFrame, min_samples: int = 5) -> DataFrame:
    """How many isolates resist exactly this combination (sorted names, repeats kept), most first."""
    rows = known(ast, "isolate_id", "antibiotic").where(F.col("result") == "R")
    combos = rows.groupBy(*ISOLATE).agg(F.array_join(F.array_sort(F.collect_list("antibiotic")), ", ").alias("antibiotic_combination"))
    out = combos.groupBy("antibiotic_combination").agg(F.count("*").alias("count")).where(F.col("count") >= min_samples)
    return out.orderBy(F.desc("count"), "antibiotic_combination")


def alerts(ast: DataFrame, overall: float = 30, combo: float = 50, combo_tests: int = 10) -> DataFrame:
    """type, severity, value, what: overall R% above 30, any MDR isolate, the first combination above 50% with 10 tests."""
    n = F.count("*")
    first = ast.agg(percent(n_of("R"), n, 1).alias("value"), percent(n_of("R"), n).alias("raw")).where(F.col("raw") > overall).select(F.lit("overall").alias("type"), F.lit("HIGH").alias("severity"), "value", F.lit(None).cast("string").alias("what"))
    second = mdr(ast).agg(F.count("*").cast("double").alias("value")).where(F.col("value") > 0).select(F.lit("mdr").alias("type"), F.lit("HIGH").alias("severity"), "value", F.lit(None).cast("string").alias("what"))
    worst = sir_table(ast, "organism", "antibiotic").where((F.col("percent_resistant") > combo) & (F.col("total") >= combo_tests))
    third = worst.orderBy(F.desc("percent_resistant"), "organism", "antibiotic").limit(1).select(
        F.lit("combination").alias("type"), F.lit("MEDIUM").alias("severity"), F.col("percent_resistant").alias("value"), F.concat_ws(" / ", "organism", "antibiotic").alias("what")
    )
    return first.unionByName(second).unionByName(third)
