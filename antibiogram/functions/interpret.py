"""Breakpoint interpretation of MIC and disk-diffusion values, as column expressions.

``mode="reference"`` matches organisms as the reference does, where a pattern ``Genus spp.`` never matches; with
``mode="intended"`` it matches names that begin with the genus, and a NaN counts as missing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import has

# Fixed values, a row each: organism, antibiotic, guideline, method, bound of S, lowest and highest I (None: no such band),
# bound of R. The first organism and antibiotic that match are used.
BREAKPOINTS = (
    ("Enterobacteriaceae", "Amoxicillin", "CLSI", "MIC", 8, 16, 16, 32),
    ("Enterobacteriaceae", "Amoxicillin", "CLSI", "DD", 20, 14, 19, 13),
    ("Enterobacteriaceae", "Amoxicillin", "EUCAST", "MIC", 8, 16, 16, 32),
    ("Enterobacteriaceae", "Amoxicillin", "EUCAST", "DD", 20, 14, 19, 13),
    ("Enterobacteriaceae", "Ampicillin", "CLSI", "MIC", 8, None, None, 16),
    ("Enterobacteriaceae", "Ampicillin", "CLSI", "DD", 17, None, None, 16),
    ("Enterobacteriaceae", "Ampicillin", "EUCAST", "MIC", 8, None, None, 16),
    ("Enterobacteriaceae", "Ampicillin", "EUCAST", "DD", 17, None, None, 16),
    ("Enterobacteriaceae", "Ceftazidime", "CLSI", "MIC", 4, 8, 8, 16),
    ("Enterobacteriaceae", "Ceftazidime", "CLSI", "DD", 21, 18, 20, 17),
    ("Enterobacteriaceae", "Ceftazidime", "EUCAST", "MIC", 1, 2, 4, 8),
    ("Enterobacteriaceae", "Ceftazidime", "EUCAST", "DD", 23, 20, 22, 19),
    ("Enterobacteriaceae", "Cefotaxime", "CLSI", "MIC", 1, 2, 2, 4),
    ("Enterobacteriaceae", "Cefotaxime", "CLSI", "DD", 26, 23, 25, 22),
    ("Enterobacteriaceae", "Cefotaxime", "EUCAST", "MIC", 1, 2, 2, 4),
    ("Enterobacteriaceae", "Cefotaxime", "EUCAST", "DD", 23, 20, 22, 19),
    ("Enterobacteriaceae", "Ciprofloxacin", "CLSI", "MIC", 0.25, 0.5, 0.5, 1),
    ("Enterobacteriaceae", "Ciprofloxacin", "CLSI", "DD", 21, 16, 20, 15),
    ("Enterobacteriaceae", "Ciprofloxacin", "EUCAST", "MIC", 0.25, 0.5, 0.5, 1),
    ("Enterobacteriaceae", "Ciprofloxacin", "EUCAST", "DD", 21, 16, 20, 15),
    ("Enterobacteriaceae", "Gentamicin", "CLSI", "MIC", 4, 8, 8, 16),
    ("Enterobacteriaceae", "Gentamicin", "CLSI", "DD", 15, 13, 14, 12),
    ("Enterobacteriaceae", "Gentamicin", "EUCAST", "MIC", 2, 4, 4, 8),
    ("Enterobacteriaceae", "Gentamicin", "EUCAST", "DD", 16, 13, 15, 12),
    ("Enterobacteriaceae", "Tetracycline", "CLSI", "MIC", 4, 8, 8, 16),
    ("Enterobacteriaceae", "Tetracycline", "CLSI", "DD", 15, 12, 14, 11),
    ("Enterobacteriaceae", "Tetracycline", "EUCAST", "MIC", 1, 2, 2, 4),
    ("Enterobacteriaceae", "Tetracycline", "EUCAST", "DD", 16, 13, 15, 12),
    ("Staphylococcus aureus", "Methicillin", "CLSI", "MIC", 2, None, None, 4),
    ("Staphylococcus aureus", "Methicillin", "CLSI", "DD", 10, None, None, 9),
    ("Staphylococcus aureus", "Methicillin", "EUCAST", "MIC", 2, None, None, 4),
    ("Staphylococcus aureus", "Methicillin", "EUCAST", "DD", 10, None, None, 9),
    ("Staphylococcus aureus", "Ciprofloxacin", "CLSI", "MIC", 1, 2, 2, 4),
    ("Staphylococcus aureus", "Ciprofloxacin", "CLSI", "DD", 21, 16, 20, 15),
    ("Staphylococcus aureus", "Ciprofloxacin", "EUCAST", "MIC", 0.5, 1, 1, 2),
    ("Staphylococcus aureus", "Ciprofloxacin", "EUCAST", "DD", 22, 19, 21, 18),
    ("Staphylococcus aureus", "Gentamicin", "CLSI", "MIC", 4, 8, 8, 16),
    ("Staphylococcus aureus", "Gentamicin", "CLSI", "DD", 15, 13, 14, 12),
    ("Staphylococcus aureus", "Gentamicin", "EUCAST", "MIC", 1, 2, 2, 4),
    ("Staphylococcus aureus", "Gentamicin", "EUCAST", "DD", 16, 13, 15, 12),
    ("Enterococcus spp.", "Ampicillin", "CLSI", "MIC", 8, None, None, 16),
    ("Enterococcus spp.", "Ampicillin", "CLSI", "DD", 17, None, None, 16),
    ("Enterococcus spp.", "Ampicillin", "EUCAST", "MIC", 4, None, None, 8),
    ("Enterococcus spp.", "Ampicillin", "EUCAST", "DD", 17, None, None, 16),
    ("Enterococcus spp.", "Vancomycin", "CLSI", "MIC", 4, 8, 16, 32),
    ("Enterococcus spp.", "Vancomycin", "CLSI", "DD", 15, 10, 14, 9),
    ("Enterococcus spp.", "Vancomycin", "EUCAST", "MIC", 4, 8, 16, 32),
    ("Enterococcus spp.", "Vancomycin", "EUCAST", "DD", 15, 10, 14, 9),
    ("Pseudomonas aeruginosa", "Ceftazidime", "CLSI", "MIC", 8, 16, 16, 32),
    ("Pseudomonas aeruginosa", "Ceftazidime", "CLSI", "DD", 18, 15, 17, 14),
    ("Pseudomonas aeruginosa", "Ceftazidime", "EUCAST", "MIC", 8, 16, 16, 32),
    ("Pseudomonas aeruginosa", "Ceftazidime", "EUCAST", "DD", 18, 15, 17, 14),
    ("Pseudomonas aeruginosa", "Ciprofloxacin", "CLSI", "MIC", 0.5, 1, 1, 2),
    ("Pseudomonas aeruginosa", "Ciprofloxacin", "CLSI", "DD", 21, 16, 20, 15),
    ("Pseudomonas aeruginosa", "Ciprofloxacin", "EUCAST", "MIC", 0.5, 1, 1, 2),
    ("Pseudomonas aeruginosa", "Ciprofloxacin", "EUCAST", "DD", 21, 16, 20, 15),
    ("Pseudomonas aeruginosa", "Gentamicin", "CLSI", "MIC", 4, 8, 8, 16),
    ("Pseudomonas aeruginosa", "Gentamicin", "CLSI", "DD", 16, 13, 15, 12),
    ("Pseudomonas aeruginosa", "Gentamicin", "EUCAST", "MIC", 4, 8, 8, 16),
    ("Pseudomonas aeruginosa", "Gentamicin", "EUCAST", "DD", 16, 13, 15, 12),
    ("Acinetobacter spp.", "Ceftazidime", "CLSI", "MIC", 4, 8, 8, 16),
    ("Acinetobacter spp.", "Ceftazidime", "CLSI", "DD", 18, 15, 17, 14),
    ("Acinetobacter spp.", "Ceftazidime", "EUCAST", "MIC", 4, 8, 8, 16),
    ("Acinetobacter spp.", "Ceftazidime", "EUCAST", "DD", 18, 15, 17, 14),
    ("Acinetobacter spp.", "Ciprofloxacin", "CLSI", "MIC", 1, 2, 2, 4),
    ("Acinetobacter spp.", "Ciprofloxacin", "CLSI", "DD", 21, 16, 20, 15),
    ("Acinetobacter spp.", "Ciprofloxacin", "EUCAST", "MIC", 1, 2, 2, 4),
    ("Acinetobacter spp.", "Ciprofloxacin", "EUCAST", "DD", 21, 16, 20, 15),
)
# Genera of the family.
ENTEROBACTERIACEAE = ("escherichia", "klebsiella", "enterobacter", "salmonella", "shigella", "citrobacter", "serratia", "proteus", "providencia", "morganella", "yersinia", "erwinia")
# Fixed values, in order of evaluation: mechanism, organisms, antibiotics, confidence.
MECHANISMS = (
    ("ESBL", ("Escherichia coli", "Klebsiella pneumoniae", "Klebsiella spp.", "Enterobacter spp.", "Serratia spp.", "Citrobacter spp.", "Proteus spp.", "Salmonella spp."),
     ("Ceftazidime", "Cefotaxime", "Ceftriaxone", "Cefpodoxime", "Aztreonam"), "High"),
    ("Carbapenemase", ("Klebsiella pneumoniae", "Escherichia coli", "Enterobacter spp.", "Serratia spp.", "Citrobacter spp.", "Acinetobacter spp.", "Pseudomonas aeruginosa"),
     ("Imipenem", "Meropenem", "Ertapenem", "Doripenem"), "High"),
    ("MRSA", ("Staphylococcus aureus",), ("Methicillin", "Oxacillin"), "High"),
    ("VRE", ("Enterococcus faecalis", "Enterococcus faecium", "Enterococcus spp."), ("Vancomycin",), "High"),
    ("AmpC", ("Enterobacter spp.", "Citrobacter spp.", "Serratia spp.", "Morganella spp.", "Providencia spp.", "Pseudomonas aeruginosa", "Acinetobacter spp."),
     ("Ceftazidime", "Cefotaxime", "Ceftriaxone", "Cefpodoxime"), "Moderate"),
)
GUIDELINES = ("CLSI", "EUCAST")
LABELS = {"CLSI": "CLSI_2025", "EUCAST": "EUCAST_2025"}


def parse_bound(text: str | None) -> tuple[str, list[float]] | None:
    """``<=x``, ``>=x``, ``a-b`` or ``x`` as (operator, numbers); None where there is no bound."""
    if text is None or text.strip() in ("", "-"):
        return None
    m = re.fullmatch(r"\s*(<=|>=)?\s*([\d.]+)(?:\s*-\s*([\d.]+))?\s*", text)
    if not m:
        raise ValueError(f"not a breakpoint: {text!r}")
    op, a, b = m.groups()
    return ("range", [float(a), float(b)]) if b else (op or "=", [float(a)])


#: The organisms and antibiotics of the breakpoints, in their order.
PAIRS = tuple(dict.fromkeys(row[:2] for row in BREAKPOINTS))


def rules() -> list[dict]:
    """A row for each (rule, guideline, method): nth, organism, antibiotic, guideline, method, s, i_low, i_high, r."""
    names = ("organism", "antibiotic", "guideline", "method", "s", "i_low", "i_high", "r")
    return [{"nth": PAIRS.index(row[:2]), **dict(zip(names, row, strict=True))} for row in BREAKPOINTS]


def normal_organism(col: str) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.col(col), r"\s+", " ")))


def matches(col: str, pattern: str, mode: str) -> Column:
    """Whether a name matches a pattern: a family, a genus ("Genus spp.") or part of the name, whatever the case."""
    if pattern.endswith(" spp."):
        if mode == "reference":
            return F.lit(False)
        return F.coalesce(F.lower(F.col(col)).startswith(pattern.removesuffix(" spp.").lower()), F.lit(False))
    return has(col, *ENTEROBACTERIACEAE) if pattern == "Enterobacteriaceae" else has(col, pattern)


def _first(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


#: What a rule is looked up by, and how many different ones may be matched apart from the tests.
NAMES = ("organism", "antibiotic", "guideline", "method")
FEW_NAMES = 100_000


def _judged(ast: DataFrame, mode: str) -> DataFrame:
    """Rows with the rule, the bounds and the mechanism of their names."""
    df = ast.withColumn("_org", normal_organism("organism"))
    rule = _first([(matches("_org", o, mode) & has("antibiotic", a), F.lit(n)) for n, (o, a) in enumerate(PAIRS)])

    def any_of(col: str, names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | matches(col, n, mode)
        return out

    mechanism = _first([(any_of("_org", o) & has("antibiotic", *a), F.lit(name)) for name, o, a, _ in MECHANISMS])
    df = df.withColumns({"_guide": F.upper("guideline"), "_method": F.upper("method"), "_rule": rule, "_mechanism": mechanism})
    # The bounds are a fixed table of 68 rows. Joined, they also keep the matching from being repeated in later filters.
    listed = ", ".join(str(tuple("NULL" if r[k] is None else r[k] for k in ("nth", "guideline", "method", "s", "i_low", "i_high", "r"))).replace("'NULL'", "CAST(NULL AS DOUBLE)") for r in rules())
    bounds = df.sparkSession.sql(
        f"SELECT _rule, _guide, _method, CAST(s AS DOUBLE) AS _s, CAST(lo AS DOUBLE) AS _i_low, CAST(hi AS DOUBLE) AS _i_high, CAST(r AS DOUBLE) AS _r FROM VALUES {listed} AS b(_rule, _guide, _method, s, lo, hi, r)"
    )
    return df.join(F.broadcast(bounds), ["_rule", "_guide", "_method"], "left").drop("_org")


def _matched(ast: DataFrame, mode: str, few: int) -> DataFrame:
    """``_judged``, each name once: the tests' different names are few, so they are matched by themselves and joined to the tests by
    broadcast. A table with more than ``few`` of them, and a stream, is matched row by row."""
    if ast.isStreaming:
        return _judged(ast, mode)
    names = ast.select(*NAMES).distinct()
    found = names.limit(few + 1).collect()
    if len(found) > few:
        return _judged(ast, mode)
    judged = _judged(ast.sparkSession.createDataFrame(found, names.schema), mode)
    judged = judged.select(*[F.col(c).alias(f"_of_{c}") for c in NAMES], *[c for c in judged.columns if c not in NAMES])
    on = F.lit(True)
    for c in NAMES:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ast.join(F.broadcast(judged), on).drop(*[f"_of_{c}" for c in NAMES])


def interpret(ast: DataFrame, mode: str = "reference", few_names: int = FEW_NAMES) -> DataFrame:
    """``ast`` with interpreted_result, interpretation_guideline, interpretation_confidence, suspected_mechanism and
    interpretation_notes. A guideline other than CLSI and EUCAST gives Unknown, "Unsupported guideline"."""
    if mode not in ("reference", "intended"):
        raise ValueError(f"no mode {mode!r}")
    value = F.when(F.upper("method") == "MIC", F.col("mic_value")).when(F.upper("method") == "DD", F.col("zone_diameter"))
    if mode == "intended":
        value = F.when(~F.isnan(value), value)
    df = _matched(ast, mode, few_names).withColumn("_given", value)
    v, mic = F.when(~F.isnan("_given"), F.col("_given")), F.col("_method") == "MIC"
    between = v.between(F.col("_i_low"), F.col("_i_high"))
    result = (
        F.when(mic & (v >= F.col("_r")), "R").when(~mic & (v >= F.col("_s")), "S").when(between, "I").when(mic & (v <= F.col("_s")), "S").when(~mic & (v <= F.col("_r")), "R").otherwise("Unknown")
    )
    supported, found, given = F.col("_guide").isin(*GUIDELINES), F.col("_rule").isNotNull(), F.col("_given").isNotNull()
    df = df.withColumn("interpreted_result", F.when(supported & found & given, result).otherwise("Unknown"))
    df = df.withColumn("suspected_mechanism", F.when(F.col("interpreted_result") == "R", F.col("_mechanism")))
    moderate = [name for name, *_, confidence in MECHANISMS if confidence == "Moderate"]
    confidence = (
        F.when(~F.coalesce(supported, F.lit(False)), "Unsupported guideline")
        .when(~found, "No breakpoint available")
        .when(~given, "Invalid test method or missing value")
        .when(F.col("suspected_mechanism").isin(*moderate), "Moderate - confirmatory test recommended")
        .otherwise("High")
    )
    label = _first([(F.col("_guide") == g, F.lit(t)) for g, t in LABELS.items()])
    notes = (
        F.when(~found, F.concat_ws(" ", F.lit("No breakpoint found for"), "organism", F.lit("-"), "antibiotic"))
        .when(~given, F.concat(F.lit("Invalid method ("), F.coalesce("method", F.lit("")), F.lit(") or missing test value")))
        .otherwise(F.concat(F.lit("Based on "), F.col("_method"), F.lit(" value: "), F.col("_given").cast("string")))
    )
    df = df.withColumns({"interpretation_guideline": label, "interpretation_confidence": confidence, "interpretation_notes": notes})
    return df.drop("_guide", "_method", "_rule", "_mechanism", "_given", "_s", "_i_low", "_i_high", "_r")


def fill_results(ast: DataFrame, mode: str = "reference") -> DataFrame:
    """Interprets rows without a valid result: ``result`` takes S, I or R where one was found, and ``auto_interpreted`` tells."""
    lacking = ~F.coalesce(F.col("result").isin("S", "I", "R"), F.lit(False))
    df = interpret(ast, mode)
    filled = lacking & F.col("interpreted_result").isin("S", "I", "R")
    out = df.withColumn("auto_interpreted", filled).withColumn("result", F.when(filled, F.col("interpreted_result")).otherwise(F.col("result")))
    for c in ("interpreted_result", "interpretation_guideline", "interpretation_confidence", "suspected_mechanism", "interpretation_notes"):
        out = out.withColumn(c, F.when(lacking, F.col(c)))
    return out
