"""Keyword routing of questions to tables: the analytical part of an assistant, without any language model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antibiogram.functions.exprs import ladder, n_of, percent
from antibiogram.operators import rates, score
from antibiogram.operators.rates import known

#: Topics in order of priority, and the words that ask for them.
TOPICS = (
    ("summary", ("summary", "overall", "resistance rate", "general")),
    ("organism", ("organism", "pathogen", "bacteria", "species")),
    ("antibiotic", ("antibiotic", "drug", "treatment", "susceptible")),
    ("region", ("region", "geographic", "location", "hotspot")),
    ("trend", ("trend", "temporal", "time", "change", "pattern")),
    ("recommend", ("recommend", "suggest", "should", "action", "prevent")),
    ("explain", ("how", "why", "explain", "mechanism", "develop")),
    ("risk", ("risk", "danger", "threat", "concern", "critical")),
)


# Above which R% a status holds, its risk, and what is to be done; and those of a rate that is above none.
BANDS = (
    (75, "CRITICAL", "CRITICAL RISK", "Immediate intervention required"),
    (50, "HIGH", "HIGH RISK", "Urgent action needed"),
    (30, "MODERATE", "MODERATE RISK", "Active surveillance and intervention"),
)
LOWEST = ("CONTROLLED", "LOW RISK", "Continue current practices")


def topic(query: str) -> str:
    low = query.lower()
    return next((name for name, words in TOPICS if any(w in low for w in words)), "fallback")


def routed(questions: DataFrame, col: str = "question") -> DataFrame:
    """``questions`` with the topic of each, null counting as empty."""
    low, found = F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit("fallback")
    for name, words in reversed(TOPICS):
        found = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name).otherwise(found)
    return questions.withColumn("topic", found)


def assessment(ast: DataFrame, *by: str) -> DataFrame:
    """Tests and rates (1 digit) of all tests, or of each group, and the words for the rate: status, risk and what to do."""
    n = F.count("*")
    rate = lambda r: percent(n_of(r), n, 1)
    out = known(ast, *by).groupBy(*by).agg(
        n.alias("total_tests"), percent(n_of("R"), n).alias("_rate"), rate("R").alias("resistance_rate"), rate("S").alias("susceptible_rate"), rate("I").alias("intermediate_rate")
    )
    words = {k: ladder(F.coalesce("_rate", F.lit(0.0)), [(limit, row[i]) for limit, *row in BANDS], LOWEST[i]) for i, k in enumerate(("status", "risk", "action"))}
    return out.withColumns(words).drop("_rate")


def answer(query: str, ast: DataFrame, samples: DataFrame) -> DataFrame:
    """The table that answers a question."""
    found = topic(query)
    if found == "organism":
        return rates.most_frequent(ast, "organism")
    if found == "antibiotic":
        return rates.most_frequent(ast, "antibiotic")
    if found == "region":
        return rates.most_sampled(samples, "region")
    if found == "trend":
        return score.half_trend(ast)
    if found == "recommend":
        return score.recommendations(ast)
    return assessment(ast)
