"""A report: named tables over one filtered set of tests, and their first rows as markdown or HTML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antibiogram.operators import detect, months, rates, score

#: Sections of rates by one dimension.
DIMENSIONS = {
    "Organisms": "organism", "Antibiotics": "antibiotic", "Regions": "region", "Districts": "district", "Source categories": "source_category",
    "Site types": "site_type", "Source types": "source_type",
}


def sections(ast: DataFrame, samples: DataFrame, by_dimension: DataFrame | None = None) -> dict[str, DataFrame]:
    """``by_dimension``: ``report_rates_of`` the seven dimensions, if it is at hand; all seven come from its one pass."""
    found = rates.report_rates_of(ast, samples, *DIMENSIONS.values()) if by_dimension is None else by_dimension
    by_month = months.counts(ast)
    by = lambda d: found.where(F.col("dimension") == d).select(F.col("value").alias(d), "total_tests", "resistant_count", "resistance_rate").orderBy(F.desc("resistance_rate"), d)
    return {
        "Summary": rates.stats(ast),
        **{name: by(d) for name, d in DIMENSIONS.items()},
        "Trend": months.trend(by_month),
        "Seasons": months.seasons(by_month),
        "Half trend": score.half_trend(ast),
        "Forecast": months.forecast(by_month),
        "High-risk organisms": score.high_risk(ast),
        "Alternatives": score.alternatives(ast),
        "Recommendations": score.recommendations(ast),
        "Emerging": score.emerging(ast),
        "Mechanisms": rates.value_counts(detect.mechanisms(ast), "organism", "resistance_mechanism", "confidence"),
        "Cross-resistance": rates.value_counts(detect.cross_resistance(ast), "antibiotic_class"),
        "Multi-drug resistance": rates.value_counts(detect.mdr(ast), "resistant_drug_classes"),
        "Co-resistance": detect.co_resistance(ast),
        "Burden": score.burden(samples, ast),
        "Data quality": score.data_quality(samples, ast),
        "Alerts": detect.alerts(ast),
    }


def run(ast: DataFrame, samples: DataFrame, act: Callable[[DataFrame], object], at_once: int = 8) -> dict[str, object]:
    """What ``act`` gives for each section. The tests, and the rates of all dimensions, are cached meanwhile; so many sections
    run at once, since most are small jobs that do not fill a cluster."""
    ast = ast.cache()
    by_dimension = rates.report_rates_of(ast, samples, *DIMENSIONS.values()).cache()
    try:
        by_dimension.count()
        found = sections(ast, samples, by_dimension)
        with ThreadPoolExecutor(at_once) as pool:
            return dict(zip(found, pool.map(act, found.values()), strict=True))
    finally:
        by_dimension.unpersist()
        ast.unpersist()


def _rendered(ast: DataFrame, samples: DataFrame, rows: int) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(section, columns, its first rows as text)."""

    def first_rows(df: DataFrame) -> tuple[list[str], list[list[str]]]:
        flat = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        return df.columns, [["" if v is None else v for v in r] for r in flat.limit(rows).collect()]

    for name, (columns, found) in run(ast, samples, first_rows).items():
        yield name, columns, found


def markdown(ast: DataFrame, samples: DataFrame, title: str = "Antimicrobial resistance report", rows: int = 20) -> str:
    """The sections' first rows as markdown tables."""
    out = [f"# {title}"]
    for name, columns, found in _rendered(ast, samples, rows):
        out += ["", f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
        out += ["| " + " | ".join(r) + " |" for r in found]
    return "\n".join(out) + "\n"


def html(ast: DataFrame, samples: DataFrame, title: str = "Antimicrobial resistance report", rows: int = 20) -> str:
    """The sections' first rows as tables of one HTML page."""
    line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in values) + "</tr>"
    out = [f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>']
    for name, columns, found in _rendered(ast, samples, rows):
        out += [f"<h2>{escape(name)}</h2><table>", line("th", columns), *[line("td", r) for r in found], "</table>"]
    return "\n".join([*out, "</body></html>"]) + "\n"
