"""An extension, not part of the reference: resistance alerts over a stream of tests, by Structured Streaming."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from antibiogram.functions.exprs import n_of, percent

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def windowed_rates(tests: DataFrame, window: str = "30 days", late: str = "90 days") -> DataFrame:
    """R% of each organism and antibiotic in windows of the test date; tests later than ``late`` are dropped."""
    rows = tests.withColumn("at", F.col("test_date").cast("timestamp")).withWatermark("at", late)
    n = F.count("*")
    return rows.groupBy(F.window("at", window), "organism", "antibiotic").agg(n.alias("tests"), percent(n_of("R"), n, 2).alias("resistance_rate"))


def stream_alerts(tests: DataFrame, above: float = 50, min_tests: int = 10, **windows: str) -> DataFrame:
    """Windows in which a combination is above the limit with enough tests."""
    out = windowed_rates(tests, **windows).where((F.col("resistance_rate") > above) & (F.col("tests") >= min_tests))
    return out.select(F.col("window.start").alias("window_start"), "organism", "antibiotic", "tests", "resistance_rate")


ALERT = "organism string, antibiotic string, tests long, resistance_rate double"


def once_alerts(tests: DataFrame, above: float = 50, min_tests: int = 10) -> DataFrame:
    """A row when a combination's R% of all its tests so far comes above the limit, and no more until it has been at or below it.

    Each combination keeps three numbers: tests, R and whether it is above. They lie in the query's checkpoint, so a restarted
    query repeats no alert. A combination's tests of a batch are summed as they come; the rate is judged at the batch's end."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, r, was_above = state.get if state.exists else (0, 0, False)
        for batch in batches:
            n += len(batch)
            r += int((batch["result"] == "R").sum())
        rate = 100.0 * r / n
        is_above = n >= min_tests and rate > above
        state.update((n, r, is_above))
        if is_above and not was_above:
            yield pd.DataFrame([(*key, n, round(rate, 2))], columns=["organism", "antibiotic", "tests", "resistance_rate"])

    rows = tests.where(F.col("organism").isNotNull() & F.col("antibiotic").isNotNull()).select("organism", "antibiotic", "result")
    return rows.groupBy("organism", "antibiotic").applyInPandasWithState(update, ALERT, "n long, r long, above boolean", "append", GroupStateTimeout.NoTimeout)
