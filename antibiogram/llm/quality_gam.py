"""Quality classifier: a generalised additive model with pairwise interactions, read off lookup tables.

Features of the whole text are cut into bins at quantiles of the learning rows. Cyclic boosting visits one feature after
another and fits a shallow tree (up to three leaves) on its bins to the gradient of the log loss; what the trees add up to
is one table per feature. The pairs with the largest gain on what is left then get tables of two features, by trees of two
levels, likewise. A score is the sigmoid of an intercept plus one table entry per feature and pair: additions of bins.

Learning rows: at most ``max_rows`` labelled rows (a hash of the id decides which), so what the driver gathers is at most
``max_rows`` x features numbers. Everything else runs in the tasks that read the text; nothing is shuffled but the labels.

Edge cases: a null text counts as empty and is scored like any text; with no labelled rows the score is 1 everywhere
(nothing speaks against a text), with one class only a smoothed share of label 1; repeated rows each get their row and null ids are never
learned from; an empty table gives an empty table; a document with several labels counts once with each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, may_learn, small_batches, unit_hash

FEATURES = (
    "log_words", "symbols_per_char", "bars_per_word", "marks_per_word", "upper_per_letter", "digits_per_char", "stops_per_word",
    "chars_per_word", "distinct_per_word", "top_word_share", "repeated_next_share", "duplicate_line_share", "words_per_line",
    "other_bytes_share", "first_upper_share",
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>@^~=_{}[]\\+"
_HIGH = bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    """The numbers that describe one whole text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    count = lambda drop: size - len(b.translate(None, drop))
    letters, upper = count(_LETTERS), count(_UPPER)
    seen = Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        count(_SYMBOLS) / chars,
        b.count(b"|") / n,
        (b.count(b"!") + b.count(b"?")) / n,
        upper / max(1, letters),
        count(_DIGITS) / chars,
        (b.count(b".") + b.count(b",") + b.count(b";") + b.count(b":")) / n,
        chars / n,
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        count(_HIGH) / chars,
        sum(w[:1] in _UPPER_SET for w in words) / n,
    ]


_UPPER_SET = frozenset(bytes([c]) for c in _UPPER)


def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


@dataclass
class Gam:
    """Cut points of each feature, a table for each feature and for each chosen pair (of coarser bins)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for table, at in zip(self.tables, self.bins(x, self.cuts), strict=True):
            z += table[at]
        if self.pairs:
            at = self.bins(x, self.coarse)
            for i, j, table in self.pairs:
                z += table[at[i], at[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Largest gain of cutting ordered bins in two, and after how many bins."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = cg**2 / (ch + ridge) + (g.sum() - cg) ** 2 / (h.sum() - ch + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """A shallow tree over one feature's bins: the value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], ridge), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts[parts.index((a, b))] = (a, a + k)
        parts.append((a + k, b))
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree of two levels over the bins of two features, the better one first: gain and the value for each cell."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        out, total, k = np.zeros_like(a), 0.0, _split(a.sum(1), b.sum(1), ridge)[1]
        for lo, hi in ((0, k), (k, len(a))):
            if lo == hi:
                continue
            ga, hb = a[lo:hi].sum(0), b[lo:hi].sum(0)
            m = _split(ga, hb, ridge)[1]
            for x, y in ((0, m), (m, len(ga))):
                if x < y:
                    s, t = ga[x:y].sum(), hb[x:y].sum()
                    out[lo:hi, x:y] = _leaf(s, t, ridge)
                    total += s**2 / (t + ridge)
        if total > best[0]:
            best = (total, out.T if flip else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, n_bins: int = 32, n_pairs: int = 6, pair_rounds: int = 40, ridge: float = 1.0) -> Gam:
    """Boosting on at most ``max_rows`` rows, in the driver."""
    n1, n = float(y.sum()), len(y)
    share = (n1 + 1) / (n + 1)  # of no rows: 1
    m = Gam(intercept=float(np.clip(np.log(share / max(1e-9, 1 - share)), -12, 12)))
    if n1 in (0, n):
        return m
    m.intercept = float(np.log(n1 / (n - n1)))
    quantiles = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
    m.cuts, m.coarse = quantiles(n_bins), quantiles(8)
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    z, at = np.full(n, m.intercept), m.bins(x, m.cuts)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            size = len(m.tables[j])
            step = rate * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), ridge)
            m.tables[j] += step
            z += step[b]
    at = m.bins(x, m.coarse)
    size = [len(c) + 1 for c in m.coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, cell = 1 / (1 + np.exp(-z)), at[i] * size[j] + at[j]
        shape = (size[i], size[j])
        return cell, np.bincount(cell, y - p, size[i] * size[j]).reshape(shape), np.bincount(cell, p * (1 - p), size[i] * size[j]).reshape(shape)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_tree2(*cells(*ij)[1:], ridge)[0])[:n_pairs]
    m.pairs = [(i, j, np.zeros((size[i], size[j]))) for i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in m.pairs:
            cell, g, h = cells(i, j)
            step = rate * _tree2(g, h, ridge)[1]
            table += step
            z += step.ravel()[cell]
    return m


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """A model of the labels of at most ``max_rows`` rows, none of them held out: a hash decides which, of the id among labels, of
    id and text among rows, so that the limit holds where an id repeats."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(may_learn(id_col) & F.col(label_col).isNotNull())
        .select(F.col(id_col), F.col(label_col).cast("double").alias("_y"))
        .orderBy(unit_hash(id_col), id_col, "_y")
        .limit(max_rows)
    )
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    learnt = found.select(F.pandas_udf(_features, "array<double>")(text_col).alias("x"), "_y", unit_hash(id_col, text_col).alias("_u"))
    rows = learnt.orderBy("_u", "_y").limit(max_rows).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["_y"].to_numpy(float))


def score_column(model: Gam, text_col: str = "text"):
    """A column with the score of a text."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(np.array([features(s) for s in t], float).reshape(-1, len(FEATURES))))

    return scored(F.col(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row of ``docs``."""
    score = score_column(train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col), text_col)
    return docs.select(id_col, is_held_out(id_col).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns kept."""
    score = score_column(train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col), text_col)
    return docs.where(score >= threshold)
