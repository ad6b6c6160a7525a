"""Mixing sources to target weights with soft membership.

A classifier learnt from the labelled table gives every document a posterior over domains (multinomial logistic regression
over hashed words and the features of ``quality_gam``; shares below ``floor`` are noise and count as zero). Document
rates r >= 0 then follow by projected-gradient least squares: minimise sum over domains k of
(sum_d r_d tokens_d p_dk - T_k)^2 / A_k, with T_k the target and A_k the expected tokens of the domain that are there. With
each document's step weighted by its tokens, the gradient of a document is sum_k p_dk (S_k - T_k) / A_k and the largest
curvature is 1, so the step is 1 and nothing needs tuning; momentum (Nesterov's) shortens the way. A document's rate follows from its posterior and the list of the
rounds' K-number steps, so rates are never gathered. The rounds run over a table of the posteriors' cells (``binned``: the
tokens and their mean posterior in each cell of a grid), which one aggregation makes; a round is one sum of K numbers over
that table. The rates and the totals that are reported are those of the documents' own posteriors. Rounds end when every
total is within ``tolerance`` of its target or nothing moves.

Targets: by default the total is the largest for which every domain can have its weight's share at rates up to
``max_rate``: the minimum over domains of what is there x max_rate / weight. A scarce domain thus sets the total. With
``whole`` a named domain is kept whole instead and sets the total; the others get their share of it, or all that they have
where that is less, and then fall short of their weight. Each row carries its domain's target and the total reached, so a
miss is seen. A document comes floor(rate) times and once more with the chance of what is left (a hash of the row decides,
so runs agree).

Tokens are white-space words unless ``tokens`` gives another count, a column of ``docs``.

Edge cases: a null or empty text has no tokens and keeps rate 1; without labelled rows there is one domain "other" and
every rate is 1; labels of domains without a target weight count as "other", whose target is what it has; a domain with a
weight of which nothing is there has target 0 and does not bind the others; repeated rows and rows with a null id are rows
like others, each with its own verdict (equal rows share it); an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import may_learn, named, small_batches, table, unit_hash
from .quality_gam import FEATURES, features

DIMS = 1 << 14
DENSE = len(FEATURES)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slots(words: list[bytes]) -> np.ndarray:
    """Hashed distinct words, marks at their ends left off."""
    return np.unique(np.fromiter((zlib.crc32(w) & (DIMS - 1) for w in {w.strip(b".,;:!?\"'()") for w in words}), np.int32))


@dataclass
class Domains:
    """Softmax over domains: weights of the hashed words (domain x DIMS), of the dense features and the intercepts."""

    names: list[str] = field(default_factory=lambda: ["other"])
    sparse: np.ndarray = field(default_factory=lambda: np.zeros((1, DIMS), np.float32))
    dense: np.ndarray = field(default_factory=lambda: np.zeros((1, DENSE), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(DENSE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(DENSE))

    def posterior(self, text: str | None, words: list[bytes]) -> np.ndarray:
        x = np.clip((np.array(features(text)) - self.mean) / self.scale, -5, 5)
        z = self.bias + self.dense @ x + self.sparse[:, slots(words)].sum(1)
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(found: list[np.ndarray], x: np.ndarray, y: np.ndarray, names: list[str], epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, batch: int = 64) -> Domains:
    """Multinomial logistic regression by AdaGrad over at most ``max_rows`` rows, in the driver."""
    m = Domains(names, np.zeros((len(names), DIMS), np.float32), np.zeros((len(names), DENSE), np.float32), np.zeros(len(names), np.float32))
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - m.mean) / m.scale, -5, 5).astype(np.float32)
    k, rng = len(names), np.random.default_rng(7)
    sums = [np.full_like(a, 1e-3) for a in (m.sparse, m.dense, m.bias)]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            size = np.array([len(found[i]) for i in rows])
            cols, owner = np.concatenate([found[i] for i in rows]), np.repeat(np.arange(len(rows)), size)
            z = m.bias + x[rows] @ m.dense.T
            for c in range(k):
                z[:, c] += np.bincount(owner, m.sparse[c, cols], len(rows))
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            used, place = np.unique(cols, return_inverse=True)
            g = np.stack([np.bincount(place, p[owner, c], len(used)) for c in range(k)]).astype(np.float32) + decay * m.sparse[:, used]
            sums[0][:, used] += g * g
            m.sparse[:, used] -= rate * g / np.sqrt(sums[0][:, used])
            for a, g, s in ((m.dense, (p.T @ x[rows]).astype(np.float32), sums[1]), (m.bias, p.sum(0).astype(np.float32), sums[2])):
                s += g * g
                a -= rate * g / np.sqrt(s)
    return m


def _learnt_from(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"s": [slots(words_of(t)) for t in texts], "x": [features(t) for t in texts]})


def train(docs: DataFrame, labels: DataFrame, domain: Column, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """A model of the domains of at most ``max_rows`` labelled rows: a hash decides which, of the id among labels, of id and
    text among rows, so that the limit holds where an id repeats."""
    small_batches(docs.sparkSession)
    chosen = labels.where(may_learn(id_col)).select(id_col, domain.alias("_domain")).where(F.col("_domain").isNotNull()).orderBy(unit_hash(id_col), id_col, "_domain").limit(max_rows)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    learnt = found.select(F.pandas_udf(_learnt_from, "struct<s:array<int>,x:array<double>>")(text_col).alias("f"), "_domain", F.col(id_col).alias("_id"), unit_hash(id_col, text_col).alias("_u"))
    rows = learnt.orderBy("_u", "_id", "_domain").limit(max_rows).toPandas().sort_values(["_id", "_domain", "_u"])
    names = sorted(set(rows["_domain"]))
    if len(names) < 2:
        return Domains(names or ["other"])
    x = np.array([list(f["x"]) for f in rows["f"]], float)
    return fit([np.asarray(f["s"], np.int64) for f in rows["f"]], x, np.array([names.index(d) for d in rows["_domain"]]), names)


def posteriors(model: Domains, text_col: str = "text", floor: float = 0.05) -> Column:
    """A column (tokens, p) of a document: its words and its posterior over ``model.names``, noise taken off."""

    def sharp(p: np.ndarray) -> np.ndarray:
        p = np.where(p < min(floor, p.max()), 0.0, p)
        return p / p.sum()

    @F.pandas_udf("struct<tokens:long,p:array<double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            words = [words_of(s) for s in t]
            yield pd.DataFrame({"tokens": [len(w) for w in words], "p": [sharp(model.posterior(s, w)) for s, w in zip(t, words, strict=True)]})

    return run(F.col(text_col))


def rate_column(p: str, steps: list[list[float]], max_rate: float, ahead: bool = False) -> Column:
    """The rate after the projected steps so far, from a document's posterior alone; ``ahead``: with the last momentum.

    A step is K numbers and the momentum: rates go from where the last momentum took them against the gradient, are
    projected to [0, max_rate], and move on by the momentum times what they moved.
    """
    if not steps:
        return F.lit(1.0)
    k = len(steps[0]) - 1
    done = "array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in s) + ")" for s in steps) + ")"
    dot = " + ".join(f"{p}[{i}] * s[{i}]" for i in range(k))
    moved = f"greatest(0D, least({float(max_rate)!r}D, a.y - ({dot})))"
    out = f"aggregate({done}, struct(1D AS r, 1D AS y), (a, s) -> struct({moved} AS r, {moved} + s[{k}] * ({moved} - a.r) AS y))"
    return F.expr(f"({out}).{'y' if ahead else 'r'}")


def binned(rows: DataFrame, k: int, levels: int = 32) -> DataFrame:
    """tokens and p (their mean) of each cell of the grid of posteriors that has tokens: for three domains 561 rows at most,
    whatever the input."""
    cell = F.transform("p", lambda x: F.floor(x * levels + 0.5).cast("int"))
    sums = rows.where("tokens > 0").groupBy(cell.alias("cell")).agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.get("p", i)).alias(f"s{i}") for i in range(k)])
    return sums.select(F.col("t").alias("tokens"), F.array(*[F.col(f"s{i}") / F.col("t") for i in range(k)]).alias("p"))


def totals(rows: DataFrame, k: int, *rates: Column) -> np.ndarray:
    """The expected tokens of each domain at these rates, a row for each of ``rates``."""
    weighed = rows.select("p", *[(F.col("tokens") * r).alias(f"t{j}") for j, r in enumerate(rates)])
    sums = weighed.agg(*[F.coalesce(F.sum(F.col(f"t{j}") * F.get("p", i)), F.lit(0.0)).alias(f"s{j}_{i}") for j in range(len(rates)) for i in range(k)]).first()
    return np.array(list(sums), float).reshape(len(rates), k)


def targets(there: np.ndarray, names: list[str], weights: dict[str, float], max_rate: float, whole: str | None) -> np.ndarray:
    """The total that each domain is to have, from the expected tokens that are there."""
    w = np.array([weights.get(n, np.nan) for n in names])
    use = np.nan_to_num(w) * (there > 0) > 0
    if whole is not None and whole in names and use[names.index(whole)]:
        total = there[names.index(whole)] * max_rate / w[names.index(whole)]
    else:
        total = min((there[use] * max_rate / w[use]).tolist(), default=0.0)
    return np.where(np.isfinite(w), np.minimum(np.nan_to_num(w) * total, there * max_rate), there)


def solve(
    rows: DataFrame, names: list[str], weights: dict[str, float], max_rate: float = 1.0, whole: str | None = None, rounds: int = 40, tolerance: float = 1e-3
) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(steps, targets, totals reached) for documents, or cells of them, with ``tokens`` and ``p``."""
    k = len(names)
    there = totals(rows, k, F.lit(1.0))[0]
    if sum(n in weights and t > 0 for n, t in zip(names, there, strict=True)) < 2:
        return [], there, there
    target = targets(there, names, weights, max_rate, whole)
    steps: list[list[float]] = []
    reached = ahead = there
    still, momentum = 0, 1.0
    for _ in range(rounds):
        if (np.abs(reached - target) <= tolerance * np.maximum(target, 1)).all() or still > 2:
            break
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        slope = np.where(there > 0, (ahead - target) / np.maximum(there, 1e-9), 0.0)
        steps.append([*map(float, slope), float((momentum - 1) / after)])
        momentum, was = after, reached
        reached, ahead = totals(rows, k, rate_column("p", steps, max_rate), rate_column("p", steps, max_rate, ahead=True))
        still = still + 1 if (np.abs(reached - was) <= 0.1 * tolerance * np.maximum(target, 1)).all() else 0
    return steps, target, reached


def _rated(
    docs: DataFrame, row: Column, labels: DataFrame, domain: Column, weights: dict[str, float], max_rate: float, whole: str | None, tokens: Column | None, max_rows: int, id_col: str, text_col: str
) -> tuple[DataFrame, list[str]]:
    """row, id, tokens, p, domain, rate, copies, domain_target, domain_reached for each row, and the domains' names."""
    model = train(docs, labels, domain, max_rows, id_col, text_col)
    names, k = model.names, len(model.names)
    found = docs.select(row.alias("row"), F.col(id_col).alias("id"), (F.lit(None) if tokens is None else tokens).cast("long").alias("own"), posteriors(model, text_col).alias("f"))
    rows = table(found.select("row", "id", F.coalesce("own", "f.tokens").alias("tokens"), "f.p"))
    steps, _, _ = solve(table(binned(rows, k)), names, weights, max_rate, whole)
    rate = rate_column("p", steps, max_rate)
    there, reached = totals(rows, k, F.lit(1.0), rate)
    target = targets(there, names, weights, max_rate, whole) if steps else there
    best = F.array_position("p", F.array_max("p")).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), best)
    out = rows.select(
        "row", "id", "tokens", "p", of(names).alias("domain"), F.when(F.col("tokens") == 0, 1.0).otherwise(rate).alias("rate"),
        of(target.tolist()).alias("domain_target"), of(reached.tolist()).alias("domain_reached"),
    )
    draw = F.pmod(F.xxhash64("id", "tokens", "p"), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    return out.withColumn("copies", copies.cast("int")), names


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    weights: dict[str, float],
    max_rate: float = 1.0,
    whole: str | None = None,
    tokens: Column | None = None,
    max_rows: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, tokens, domain (the likeliest), p_<domain>, rate, copies, domain_target and domain_reached for each row of ``docs``."""
    rows, names = _rated(docs, F.lit(None), labels, domain, weights, max_rate, whole, tokens, max_rows, id_col, text_col)
    return rows.select(
        F.col("id").alias(id_col), "tokens", "domain", *[F.get("p", i).alias(f"p_{n}") for i, n in enumerate(names)], "rate", "copies", "domain_target", "domain_reached"
    )


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    weights: dict[str, float],
    max_rate: float = 1.0,
    whole: str | None = None,
    tokens: Column | None = None,
    max_rows: int = 6000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with each row as often as ``mix`` says, all columns kept. The rows are written once with their posteriors, so
    nothing is joined or shuffled."""
    row = F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows, _ = _rated(docs, row, labels, domain, weights, max_rate, whole, tokens, max_rows, id_col, text_col)
    rows = rows.where("copies > 0")
    if max_rate > 1:
        rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return rows.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


#: Domains of the ``labels`` table, and the shares of tokens that the registered query and the pipeline ask for.
WEIGHTS = {"clean": 0.94, "toxic": 0.03, "low": 0.03}


def label_domain() -> Column:
    """``clean``, ``toxic`` or ``low``, from the columns of the ``labels`` table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
