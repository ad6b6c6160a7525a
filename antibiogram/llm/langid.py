"""Language identification by hierarchical discrimination.

First the language family, then the language within it: both decided by one-versus-one linear support vector machines
over hashed byte bigrams and trigrams of the lower-cased letters (square roots of their shares, so every vector has
length one). Families come from ``FAMILIES``; a learned language that is not listed is a family of its own.

Learning rows: for each language at most about ``per_lang`` rows (a hash of the id decides), of at most ``max_langs``
languages (the most frequent), so what the driver gathers is bounded by ``per_lang`` x ``max_langs`` sparse vectors.
Prediction reads each whole text once and shuffles nothing.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with no learned language everything is ``und``;
with one, that one has score 1; repeated rows each get their row; rows with a null id or lang are predicted and never
learned from; an empty table gives an empty table; texts of any length are read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, may_learn, small_batches, unit_hash

#: Families of closely related languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BIGRAMS, TRIGRAMS = 1 << 10, 1 << 12
DIMS = BIGRAMS + TRIGRAMS
PIECE = 1 << 20
_SPACES = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """The hashed n-gram vector of a whole text, of length one (or zero)."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACES) + b" ", np.uint8)
    counts = np.zeros(DIMS, np.float32)
    for at in range(0, max(1, len(b) - 1), PIECE):
        x = b[at : at + PIECE + 2].astype(np.uint32)
        two = (x[:-1] << 8) | x[1:]
        two = two[: PIECE]
        keep = two != 0x2020
        counts[:BIGRAMS] += np.bincount((two[keep] * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=BIGRAMS)
        if len(x) > 2:
            three = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])[:PIECE]
            three = three[(three & 0xFFFF) != 0x2020]
            counts[BIGRAMS:] += np.bincount((three * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=TRIGRAMS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def _vectors(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        v = vector(t or "")
        i = np.flatnonzero(v)
        rows.append((i.astype(np.int32), v[i]))
    return pd.DataFrame({"i": [r[0] for r in rows], "v": [r[1] for r in rows]})


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent; y is +-1.
    The rarer class costs more, so both weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diag = 1 / (2 * cost * weight)
    q = np.einsum("ij,ij->i", x, x) + diag
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1], np.float32), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Votes:
    """One-versus-one machines over a sorted list of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def best(self, v: np.ndarray, steep: float = 3.0) -> tuple[str, float]:
        """The class with most votes (ties: larger sum of margins, then the earlier name) and the mean of its chances."""
        if self.weights is None:
            return self.classes[0], 1.0
        margin = self.weights[:, :-1] @ v + self.weights[:, -1]
        chance = 1 / (1 + np.exp(-steep * margin))
        votes, sums, chances = (np.zeros(len(self.classes)) for _ in range(3))
        for (a, b), m, c in zip(self.pairs, margin, chance, strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            chances[a] += c
            chances[b] += 1 - c
        k = max(range(len(self.classes)), key=lambda i: (votes[i], sums[i], -i))
        return self.classes[k], float(chances[k] / (len(self.classes) - 1))


def fit_votes(x: np.ndarray, names: np.ndarray) -> Votes:
    classes = sorted(set(names.tolist()))
    out = Votes(classes, list(combinations(range(len(classes)), 2)))
    if out.pairs:
        rows = [(names == classes[a]) | (names == classes[b]) for a, b in out.pairs]
        out.weights = np.array([fit_svm(x[r], np.where(names[r] == classes[a], 1.0, -1.0)) for r, (a, _) in zip(rows, out.pairs, strict=True)])
    return out


@dataclass
class Model:
    families: Votes | None = None
    within: dict[str, Votes] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or text is None or not has_letter(text):
            return "und", 0.0
        v = vector(text)
        family, p = self.families.best(v)
        lang, q = self.within[family].best(v)
        return lang, p * q


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    if not len(langs):
        return Model()
    family = np.array([_FAMILY.get(lang, f"only {lang}") for lang in langs])
    return Model(fit_votes(x, family), {f: fit_votes(x[family == f], langs[family == f]) for f in set(family.tolist())})


def train(docs: DataFrame, per_lang: int = 500, max_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(may_learn(id_col) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(max_langs)
    share = counts.select("_lang", (per_lang / F.col("n")).alias("share"))
    chosen = rows.join(F.broadcast(share), "_lang").where((unit_hash("_id") < F.col("share")) & F.col("_t").rlike(r"\p{L}"))
    found = chosen.limit(2 * per_lang * max_langs).select(F.pandas_udf(_vectors, "struct<i:array<int>,v:array<float>>")("_t").alias("x"), "_lang", "_id").toPandas()
    found = found.sort_values(["_lang", "_id"])
    x = np.zeros((len(found), DIMS), np.float32)
    for row, v in zip(x, found["x"], strict=True):
        row[np.asarray(v["i"], int)] = v["v"]
    return fit(x, found["_lang"].to_numpy(object))


def identify(docs: DataFrame, per_lang: int = 500, max_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score for each row of ``docs``."""
    model = train(docs, per_lang, max_langs, id_col, text_col, lang_col)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([model.predict(s) for s in t], columns=["lang_pred", "score"])

    out = docs.select(F.col(id_col), is_held_out(id_col).alias("held_out"), predicted(F.col(text_col)).alias("_p"))
    return out.select(id_col, "held_out", "_p.lang_pred", "_p.score")
