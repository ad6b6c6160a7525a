"""Small document tables for the corpus operators' tests."""

from __future__ import annotations

import random

#: Names that operators use inside, as columns of the caller's.
CLASHING = ("_id", "_t", "_h", "fp", "key", "node", "start", "length", "text_hash", "host", "line", "score", "held_out", "kept", "tokens", "p", "rate", "_salt", "bucket", "_copies", "copies", "n", "_again", "_p", "_f", "f", "r", "_s", "_y", "_domain", "section", "per_bin", "class_n", "full", "component_id", "keep_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, clash: bool = False):
    """Rows of text, or of (doc_id, text, lang, source)."""
    rows = []
    for k, t in enumerate(texts):
        i, text, lang, source = t if isinstance(t, tuple) else (k, t, "en", "src")
        rows.append((i, text, lang, source, None if text is None else len(text)))
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in CLASHING})
    return df


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


#: Texts that every operator must take.
ODD = [None, "", " \n\t ", "a", "a b", "x" * 50_000, prose(1, 20_000), prose(2, 80), prose(2, 80), "1234 5678 !!!", "  ", "ñ é ß 漢字 \U0001f600", "A\x0bb\x0cC\r\nd"]
