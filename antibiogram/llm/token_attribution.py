"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, whole, by a lossless byte-level tokenizer, so the lengths of its tokens' bytes give every
token's span. Spans of tokens are joined with spans of sections by binary search over the sorted bounds, as an interval join
of two sorted lists is. A token that crosses a bound belongs to the section that holds most of its bytes, to the earlier
one of equals ("most", the default), or to the section of its first byte ("first").

Sections are the text's lines with their line end unless a table of spans (id, section, start, end in characters, end
exclusive, not overlapping) is given. Tokens outside every section are counted under section null.

Scale: with lines, nothing is shuffled; a given table is grouped by document, a document's own sections in one row;
sections without an id are left out before.

Edge cases: a null or empty text has no rows; spans outside the text are cut to it and empty ones have no tokens; repeated
rows give repeated counts; rows with a null id are counted (a given table cannot name them); an empty table gives an empty
table; lone surrogates count as the replacement character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OUT = "section long, start long, end long, n_tokens long, n_crossing long"


class SpanEncoder:
    """Byte spans of a text's tokens."""

    def __init__(self, path: str):
        import tiktoken

        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def bounds(self, text: str) -> np.ndarray:
        """0 and the end of each token, in bytes."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        return np.concatenate([[0], np.cumsum(self.size[ids])])


_ENCODERS: dict[str, SpanEncoder] = {}


def encoder(path: str) -> SpanEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path)
    return _ENCODERS[path]


def lines(text: str) -> np.ndarray:
    """(start, end) of each line in characters, with its line end."""
    out, at = [], 0
    for part in text.split("\n"):
        out.append((at, min(at + len(part) + 1, len(text))))
        at += len(part) + 1
    if out and out[-1][0] >= out[-1][1]:
        out.pop()
    return np.array(out, np.int64).reshape(-1, 2)


def attribute(bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and bound-crossing tokens of each section (sorted, apart, in the same unit), and tokens of no section."""
    lo, hi = bounds[:-1], bounds[1:]
    n = len(starts)
    if not n or not len(lo):
        return np.zeros(n, np.int64), np.zeros(n, np.int64), len(lo)
    first = np.searchsorted(ends, lo, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(starts, hi, side="left") - 1  # the last one that starts before its end
    owner = np.where(first <= last, first, -1)
    k = np.minimum(first, n - 1)
    inside = (owner >= 0) & (starts[k] <= lo) & (ends[k] >= hi)
    if rule == "first":
        owner = np.where((owner >= 0) & (starts[k] <= lo), owner, -1)
    else:
        for t in np.flatnonzero((owner >= 0) & (first < last)):  # few: tokens over several sections
            s = np.arange(first[t], last[t] + 1)
            owner[t] = s[np.argmax(np.minimum(ends[s], hi[t]) - np.maximum(starts[s], lo[t]))]
    mine = owner >= 0
    return np.bincount(owner[mine], minlength=n), np.bincount(owner[mine & ~inside], minlength=n), int((~mine).sum())


def count_sections(text: str | None, enc: SpanEncoder, sections: list | None, rule: str) -> list[tuple]:
    text = (text or "").encode("utf-8", "replace").decode("utf-8")
    if not text:
        return []
    if sections is None:
        spans = lines(text)
        names = list(range(len(spans)))
    else:
        cut = sorted((min(max(0, s["start"] or 0), len(text)), min(max(0, s["end"] or 0), len(text)), s["section"]) for s in sections)
        names = [c[2] for c in cut]
        spans = np.array([(c[0], max(c[0], c[1])) for c in cut], np.int64).reshape(-1, 2)
    chars = spans
    if not text.isascii():  # characters to bytes
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))])
        spans = at[spans]
    tokens, crossing, outside = attribute(enc.bounds(text), spans[:, 0], spans[:, 1], rule)
    rows = [(name, int(a), int(b), int(t), int(c)) for name, (a, b), t, c in zip(names, chars, tokens, crossing, strict=True)]
    return [*rows, (None, None, None, outside, 0)] if outside else rows


def section_tokens(docs: DataFrame, tokenizer_path: str, sections: DataFrame | None = None, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, section, start, end (characters), n_tokens, n_crossing for each section of each document."""
    if rule not in ("most", "first"):
        raise ValueError(f"no rule {rule!r}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    if sections is not None:
        own = sections.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "section")).alias("_s"))
        rows = rows.join(own, id_col, "left").withColumn("_s", F.coalesce("_s", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,section:bigint>>)")))
    else:
        rows = rows.withColumn("_s", F.lit(None).cast("array<struct<start:bigint,end:bigint,section:bigint>>"))

    @F.pandas_udf(f"array<struct<{OUT.replace(' ', ':').replace(',:', ',')}>>")
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        enc, names = encoder(tokenizer_path), [c.split()[0] for c in OUT.split(", ")]
        for texts, spans in batches:
            yield pd.Series([[dict(zip(names, r, strict=True)) for r in count_sections(t, enc, None if s is None else list(s), rule)] for t, s in zip(texts, spans, strict=True)])

    return rows.select(id_col, F.explode(counted("_t", "_s")).alias("r")).select(id_col, "r.section", "r.start", "r.end", "r.n_tokens", "r.n_crossing")
