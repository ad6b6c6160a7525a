"""License scans by patience alignment.

Text and template are aligned as sequences of normalised words: words that occur once in both are anchors, the longest
increasing subsequence of their places keeps those in order, and the gaps between kept anchors are aligned likewise; a gap
without anchors is aligned as far as equal words continue from an anchor beside it. Coverage is the share of the template's
words that are aligned.

What tells a license from its kin (name, version, restrictions) is a phrase of its template, in double brackets. A phrase
is one unit of the alignment: it stands in the text word for word, not as part of a longer hyphenated name, or the template
is not found, however much else is aligned.

A document is read once, whole. A stretch of at most twice the template's units that holds enough of them is aligned from
each of the template's words in it on, to each later one, and the stretch with most aligned words counts; what lies before and
behind it is searched likewise, so a license given twice is found twice. An end is passed over only if no alignment up to it
can count: the longest common subsequence, which no alignment exceeds, is computed for all ends of a start in one pass over
machine words. A notice that other text pulls apart to more than twice its length is not a finding. Nothing is shuffled; a
task holds one batch of texts.

Edge cases: a null or empty text has no finding; case, marks and white space do not matter; findings do not overlap: of
templates that fit one stretch, the one with most aligned words is reported; repeated rows give repeated findings; rows with
a null id are scanned; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .licenses import templates as known_licenses

#: A word of the normal form, with its place in the text.
WORD = re.compile(r"\w+(?:\.\d+)*")


def normal_words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, given in order of the first number, whose second numbers increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def anchors(a: list[str], a0: int, a1: int, b: list[str], b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of the words that occur once in both parts, those that are in order."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
    return increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at])


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the aligned words, in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b), False, False)]  # the last two: whether an anchor lies before and behind the gap
    while gaps:
        a0, a1, b0, b1, before, behind = gaps.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        kept = anchors(a, a0, a1, b, b0, b1)
        if kept:
            found += kept
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            for k, ((p, q), (r, s)) in enumerate(zip(edges, edges[1:], strict=False)):
                gaps.append((p + 1, r, q + 1, s, before or k > 0, behind or k < len(kept)))
            continue
        size = a1 - a0
        if before or not behind:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                found.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
        if behind or not before:
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                found.append((a1, b1))
        if a1 - a0 < size:  # what is left may have words that occur once
            gaps.append((a0, a1, b0, b1, before, behind))
    return sorted(found)


@dataclass
class Template:
    """A license's units: words and, as one, the phrases in double brackets. ``places``: of each unit, a bit for each place;
    ``largest``: the words of its largest units, by their number."""

    license: str
    units: list[str]
    phrases: list[list[str]]
    words: int

    def __post_init__(self) -> None:
        self.places: dict[str, int] = {}
        for k, u in enumerate(self.units):
            self.places[u] = self.places.get(u, 0) | 1 << k
        self.largest = [0, *accumulate(sorted((u.count(" ") + 1 for u in self.units), reverse=True))]


def template(name: str, text: str) -> Template:
    units: list[str] = []
    phrases = []
    for k, part in enumerate(re.split(r"\[\[|\]\]", text)):
        words = [w for w, _, _ in normal_words(part)]
        if k % 2 and words:
            phrases.append(words)
            units.append(" ".join(words))
        else:
            units += words
    return Template(name, units, sorted(phrases, key=len, reverse=True), sum(u.count(" ") + 1 for u in units))


def _units(text: str, words: list[tuple[str, int, int]], t: Template) -> list[tuple[str, int, int]]:
    """The text's words with each phrase of the template as one, with places in the text; none if a phrase is missing."""
    if not t.phrases:
        return words
    goes_on = re.compile(r"-\w")
    plain = [w for w, _, _ in words]
    at = {}
    for p in t.phrases:
        starts = [i for i, w in enumerate(plain) if w == p[0] and plain[i : i + len(p)] == p]
        whole = [i for i in starts if not goes_on.match(text, words[i + len(p) - 1][2]) and not (words[i][1] and text[words[i][1] - 1] == "-")]
        if not whole:
            return []
        for i in whole:
            at.setdefault(i, p)
    out, i = [], 0
    while i < len(words):
        p = at.get(i)
        n = len(p) if p else 1
        out.append((" ".join(p), words[i][1], words[i + n - 1][2]) if p else words[i])
        i += n
    return out


def _may_start(units: list[str], t: Template, reach: int, need: float) -> list[int]:
    """Places from which on ``reach`` units hold enough of the template, in any order."""
    want = Counter(t.units)
    size = {u: u.count(" ") + 1 for u in want}
    have: Counter[str] = Counter()
    total, out, ahead = 0, [], 0
    for i, u in enumerate(units):
        while ahead < min(i + reach, len(units)):
            w = units[ahead]
            if w in want:
                have[w] += 1
                total += size[w] if have[w] <= want[w] else 0
            ahead += 1
        if u in want:
            if total >= need:
                out.append(i)
            total -= size[u] if have[u] <= want[u] else 0
            have[u] -= 1
    return out


def most_aligned(units: list[str], t: Template, first: int, stop: int) -> list[int]:
    """For each end after ``first``, up to ``stop``, how many words an alignment of the units up to it can have at most.

    A bit for each of the template's units; those that are cleared are as many as the longest common subsequence has."""
    whole = (1 << len(t.units)) - 1
    rows, out = whole, []
    for u in units[first:stop]:
        bits = t.places.get(u)
        if bits is not None:
            same = rows & bits
            rows = ((rows + same) | (rows - same)) & whole
        out.append(t.largest[len(t.units) - rows.bit_count()])
    return out


def find(units: list[str], t: Template, threshold: float) -> list[tuple[int, int, int]]:
    """(first unit, unit after the last, aligned words) of each stretch of the text that holds the template."""
    need, reach = threshold * t.words - 1e-9, 2 * len(t.units)
    own = set(t.units)
    hits = [i for i, u in enumerate(units) if u in own]
    starts = _may_start(units, t, reach, need)
    phrases = {" ".join(p) for p in t.phrases}
    fewest = [bisect_left(t.largest, n) for n in range(t.words + 1)]  # units that hold so many words

    def best(s: int, stop: int) -> tuple[int, int, int] | None:
        """The stretch from ``s`` on with most aligned words, of equals the shortest."""
        last = min(stop, s + reach)
        bound = most_aligned(units, t, s, last)
        if not bound or bound[-1] < need:
            return None
        found = None
        for e in [e + 1 for e in hits[bisect_left(hits, s) : bisect_left(hits, last)]]:
            most = bound[e - s - 1]
            if most < need or (found and most < found[2]):
                continue
            if found and found[2] == bound[-1] and found[1] - found[0] <= fewest[found[2]]:
                break  # no later end has more words, or as many in fewer units
            pairs = align(units[s:e], t.units)
            size = sum(units[s + i].count(" ") + 1 for i, _ in pairs)
            if size >= need and phrases <= {t.units[j] for _, j in pairs}:
                one = (s + pairs[0][0], s + pairs[-1][0] + 1, size)
                if found is None or (-size, one[1] - one[0]) < (-found[2], found[1] - found[0]):
                    found = one
        return found

    out, parts = [], [(0, len(units))]
    while parts:
        at, stop = parts.pop()
        for s in starts[bisect_left(starts, at) : bisect_left(starts, stop)]:
            one = best(s, stop)
            if one:
                out.append(one)
                parts += [(s, one[0]), (one[1], stop)]
                break
    return sorted(out)


def scan(text: str | None, templates: list[Template], threshold: float = 0.8) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, aligned words, first character, character after the last) of each finding in a text."""
    found: list[tuple[str, float, int, int, int]] = []
    words = normal_words(text or "")
    here = {w for w, _, _ in words}
    for t in templates:
        if not all(w in here for p in t.phrases for w in p):
            continue
        if sum(u.count(" ") + 1 for u in t.units if " " in u or u in here) < threshold * t.words - 1e-9:
            continue
        units = _units(text or "", words, t)
        for first, last, size in find([u for u, _, _ in units], t, threshold):
            found.append((t.license, size / t.words, size, units[first][1], units[last - 1][2]))
    return apart(found)


def apart(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Findings that do not overlap: of those that do, the one with most aligned words, then coverage, then the earlier name."""
    kept: list[tuple[str, float, int, int, int]] = []
    for f in sorted(found, key=lambda f: (-f[2], -f[1], f[0], f[3])):
        if all(f[4] <= k[3] or f[3] >= k[4] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[3])


def license_scan(
    docs: DataFrame, templates: list[tuple[str, str]] | dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, license, coverage, aligned_words, start, end of each finding. ``templates``: (license, text) pairs, several a
    license if need be; the known licenses if none are given."""
    small_batches(docs.sparkSession)
    pairs = known_licenses() if templates is None else list(templates.items()) if isinstance(templates, dict) else templates
    wanted = [template(name, text) for name, text in pairs]

    @F.pandas_udf("array<struct<license:string,coverage:double,aligned_words:long,start:long,end:long>>")
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("license", "coverage", "aligned_words", "start", "end")
        for t in texts:
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in scan(s, wanted, threshold)] for s in t])

    found = docs.select(F.col(id_col), F.explode(scanned(F.col(text_col))).alias("f"))
    return found.select(id_col, "f.license", "f.coverage", "f.aligned_words", "f.start", "f.end")
