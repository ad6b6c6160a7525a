"""Words and spelling variants against brute force, and the automaton against all edits."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import ODD, docs, prose
from pyspark.sql import functions as F

from antibiogram.llm import spelling
from antibiogram.llm.queries import op11_spelling_variants

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def words_by_hand(rows):
    seen = Counter()
    for i, t in rows:
        for w in LETTERS.findall(t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one insertion, deletion or replacement."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(words):
    out, forms = {}, {}
    for w, n in words.items():
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return sorted((w, *x) for w, x in out.items())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def typos(seed: int, n: int) -> list[str]:
    """Words around a few stems, with runs of equal letters, each some times."""
    r = random.Random(seed)
    stems = ["aaaaab", "baaaaa", "abababab", "colour", "favour", "étudié", "straße", "aabbaabb", "zzzzz"]
    out = []
    for _ in range(n):
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k, how = r.randrange(len(w)), r.randrange(3)
            w[k : k + 1] = [[], [r.choice("abé")], [w[k], r.choice("abz")]][how]
        out += ["".join(w)] * r.randrange(1, 12)
    return out


def test_automaton_numbers_and_errors():
    words = sorted({w for w in typos(1, 900) if len(w) >= 5} | {"x" * 3000, "x" * 2999, "x" * 2000 + "y" + "x" * 999})
    a = spelling.Automaton()
    for w in words:
        a.add(w)
    a.finish()
    assert a.size[a.root] == len(words) and len(a.size) < sum(map(len, words))
    for k, w in enumerate(words):
        assert a._rest(a.root, w, 0) == k and a._rest(a.root, w + "!", 0) == -1
        if len(w) < 50:
            for exact in (0, len(w) // 2, len(w)):
                got = [n for n in a.one_error(w, exact) if n >= 0]
                assert sorted(got) == [m for m, v in enumerate(words) if near(w, v) and v[:exact] == w[:exact]]  # each once
    assert {words[n] for n in a.one_error("x" * 3000, 1500) if n >= 0} == {"x" * 2999, "x" * 2000 + "y" + "x" * 999}


@pytest.mark.parametrize(("hot", "task"), [(spelling.HOT, spelling.TASK_TARGETS), (1, 40), (3, 1000)])
def test_variants(spark, hot, task):
    texts = [*ODD, *[" ".join(typos(k, 60)) for k in range(12)], "Colour COLOUR cOLOUR", "l'été d'étudié×étudiés"]
    rows = [*enumerate(texts), (None, "colour colours colours"), (3, "colours favours"), (3, "colours favours")]
    df = docs(spark, [(i, t, None, None) for i, t in rows], clash=True).withColumns({c: F.lit("mine") for c in ("word", "w", "way", "half", "query", "i", "j", "root", "form")})
    words = words_by_hand(rows)
    assert rows_of(spelling.spelling_variants(df, hot_size=hot, task_targets=task)) == variants_by_hand(words)


def test_long_chain_ties_and_limits(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb", "bbbbbbb"]
    vocabulary = [(w, 3 * 2**k) for k, w in enumerate(chain)] + [("ccccc", 3), ("ccccd", 6), ("cccce", 6), ("ddddd", 4), ("dddde", 7)]
    text = " ".join(" ".join([w] * n) for w, n in vocabulary)
    got = {r.word: r for r in spelling.spelling_variants(docs(spark, [text]), one_in=10**9).collect()}
    assert {got[w].root for w in chain} == {chain[-1]} and got["ccccc"].form == "ccccd" and got["ddddd"].form is None
    assert got["ccccc"].n_near == 2 and got["dddde"].n_near == 1 and got["ccccd"].form_n is None
    assert spelling.spelling_variants(docs(spark, [text]).limit(0)).isEmpty()
    assert spelling.spelling_variants(docs(spark, [None, "", "a b c", "abcde abcde"])).isEmpty()


def test_query_over_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    words = words_by_hand(rows)
    got = rows_of(op11_spelling_variants(spark, sf_dir))
    assert {r[0]: r[3] for r in got} == words
    some = random.Random(2).sample(sorted(words), 60)
    by_word = {r[0]: r for r in got}
    for w in some:
        others = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        assert by_word[w][4] == len(others) and by_word[w][1] == (best if best and words[best] >= 2 * words[w] else None)


def test_prose_is_whole(spark):
    """A text far beyond a batch, and one run of 50,000 letters in three texts."""
    texts = [prose(7, 30_000), *["Q" * 50_000] * 3, *["q" * 49_999] * 7]
    got = {r.word: r for r in spelling.spelling_variants(docs(spark, texts), one_in=10**9).collect()}
    assert got["q" * 50_000].form == "q" * 49_999 and got["gamma"].n == Counter(LETTERS.findall(texts[0]))["gamma"]
