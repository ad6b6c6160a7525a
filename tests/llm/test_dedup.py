"""Exact and near dedup, and components, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from helpers import ODD, docs, prose
from pyspark.sql import functions as F

from antibiogram.llm import common, exact_dedup, simhash


def exact_by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hasher", [exact_dedup.content_hash, lambda t: F.length(t) % 3, lambda t: F.lit(0)])
def test_exact_groups(spark, hasher):
    texts = [*ODD, *[prose(k % 7, 12) for k in range(60)], "a  b", "a\n b"]
    rows = list(enumerate(texts)) + [(None, "a b"), (None, "alone"), (3, "a")]
    df = docs(spark, [(i, t, None, None) for i, t in rows], clash=True)
    got = sorted(map(tuple, exact_dedup.exact_groups(df, hasher=hasher).collect()), key=str)
    assert got == exact_by_hand(rows)


def test_exact_hot_group_and_filter(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}", None, None) for k in range(3000)]
    df = docs(spark, rows, clash=True)
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == 1001 and kept.where("text = 'same text'").first().doc_id == 1
    assert exact_dedup.exact_groups(df.limit(0)).isEmpty()


def print_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_by_hand(prints):
    """doc -> smallest doc that it reaches by links of at most 3 bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    r = random.Random(3)
    texts = list(ODD)
    for k in range(25):
        base = prose(100 + k, 300).split()
        for _ in range(4):
            copy = list(base)
            copy[r.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    df = docs(spark, texts, clash=True)
    got = {x.doc_id: x for x in simhash.simhash_groups(df).collect()}
    prints = {i: print_by_hand(t) for i, t in enumerate(texts)}
    assert {i: int(x.fingerprint, 16) for i, x in got.items()} == prints and all(len(x.fingerprint) == 16 for x in got.values())
    assert {i: x.component_id for i, x in got.items()} == roots_by_hand(prints)
    kept = simhash.simhash_dedup(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(roots_by_hand(prints).values())
    assert simhash.simhash_groups(df.limit(0)).isEmpty()


def test_long_text_in_pieces(monkeypatch):
    text = prose(5, 3000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == whole == print_by_hand(text)


@pytest.mark.parametrize(("chunk", "few"), [(4, 2), (1024, 2), (1024, 8), (16, 1000)])
def test_links_of_close_fingerprints(spark, chunk, few):
    """Many fingerprints around a few centres: hot keys, met in chunks or joined, link what all pairs would."""
    r = random.Random(11)
    centres = [r.getrandbits(64) for _ in range(4)]
    prints = set()
    for k in range(240):
        fp = centres[k % 4]
        for _ in range(r.randrange(6)):
            fp ^= 1 << r.randrange(64)
        prints.add(fp - (1 << 64) if fp >> 63 else fp)
    links = simhash.links(spark.createDataFrame([(fp,) for fp in prints], "fp long"), chunk, few)
    found = dict(map(tuple, common.components(links).collect()))
    assert {k: found.get(k, k) for k in prints} == roots_by_hand({k: k % (1 << 64) for k in prints})
    assert few > 8 or links.count() < 20 * len(prints) * 30


REPEATED = [
    (1, "same"), (3, "same"), (3, "unique text of id three"), (4, "a"), (1, "same"), (2, "same"), (None, "same"), (None, "alone without id"),
    (None, "alone without id"), (None, None), (7, ""), (8, "a  b"), (8, "a b"), (9, "a b"), (10, prose(4, 200)), (10, prose(5, 200)), (11, prose(5, 200)),
]


def one_a_group(rows, group):
    """The rows that stay: of each group the one with the smallest id, null last."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[group(i, t)].append((i is None, i or 0))
    return sorted(str(min(g)) for g in groups.values())


def test_dedup_judges_rows(spark):
    """Repeated ids, rows and null ids: no text is lost, and no group keeps two rows."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    for rows in (REPEATED, REPEATED[::-1]):
        df = docs(spark, [(i, t, None, f"s{k}") for k, (i, t) in enumerate(rows)], clash=True)
        kept = exact_dedup.exact_dedup(df)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert kept.columns == df.columns and {norm(t) for _, t in got} == {norm(t) for _, t in rows}
        assert sorted(str((i is None, i or 0)) for i, _ in got) == one_a_group(rows, lambda i, t: norm(t))
        assert sorted(map(str, exact_dedup.exact_dedup(df, few=0).select("doc_id").collect())) == sorted(map(str, kept.select("doc_id").collect()))
        near = [(r.doc_id, r.text) for r in simhash.simhash_dedup(df).collect()]
        prints = {t: print_by_hand(t) for _, t in rows}
        assert {prints[t] for _, t in near} <= set(prints.values())
        roots = roots_by_hand({p: p for p in prints.values()})
        assert sorted(str((i is None, i or 0)) for i, _ in near) == one_a_group(rows, lambda i, t: roots[prints[t]])


def test_null_ids_link(spark):
    """Two documents that only a row without an id links are one component, whose name is the smaller id."""
    base = prose(40, 400).split()
    steps = [list(base)]
    while len(steps) < 40:
        steps.append([*steps[-1]])
        steps[-1][len(steps) * 7 % 400] = f"new{len(steps)}"
    prints = [print_by_hand(" ".join(s)) for s in steps]
    apart = lambda a, b: bin(prints[a] ^ prints[b]).count("1")
    chain = next((a, b, c) for a in range(40) for b in range(40) for c in range(40) if apart(a, b) <= 3 and apart(b, c) <= 3 and apart(a, c) > 3)
    rows = [(5, " ".join(steps[chain[0]]), None, None), (None, " ".join(steps[chain[1]]), None, None), (4, " ".join(steps[chain[2]]), None, None)]
    assert {r.component_id for r in simhash.simhash_groups(docs(spark, rows)).collect()} == {4}


def test_components(spark):
    r = random.Random(1)
    chain = [(k, k + 1) for k in range(40)]
    web = [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(80)]
    links = chain + web + [(7, 7), (300, 301), (301, 300)]
    nodes = {x for e in links for x in e}
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, common.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {n: got.get(n, n) for n in nodes} == root
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).isEmpty()
