"""Packing, token attribution, license scans and the Merkle audit against plain versions and round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import ODD, docs, prose

from antibiogram.llm import license_scan as ls
from antibiogram.llm import licenses, merkle, packing
from antibiogram.llm import token_attribution as ta
from antibiogram.llm.queries import damaged, tokenizer

WORD_BPE = tokenizer("word_bpe_49k.json")
BYTE_BPE = tokenizer("byte_bpe_50k.tiktoken")
TRICKY = [
    "It's we'll THE'S don't.", "a1b2 3,4 x.y, (z) \"q\"|r", "<|endoftext|> in<|startoftext|>side", "İstanbul ΑΣ Σ ﬁ Å é", "a b c\x1cd\x85e", "# * $$ %% && !?!?",
    "naïve, café. ÉTÉ!! ça|va", "tab\tnew\nline\x0bv\x0cf",
]


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1]


def test_word_encoder_equals_whole_texts(spark, sf_dir):
    enc = packing.WordEncoder(WORD_BPE, 1, max_words=50)  # so few that most words are not kept
    some = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    for t in [*ODD[:5], *ODD[7:], *TRICKY, *some]:
        assert enc.encode(t).tolist() == whole_ids(t), t


def test_words_of_letters_go_to_the_model_alone():
    enc = packing.WordEncoder(WORD_BPE, 1, max_words=4)
    letters = "ÀÉÎÕÜßàéîõüÿÆæØøÞþÐð"
    texts = ["Straße, ÜBER señor Çaile!", "ü Ã¼ ü Ã¼", "Hello HELLO hello HeLLo", *(f"{a}{c}{b} {c}" for c in letters for a, b in (("", "x"), ("X", "")))]
    want = [whole_ids(t) for t in texts]
    for t, ids in zip(texts, want, strict=True):
        assert enc.encode(t).tolist() == ids, t
    enc.tokenizer = None  # none of these needs more than the model
    assert enc.encode("Zweifelhafte ÉTRÉTIONLE uncachedwords x").tolist() == whole_ids("Zweifelhafte ÉTRÉTIONLE uncachedwords x")


def test_word_encoder_of_a_file_that_keeps_cases(tmp_path):
    from tokenizers import Tokenizer, normalizers

    plain = Tokenizer.from_file(WORD_BPE)
    plain.normalizer = normalizers.NFC()
    path = str(tmp_path / "cases.json")
    plain.save(path)
    text = "Hello HELLO hello Über ÜBER."
    assert packing.WordEncoder(path, 1).encode(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_cut():
    for n in [*range(1, 5000, 7), 2047, 2048, 2049, 100_000]:
        parts = packing.cut(n)
        assert sum(size for size, _ in parts) == n
        for size, j in parts:
            slot = packing.CAPACITY // j
            assert 0 < size <= slot and (slot - size <= max(0.1 * slot, 16))
    assert packing.cut(1000) == [(1000, 2)] and len(packing.cut(900)) == 2  # nearly half a sequence is not cut
    assert sum(j - 1 for j in packing.DENOMINATORS) == 4540


def test_packing_of_text_ids_and_repeats(spark):
    """Ids that are no numbers, and one row many times."""
    rows = spark.createDataFrame([("x", "one two three")] * 400 + [(None, "one two three")] * 400 + [("y 1", "four")], "doc_id string, text string").repartition(7)
    got = packing.harmonic_pack(rows, WORD_BPE).collect()
    assert len(got) == 801 and {r.doc_id for r in got} == {"x", None, "y 1"}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(b)] == np.cumsum([0, *[n for _, n in sorted(b)]])[:-1].tolist() and sum(n for _, n in b) <= packing.CAPACITY for b in bins.values())


def test_packing(spark):
    texts = [*ODD, *TRICKY, *[prose(k, 5 + 37 * k % 900) for k in range(120)]]
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(None, "no id", None, None), (3, "a", None, None), (2**60 + 1, "large id", None, None)]
    df = docs(spark, rows, clash=True)
    got = packing.harmonic_pack(df, WORD_BPE).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, whole_ids(t))
    pieces, bins = {}, {}
    for r in got:
        own = np.array(ids[r.doc_id], "<u4")
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, spans in pieces.items():
        covered = sorted(p for s, n in spans for p in range(s, s + n))
        assert covered == sorted(list(range(len(ids[i]))) * sum(x[0] == i for x in rows))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    tokens = sum(r.length for r in got)
    padding = sum(packing.CAPACITY - sum(n for _, n in b) for b in bins.values())
    assert padding <= packing.CAPACITY + 0.02 * tokens
    assert packing.harmonic_pack(df.limit(0), WORD_BPE).isEmpty()


def attributed_by_hand(text, sections, rule):
    """Tokens of each section, one token at a time over characters' bytes."""
    enc = ta.encoder(BYTE_BPE)
    bounds = enc.bounds(text)
    at = np.cumsum([0] + [len(c.encode()) for c in text])
    spans = [(at[a], at[b]) for a, b in sections]
    out, lost = [0] * len(spans), 0
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = [max(0, min(hi, e) - max(lo, s)) for s, e in spans]
        if rule == "first":
            k = next((k for k, (s, e) in enumerate(spans) if s <= lo < e), None)
        else:
            k = part.index(max(part)) if part and max(part) else None
        if k is None:
            lost += 1
        else:
            out[k] += 1
    return out, lost


@pytest.mark.parametrize("rule", ["most", "first"])
def test_attribution(spark, rule):
    r = random.Random(4)
    texts = [t for t in [*ODD, *TRICKY, "one\ntwo\n\nthree\n", "\n\n"] if t and len(t) < 2000]
    rows, sections, want = [], [], {}
    for k, t in enumerate(texts):
        rows.append((k, t, None, None))
        cuts = sorted(r.sample(range(len(t) + 1), min(6, len(t) + 1)))
        own = [(a, b) for a, b in list(zip(cuts, cuts[1:], strict=False))[::2]]
        sections += [(k, n, a, b) for n, (a, b) in enumerate(own)]
        want[k] = attributed_by_hand(t, own, rule)
    rows.append((None, "one two", None, None))  # its tokens are counted, but no section of a null id is its own
    df = docs(spark, rows, clash=True)
    spans = spark.createDataFrame([*sections, *[(None, n, 0, 3) for n in range(3)]], "doc_id long, section long, start long, end long")
    got = ta.section_tokens(df, BYTE_BPE, spans, rule).collect()
    for k, (counts, lost) in want.items():
        mine = {x.section: x.n_tokens for x in got if x.doc_id == k}
        assert mine.pop(None, 0) == lost and [mine[n] for n in range(len(counts))] == counts
    nameless = [(x.section, x.n_tokens) for x in got if x.doc_id is None]
    assert nameless == [(None, len(ta.encoder(BYTE_BPE).bounds("one two")) - 1)]
    by_line = ta.section_tokens(docs(spark, [(k, t, None, None) for k, t in enumerate([*ODD, *texts])]), BYTE_BPE, rule=rule)
    total = {x.doc_id: x.n for x in by_line.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    for k, t in enumerate([*ODD, *texts]):
        assert total.get(k, 0) == (len(ta.encoder(BYTE_BPE).bounds(t)) - 1 if t else 0)
    assert by_line.where("section IS NULL").isEmpty() and ta.section_tokens(df.limit(0), BYTE_BPE).isEmpty()


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def patience_by_hand(a, b, before=False, behind=False):
    """How many words a plain recursive patience alignment matches, with the longest of all anchor chains."""
    if not a or not b:
        return 0
    once = [(a.index(w), b.index(w)) for w in set(a) & set(b) if a.count(w) == b.count(w) == 1]
    chains = [()]
    for x in sorted(once):
        chains += [(*c, x) for c in chains if not c or c[-1][1] < x[1]]
    most = max(map(len, chains))
    if most:
        # Which of equally long chains is taken is open; the operator's own must be among them.
        mine = ls.anchors(a, 0, len(a), b, 0, len(b))
        assert len(mine) == most and tuple(mine) in chains
        total, last = most, (-1, -1)
        for k, (i, j) in enumerate([*mine, (len(a), len(b))]):
            total += patience_by_hand(a[last[0] + 1 : i], b[last[1] + 1 : j], before or k > 0, behind or k < most)
            last = (i, j)
        return total
    if (before or not behind) and a[0] == b[0]:
        return 1 + patience_by_hand(a[1:], b[1:], before, behind)
    if (behind or not before) and a[-1] == b[-1]:
        return 1 + patience_by_hand(a[:-1], b[:-1], before, behind)
    return 0


def test_increasing_and_alignment():
    r = random.Random(9)
    for _ in range(300):
        order = r.sample(range(12), 12)
        best = ls.increasing(list(enumerate(order)))
        tails = [1] * 12
        for i in range(12):
            tails[i] = 1 + max([tails[j] for j in range(i) if order[j] < order[i]], default=0)
        assert len(best) == max(tails) and all(a < c and b < d for (a, b), (c, d) in zip(best, best[1:], strict=False))
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(14))] for _ in range(2))
        pairs = ls.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= longest_common(a, b) and len(pairs) >= patience_by_hand(a, b)
    assert ls.align("permission x permission is hereby".split(), "permission is hereby".split())[0] == (2, 0)  # the stray one is left


def test_scan_against_every_window():
    """Every stretch that aligns is found or lies over a finding, and every finding aligns."""
    r = random.Random(12)
    t = ls.template("T", "released under the [[blue license]] version")
    for case in range(150):
        text = " ".join(r.choice(["released", "under", "the", "blue license", "blue", "license", "version", "noise", "other", "released under the blue license version"]) for _ in range(r.randrange(4, 18)))
        words = ls.normal_words(text)
        units = [u for u, _, _ in ls._units(text, words, t)]
        threshold = r.choice([0.6, 0.8])
        found = ls.find(units, t, threshold) if units else []
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))

        def aligned(s, e):
            pairs = ls.align(units[s:e], t.units)  # noqa: B023
            size = sum(t.units[j].count(" ") + 1 for _, j in pairs)
            return size if "blue license" in {t.units[j] for _, j in pairs} and size >= threshold * t.words else 0  # noqa: B023

        for s, e, size in found:
            assert size == aligned(s, e) or any(aligned(s, x) == size for x in range(e, len(units) + 1))
        for s in range(len(units)):
            for e in range(s + 1, min(len(units), s + 2 * len(t.units)) + 1):
                if aligned(s, e):
                    assert any(s < b and a < e for a, b, _ in found), (case, text, s, e)


def test_license_scan(spark):
    mit, gpl = licenses.TEXTS["MIT"][0], next(t for n, t in licenses.templates() if n == "GPL-3.0-or-later").replace("[[", "").replace("]]", "")
    near = gpl.replace("Free Software Foundation", "Free Software Fund").upper()
    texts = [*ODD, prose(1, 300) + "\n" + mit + "\n" + prose(2, 300), near, mit + " " + prose(3, 50) + " " + mit, " ".join(mit.split()[:10]), "licensed under CC-BY-NC 4.0 today", "under the licensed licensed apache of version of"]
    df = docs(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(None, mit, None, None)], clash=True)
    found = ls.license_scan(df).collect()
    n = len(ODD)
    assert sorted([(r.doc_id, r.license) for r in found], key=str) == sorted([(n, "MIT"), (n + 1, "GPL-3.0-or-later"), (n + 2, "MIT"), (n + 2, "MIT"), (n + 4, "CC-BY-NC-4.0"), (None, "MIT")], key=str)
    spans = {r.doc_id: (r.start, r.end, r.coverage) for r in found}
    start, end, coverage = spans[n]
    assert texts[n][start:end] == mit and coverage == 1.0 and 0.8 <= spans[n + 1][2] < 1
    assert ls.license_scan(df.limit(0)).isEmpty()
    own = ls.license_scan(df, {"mine": "some words of [[my own]] license"})
    assert own.isEmpty()


KNOWN = [ls.template(*t) for t in licenses.templates()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the Apache License.", ["Apache"]),
        ("Released under the BSD License.", ["BSD"]),
        ("Released under the Zope License.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]),
        ("// SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
        ("SPDX-License-Identifier: MIT-0", ["MIT-0"]),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", []),
        ("Distributed under the MIT License. Released under the MIT License.", ["MIT", "MIT"]),
        ("permission given. " + licenses.TEXTS["MIT"][1], ["MIT"]),
        (licenses.TEXTS["BSD-2-Clause"][0], ["BSD-2-Clause"]),
        (licenses.TEXTS["BSD-3-Clause"][0].replace("[[", "").replace("]]", ""), ["BSD-3-Clause"]),
    ],
)
def test_right_licenses(text, want):
    found = ls.scan(text, KNOWN)
    assert [f[0] for f in found] == want
    assert not text.startswith("permission") or text[found[0][3] :].startswith("Permission is hereby")


def test_every_template_finds_its_license():
    for (name, text), t in zip(licenses.templates(), KNOWN, strict=True):
        plain = text.replace("[[", "").replace("]]", "")
        assert [f[0] for f in ls.scan(f"word {plain} word", KNOWN)] == [name], (name, t)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, slot string, digest string")


def test_merkle_audit(spark, tmp_path):
    rows = [(k, f"u{k}", prose(k, 30), "x", "y") for k in range(2500) if k % 7] + [(None, None, None, "x", "y"), (3000, None, "", "x", "y"), (3001, "u", None, "x", "y"), (3002, "u", "twice", "x", "y"), (3002, "u", "again", "x", "y")]
    bad = {5: ("corrupt", "changed"), 1024: ("corrupt", ""), 2000: ("missing", None), 2498: ("missing", None)}
    theirs = [(k, u, bad[k][1] if k in bad else h, s, d) for k, u, h, s, d in rows if bad.get(k, ("",))[0] != "missing"]
    theirs.append((7, "u7", "added", "x", "y"))
    ours = merkle.tree(pages(spark, rows))
    same = merkle.tree(pages(spark, random.Random(2).sample(rows, len(rows))))
    assert merkle.audit(ours, same).isEmpty()
    got = {(r.warc_file, r.slot): r for r in merkle.audit(ours, merkle.tree(pages(spark, theirs))).collect()}
    want = {(k // 1024, k % 1024): s for k, (s, _) in bad.items()} | {(0, 7): "extra"}
    assert {k: r.status for k, r in got.items()} == want and {r.records for r in got.values()} == {1}
    # Offsets: where the record begins in the written file.
    path = str(tmp_path / "warc")
    merkle.write_warc(pages(spark, rows), path)
    import glob

    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/warc_file=1/*.txt")))
    r = got[1, 2000 - 1024]
    record = data[r.offset : r.offset + r.bytes]
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:2000>") and record.endswith(b"\r\n\r\n") and got[0, 7].offset is None
    none = merkle.tree(pages(spark, []))
    assert merkle.audit(none, none).isEmpty() and merkle.audit(ours, none).agg({"records": "sum"}).first()[0] == ours[0].count()


def test_repeated_and_null_keys(spark):
    """Each lost, added or altered record of a key that many have, or of none, is told; negative keys are not null ones."""
    many = [(7, "u", f"version {k}", "x", "y") for k in range(50)] + [(7, "u", "same", "x", "y")] * 50
    null = [(None, "u", f"page {k}", "x", "y") for k in range(50)]
    rows = [*many, *null, (-1, "u", "minus one", "x", "y"), (8, "u", "eight", "x", "y"), (9, "u", "nine", "x", "y")]
    lost = [many[3], null[4], null[5]]
    theirs = [r for r in rows if r not in lost and r[0] not in (-1, 8)]
    theirs.remove(many[-1])
    theirs += [(None, "u", "new", "x", "y"), (8, "u", "8", "x", "y"), (-1, "u", "minus one", "x", "y"), (9, "u", "nine", "x", "y"), (9, "u", "nine", "x", "y")]
    found = merkle.audit(merkle.tree(pages(spark, rows)), merkle.tree(pages(spark, theirs))).collect()
    got = sorted((r.warc_file, r.slot, r.status, r.records) for r in found)
    n = merkle.NULL_FILE
    assert got == sorted([(0, 7, "missing", 1), (0, 7, "missing", 1), (n, 0, "missing", 1), (n, 0, "missing", 1), (n, 0, "extra", 1), (0, 8, "corrupt", 1), (0, 9, "extra", 2)])


def test_damaged_replica(spark):
    p = spark.createDataFrame([(k, "u", "h") for k in range(300)], "page_id long, url string, html string")
    got = damaged(p)
    assert got.columns == p.columns and got.where("page_id = 11").isEmpty() and got.where("page_id = 13").count() == 2
