"""Line rules against a plain count."""

from __future__ import annotations

import re
from collections import Counter

from helpers import ODD, docs, prose

from antibiogram.llm.line_rules import line_filter, line_rules, without_common_lines

SPACE = r"[\x20\x09-\x0d]+"


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t)


def by_hand(rows, max_docs, max_share, max_loss):
    docs_of, hosts = Counter(), Counter()
    lines = lambda t: [re.sub(r"[\x20\x09\x0b-\x0d]+", " ", x.lower()).strip(" ") for x in t.split("\n")]
    for _, t, host in rows:
        own = {x for x in lines(t or "") if x}
        docs_of.update((host or "", x) for x in own)
        hosts[host or ""] += bool(own)
    out = []
    for i, t, host in rows:
        t = t or ""
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        own = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        common = [x for x in lines(t) if x and docs_of[host or "", x] > max(max_docs, max_share * hosts[host or ""])]
        lost = sum(len(x.split(" ")) for x in common)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered), failed, not failed and lost <= max_loss * len(w), len(common), lost))
    return sorted(out, key=str)


def test_line_rules(spark):
    rows = [(k, t, f"h{k % 2}" if k % 5 else None) for k, t in enumerate(ODD)]
    for k in range(30):
        shared = "Shared line of words, " * 12
        rows.append((100 + k, prose(k, 60) + "\n" + shared + "\n" + prose(k, 30), "h1"))
        rows.append((200 + k, f"only {k}\nCommon  text HERE " + prose(77, 150).replace("\n", " ") + "\n" + prose(k, 50), "h2"))
        rows.append((300 + k, prose(500, 70), "h3"))  # copies are documents, so their line is common
        rows.append((400 + k, prose(k, 25) + " | # $ " + prose(k, 25), "h4"))
    rows += [(None, prose(9, 90), "h1"), (None, prose(9, 90), "h1"), (100, prose(0, 60), "h1")]
    df = docs(spark, [(i, t, None, h) for i, t, h in rows], clash=True)
    for share in (0.0, 0.1):
        limits = {"max_docs": 10, "max_share": share, "max_loss": 0.5}
        for few in (100_000, 2, 0):  # common lines as hash tables, some broadcast and the others joined by shuffle, all joined by shuffle
            got = sorted((tuple(r) for r in line_rules(df, broadcast_rows=few, **limits).collect()), key=str)
            assert got == by_hand(rows, **limits)
    assert {r[7] for r in got if 300 <= (r[0] or 0) < 330} == {False}
    assert any(not r[6] and not r[7] for r in got) and any(r[7] for r in got)
    assert line_rules(df.limit(0)).isEmpty()


def test_texts_without_common_lines(spark):
    rows = [(k, t, f"h{k % 2}") for k, t in enumerate([*ODD[:6], *ODD[7:]])]
    for k in range(30):
        rows.append((100 + k, f"Menu  | Home\n\n{prose(k, 60)}\n menu | HOME\r\n \t\n{prose(1000 + k, 30)} Tail\nAll rights reserved\n", "h1"))
        rows.append((200 + k, "Common line\n" + prose(k, 5) + "\nAnother common one", "h2"))
        rows.append((300 + k, "common  LINE\nmenu | home\nCommon line", None))
    rows += [(None, "Menu | Home\n" + prose(9, 90), "h1"), (None, "kept\nMenu | Home\nlast", "h1"), (100, "Menu | Home\nthe id again", "h1"), (500, rows[-1][1], "h9"), (500, rows[-1][1], "h2")]
    rows += [(600, "Menu | Home\nCommon line\nown", "h1"), (600, "Menu | Home\nCommon line\nown", "h2")]  # id and text again, on another host
    df = docs(spark, [(i, t, None, h) for i, t, h in rows], clash=True)
    limits = {"max_docs": 10, "max_share": 0.1}
    norm = lambda x: re.sub(r"[\x20\x09\x0b-\x0d]+", " ", x.lower()).strip(" ")
    docs_of, hosts = Counter(), Counter()
    for _, t, h in rows:
        own = {x for x in map(norm, (t or "").split("\n")) if x}
        docs_of.update((h or "", x) for x in own)
        hosts[h or ""] += bool(own)
    common = {(h, x) for (h, x), n in docs_of.items() if n > max(10, 0.1 * hosts[h])}
    assert {("h1", "menu | home"), ("h1", "all rights reserved"), ("h2", "common line")} <= common
    clean = lambda t, h: None if t is None else "\n".join(x for x in t.split("\n") if (h or "", norm(x)) not in common)
    want = sorted(((i, clean(t, h), h) for i, t, h in rows), key=str)
    for paths in ({}, {"table_rows": 0}, {"broadcast_rows": 0}):  # hash tables, positions by broadcast, positions by shuffle
        out = without_common_lines(df, **limits, **paths)
        got = out.collect()
        assert out.columns == df.columns and all(r._h == "mine" for r in got)
        assert sorted(((r.doc_id, r.text, r.source) for r in got), key=str) == want
    verdicts = line_rules(df, **limits).collect()
    lost = sorted((str(r.doc_id), r.common_line_words) for r in verdicts)
    assert lost == sorted((str(i), len(words(t or "")) - len(words(clean(t, h) or ""))) for i, t, h in rows)
    kept = line_filter(df, **limits)
    got = kept.collect()
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in verdicts if r.kept)
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(want) and any(100 <= (r.doc_id or 0) < 130 and "menu" not in r.text.lower() for r in got)
