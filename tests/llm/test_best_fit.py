"""Best-two-fit packing: ids, pieces and places by hand; plans against bin-by-bin packing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, docs, prose
from pyspark.sql import functions as F

from antibiogram.llm import best_fit
from antibiogram.llm.queries import op12_best_two_fit, tokenizer

PATH = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(PATH))


def check(rows, texts, plain, capacity=2048):
    """Every id in one piece, cuts only where a document is longer than a sequence, no gap and no overflow."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*plain.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) for r in own)
        assert all(r.length == capacity for r in own[1:])
    for own in by_seq.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_seq)


def test_encoder_equals_tokenizers(plain):
    enc = best_fit.encoder(tokenizer(PATH), 0)
    assert enc.fast is not None
    r = random.Random(5)
    alphabet = [*"ab  \n\t\r'.,1 ²", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "ß", "漢", "\U0001f600", "́", "'s", "'ll", "<|endoftext|>", "  \n"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        assert enc.encode(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], repr(text)
    assert best_fit.ByteEncoder(tokenizer("word_bpe_49k.json"), 0).fast is None


def bins_one_by_one(lengths, capacity):
    """The method as it is told, a bin at a time over single pieces."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        taken, room = [], capacity
        for x in list(left):
            if x <= room:
                taken.append(x)
                left.remove(x)
                room -= x
        if room and len(taken) > 1:
            small = min(taken)
            best = max(((a + b, a, b) for k, a in enumerate(left) for b in left[k + 1 :] if small < a + b <= room + small), default=None)
            if best:
                taken.remove(small)
                taken += best[1:]
                left.remove(best[1])
                left.remove(best[2])
                left = sorted([*left, small], reverse=True)
        bins.append(taken)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_as_good_as_bin_by_bin(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 100])
    lengths = [min(capacity, max(1, int(r.expovariate(1 / r.choice([5, 20, 40]))))) for _ in range(r.randrange(1, 300))]
    bins = best_fit.plan(Counter(lengths), capacity)
    assert Counter(x for k, b in bins for x in b for _ in range(k)) == Counter(lengths) and all(sum(b) <= capacity for _, b in bins)
    n, by_hand = sum(k for k, _ in bins), len(bins_one_by_one(lengths, capacity))
    assert -(-sum(lengths) // capacity) <= n <= by_hand + 1
    spots = best_fit.places(bins)
    assert Counter({x: sum(s[2] for s in spots if s[0] == x) for x in set(lengths)}) == Counter(lengths)


def test_two_replace_the_smallest():
    # 6 and 3 fill 9 of 10; 2 and 2 take the place of 3
    assert best_fit.plan({6: 1, 3: 2, 2: 2}, 10)[0][1] in ([6, 3], [6, 2, 2])
    assert best_fit.fill(np.array([0, 0, 0, 0, 2, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0]), 15) == Counter({7: 1, 4: 2})
    assert best_fit.fill(np.array([0] * 60 + [1] + [0] * 9 + [1] + [0] * 30), 100) == Counter({70: 1})


def test_plan_is_short():
    r = random.Random(4)
    counts = {x: r.randrange(1, 10**9) for x in range(1, 2049)}
    bins = best_fit.plan(counts)
    assert len(bins) < 20_000 and sum(len(b) for _, b in bins) < 200_000
    assert sum(k for k, _ in bins) <= 1.01 * sum(x * n for x, n in counts.items()) / 2048


def test_packs_odd_rows(spark, plain):
    texts = dict(enumerate([*ODD, *[prose(k, 10 * k) for k in range(60)], "<|endoftext|> here"]))
    df = docs(spark, [(i, t, None, None) for i, t in texts.items()], clash=True).withColumns({c: F.lit("mine") for c in ("piece", "task", "nth", "rank", "lowest", "base", "offset")})
    packed = best_fit.best_two_fit(df.repartition(5), tokenizer(PATH))
    assert dict(packed.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    check(packed.collect(), texts, plain)
    assert best_fit.best_two_fit(df.limit(0), tokenizer(PATH)).isEmpty()
    again = docs(spark, [(None, "a b", None, None), (None, "a b", None, None), (3, "c", None, None), (3, "c", None, None)])
    rows = best_fit.best_two_fit(again, tokenizer(PATH)).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None", "None"] and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_query_over_documents(spark, sf_dir, plain):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op12_best_two_fit(spark, sf_dir).collect()
    n = check(rows, texts, plain)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2
