r"""SimHash near-dedup by pigeonhole blocks.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, 3-word shingles with repeats, XXH64 (seed 42) of each; a bit
is 1 if set in over half the hashes. Fewer than three words: the whole sequence is the one shingle; none: zero.

Links: fingerprints at most 3 bits apart. The 64 bits are cut into 6 blocks; two such fingerprints agree on 3 blocks at
least, so each of the 20 choices of 3 blocks is a key of 31 to 33 bits and close pairs meet under one of them. Texts with
one fingerprint are one class from the start. Keys of up to ``FEW`` classes are settled by native expressions over their few classes;
classes of a key that has more meet in chunks of at most 2 x 1024 (pairs of chunks, where a key has more than one), and
each meeting returns the links of a spanning forest, never all pairs: the classes that the links connect are the same.
A key of more than ``SPLIT`` classes is split by the same rule once more: the bits outside its three blocks are cut into
six parts, three of which agree, so its classes meet under sub-keys that fix another half of these bits.
Components of fingerprints follow by star contraction on tables in the shared folder.

Scale: a document moves as (id, fingerprint); a fingerprint as 20 keys of 16 bytes, first counted with a partial sum and
kept only where a key has two. Hot keys are never joined, and their classes are dealt by their sub-keys. Python sees only
keys of more than ``FEW`` classes. A hot fingerprint is dealt over
partitions by ``common.lookup``, as are the links of a large component.

Edge cases: a null text counts as empty; documents without words share fingerprint zero and are linked like any others;
texts of any length are hashed in pieces of 65536 shingles; repeated rows each get their row; rows with a null id are
linked like others and get the smallest id of their component (null where it has none); an empty table gives an empty
table. ``simhash_dedup`` keeps exactly one row of each component: it decides about (id, text), so rows that share an id
but not the component are judged apart, and of rows that share both one stays; a null id comes last. Ids may be of any
type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_KEYS, components, lookup, small_batches, table, text_key, without

SEED = 42
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit and width
MAX_BITS = 3
CHOICES = tuple(combinations(BLOCKS, len(BLOCKS) - MAX_BITS))
FEW = 8
CHUNK = 1024
SPLIT = 4096
PIECE = 1 << 16
_ONES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, PIECE):
        part = w[at : min(at + PIECE, n) + words - 1]
        grams = zip(*(part[k:] for k in range(words)), strict=False) if len(w) >= words else [part]
        h = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64)
        b = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(b[:, k], minlength=256) @ _ONES
    return int(sum(1 << k for k in range(64) if 2 * int(ones[k]) > n))


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series(np.array([fingerprint(x) for x in t], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(_id, _k, fp) with the fingerprint's 64 bits as a signed long; ``_k`` is ``key``."""
    small_batches(docs.sparkSession)
    key = F.lit(None).cast("binary") if key is None else key
    return docs.select(F.col(id_col).alias("_id"), key.alias("_k"), F.pandas_udf(_fingerprints, "long")(F.col(text_col)).alias("fp"))


def _block(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def _packed(fp: Column, parts: tuple[tuple[int, int], ...], above: Column) -> Column:
    """The bits of these parts, behind those of ``above``."""
    for first, width in parts:
        above = F.shiftleft(above, width).bitwiseOR(_block(fp, first, width))
    return above


def block_keys(fp: str = "fp") -> Column:
    """The 20 keys of a fingerprint: which three blocks, above 33 bits, and their bits."""
    tops = [F.lit(t << 33 >> sum(w for _, w in chosen)) for t, chosen in enumerate(CHOICES)]
    return F.array(*[_packed(F.col(fp), chosen, top.cast("long")) for chosen, top in zip(CHOICES, tops, strict=True)])


def sub_keys(fp: str = "fp", key: str = "key") -> Column:
    """The 20 keys of a fingerprint among those that share ``key``: its bits outside the key, in six parts of 5 or 6, three of
    which agree as well. 16 bits or so are left, so a sub-key has at most 2 ** 18 fingerprints, however many a key has."""
    left = [_packed(F.col(fp), tuple(b for b in BLOCKS if b not in chosen), F.lit(0).cast("long")) for chosen in CHOICES]
    rest = F.element_at(F.array(*left), (F.shiftrightunsigned(F.col(key), 33) + 1).cast("int"))
    parts = list(combinations([(6 * k, 6) for k in range(6)], 6 - MAX_BITS))
    return F.transform(F.array(rest), lambda r: F.array(*[_packed(r, chosen, F.lit(t).cast("long")) for t, chosen in enumerate(parts)]))[0]


def forest(fp: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(fingerprint, smallest one that it reaches) by links among these, for all but the smallest ones.

    Grows one component at a time from its smallest member: every step takes out of the rest whatever is near the frontier.
    """
    fp = np.sort(fp.astype(np.int64))
    bits = fp.view(np.uint64)
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(bits[left] ^ bits[frontier.pop()]) <= max_bits
            hit = left[near]
            if len(hit):
                out += [(int(fp[i]), int(fp[root])) for i in hit]
                frontier += hit.tolist()
                left = left[~near]
    return out


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(forest(rows["fp"].to_numpy()), columns=["a", "b"]).astype("int64")


def _settled(rows: DataFrame, chunk: int, few: int) -> DataFrame:
    """The links of rows (fp, key, sub, n), n being the fingerprints of (key, sub), which lie in one task each."""
    small = rows.where(F.col("n") <= few).groupBy("key", "sub").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    behind = lambda x, i: F.filter(F.slice("fps", i + 2, few), lambda y: F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS)
    close = small.select(F.explode(F.flatten(F.transform("fps", lambda x, i: F.transform(behind(x, i), lambda y: F.struct(y.alias("a"), x.alias("b")))))).alias("l"))
    large = rows.where(F.col("n") > few).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.struct(F.least(own, d).alias("lo"), F.greatest(own, d).alias("hi"))
    )
    met = large.select("key", "sub", "fp", F.explode(meets).alias("meet")).groupBy("key", "sub", "meet").applyInPandas(lambda rows: _meet(rows), "a long, b long")
    return close.select("l.a", "l.b").union(met)


def _counted(keyed: DataFrame) -> DataFrame:
    """Rows (fp, key, sub) with ``n``, where another fingerprint has the key. The join deals the rows by key, so the few of a key
    come together without another shuffle."""
    shared = keyed.groupBy("key", "sub").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return keyed.join(shared.hint("shuffle_hash"), ["key", "sub"])


def links(prints: DataFrame, chunk: int = CHUNK, few: int = FEW, split: int = SPLIT) -> DataFrame:
    """(a, b) links that connect what fingerprints at most 3 bits apart connect; ``prints`` has distinct fp.

    Keys of more than ``split`` fingerprints are not joined: their list, at most FEW_KEYS of them, is broadcast, and their
    fingerprints meet under sub-keys instead."""
    keyed = prints.select("fp", F.explode(block_keys()).alias("key"))
    split = max(split, len(CHOICES) * prints.count() // FEW_KEYS)
    hot = table(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split).select("key"))
    cold = keyed
    found = []
    if not hot.isEmpty():
        cold = keyed.join(F.broadcast(hot), "key", "left_anti")
        below = keyed.join(F.broadcast(hot), "key", "left_semi").select("fp", "key", F.explode(sub_keys()).alias("sub"))
        found.append(_settled(_counted(below), chunk, few))
    found.append(_settled(_counted(cold.withColumn("sub", F.lit(0).cast("long"))), chunk, few))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def _classes(docs: DataFrame, id_col: str, text_col: str, key: Column | None) -> DataFrame:
    """_id, _k, fp, and of its component _keep and _keep_k (smallest id, null last, and the smallest key with it), for each row."""
    prints = table(fingerprints(docs, id_col, text_col, key))
    first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_k"))
    classes = table(prints.groupBy("fp").agg(first.alias("f"), F.count("*").alias("n")))
    # Fingerprints are the nodes, since ids may be null or repeated; a component's name is found afterwards.
    roots = table(components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "root"))
    names = classes.join(roots, "fp").groupBy("root").agg(F.min("f").alias("c"))
    named = classes.join(roots.join(names, "root").select("fp", "c"), "fp", "left").select("fp", "n", F.coalesce("c", "f").alias("c"))
    found = lookup(prints, named, "fp", "n", F.monotonically_increasing_id(), prints.count())
    return found.select("_id", "_k", "fp", F.col("c._id").alias("_keep"), F.col("c._k").alias("_keep_k"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id that it reaches)."""
    found = _classes(docs, id_col, text_col, None)
    return found.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_keep").alias("component_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that of the smallest id (null last), then of any of the
    rows that share this id and text."""
    found = table(_classes(docs, id_col, text_col, text_key(F.col(text_col))))
    stays = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_k") == F.col("_keep_k"))
    tied = found.where(stays).groupBy("_id", "_k").count().where("count > 1")
    return without(docs, found.where(~stays), id_col, text_col, tied)
