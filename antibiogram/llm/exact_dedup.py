"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts are equal when identical after every run of white space becomes one space; null counts as empty. Only DataFrame
functions are used.

Scale: what is shuffled of every row is (id, hashes). Texts move only where their hash occurs twice, and as the smallest
and the largest text of each (task, hash): a group is free of collisions exactly if these two agree over all tasks, so a
group of any size costs each task one row. Hashes that occur twice are broadcast to the texts up to ``few`` of them;
beyond that a bitmap of them is, 16 bits a hash and ``MAX_BITS`` at most (128 MB), and lets pass every text of such a hash
and one in seventeen of the others, or more where the hashes are over 67 million. Rows learn their group through
``common.lookup``, which deals out hot groups by their rows' places in the written table of hashes.

Edge cases: null or empty texts form one group; repeated rows count in ``group_size``, and ``exact_groups`` marks each row
that has the smallest id as kept, since it tells rows apart by their id; rows with a null id never displace others and
are marked as kept where no row of their group has an id; an empty table gives an empty table; further columns are
ignored, whatever their names. ``exact_dedup`` keeps exactly one row of each group: it decides about (id, text), so rows
that share an id but not the text are judged apart, and of rows that share both one stays; a null id comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_KEYS, SPACE, lookup, table, text_key, without

#: Bits of one bitmap of Spark's bitmap functions, and of all that are broadcast.
BITMAP_BITS, MAX_BITS = 1 << 15, 1 << 30


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE}+", " ")


def _first_row(*cols: str) -> Column:
    """The smallest row by its id, null last, then by the other columns."""
    return F.min(F.struct(F.col("_id").isNull().alias("no_id"), *[F.col(c) for c in ("_id", *cols)]))


def _groups(docs: DataFrame, id_col: str, text_col: str, hasher: Callable[[Column], Column], few: int, key: bool) -> DataFrame:
    """_id, _sha, _k (the raw text's key, if asked for), _keep, _keep_k and _n of the group, for each row of ``docs``."""
    # Once the text is hashed, a row is its id and hashes.
    hashed = docs.select(F.col(id_col).alias("_id"), _normal(text_col).alias("_t"), (text_key(F.col(text_col)) if key else F.lit(None).cast("binary")).alias("_k"))
    prints = table(hashed.select("_id", hasher(F.col("_t")).alias("_h"), F.sha2("_t", 256).alias("_sha"), "_k"))
    sizes = table(prints.groupBy("_h").agg(_first_row("_k").alias("f"), F.count("*").alias("_n")).select("_h", "_n", F.col("f._id").alias("_keep"), F.col("f._k").alias("_keep_k")))
    found = lookup(prints, sizes, "_h", "_n", F.monotonically_increasing_id(), prints.count()).drop("_salt")
    twice = sizes.where("_n > 1").select("_h")
    texts = docs.select(_normal(text_col).alias("_t")).withColumn("_h", hasher(F.col("_t")))
    n = twice.count()
    texts = texts.join(F.broadcast(twice), "_h", "left_semi") if n <= few else _maybe_in(texts, twice, n)
    odd = texts.groupBy("_h").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).where("lo <> hi").select("_h")
    odd = table(odd)
    if odd.isEmpty():
        return found
    return found.join(odd, "_h", "left_anti").unionByName(_told_apart(hashed, hasher, odd))


def _maybe_in(rows: DataFrame, hashes: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows whose ``_h`` is among n ``hashes``, and few others: a bit for each hash, in bitmaps of 4 kB that are broadcast."""
    bits = BITMAP_BITS
    while bits < min(16 * n, max_bits):
        bits *= 2
    bit = F.pmod(F.xxhash64("_h"), F.lit(bits))
    number, at = F.floor(bit / BITMAP_BITS), (bit % BITMAP_BITS).cast("long")
    maps = hashes.select(number.alias("_map"), at.alias("_at")).groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"_map": number, "_at": at}).join(F.broadcast(maps), "_map")
    return found.where(F.getbit(byte, F.col("_at").bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def _told_apart(hashed: DataFrame, hasher: Callable[[Column], Column], odd: DataFrame) -> DataFrame:
    """Rows whose hash stands for several texts, grouped by the text itself."""
    rows = hashed.withColumn("_h", hasher(F.col("_t"))).join(odd, "_h", "left_semi").withColumn("_sha", F.sha2("_t", 256))
    sizes = rows.groupBy("_h", "_t").agg(_first_row("_k").alias("f"), F.count("*").alias("_n"))
    both = rows.join(sizes, ["_h", "_t"])
    return both.select("_h", "_id", "_sha", "_k", "_n", F.col("f._id").alias("_keep"), F.col("f._k").alias("_keep_k"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hasher: Callable[[Column], Column] = content_hash, few: int = FEW_KEYS
) -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``hasher`` may be any function of the text; whatever it lets collide is told apart by the comparison of bytes.
    """
    found = _groups(docs, id_col, text_col, hasher, few, key=False)
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW_KEYS) -> DataFrame:
    """``docs`` with one row of each group, all columns kept: that of the smallest id (null last), then of any of the rows
    that share this id and text."""
    found = table(_groups(docs, id_col, text_col, content_hash, few, key=True).where("_n > 1"))
    stays = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_k") == F.col("_keep_k"))
    tied = found.where(stays).groupBy("_id", "_k").count().where("count > 1")
    return without(docs, found.where(~stays), id_col, text_col, tied)
