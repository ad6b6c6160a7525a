"""Quality rules: counts of words, symbols and repeats, and cross-document line frequency.

A line's normal form is lower case with runs of white space as one space. For every host, the distinct documents that
have a line are counted; a document is a row, so exact copies count each. Lines of more than ``max_docs`` documents (and,
if ``max_share`` is set, of more than that share of the host's documents) are taken out: ``without_common_lines`` and
``line_filter`` give the texts that are left, ``line_rules`` the counts of what was taken out of them; a document that
loses more than ``max_loss`` of its words is rejected as depleted. Only DataFrame functions are used.

Scale: a row's lines are hashed and made distinct where its text is read, so a line's documents are a plain count, summed
in each task before it moves: a hot host or line costs each task one row. Where no host has more than ``table_rows`` common
lines, each host's lines are broadcast as a hash table and taken out where the text is read: no text is shuffled. Else the
lines' positions are found by joins: the ``broadcast_rows`` lines of most documents are broadcast, so what is joined by
shuffle are only lines less frequent than all of these, and a document's text meets its positions in a shuffle.

Edge cases: a null text has no words, fails the base rules and stays null; lines without a word stay; a null host is a host
of its own, the same as an empty one; empty tables give empty tables; repeated rows and rows with a null id each get their
row; further columns are kept with the texts and ignored by the counts, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, named, table

NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Symbols that the base rules count.
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``also``, a row for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _words(text)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_SPACE))
    n = F.size("_w")
    window_hashes = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    )
    out = docs.select(F.col(id_col), text.alias("_t"), words.alias("_w"), *also)
    out = out.select(
        id_col,
        *also,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(n >= 3, window_hashes).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    # Windows sorted by hash bring repeats together; only texts that have repeats are sorted.
    by_hash = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), by_hash))
    repeated = F.filter(
        "_s", lambda x, k: F.coalesce((F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"]), F.lit(False))
    )
    # Each start, in order, covers the words up to the next start, three at most.
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["total"] + F.least(F.lit(3), i - a["last"])).alias("total"), i.alias("last")),
        lambda a: a["total"],
    )
    counts = F.struct(
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # As rows of a generator, so that the optimizer moves no later filter into these expressions, of which it would make copies.
    return out.select(id_col, *also, F.inline(F.array(counts)))


def _normal_lines(text: Column) -> Column:
    """The lines in normal form but for spaces at their ends."""
    return F.split(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "\n")


def _line_hashes(text: Column) -> Column:
    """The hash of each line's normal form, null for lines without a word."""
    return F.transform(_normal_lines(text), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def common_lines(docs: DataFrame, text_col: str, host_col: str, max_docs: int, max_share: float) -> DataFrame:
    """host, line (hash of the normal form), n_docs of the lines above the limits."""
    hashes = F.array_compact(F.array_distinct(_line_hashes(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), hashes.alias("lines"))
    often = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    if max_share > 0:
        hosts = rows.where(F.size("lines") > 0).groupBy("host").agg(F.count("*").alias("host_docs"))
        often = often.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))
    return often.select("host", "line", "n_docs")


def _hash_tables(common: DataFrame) -> DataFrame:
    """host, buckets: the host's common lines, hash h in bucket h mod the number of buckets, of which it has one a line."""
    sizes = common.groupBy("host").agg(F.count("*").alias("n"))
    used = common.join(sizes, "host").groupBy("host", F.pmod("line", "n").alias("b")).agg(F.collect_list("line").alias("l"))
    every = sizes.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b")).join(used, ["host", "b"], "left")
    ordered = F.sort_array(F.collect_list(F.struct("b", F.coalesce("l", F.array().cast("array<bigint>")).alias("l"))))
    return every.groupBy("host").agg(ordered.alias("s")).select("host", F.transform("s", lambda x: x["l"]).alias("buckets"))


def _cleaned(
    docs: DataFrame, row: Column, id_col: str, text_col: str, host_col: str, max_docs: int, max_share: float, broadcast_rows: int, table_rows: int
) -> DataFrame:
    """_id, _row, _text, _clean (the text without its common lines) and _gone (how many they are), a row for each row."""
    rows = docs.select(F.col(id_col).alias("_id"), row.alias("_row"), F.col(text_col).alias("_text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"))
    text = F.coalesce("_text", F.lit(""))
    common = table(common_lines(docs, text_col, host_col, max_docs, max_share))
    if common.groupBy("host").count().where(F.col("count") > table_rows).isEmpty() and common.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(_hash_tables(common.select("host", "line"))), F.col("_host") == F.col("host"), "left")
        rows = rows.withColumn("_hashes", F.when(F.col("buckets").isNotNull(), _line_hashes(text)))
        bucket = lambda h: F.get("buckets", F.pmod(h, F.size("buckets")).cast("int"))
        is_common = lambda i: F.array_contains(bucket(F.get("_hashes", i)), F.get("_hashes", i))
        at = F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), is_common)
        rows = rows.withColumn("_at", F.when(F.col("_hashes").isNotNull(), at))
    else:
        lines = rows.select(F.col("_id").alias("_key"), F.xxhash64(text).alias("text_hash"), F.col("_host").alias("host"), F.posexplode(_line_hashes(text)).alias("pos", "line")).where("line IS NOT NULL")
        hot = table(common.orderBy(F.desc("n_docs"), "host", "line").limit(broadcast_rows).select("host", "line"))
        cold = common.select("host", "line").join(hot, ["host", "line"], "left_anti")
        hits = lines.join(F.broadcast(hot), ["host", "line"], "left_semi")
        if not cold.isEmpty():
            hits = hits.unionByName(lines.join(F.broadcast(hot), ["host", "line"], "left_anti").join(cold, ["host", "line"], "left_semi"))
        hits = hits.groupBy("_key", "host", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("_at"))
        rows = rows.join(hits, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_host") == F.col("host")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    rows = rows.select("_id", "_row", "_text", F.coalesce("_at", F.array().cast("array<int>")).alias("_at"))
    rows = rows.withColumn("_lines", F.when(F.size("_at") > 0, F.split("_text", "\n")))
    # What lies between one common line and the next, and behind the last.
    ends = F.concat("_at", F.array(F.size("_lines")))
    before = lambda k: F.coalesce(F.get("_at", k - 1), F.lit(-1))
    left = F.flatten(F.transform(ends, lambda p, k: F.slice("_lines", before(k) + 2, p - before(k) - 1)))
    return rows.select("_id", "_row", "_text", F.when(F.size("_at") > 0, F.array_join(left, "\n")).otherwise(F.col("_text")).alias("_clean"), F.size("_at").alias("_gone"))


def without_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    max_share: float = 0.0,
    broadcast_rows: int = 100_000,
    table_rows: int = 5_000,
) -> DataFrame:
    """``docs``, row for row, each text without its common lines; the other lines are as they were and in their order."""
    rows = _cleaned(docs, F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]), id_col, text_col, host_col, max_docs, max_share, broadcast_rows, table_rows)
    return rows.select(*[F.col("_clean" if c == text_col else f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_docs: int = 20,
    max_share: float = 0.0,
    max_loss: float = 0.5,
    broadcast_rows: int = 100_000,
    table_rows: int = 5_000,
) -> DataFrame:
    """A row for each document: its counts, ``base_failed``, the words in common lines and whether it is kept."""
    rows = _cleaned(docs, F.lit(None), id_col, text_col, host_col, max_docs, max_share, broadcast_rows, table_rows)
    return _verdicts(rows, min_words, max_repeat_percent, max_loss).drop("_row", "_clean").withColumnRenamed("_id", id_col)


def line_filter(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_docs: int = 20,
    max_share: float = 0.0,
    max_loss: float = 0.5,
    broadcast_rows: int = 100_000,
    table_rows: int = 5_000,
) -> DataFrame:
    """The rows of ``docs`` that ``line_rules`` keeps, each text without its common lines."""
    rows = _cleaned(docs, F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]), id_col, text_col, host_col, max_docs, max_share, broadcast_rows, table_rows)
    kept = _verdicts(rows, min_words, max_repeat_percent, max_loss).where("kept")
    return kept.select(*[F.col("_clean" if c == text_col else f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def _verdicts(rows: DataFrame, min_words: int, max_repeat_percent: int, max_loss: float) -> DataFrame:
    """The columns of ``line_rules`` for ``_cleaned`` rows, with ``_row`` and ``_clean``."""
    out = base_counts(rows, "_id", "_text", ("_row", "_clean", "_gone"))
    # The words that the removal took: those of the text less those of what is left.
    lost_words = F.when(F.col("_gone") > 0, F.col("n_words") - F.size(_words(F.col("_clean")))).otherwise(F.lit(0))
    out = out.withColumn("_lost", lost_words.cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.select(
        "_id",
        "_row",
        "_clean",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("_lost") <= max_loss * F.col("n_words"))).alias("kept"),
        F.col("_gone").cast("long").alias("common_lines"),
        F.col("_lost").alias("common_line_words"),
    )
