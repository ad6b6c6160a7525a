"""WARC fixity audit with Merkle trees.

A WARC file's records, in order of their key, are the leaves of a tree: a leaf's digest is the SHA-256 of the record's
bytes; a node covers ``FAN_OUT`` children, that is an ordered range of offsets, and its digest is the SHA-256 of the
range's length in bytes and the children's digests. Two replicas are compared root by root; only below roots that differ
are children joined, level after level, down to slots and the records in them. A slot of the tree is a record's key within
its file, so a lost or added record changes its own branch alone, although all later offsets move.

All steps are DataFrame operations. A record's bytes are hashed where they are read; what is shuffled is a digest for
each record, and every level above it is a sixteenth of the one below. A file has at most ``per_file`` slots. Records that
share a key share a slot, whose digest is the SHA-256 of their number and of the sums of their digests' eight words: sums
are made in each task, so a key that a third of all records have costs each task one row.

Edge cases: null fields of a record count as empty; records with a null key are the one slot of a file of their own
(``NULL_FILE``); records of a repeated key or of none are compared as a multiset, so each lost, added or altered one is
told; keys may be texts: those that are no whole numbers get a slot by their hash, in files of negative numbers, and keys that
share it are compared like records of one key; empty replicas differ from others in every record; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY_ROWS, table

FAN_OUT = 16
PER_FILE = 1024
#: The file of records without a key; no quotient of a long is as low.
NULL_FILE = -(1 << 63)
#: Slots over which keys are dealt that are texts and no whole numbers.
HASHED_SLOTS = 1 << 30
LINE = "\r\n"


def warc_record(key: str = "page_id", url: str = "url", body: str = "html", end: str = 2 * LINE) -> Column:
    """The bytes, as text, of a WARC/1.1 resource record for a page, with ``end`` after the payload."""
    payload = F.coalesce(F.col(body), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(key).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit(end),
    )


def write_warc(pages: DataFrame, path: str, per_file: int = PER_FILE, key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """A folder ``path/warc_file=<n>/`` a WARC file, its records in order of their key: a part, or several in order of their names
    where a file has very many records or lies across the ranges that the writing tasks take."""
    rows = pages.select(_file(_number(pages, key), per_file).alias("warc_file"), F.col(key).alias("_key"), warc_record(key, url, body, LINE).alias("value"))
    rows = rows.withColumn("_nth", F.monotonically_increasing_id())  # ranges may part equal keys
    rows = rows.repartitionByRange("warc_file", "_key", "_nth").sortWithinPartitions("warc_file", "_key", "_nth").select("warc_file", "value")
    rows.write.partitionBy("warc_file").option("lineSep", LINE).text(path)


def _number(pages: DataFrame, key: str) -> Column:
    """A record's place in the order of keys: the key, or for a text that is no whole number a negative number by its hash."""
    if pages.schema[key].dataType.typeName() != "string":
        return F.col(key)
    hashed = -1 - F.pmod(F.xxhash64(key), F.lit(HASHED_SLOTS))
    return F.coalesce(F.col(key).try_cast("long"), F.when(F.col(key).isNotNull(), hashed))


def _file(number: Column, per_file: int) -> Column:
    return F.coalesce(F.floor(number / per_file).cast("long"), F.lit(NULL_FILE))


def records(pages: DataFrame, per_file: int = PER_FILE, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """warc_file, slot, bytes, digest of each record."""
    record, number = warc_record(key, url, body), _number(pages, key)
    return pages.select(
        _file(number, per_file).alias("warc_file"),
        F.coalesce(F.pmod(number, F.lit(per_file)), F.lit(0)).cast("long").alias("slot"),
        F.octet_length(record).cast("long").alias("bytes"),
        F.sha2(record, 256).alias("digest"),
    )


def leaves(found: DataFrame) -> DataFrame:
    """level 0: warc_file, slot, bytes, digest, records."""
    word = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    sums = found.groupBy("warc_file", "slot").agg(
        F.sum("bytes").alias("bytes"), F.min("digest").alias("digest"), F.count("*").alias("records"), *[F.sum(word(k)).alias(f"w{k}") for k in range(8)]
    )
    several = F.sha2(F.concat_ws("|", F.col("records").cast("string"), *[F.col(f"w{k}").cast("string") for k in range(8)]), 256)
    return sums.select("warc_file", "slot", "bytes", F.when(F.col("records") > 1, several).otherwise(F.col("digest")).alias("digest"), "records")


def parents(children: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("slot", "digest")))
    joined = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["slot"].cast("string"), x["digest"])), "|")
    return (
        children.withColumn("parent", F.floor(F.col("slot") / fan_out))
        .groupBy("warc_file", F.col("parent").alias("slot"))
        .agg(F.sum("bytes").alias("bytes"), F.sha2(F.concat(F.sum("bytes").cast("string"), F.lit("|"), joined), 256).alias("digest"), F.sum("records").alias("records"))
    )


def tree(pages: DataFrame, per_file: int = PER_FILE, fan_out: int = FAN_OUT, **columns) -> list[DataFrame]:
    """The records, then the levels from leaves to roots, each a table in the shared folder."""
    found = table(records(pages, per_file, **columns))
    levels, width = [found, table(leaves(found))], per_file
    while width > 1:
        levels.append(table(parents(levels[-1], fan_out)))
        width = -(-width // fan_out)
    return levels


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """warc_file, slot of the nodes of one level that differ or that one side lacks."""
    a = ours.select("warc_file", "slot", F.col("digest").alias("_ours"))
    b = theirs.select("warc_file", "slot", F.col("digest").alias("_theirs"))
    both = a.join(b, ["warc_file", "slot"], "full")
    return both.where(~F.col("_ours").eqNullSafe(F.col("_theirs"))).select("warc_file", "slot")


def _of_slots(side: list[DataFrame], slots: DataFrame) -> DataFrame:
    """The records of these slots. Slots of more than ``KEY_ROWS`` records, at most one in so many records, are broadcast, so that
    their records stay where they are."""
    at = ["warc_file", "slot"]
    hot = side[1].where(F.col("records") > KEY_ROWS).select(*at)
    if hot.isEmpty():
        return side[0].join(slots, at, "left_semi")
    odd = table(hot.join(slots, at, "left_semi"))
    return side[0].join(F.broadcast(hot), at, "left_anti").join(slots, at, "left_semi").unionByName(side[0].join(F.broadcast(odd), at, "left_semi"))


def audit(ours: list[DataFrame], theirs: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """warc_file, slot, status (corrupt, missing, extra), offset, bytes and records, for the records that differ.

    ``corrupt``: a slot's only record that differs, altered in the replica (bytes as we have it); ``missing``: the replica
    lacks it; ``extra``: only the replica has it (bytes as the replica has it). A row is one record, or ``records`` equal
    ones of a slot. ``offset`` is where the slot's records begin in our file, null for extra ones.
    """
    suspects = differing(ours[-1], theirs[-1])
    for a, b in zip(reversed(ours[1:-1]), reversed(theirs[1:-1]), strict=True):
        parent = suspects.withColumnRenamed("slot", "_parent")
        below = lambda level: level.withColumn("_parent", F.floor(F.col("slot") / fan_out)).join(parent, ["warc_file", "_parent"], "left_semi")  # noqa: E731, B023
        suspects = table(differing(below(a), below(b)))
    # In these slots only: how many more of each record one side has.
    sides = [_of_slots(side, suspects).withColumn("_n", F.lit(sign)) for side, sign in ((ours, 1), (theirs, -1))]
    odd = sides[0].unionByName(sides[1]).groupBy("warc_file", "slot", "digest").agg(F.min("bytes").alias("bytes"), F.sum("_n").alias("_n")).where("_n <> 0")
    odd = table(odd)
    per_slot = odd.groupBy("warc_file", "slot").agg((F.count("*") == 2).alias("_two"), F.max("_n").alias("_most"), F.min("_n").alias("_least"))
    altered = per_slot.where("_two AND _most = 1 AND _least = -1").select("warc_file", "slot", F.lit(True).alias("_altered"))
    found = odd.join(altered, ["warc_file", "slot"], "left").where("_altered IS NULL OR _n > 0")
    # Offsets: the bytes before a slot, from our leaves of the files in question only (at most per_file rows each).
    before = (
        ours[1].join(suspects.select("warc_file").distinct(), "warc_file", "left_semi")
        .groupBy("warc_file")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "bytes"))).alias("_all"))
    )
    offset = F.aggregate(F.filter("_all", lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda s, x: s + x["bytes"])
    status = F.when(F.col("_altered"), "corrupt").when(F.col("_n") > 0, "missing").otherwise("extra")
    return found.join(before, "warc_file", "left").select(
        "warc_file", "slot", status.alias("status"), F.when(F.col("_n") > 0, offset).alias("offset"), "bytes", F.abs("_n").alias("records")
    )
