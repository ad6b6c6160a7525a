"""Best-two-fit packing of tokenised documents into sequences of ``capacity`` tokens.

Each document is encoded once and ended with ``end_id``. Only a document longer than a sequence is cut, into whole sequences
and, before them, a first piece of what is left. A bin is filled greedily, the longest unpacked piece that fits first. If room
stays, the bin's smallest piece is taken out and two unpacked pieces whose sum is largest within the widened gap take its
place, if they fill more of it. A bin of one piece stays as it is: nothing unpacked fits beside it.

Pieces of one length are alike, so bins are planned from how many pieces there are of each length, at most ``capacity``
numbers whatever the input. A planned bin is repeated as long as its pieces last; each repetition uses up a length or leaves
fewer pieces of it than the bin takes, so a plan has a few thousand bins at most. Each place in a planned bin serves a stretch
of ranks among the pieces of its length, so a piece's sequence and offset follow from its length and rank alone, in a join
with the places by length. Ranks need no pass through one task and no sort: a task numbers the pieces of each length as
it cuts them, and the counts of all (length, task) give each task its start.

What is written between the steps is a row of numbers for each piece; token ids never leave the task that made them. Which of
the pieces of one length goes where depends on how the input is split into tasks; it is fixed once written.

Edge cases: a null or empty text is the end id alone; documents of any length are whole; repeated rows and rows with a null id
are packed each, wherever they are read; ids may be of any type that a cast to text and back keeps (long, text, date); other
columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_KEYS, small_batches, table

CAPACITY = 2048
PIECES = "doc_id string, piece int, start long, length int, ids_crc32 long, task long, nth long"
# How the tokenizer's file splits texts, and the bytes that it writes as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = (range(33, 127), range(161, 173), range(174, 256))


class ByteEncoder:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``.

    Where the file's ids follow the order of its merges, as byte-level files' do, ``tiktoken`` gives the same ids several
    times as fast; texts that hold a special token's string, and files of another make, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.fast = self._fast(file)

    def _fast(self, file: dict):
        import tiktoken

        split = file["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"].get("merges", [])]
        vocab = file["model"]["vocab"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file["normalizer"] and not file["post_processor"]
        if not plain or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        own = [b for r in PLAIN_BYTES for b in r]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        ranks = {bytes(byte[c] for c in t): k for t, k in vocab.items() if t not in self.special}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text and the end id, as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, self.end_id], "<u4")


_ENCODERS: dict[tuple, ByteEncoder] = {}


def encoder(path: str, end_id: int) -> ByteEncoder:
    """One for each task process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = ByteEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of a document of n tokens, in order."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, number, start, length, checksum of its ids, the task that cut it and its number among the
    task's pieces of the length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids, start = enc.encode(text), 0
                for k, length in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length]), task, seen[length]))
                    start += length
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))  # pandas has no long with nulls
    return texts.mapInPandas(run, PIECES)


def _up_to(left: np.ndarray) -> np.ndarray:
    """For each number the largest length up to it of which pieces are left, or 0."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def fill(left: np.ndarray, capacity: int) -> Counter[int]:
    """The lengths of the next bin, from the numbers ``left`` of pieces of each length (index 0 unused)."""
    fits, room, taken = _up_to(left), capacity, Counter()
    length = int(fits[room])
    while length:
        k = min(int(left[length]), room // length)
        taken[length] = k
        room -= k * length
        length = int(fits[min(room, length - 1)])
    if not room or sum(taken.values()) < 2:
        return taken
    small = min(taken)
    gap, rest = room + small, left.copy()
    for x, k in taken.items():
        rest[x] -= k
    fits = _up_to(rest)
    a = np.flatnonzero(rest[:gap])
    b = fits[np.minimum(gap - a, a)]
    alone = (b == a) & (rest[a] < 2)
    b = np.where(alone, fits[np.maximum(np.minimum(gap - a, a - 1), 0)], b)
    both = np.where(b > 0, a + b, 0)
    if len(a) and both.max() > small:
        best = int(both.argmax())
        taken[small] -= 1
        taken.update((int(a[best]), int(b[best])))
    return +taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths in the order of their places) of planned bins that take every piece of ``counts`` once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        taken = fill(left, capacity)
        repeats = min(int(left[x]) // k for x, k in taken.items())
        for x, k in taken.items():
            left[x] -= k * repeats
        out.append((repeats, sorted(taken.elements(), reverse=True)))
    return out


def places(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of each place in the planned bins."""
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for repeats, lengths in bins:
        offset = 0
        for length in lengths:
            out.append((length, used[length], repeats, sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return out


def best_two_fit(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark, id_type = docs.sparkSession, docs.select(id_col).schema[0].dataType
    cuts = table(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col))
    counts = table(cuts.groupBy("length", "task").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = F.broadcast(starts) if counts.count() <= FEW_KEYS else starts
    totals = dict(map(tuple, counts.groupBy("length").agg(F.sum("n")).collect()))  # at most ``capacity`` rows
    at = spark.createDataFrame(places(plan(totals, capacity)), "length int, lowest long, ranks long, base long, offset long")
    rank = F.col("first") + F.col("nth")
    placed = cuts.join(starts, ["length", "task"]).select("*", rank.alias("rank")).join(F.broadcast(at), "length")  # bounded by capacity alone
    return placed.where((F.col("rank") >= F.col("lowest")) & (F.col("rank") < F.col("lowest") + F.col("ranks"))).select(
        F.col("doc_id").cast(id_type).alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("base") + F.col("rank") - F.col("lowest")).alias("sequence_id"), "offset",
    )
