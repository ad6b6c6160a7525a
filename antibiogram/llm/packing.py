"""Harmonic packing of tokenised documents into sequences of ``capacity`` tokens.

Each document is encoded once, ended with ``end_id`` and cut into whole sequences and a rest. A rest goes uncut into the
class of pieces of which j fit a sequence (at most capacity // j tokens each, j in ``DENOMINATORS``) if its slot there is
nearly full: at most ``loss`` of the slot or ``spare`` tokens empty. Else a piece that fills the next smaller slot is cut off
it and what remains is judged likewise. A class's bins take exactly j pieces each, so where a piece stands follows from its
rank in its class alone: sequence rank // j, place rank % j.

Ranks need no pass through one task and no sort: a task numbers the pieces of each class as it cuts them, and the counts of
all (class, task) give each task its start. They are broadcast where they are few, else joined by (class, task), of which
each has the pieces of one task at most. The last, unfilled bins of all classes together hold at most sum(j - 1) pieces,
4540 whatever the input; they are packed first fit, longest first.

What is written between the steps is a row of numbers for each piece; token ids never leave the task that made them. The
numbering depends on how the input is split into tasks; it is fixed once written.

Edge cases: a null or empty text is the end id alone; documents of any length are cut; repeated rows and rows with a null id
are packed each, wherever they are read; ids may be of any type that a cast to text and back keeps (long, text, date); an
empty table gives an empty table; words are cached in each task process up to a fixed number of entries.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_KEYS, small_batches, table

CAPACITY = 2048
#: Numbers of pieces in a bin. Small pieces hold few tokens, so their classes lie further apart.
DENOMINATORS = (*range(1, 49), 51, 54, 57, 60, 64, 70, 76, 85, 93, 102, 113, 128, 170, 256, 2048)
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, per_bin int, task long, nth long"
MAX_WORDS = 300_000
#: ASCII marks that the tokenizer always cuts from a word that they end.
_MARKS = ".,!*&$%#:;)?\"|"
#: Letters of which none changes another beside it.
_LETTERS = "".join(chr(k) for k in (*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)))
_of_letters = re.compile(f"[{_LETTERS}]+").fullmatch


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, with the words that it has seen kept.

    The tokenizer splits at white space before anything else looks across it, so encoding word by word gives the ids of
    the whole; letters and the marks after them are likewise apart, so ``word,`` is ``word`` and ``,``. Where the tokenizer
    turns letters into others one by one, whatever their case, and leaves them in one piece, a new word of letters goes to its
    model alone, in a third of the time.
    """

    def __init__(self, path: str, end_id: int, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.max_words = Tokenizer.from_file(path), np.array([end_id], "<u4").tobytes(), max_words
        self.model, self.letters = self.tokenizer.model, self._letters()
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _letters(self) -> dict[int, str]:
        """What the model sees of each letter; empty if a word's letters do not stand for themselves."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is None or splitter is None:
            return {}
        seen = lambda text: [p for p, _ in splitter.pre_tokenize_str(normalizer.normalize_str(text))]
        each = [seen(c) for c in _LETTERS]
        alone = seen(_LETTERS) == ["".join(p for ps in each for p in ps)] and each == [seen(c.lower()) for c in _LETTERS]
        return str.maketrans({c: "".join(ps) for c, ps in zip(_LETTERS, each, strict=True)}) if alone else {}

    def _ids(self, word: str) -> bytes:
        if self.letters and _of_letters(word):
            ids = [t.id for t in self.model.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _core(self, word: str) -> bytes:
        got = self.cores.get(word)
        if got is None:
            got = self._ids(word)
            if len(self.cores) < self.max_words:
                self.cores[word] = got
        return got

    def _word(self, key: bytes) -> bytes:
        word = key.decode("utf-8", "replace")
        core = word.rstrip(_MARKS)
        if core.isalpha():
            got = self._core(core.lower() if self.letters and _of_letters(core) else core)
            if len(core) < len(word):
                got += self._core(word[len(core) :])
        else:
            got = self._core(word)
        if len(self.words) < self.max_words:
            self.words[key] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text and the end id, as little-endian unsigned 32-bit numbers."""
        words, get, word = self.words, self.words.get, self._word
        return np.frombuffer(b"".join([get(w) or word(w) for w in (text or "").encode("utf-8", "replace").split()]) + self.end, "<u4")


def cut(n: int, capacity: int = CAPACITY, denominators: tuple[int, ...] = DENOMINATORS, loss: float = 0.1, spare: int = 16) -> list[tuple[int, int]]:
    """(length, pieces in a bin) of the pieces that a document of n tokens is cut into, in order."""
    out = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left:
        k = bisect_right(denominators, capacity // left)
        slot = capacity // denominators[k - 1]
        if slot - left <= max(loss * slot, spare) or k == len(denominators):
            return [*out, (left, denominators[k - 1])]
        out.append((capacity // denominators[k], denominators[k]))
        left -= capacity // denominators[k]
    return out


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    """One for each task process; tasks that follow in it find its words."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, checksum of its ids, the document's tokens, its class (pieces a bin), the task
    that cut it and its number among the task's pieces of the class."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, task = encoder(tokenizer_path, end_id), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids, start = enc.encode(text), 0
                for length, j in cut(len(ids), capacity):
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), j, task, seen[j]))
                    start += length
                    seen[j] += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))  # pandas has no long with nulls
    return texts.mapInPandas(run, PIECES)


def first_fit(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first into the first bin with room."""
    room: list[int] = []
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(capacity)
        out[i] = (k, capacity - room[k])
        room[k] -= lengths[i]
    return out


def harmonic_pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, per_bin for each piece."""
    id_type = docs.select(id_col).schema[0].dataType
    cuts = table(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col))
    counts = table(cuts.groupBy("per_bin", "task").agg(F.count("*").alias("n")))
    before = Window.partitionBy("per_bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("per_bin", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most len(DENOMINATORS) rows: the full bins of each class, and the id of its first sequence.
    per_class = counts.groupBy("per_bin").agg(F.floor(F.sum("n") / F.col("per_bin")).alias("full"))
    all_classes = Window.orderBy("per_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_class = table(per_class.withColumn("base", F.coalesce(F.sum("full").over(all_classes), F.lit(0))))
    ranked = (
        cuts.join(F.broadcast(starts) if counts.count() <= FEW_KEYS else starts, ["per_bin", "task"])
        .join(F.broadcast(per_class), "per_bin")
        .withColumn("rank", F.col("first") + F.col("nth"))
        .withColumn("bin", F.floor(F.col("rank") / F.col("per_bin")))
        .withColumn("sequence_id", F.col("base") + F.col("bin"))
    )
    in_bin = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranked.where(F.col("bin") < F.col("full")).withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    n_full = per_class.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n_full")).first()["n_full"]
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "per_bin"]

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        """The unfilled bins' pieces: at most sum(j - 1) rows."""
        rows = rows.sort_values(["per_bin", "rank"]).reset_index(drop=True)
        at = first_fit(rows["length"].tolist(), capacity)
        rows["sequence_id"], rows["offset"] = [n_full + k for k, _ in at], [o for _, o in at]
        return rows[out]

    names = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, per_bin int"
    rest = ranked.where(F.col("bin") >= F.col("full")).drop("sequence_id").withColumn("all", F.lit(0))
    rest = rest.groupBy("all").applyInPandas(lambda rows: last(rows), names)
    return whole.select(out).unionByName(rest).withColumn("doc_id", F.col("doc_id").cast(id_type))
