"""Groups of spelling variants: words one code point apart, each pointing to a much more frequent neighbour.

Runs of letters are lower-cased (A-Z only); of one run in ``one_in``, by a hash of the document's id and the run, a code point
is left out. What has at least ``min_length`` code points and ``min_count`` occurrences over all texts is a word.

Neighbours are found in automata. One error lies either in a word's second half or in its first, so the other half is matched
exactly: the first half walks a minimal acyclic automaton of words, the second half, reversed, one of reversed words; the rest
is completed with one inserted, deleted or replaced code point. An edge keeps how many words lie before it, so a walk adds up
to the word's number in order (a perfect hash), which finds its count. An error inside a run of equal code points stands at the
run's end only, and what the backward walk finds is left out if its first half agrees as well, so each neighbour comes once.

No task holds all words. A word is a target under the halves that a query of its length, one less or one more would match, and
a query under its own half; both meet in the task that the half's hash names, which builds one automaton of its targets at a
time. A half with more than ``HOT`` targets is cut into blocks, targets by queries, each block with its share of both. What
leaves a task is a row for each query: how many neighbours, and the most frequent. Pairs are never written.

Edge cases: null and empty texts have no words; a null id is hashed as an empty one; texts and runs of any length are whole;
repeated rows count each; ties in count go to the smaller word in code-point order; other columns are not looked at; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Targets of one half that a single task may get.
HOT = 200_000
#: Targets a task gets on average.
TASK_TARGETS = 100_000
FOUND = "word string, n_near long, best_n long, best string"


class Automaton:
    """Minimal acyclic automaton of words that are added in ascending order; a word's number is its place in that order."""

    def __init__(self) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        self._open: list[list] = [["", {}, False]]  # the states along the last word: what leads there, edges, whether final
        self._last = ""
        self.root = -1

    def add(self, word: str) -> None:
        same, most = 0, min(len(word), len(self._last))
        while same < most and word[same] == self._last[same]:
            same += 1
        self._close(same)
        self._open += [[c, {}, False] for c in word[same:]]
        self._open[-1][2] = True
        self._last = word

    def finish(self) -> None:
        self._close(0)
        self.root = self._state(self._open[0][1], self._open[0][2])

    def _close(self, depth: int) -> None:
        while len(self._open) - 1 > depth:
            char, edges, final = self._open.pop()
            self._open[-1][1][char] = self._state(edges, final)

    def _state(self, edges: dict[str, int], final: bool) -> int:
        key = (final, *edges.items())
        at = self._known.get(key)
        if at is None:
            before, out = int(final), {}
            for char, to in edges.items():
                out[char] = (to, before)
                before += self.size[to]
            at = self._known[key] = len(self.size)
            self.edges.append(out)
            self.final.append(final)
            self.size.append(before)
        return at

    def _rest(self, state: int, rest: str, number: int) -> int:
        """The number of the word that goes on with exactly ``rest``, or -1."""
        edges = self.edges
        for char in rest:
            step = edges[state].get(char)
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, exact: int) -> Iterator[int]:
        """Numbers of the words that begin with the first ``exact`` code points of ``word`` and differ by one error after."""
        state, number, end = self.root, 0, len(word)
        for at, char in enumerate(word[:exact]):
            step = self.edges[state].get(char)
            if step is None:
                return
            state, number = step[0], number + step[1]
        for at in range(exact, end + 1):
            edges, char = self.edges[state], word[at : at + 1]
            here, after = word[at:], word[at + 1 :]
            if char and after[:1] != char:
                yield self._rest(state, after, number)
            for other, (to, before) in edges.items():
                if other != char:
                    yield self._rest(to, here, number + before)
                    if char:
                        yield self._rest(to, after, number + before)
            if not char or char not in edges:
                return
            to, before = edges[char]
            state, number = to, number + before


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, one_in: int = 97) -> DataFrame:
    """(word, n) of the whole table: native, one row a word and task is shuffled."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("w"))
    upper = "".join(map(chr, range(65, 91)))
    low = F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(F.translate("w", upper, upper.lower()))
    runs = runs.where(F.length("w") >= min_length).select("i", low.alias("w"))
    h = F.crc32(F.concat("i", F.lit(":"), "w"))
    at = F.pmod("h", F.length("w")).cast("int")
    rest = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    kept = runs.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, rest).otherwise(F.col("w")).alias("word"))
    return kept.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(vocabulary: DataFrame, min_length: int) -> DataFrame:
    """Rows (way, query, s, n, exact): every word as a query and as a target, forward (way 0) and reversed (way 1)."""
    out = []
    for way, s in ((0, F.col("word")), (1, F.reverse("word"))):
        size = F.length("word")
        half = lambda n, way=way: F.floor((n + way) / 2).cast("int")
        asked = F.array(F.when(size > min_length, half(size - 1)), half(size), half(size + 1))
        row = [F.lit(way).alias("way"), s.alias("s"), "n"]
        out.append(vocabulary.select(*row, F.lit(0).alias("query"), F.explode(F.array_distinct(F.array_compact(asked))).alias("exact")))
        out.append(vocabulary.select(*row, F.lit(1).alias("query"), half(size).alias("exact")))
    both = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return both.withColumn("half", F.xxhash64("way", F.substring("s", F.lit(1), F.col("exact"))))


def _dealt(rows: DataFrame, hot_size: int) -> DataFrame:
    """``rows`` with ``cuts``, ``i`` and ``j``: the block of targets and the block of queries. Only halves of more than
    ``hot_size`` targets have more than one; there are at most (targets / hot_size) such halves."""
    many = table(rows.where("query = 0").groupBy("half").agg(F.count("*").alias("c")).where(F.col("c") > hot_size).select("half", F.ceil(F.col("c") / hot_size).cast("int").alias("cuts")))
    if many.isEmpty():
        return rows.withColumns({"cuts": F.lit(1), "i": F.lit(0), "j": F.lit(0)})
    rows = rows.join(many, "half", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own, every = F.array(F.pmod(F.crc32("s"), F.col("cuts")).cast("int")), F.sequence(F.lit(0), F.col("cuts") - 1)
    is_target: Column = F.col("query") == 0
    return rows.withColumn("i", F.explode(F.when(is_target, own).otherwise(every))).withColumn("j", F.explode(F.when(is_target, every).otherwise(own)))


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's rows in the order of way, query, s: the targets of a way, then its queries."""
    names = ["word", "n_near", "best_n", "best"]
    way, automaton, targets, counts = -1, Automaton(), [], []
    for batch in batches:
        out = []
        for r in zip(batch["way"], batch["query"], batch["s"], batch["n"], batch["exact"], batch["cuts"], batch["i"], strict=True):
            now, query, s, n, exact, cuts, i = r
            if now != way:
                way, automaton, targets, counts = now, Automaton(), [], []
            if not query:
                if not targets or targets[-1] != s:
                    automaton.add(s)
                    targets.append(s)
                    counts.append(n)
                continue
            if automaton.root < 0:
                automaton.finish()
            near, most, best, tail = 0, 0, "", s[exact:]
            for k in automaton.one_error(s, exact):
                if k < 0:
                    continue
                t = targets[k]
                if (way and t.endswith(tail)) or (cuts > 1 and zlib.crc32(t.encode()) % cuts != i):
                    continue
                near += 1
                if counts[k] >= most:
                    t = t[::-1] if way else t
                    if counts[k] > most or t < best:
                        most, best = counts[k], t
            if near:
                out.append((s[::-1] if way else s, near, most, best))
        yield pd.DataFrame(out, columns=names)


def neighbours(vocabulary: DataFrame, min_length: int = 5, hot_size: int = HOT, task_targets: int = TASK_TARGETS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a neighbour: how many, and the most frequent of them."""
    spark = vocabulary.sparkSession
    small_batches(spark)
    rows = _dealt(_halves(vocabulary, min_length), hot_size)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * vocabulary.count() // task_targets))
    dealt = rows.repartition(parts, "half", "i", "j").sortWithinPartitions("way", "query", "s")
    found = dealt.select("way", "query", "s", "n", "exact", "cuts", "i").mapInPandas(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def followed(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of rows (word, form) that form no ring: each round doubles how far a word has followed, and a form is at
    least twice as frequent as its word, so a handful does."""
    roots = table(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = table(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots
    raise RuntimeError(f"roots were not reached in {rounds} rounds")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, one_in: int = 97, ratio: float = 2,
    hot_size: int = HOT, task_targets: int = TASK_TARGETS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word; ``form`` is its most frequent neighbour if that is at least
    ``ratio`` times as frequent, ``root`` where following forms ends."""
    vocabulary = table(words(docs, id_col, text_col, min_length, min_count, one_in))
    near = neighbours(vocabulary, min_length, hot_size, task_targets)
    formed = F.col("best_n") >= ratio * F.col("n")
    known = table(
        vocabulary.join(near, "word", "left").select(
            "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")
        )
    )
    roots = followed(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
