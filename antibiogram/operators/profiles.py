"""One row an isolate, from which the patterns of ``detect`` follow without going back to the tests.

The different antibiotics and organisms of the tests are few, so each gets a number; an isolate's drugs are then bits of a few
longs, and the first of its tests is the smallest of one packed long. All are aggregates of fixed size, which are combined
before the tests are shuffled by isolate, so a hot isolate is no hot task. Tables with more than ``FEW_DRUGS`` antibiotics or
``FEW_ORGANISMS`` organisms go to the functions of ``detect``, which give the same rows.

Nulls: tests without an isolate are left out; a test without an antibiotic is a drug of class "Other", but not one of an
isolate's distinct drugs nor part of a combination. Of tests of equal date and antibiotic the one whose organism comes first
in alphabetical order (null first) counts as the first.
"""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antibiogram.functions.exprs import has, percent
from antibiogram.sources import mart

from . import detect
from .detect import CROSS_CLASSES, DRUG_CLASSES, ISOLATE
from .rates import known

#: Drugs that a word of an isolate's bits holds, and the most names that are numbered.
WORD = 60
FEW_DRUGS = 8 * WORD - 1
FEW_ORGANISMS = 4095
#: Places of the drug and of the date in a test's packed order; the organism's number is below, dates begin 2 ** 22 days
#: before 1970, and a missing date comes after all others.
DRUG_AT, DATE_AT, FIRST_DAY, NO_DATE = 12, 24, 1 << 22, 1 << 23
NO_ORGANISM = 1 << 50
NAMES = "kind string, name string"


def _many(n_drugs: int, n_organisms: int) -> bool:
    return n_drugs > FEW_DRUGS or n_organisms > FEW_ORGANISMS


class Profiles:
    """The isolates of ``ast``. Making one runs a job that collects its names, at most the two limits of them and a few; ``write``
    and ``read`` keep them, so that the tests are aggregated once for all patterns."""

    def __init__(self, ast: DataFrame, stored: str | None = None):
        self.ast, self.spark, self.stored = ast, ast.sparkSession, stored
        if stored is None:
            pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("antibiotic", "organism")])
            names = known(ast, "isolate_id").select(F.explode(pairs).alias("p")).select("p.*").distinct()
        else:
            names = self.spark.read.schema(NAMES).parquet(f"{stored}/names")
        self.names = [tuple(r) for r in names.limit(FEW_DRUGS + FEW_ORGANISMS + 3).collect()]
        # Numbers follow the order of the names, null is 0.
        of = lambda kind: sorted((name for k, name in self.names if k == kind and name is not None), key=str.encode)
        self.drugs, self.organisms = of("antibiotic"), of("organism")
        self.few = not _many(len(self.drugs), len(self.organisms))
        self.words = range(1 + len(self.drugs) // WORD)

    @classmethod
    def read(cls, ast: DataFrame, path: str) -> Profiles:
        """What ``write`` kept of these tests."""
        return cls(ast, path)

    def write(self, path: str) -> None:
        """Isolates, then names: a folder without names was not finished. New tests need a new folder, since numbers follow names."""
        if self.few:
            # Isolates meet in partitions by the tests' number; Spark's own number would let a task grow with the tables.
            parts = mart.buckets_for(self.ast.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions")), mart.TASK_ROWS)
            with mart.shuffle_partitions(self.spark, parts):
                self.frame.write.mode("overwrite").parquet(f"{path}/isolates")
        self._table(self.names, NAMES).coalesce(1).write.mode("overwrite").parquet(f"{path}/names")

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        """A table of the plan itself, no larger than the names."""
        columns = [c.split()[0] for c in schema.split(",")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(",")]
        values = list(zip(*rows, strict=True)) if rows else [() for _ in columns]
        return self.spark.createDataFrame(pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=columns))

    def _organisms(self, number: str) -> DataFrame:
        """The organisms under their numbers: ``FEW_ORGANISMS`` + 1 rows at most, so they are broadcast."""
        return F.broadcast(self._table(list(enumerate([None, *self.organisms])), f"{number} long, organism string"))

    @cached_property
    def frame(self) -> DataFrame:
        """dataset_id, isolate_id; ``first``, the packed order of the first test; ``tested_k`` and ``resisted_k``, bits of drugs;
        ``resistant_rows`` with an antibiotic; ``resistant_first``, ``resistant_sample``; ``tests_k``, ``resistant_k`` and
        ``first_k`` of the k-th class of cross-resistance. What a query does not use is not computed."""
        if self.stored is not None:
            return self.spark.read.parquet(f"{self.stored}/isolates")
        listed = self._table([(n, name, n // WORD, 1 << n % WORD) for n, name in enumerate([None, *self.drugs])], "_drug long, _name string, _word int, _bit long")
        listed = listed.select("*", *[has("_name", *drugs).alias(f"_class_{k}") for k, drugs in enumerate(CROSS_CLASSES.values())])
        organisms = self._organisms("_organism").withColumnRenamed("organism", "_organism_name")
        rows = known(self.ast, "isolate_id").join(F.broadcast(listed), F.col("antibiotic").eqNullSafe(F.col("_name")))
        rows = rows.join(F.broadcast(organisms), F.col("organism").eqNullSafe(F.col("_organism_name")))
        day = F.coalesce(F.unix_date("test_date") + F.lit(FIRST_DAY), F.lit(NO_DATE)).cast("long")
        order = day * F.lit(1 << DATE_AT) + F.col("_drug") * F.lit(1 << DRUG_AT) + F.col("_organism")
        rows = rows.withColumns({"_r": F.coalesce(F.col("result") == "R", F.lit(False)), "_order": order})
        bits = lambda k, also: F.coalesce(F.bit_or(F.when((F.col("_word") == k) & also, F.col("_bit"))), F.lit(0).cast("long"))
        resistant, order = F.col("_r"), F.col("_order")
        late = F.when(F.col("_organism") == 0, F.lit(NO_ORGANISM)).otherwise(F.lit(0)).cast("long")  # one without an organism comes last
        return rows.groupBy(*ISOLATE).agg(
            F.min(order).alias("first"),
            *[bits(k, F.lit(True)).alias(f"tested_{k}") for k in self.words],
            *[bits(k, resistant).alias(f"resisted_{k}") for k in self.words],
            F.count_if(resistant & (F.col("_drug") > 0)).alias("resistant_rows"),
            F.min(F.when(resistant, order + late)).alias("resistant_first"),
            F.min_by("sample_id", F.when(resistant, F.struct(F.col("sample_id").isNull(), F.shiftright(order, DRUG_AT)))).alias("resistant_sample"),
            *[F.count_if(F.col(f"_class_{k}")).alias(f"tests_{k}") for k in range(len(CROSS_CLASSES))],
            *[F.count_if(F.col(f"_class_{k}") & resistant).alias(f"resistant_{k}") for k in range(len(CROSS_CLASSES))],
            *[F.min(F.when(F.col(f"_class_{k}"), order)).alias(f"first_{k}") for k in range(len(CROSS_CLASSES))],
        )

    def _with_organism(self, df: DataFrame, first: str) -> DataFrame:
        """With the organism of the test of this packed order."""
        return df.withColumn("_number", F.col(first).bitwiseAND(F.lit((1 << DRUG_AT) - 1))).join(self._organisms("_number"), "_number").drop("_number")

    def _count(self, bits: str) -> Column:
        """How many drugs are among these bits; the first bit is that of no drug."""
        masks = [((1 << WORD) - 1) - (k == 0) for k in self.words]
        return sum((F.bit_count(F.col(f"{bits}_{k}").bitwiseAND(F.lit(m))) for k, m in zip(self.words, masks, strict=True)), F.lit(0)).cast("long")

    def multi_resistance(self, min_resistances: int = 3) -> DataFrame:
        """As ``detect.multi_resistance``."""
        if not self.few:
            return detect.multi_resistance(self.ast, min_resistances)
        r = F.col("resistant_count")
        out = self.frame.select(*ISOLATE, "first", self._count("resisted").alias("resistant_count"), self._count("tested").alias("total_tested")).where(r >= min_resistances)
        out = self._with_organism(out, "first").withColumns(
            {"resistance_percentage": percent(r, F.col("total_tested"), 1), "resistance_level": F.when(r >= 3, "MDR").otherwise("Multi-drug resistant")}
        )
        return out.select(*ISOLATE, "organism", "resistant_count", "total_tested", "resistance_percentage", "resistance_level")

    def mdr(self, resistance_threshold: int = 3) -> DataFrame:
        """As ``detect.mdr``."""
        if not self.few:
            return detect.mdr(self.ast, resistance_threshold)
        masks: dict[str, list[int]] = {}
        for n, name in enumerate([None, *self.drugs]):
            masks.setdefault(DRUG_CLASSES.get(name, "Other"), [0 for _ in self.words])[n // WORD] |= 1 << n % WORD
        met = lambda mask: sum((F.bit_count(F.col(f"resisted_{k}").bitwiseAND(F.lit(m))) for k, m in enumerate(mask) if m), F.lit(0)) > 0
        classes = sum((met(mask).cast("long") for mask in masks.values()), F.lit(0).cast("long"))
        out = self.frame.select(*ISOLATE, classes.alias("resistant_drug_classes"), "resistant_first", F.col("resistant_sample").alias("sample_id"))
        out = self._with_organism(out.where(F.col("resistant_drug_classes") >= F.greatest(F.lit(resistance_threshold), F.lit(1))), "resistant_first")
        return out.select(*ISOLATE, "resistant_drug_classes", "organism", "sample_id").orderBy(F.desc("resistant_drug_classes"), *ISOLATE)

    def cross_resistance(self) -> DataFrame:
        """As ``detect.cross_resistance``."""
        if not self.few:
            return detect.cross_resistance(self.ast)
        each = [
            F.when(F.col(f"resistant_{k}") >= 2, F.struct(F.lit(name).alias("antibiotic_class"), F.col(f"resistant_{k}").alias("resistant_antibiotics"), F.col(f"tests_{k}").alias("total_antibiotics"), F.col(f"first_{k}").alias("_first")))
            for k, name in enumerate(CROSS_CLASSES)
        ]
        out = self.frame.select(*ISOLATE, F.explode(F.array_compact(F.array(*each))).alias("f")).select(*ISOLATE, "f.*")
        level = F.when(F.col("resistant_antibiotics") == F.col("total_antibiotics"), "High").otherwise("Moderate")
        out = self._with_organism(out, "_first").withColumn("cross_resistance_level", level)
        return out.select(*ISOLATE, "antibiotic_class", "organism", "resistant_antibiotics", "total_antibiotics", "cross_resistance_level")

    def co_resistance(self, min_samples: int = 5) -> DataFrame:
        """As ``detect.co_resistance``. Isolates are counted by their bits, which are spelt out once a combination; those that
        have an antibiotic twice, against the rules of an upload, are taken from the tests."""
        if not self.few:
            return detect.co_resistance(self.ast, min_samples)
        words = [f"resisted_{k}" for k in self.words]
        once = F.col("resistant_rows") == self._count("resisted")
        some = self.frame.select(*ISOLATE, *words, "resistant_rows").where(F.col("resistant_rows") > 0)
        # Of a bit for no drug nothing is spelt.
        spelt = F.concat_ws(", ", *[F.when(F.col(words[n // WORD]).bitwiseAND(F.lit(1 << n % WORD)) != 0, F.lit(name)) for n, name in enumerate(self.drugs, 1)])
        sets = some.where(once).groupBy(*words).agg(F.count("*").alias("_n")).select(spelt.alias("antibiotic_combination"), "_n")
        found, twice = sets, some.where(~once).select(*[F.col(c).alias(f"_{c}") for c in ISOLATE])
        if self.stored is None or not twice.isEmpty():
            rows = known(self.ast, "isolate_id", "antibiotic").where(F.col("result") == "R")
            rows = rows.join(twice, (F.col("isolate_id") == F.col("_isolate_id")) & F.col("dataset_id").eqNullSafe(F.col("_dataset_id")), "left_semi")
            lists = rows.groupBy(*ISOLATE).agg(F.array_join(F.array_sort(F.collect_list("antibiotic")), ", ").alias("antibiotic_combination"))
            found = sets.unionByName(lists.select("antibiotic_combination", F.lit(1).cast("long").alias("_n")))
        # Different drugs may be spelt alike ("A", "B" and "A, B"), so combinations meet again by their text.
        out = found.groupBy("antibiotic_combination").agg(F.sum("_n").alias("count")).where(F.col("count") >= min_samples)
        return out.orderBy(F.desc("count"), "antibiotic_combination")
