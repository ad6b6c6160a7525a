"""The corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, packing; each stage works on all that the one
before kept, and its decisions take effect. A stage takes (spark, docs, sf_dir) and returns the columns of ``documents``;
the last returns the packed pieces.

Edge cases: null, empty and very long texts go through every stage (null counts as empty; null and empty texts are one group
of exact copies); rows that repeat an id are judged by their own text, and of equal rows one stays after ``exact``; a null id
comes last where the smallest stays; ties are settled as the operators' docstrings say; further columns are kept up to
``mix``, whatever their names; empty tables give empty tables. Tables that a stage wrote for itself are deleted once its
result is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from antibiogram.llm import mixing
from antibiogram.llm.common import drop_tables, read, table, tables_written
from antibiogram.llm.exact_dedup import exact_dedup
from antibiogram.llm.packing import harmonic_pack
from antibiogram.llm.quality_gam import quality_filter
from antibiogram.llm.queries import tokenizer
from antibiogram.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links the one with the smallest id stays."""
    return simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come at the rates that meet the target weights. The clean domain stays whole and sets the total, since the
    stages before leave few other documents."""
    return mixing.mixed(docs, read(spark, sf_dir, "labels"), mixing.label_domain(), mixing.WEIGHTS, whole="clean")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return harmonic_pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written and read again."""
    docs = read(spark, sf_dir, "documents")
    written: list[str] = []
    for _, stage in STAGES[:-1]:
        others = set(tables_written())
        docs = table(stage(spark, docs, sf_dir))
        own = [p for p in tables_written() if p not in others]
        drop_tables([*written, *own[:-1]])  # what the stage read, and what it wrote for itself
        written = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
