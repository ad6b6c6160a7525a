"""The registered SQL of the corpus operators, and the pipeline's stages on the smallest tables."""

from __future__ import annotations

import compare
import pytest
from helpers import ODD, docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from antibiogram.llm import queries
from antibiogram.llm.exact_dedup import exact_groups
from antibiogram.llm.simhash import simhash_groups


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    assert compare.differences(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name]) == ""


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = kept[list(kept)[-1]]
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert kept[name].columns == docs.columns and kept[name].join(before, docs.columns, "left_anti").isEmpty()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept["exact"]) == {r.doc_id for r in exact_groups(kept["quality"]).where("kept").collect()}
    assert ids(kept["near"]) == {r.component_id for r in simhash_groups(kept["exact"]).collect()}
    assert ids(kept["pack"]) == ids(kept["mix"]) and kept["pack"].groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).where("NOT ok").isEmpty()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = ids(kept["near"].join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi"))
    assert len(clean - ids(kept["mix"])) <= 0.02 * len(clean)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.select("doc_id", "start", "length", "ids_crc32").exceptAll(kept["pack"].select("doc_id", "start", "length", "ids_crc32")).isEmpty()


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns and empty tables: no stage crashes or loses a text
    that it does not reject, and what leaves the chain is what went in."""
    rows = [(k, t, None, None) for k, t in enumerate(ODD)] + [(None, prose(8, 120), None, None), (None, None, None, None), (7, prose(9, 150), None, "s"), (7, prose(9, 150), None, "s"), (20, prose(9, 150), "en", "t"), (7, prose(30, 150), None, None)]
    df = docs(spark, rows, clash=True)
    kept = df
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # the classifier may reject any of these
        before, kept = kept, stage(spark, kept, sf_dir)
        assert kept.columns == df.columns and kept.join(before.select("text"), kept["text"].eqNullSafe(before["text"]), "left_anti").isEmpty(), name
        if name == "exact":
            assert {r.text for r in kept.where("length(text) > 200").collect()} == {t for _, t, *_ in rows if t and len(t) > 200}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.quality(spark, df, sf_dir).columns == df.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).isEmpty(), name
