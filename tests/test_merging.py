"""A stored merge: ended at any step and called again, it is what the frames give, once."""

from __future__ import annotations

import fixtures
import pytest
from pyspark.sql import functions as F

from antibiogram.sources import catalog, io, mart, merging


class Killed(BaseException):
    pass


@pytest.fixture
def stored(spark, tmp_path):
    s, a = fixtures.samples(spark, [*fixtures.QUICK_SAMPLES, (None, "Volta", "Ho", "FOOD", None, None), (" ", "Volta", "Ho", "FOOD", 1.0, 1.0)]), fixtures.tests(spark, [*fixtures.QUICK_TESTS, (None, None, "E. coli", "Colistin", "R", "2024-03-01")])
    ids = spark.createDataFrame([("one", "One", "x@lab.org", "2025-01-01", None, None, "Ghana", False), ("two", "Two", "y@lab.org", "2025-01-02", None, None, None, True), ("three", "Three", "z", "2025-01-03", None, None, None, False)], io.DATASETS)
    each = lambda df: df.drop("dataset_id").crossJoin(ids.where("dataset_id <> 'three'").select("dataset_id"))
    path = str(tmp_path / "store")
    io.write_datasets(path, ids, each(s), each(a))
    return path


def content(spark, path):
    return [sorted(map(str, io.scan(spark, path, t).collect())) for t in io.TABLES]


def by_frames(spark, path):
    """The store's tables with those of the merged target in place of its own."""
    tables = [io.scan(spark, path, t) for t in io.TABLES]
    merged = catalog.merge(*tables, "one", "two")
    return [sorted(map(str, io.conform(m.where("dataset_id = 'two'"), s).unionByName(t.where("dataset_id <> 'two'")).collect())) for t, m, s in zip(tables, merged, io.TABLES.values(), strict=True)]


@pytest.mark.parametrize("step", range(8))
def test_killed_and_called_again(spark, stored, monkeypatch, step):
    want, calls = by_frames(spark, stored), [0]

    def dying(name):
        real = getattr(merging.Folders, name)

        def call(self, *args):
            calls[0] += 1
            if calls[0] - 1 == step:
                raise Killed
            return real(self, *args)

        return call

    with monkeypatch.context() as m:
        for name in ("delete", "mark", "move"):  # a try consists of these, in turn, after the staging
            m.setattr(merging.Folders, name, dying(name))
        try:
            merging.merge_stored(spark, stored, "one", "two")
            assert step >= 7
        except Killed:
            pass
    registry = io.scan(spark, stored, "datasets", "two").first()
    assert registry.rows_tests in (11, 22) and (registry.rows_tests == 11 or io.scan(spark, stored, "ast_results", "two").count() == 22)
    merging.merge_stored(spark, stored, "one", "two")
    assert content(spark, stored) == want
    assert not merging.merge_stored(spark, stored, "one", "two") and content(spark, stored) == want


def test_killed_between_removal_and_move(spark, stored, monkeypatch):
    want = by_frames(spark, stored)
    with monkeypatch.context() as m:

        def half(self, name, to):
            self.delete(to)
            raise Killed

        m.setattr(merging.Folders, "move", half)
        with pytest.raises(Killed):
            merging.merge_stored(spark, stored, "one", "two")
    assert merging.merge_stored(spark, stored, "one", "two") and content(spark, stored) == want


def test_half_staged_is_staged_anew(spark, stored, monkeypatch):
    want = by_frames(spark, stored)
    with monkeypatch.context() as m:
        real = catalog.merge
        broken = lambda *a: (*real(*a)[:2], real(*a)[2].withColumn("rows_tests", F.raise_error(F.lit("lost"))))
        m.setattr(catalog, "merge", broken)
        with pytest.raises(Exception, match="lost"):
            merging.merge_stored(spark, stored, "one", "two")
    assert merging.merge_stored(spark, stored, "one", "two") and content(spark, stored) == want


def test_again_under_another_name_and_errors(spark, stored):
    assert merging.merge_stored(spark, stored, "one", "two") and merging.merge_stored(spark, stored, "one", "two", "second")
    again = io.scan(spark, stored, "datasets", "two").first()
    assert io.scan(spark, stored, "ast_results", "two").count() == 22 and again.rows_tests == 33  # rows are replaced, counts are added to
    with pytest.raises(ValueError, match="no dataset 'four'"):
        merging.merge_stored(spark, stored, "one", "four")
    with pytest.raises(ValueError, match="'three' is empty"):
        merging.merge_stored(spark, stored, "three", "two")
    assert io.health(spark, stored).first().datasets == 3


def test_merged_rows_are_staged_in_partitions_by_the_tests_number(spark, stored, monkeypatch):
    """Not in as many as Spark's setting says, which lets a task grow with the tables."""
    want = by_frames(spark, stored)
    monkeypatch.setattr(mart, "TASK_ROWS", 1, raising=False)
    assert merging.merge_stored(spark, stored, "one", "two") and content(spark, stored) == want
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in ("samples", "ast_results"):
        rows = io.scan(spark, stored, table, "two")
        assert rows.select(F.input_file_name()).distinct().count() > parts, table
