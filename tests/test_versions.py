"""Tables that change as one version, and a sink that takes each key once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.operators import runs
from larkspur.sources.versions import Conflict, KeyedSink, Kinds, VersionedTables


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "k int, v string")


class Failing:
    """A table whose write fails."""

    def __init__(self, spark):
        self.df = spark.range(3).select((F.lit(1) / F.when(F.col("id") < 2, 1).otherwise(F.raise_error(F.lit("killed")).cast("int"))).alias("x"))


def test_versions_are_read_whole(spark, tmp_path, frame):
    t = VersionedTables(spark, str(tmp_path / "db"))
    assert t.version() == 0 and t.tables() == {}
    assert t.seed_if_empty({"a": frame((1, "x")), "b": frame((2, "y"))}) and not t.seed_if_empty({"a": frame()})
    before = t.tables()
    assert t.commit({"a": frame((3, "z"))}) == 2
    # What was read before stays as it was; what didn't change is carried over.
    assert rows(before["a"]) == [(1, "x")] and rows(t.tables()["a"]) == [(3, "z")] and rows(t.tables()["b"]) == [(2, "y")]
    assert rows(t.tables(1)["a"]) == [(1, "x")]
    assert rows(VersionedTables(spark, str(tmp_path / "db")).tables()["a"]) == [(3, "z")]


def test_a_failure_between_two_tables_changes_nothing(spark, tmp_path, frame):
    t = VersionedTables(spark, str(tmp_path / "db"))
    t.commit({"a": frame((1, "x")), "b": frame((2, "y"))})
    with pytest.raises(Exception, match="killed"):
        t.commit({"a": frame((9, "new")), "b": Failing(spark).df})
    assert t.version() == 1 and rows(t.tables()["a"]) == [(1, "x")] and rows(t.tables()["b"]) == [(2, "y")]
    gone = t.vacuum()
    assert any(g.startswith("a/") for g in gone) and rows(t.tables()["a"]) == [(1, "x")] and t.vacuum() == []


def test_of_two_writers_one_is_first(spark, tmp_path, frame):
    one, two = (VersionedTables(spark, str(tmp_path / "db")) for _ in range(2))
    one.commit({"a": frame((1, "x"))})
    base = two.version()
    one.commit({"a": frame((2, "x"))}, base)
    with pytest.raises(Conflict):
        two.commit({"a": frame((3, "x"))}, base)
    assert rows(two.tables()["a"]) == [(2, "x")]

    late = []

    def add(tables):
        # The first try meets another writer.
        if not late:
            late.append(one.commit({"a": frame((5, "other"))}))
        return {"a": tables["a"].union(frame((4, "mine")))}

    two.update(add)
    assert rows(one.tables()["a"]) == [(4, "mine"), (5, "other")]


def test_empty_tables_keep_their_columns(spark, tmp_path, frame):
    t = VersionedTables(spark, str(tmp_path / "db"))
    t.commit({"a": frame()})
    assert t.tables()["a"].schema == frame().schema and t.tables()["a"].count() == 0
    with pytest.raises(ValueError, match="re-identification"):
        t.commit({"a": frame().withColumn("reidentify_map", F.lit(1))})
    assert t.version() == 1


def work(fail):
    def run(v):
        if v in fail:
            raise ValueError(v)
        return v * 2

    return lambda jobs: runs.run_cases(jobs, ["k"], run, ["v"], "artifact string").drop("elapsed_ms")


def test_a_repeated_run_does_what_is_left(spark, tmp_path, frame):
    jobs = frame((1, "a"), (2, "b"), (3, "c"), (4, "d"))
    sink = KeyedSink(spark, str(tmp_path / "out"), ["k"])
    assert sink.results() is None and sink.failures() is None and sink.pending(jobs).count() == 4
    sink.commit(work({"b"})(jobs))
    assert rows(sink.results().select("k", "artifact")) == [(1, "aa"), (3, "cc"), (4, "dd")]
    assert rows(sink.failures().select("k", "attempts", "last_error.code")) == [(2, 1, "ValueError")]
    assert rows(sink.pending(jobs)) == [(2, "b")]
    assert sink.run(jobs, work({"b"})) == 1 and rows(sink.failures().select("k", "attempts")) == [(2, 2)]
    assert sink.run(jobs, work(set())) == 1 and rows(sink.results().select("k", "artifact")) == [(1, "aa"), (2, "bb"), (3, "cc"), (4, "dd")]
    assert sink.run(jobs, work(set())) == 0 and sink.attempts().count() == 6 and sink.failures().count() == 0


def test_refusals_are_results(spark, tmp_path, frame):
    jobs = frame((1, "a"), (2, "b"))
    sink = KeyedSink(spark, str(tmp_path / "out"), ["k"], Kinds(permanent=("ValueError",)))
    sink.run(jobs, work({"b"}))
    assert sink.pending(jobs).count() == 0 and rows(sink.results().select("k", "artifact")) == [(1, "aa"), (2, None)]


def test_a_killed_run_leaves_no_half_batch(spark, tmp_path, frame):
    jobs = frame(*[(i, f"v{i}") for i in range(40)])
    whole = KeyedSink(spark, str(tmp_path / "whole"), ["k"])
    whole.run(jobs, work(set()), batches=4)

    sink, calls = KeyedSink(spark, str(tmp_path / "out"), ["k"]), []

    def dies(part):
        calls.append(1)
        out = work(set())(part)
        # The third batch is killed while its files are being written.
        return out.withColumn("artifact", F.when(F.col("k") % 2 == 0, F.raise_error(F.lit("killed"))).otherwise(F.col("artifact"))) if len(calls) == 3 else out

    with pytest.raises(Exception, match="killed"):
        sink.run(jobs, dies, batches=4)
    assert 0 < sink.results().count() < 40
    again = KeyedSink(spark, str(tmp_path / "out"), ["k"])
    assert again.run(jobs, work(set()), batches=4) == 2
    assert rows(again.results()) == rows(whole.results()) and again.attempts().count() == 40
    assert len(again.vacuum()) == 1 and rows(again.results()) == rows(whole.results())
