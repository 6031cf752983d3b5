"""Publishing by manifest, newest readings over overlapping sources, indexes of many values."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thermoline import schemas
from thermoline.operators import cleaning, combine, learning
from thermoline.sources import history


def dated(rows):
    return cleaning.with_partition_date(rows).select(*schemas.READING.names, "dt")


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "source"), str(tmp_path / "target")


def put(rows, path):
    dated(rows).write.mode("append").partitionBy("dt").parquet(path)


def ids(spark, path):
    return sorted(r["reading_id"] for r in history.read_history(spark, path).collect())


def test_a_target_without_manifest_is_published_whole_once(spark, readings, store):
    source, target = store
    put(readings([("a", "M", 1, "2024-01-01"), ("b", "M", 1, "2024-01-02")]), source)
    history.write_history(dated(readings([("old", "M", 1, "2024-01-01")])), target)
    history.sync_partitions(spark, source, target)
    assert ids(spark, target) == ["a", "b"]
    assert history.changed_dates(spark, source, target).isEmpty()


def test_a_failed_publish_is_repeated(spark, readings, store, monkeypatch):
    source, target = store
    put(readings([("a", "M", 1, "2024-01-01")]), source)
    history.sync_partitions(spark, source, target)
    put(readings([("b", "M", 1, "2024-01-01"), ("c", "M", 1, "2024-01-03")]), source)
    with monkeypatch.context() as patch:
        def refuse(*_):
            raise OSError("no room")
        patch.setattr(history.VersionedTable, "replace", refuse)
        with pytest.raises(OSError):
            history.sync_partitions(spark, source, target)
    assert {str(r["dt"]) for r in history.changed_dates(spark, source, target).collect()} == {
        "2024-01-01", "2024-01-03"}
    history.sync_partitions(spark, source, target)
    assert ids(spark, target) == ["a", "b", "c"]
    assert history.changed_dates(spark, source, target).isEmpty()


def test_dates_that_are_gone_go(spark, readings, store):
    source, target = store
    put(readings([("a", "M", 1, "2024-01-01"), ("b", "M", 1, "2024-01-02"),
                  ("c", "M", 1, None)]), source)
    history.sync_partitions(spark, source, target)
    history.drop_dates(spark, source, ["2024-01-02", None, "1999-01-01"])
    history.sync_partitions(spark, source, target)
    assert ids(spark, target) == ["a"]
    assert history.changed_dates(spark, source, target).isEmpty()


def test_named_dates_leave_others_to_be_published(spark, readings, store):
    source, target = store
    put(readings([("a", "M", 1, "2024-01-01"), ("b", "M", 1, "2024-01-02")]), source)
    history.sync_partitions(spark, source, target, ["2024-01-02"])
    assert ids(spark, target) == ["b"]
    assert [str(r["dt"]) for r in history.changed_dates(spark, source, target).collect()] == [
        "2024-01-01"]


def plain_newest(sources, n):
    """The rows that sorting everything gives."""
    winner = {}
    for rank, rows in enumerate(sources):
        for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or ""), reverse=True):
            if r[0] is not None:
                winner.setdefault(r[0], (r[3], rank))
    order = sorted(winner.items(), key=lambda x: (x[1][0] is not None, x[1][0] or "", x[0]),
                   reverse=True)
    return [(i, rank) for i, (_, rank) in order[:n]]


@pytest.mark.parametrize("seed", range(3))
def test_newest_over_overlapping_sources(readings, seed):
    r, day = random.Random(seed), datetime(2024, 1, 1)
    names = [None, *(f"r{i:02d}" for i in range(40))]
    sources = [[(r.choice(names), "M", r.randint(1, 90), r.choice(
        [None, *(str(day + timedelta(hours=r.randint(0, 300))) for _ in range(6))]))
        for _ in range(size)] for size in (r.randint(0, 5), 30, 120)]
    frames = [readings(rows) for rows in sources]
    frames[2] = frames[2].withColumn("dt", F.to_date("txn_timestamp"))
    for n, first in ((3, 1), (8, 2), (60, None)):
        found = combine.newest_resolved(
            [(str(k), f) for k, f in enumerate(frames)], n, first).collect()
        assert [(row["reading_id"], int(row["source"])) for row in found] == plain_newest(
            sources, n)


def test_newest_of_nothing(readings):
    none = readings([])
    assert combine.recent_telemetry(none, none, none).collect() == []


def test_index_of_many_values_is_the_model_s(spark):
    values = [(v,) for v in "b b b a a a c c d e e e e".split()] + [(None,)]
    df = spark.createDataFrame(values, "name string")
    index = learning.index_values(df, "name", "idx")
    model = learning.index_branch(df, "name", "idx")
    more = df.unionByName(spark.createDataFrame([("new",)], "name string"))
    assert sorted(learning.with_index(more, index, "name", "idx").collect(), key=str) == sorted(
        model.transform(more).collect(), key=str)
    none = learning.index_values(df.limit(0), "name", "idx")
    assert none.count() == 0 and learning.with_index(df, none, "name", "idx").count() == len(values)
