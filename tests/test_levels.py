"""Log and machine states in levels of bucketed runs."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline import schemas
from thermoline.operators import combine
from thermoline.sources.levels import LeveledTable
from thermoline.sources.versions import VersionedTable
from thermoline.streaming import ingest

ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType()),
                    T.StructField("at", T.LongType())])


def table(spark, path, updates=("v",), **levels):
    return LeveledTable(spark, str(path), ROW, "k", ("at", "batch"), updates,
                        **({"buckets": 4, "fanout": 2} | levels))


def deliveries(spark, batch):
    """A hot key in each batch, keys that come once, keys that come again, rows without key."""
    data = [("hot", batch * 10 + i, batch) for i in range(30)]
    data += [(f"once-{batch}-{i}", i, batch) for i in range(5)]
    data += [(f"again-{i}", batch, batch) for i in range(batch % 3 + 1)]
    data += [(None, 1, batch), ("null", None, batch), ("late", batch, -batch)]
    return spark.createDataFrame(data, ROW)


def folded(spark, batches, updates=("v",)):
    rows = None
    for b in batches:
        part = deliveries(spark, b).withColumn("batch", F.lit(f"b-{b:03d}"))
        rows = part if rows is None else rows.unionByName(part)
    return sorted(map(str, combine.fold_by_key(rows, "k", updates, ("at", "batch"))
                      .drop("batch").select(*ROW.names).collect()))


def read(t, updates=None):
    return sorted(map(str, t.read(updates).collect()))


@pytest.mark.parametrize("updates", [("v",), "all", "none"])
def test_reads_the_same_at_every_level(spark, tmp_path, updates):
    t = table(spark, tmp_path / "t", updates)
    for b in range(9):
        t.append(deliveries(spark, b), f"b-{b:03d}")
        assert t.compact() == (b % 2 == 1)
        assert read(t) == folded(spark, range(b + 1), updates)
    assert [level for level, _ in t.runs()] == [3] and t.waiting() == ["b-008"]


def test_other_updates_at_reading(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for b in range(3):
        t.append(deliveries(spark, b), f"b-{b:03d}")
        t.compact()
    for updates in ("all", "none", ("v", "at")):
        assert read(t, updates) == folded(spark, range(3), updates)


def test_runs_are_merged_without_a_shuffle(spark, tmp_path):
    t = table(spark, tmp_path / "t", fanout=4)
    for b in range(12):
        t.append(deliveries(spark, b), f"b-{b:03d}")
        t.compact()
    assert len(t.runs()) == 3 and not t.waiting()
    text = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text and "Exchange" not in text
    t.append(deliveries(spark, 12), "b-012")
    text = t.read()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Bucketed: true", text)) == 3
    union = text[text.index("Union"):]
    assert text.count("Exchange") == union.count("Exchange") > 0     # the new batch alone
    assert read(t) == folded(spark, range(13))
    assert t.compact(least=1) and read(t) == folded(spark, range(13))


def test_few_runs_after_many_batches_and_folders_go(spark, tmp_path):
    t = table(spark, tmp_path / "t", fanout=3)
    for b in range(20):
        t.append(deliveries(spark, b), f"b-{b:03d}")
        t.compact(keep=1)
    assert len(t.runs()) + len(t.waiting()) <= 2 * 3 + 2
    batches = list((tmp_path / "t").glob("batch=*"))
    assert len(batches) <= 6
    runs = list((tmp_path / "t" / "_levels").glob("run=*"))
    assert len(runs) <= len(t.runs()) + 6
    assert read(t) == folded(spark, range(20))


def test_replay_of_a_folded_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for b in range(6):
        t.append(deliveries(spark, b), f"b-{b:03d}")
        t.compact(keep=1)
    before = read(t)
    assert not (tmp_path / "t" / "batch=b-000").exists()
    for b in (0, 1, 5):                                   # some gone, one still there
        t.append(deliveries(spark, b), f"b-{b:03d}")
        assert read(t) == before
    t.compact(least=1)
    assert read(t) == before


def test_reader_that_has_begun_can_finish(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for b in range(2):
        t.append(deliveries(spark, b), f"b-{b:03d}")
    begun = t.read()
    t.compact()
    assert sorted(map(str, begun.collect())) == folded(spark, range(2))


def test_failed_compaction_leaves_the_table(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    for b in range(2):
        t.append(deliveries(spark, b), f"b-{b:03d}")

    def refuse(*args, **kwargs):
        raise OSError("store is away")

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "replace", refuse)
        with pytest.raises(OSError, match="away"):
            t.compact()
    assert t.runs() == [] and read(t) == folded(spark, range(2))
    assert t.compact() and read(t) == folded(spark, range(2))


def test_second_writer_is_refused(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "v"), schemas.PREDICTION)
    empty = spark.createDataFrame([], schemas.PREDICTION)
    store.replace(empty)
    known = store.newest()
    store.replace(empty, after=known)
    with pytest.raises(RuntimeError, match="another job"):
        store.replace(empty, after=known)
    assert store.versions() == [0, 1]
    assert not list((tmp_path / "v").glob("_new-*"))


def test_empty_table_and_empty_batch(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().schema.names == ROW.names and t.read().isEmpty()
    assert t.waiting() == [] and not t.compact(least=1)
    t.append(spark.createDataFrame([], ROW), "b-000")
    assert t.read().isEmpty()
    with pytest.raises(ValueError):
        table(spark, tmp_path / "u", fanout=1)


def test_columns_of_other_names_are_left_out(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    extra = deliveries(spark, 0).withColumns({"batch": F.lit("x"), "_first": F.lit(1)})
    t.append(extra, "b-000")
    assert read(t) == folded(spark, [0])


@pytest.mark.parametrize("by", ["event", "arrival"])
def test_states_equal_the_upsert(spark, telemetry, tmp_path, by):
    targets = ingest.Targets(spark, str(tmp_path / by), status_by=by, fanout=2, buckets=4)
    known = spark.createDataFrame([], schemas.STATUS)
    for b in range(5):
        part = (telemetry.filter(F.col("event_id") % 5 == b).withColumns({
            "arrived_at": F.timestamp_seconds(F.lit(1_800_000_000 + b)),
            "offset": F.col("event_id")}))
        targets.status.append(ingest.batch_states(part, by), f"q-{b:012d}")
        targets.status.compact()
        updated = F.col("arrived_at") if by == "arrival" else None
        known = combine.upsert_status(known, combine.status_rows(part, updated), by)
    have = targets.status.read().select(*schemas.STATUS.names)
    assert sorted(map(str, have.collect())) == sorted(map(str, known.collect()))


def test_log_is_compacted_in_place(spark, telemetry, tmp_path):
    path = str(tmp_path / "log")
    log = ingest.log_table(spark, path, buckets=4, fanout=2)
    for b in range(4):
        part = telemetry.filter(F.col("event_id") % 4 <= b).withColumns({
            "arrived_at": F.timestamp_seconds(F.lit(1_800_000_000 + b)),
            "offset": F.col("event_id"),
            "cycle_temperature": (F.col("cycle_temperature") + b).cast(schemas.TEMPERATURE)})
        ingest.append_batch(part.select(*schemas.LOG.names, "arrived_at", "offset"), path,
                            f"q-{b:012d}")
        log.compact()
    assert log.waiting() == [] and [level for level, _ in log.runs()] == [2]
    rows = ingest.read_log(spark, path)
    assert rows.count() == rows.select("reading_id").distinct().count() == telemetry.count()
    changed = rows.alias("l").join(telemetry.alias("t"), "reading_id").filter(
        F.col("l.cycle_temperature") != F.col("t.cycle_temperature") + 3)
    assert changed.isEmpty()
    first = rows.groupBy("arrived_at").count().count()
    assert first == 4                                     # other columns are the first row's
