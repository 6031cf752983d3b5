import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from thermoline import schemas
from thermoline.operators import aggregates, combine, sequence
from thermoline.sources import history, topic
from thermoline.streaming import ingest

ONCE = {"availableNow": True}


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture
def message_files(spark, telemetry, tmp_path):
    """Messages in ten files: each reading once, then some of them again."""
    path = str(tmp_path / "messages")
    sent = topic.encode_records(telemetry.select(*schemas.READING.names)).withColumn(
        "offset", F.monotonically_increasing_id())
    sent.repartition(8, "key").write.parquet(path)
    again = sent.filter(F.col("offset") % 3 == 0).withColumn("offset", F.col("offset") + 10 ** 9)
    again.repartition(2, "key").write.mode("append").parquet(path)
    return path


def stream(spark, path, files=3):
    source = (spark.readStream.schema("key binary, value binary, offset bigint")
              .option("maxFilesPerTrigger", files).parquet(path))
    return ingest.telemetry_stream(source)


def batch(spark, path):
    return topic.normalize_records(topic.decode_records(spark.read.parquet(path)))


def run(spark, path, targets, checkpoint, files=3):
    query = ingest.run_pipeline(stream(spark, path, files), targets, str(checkpoint), ONCE)
    query.awaitTermination()


def tables(targets):
    spark = targets.spark
    return {
        "status": rows(targets.status.read(), schemas.STATUS.names),
        "log": rows(ingest.read_log(spark, targets.log), schemas.LOG.names),
        "live": rows(targets.live.read(), schemas.READING.names),
        "raw": rows(sequence.dedupe(ingest.read_raw(spark, targets.raw)),
                    schemas.READING.names),
    }


def test_pipeline_equals_batch(spark, telemetry, message_files, tmp_path):
    targets = ingest.Targets(spark, str(tmp_path / "out"))
    run(spark, message_files, targets, tmp_path / "checkpoint")
    single = sequence.dedupe(batch(spark, message_files))
    have = tables(targets)
    assert have["log"] == rows(single, schemas.LOG.names)
    assert have["raw"] == rows(single, schemas.READING.names)
    assert have["status"] == rows(combine.status_rows(sequence.latest_per_key(single)),
                                  schemas.STATUS.names)
    assert have["live"] == rows(sequence.newest(single, 50), schemas.READING.names)
    assert ingest.read_raw(spark, targets.raw).count() > telemetry.count()
    counts = ingest.live_counts(targets.live.read()).first()
    assert counts["live_alert_count"] + counts["live_normal_count"] == 50


def test_replay_from_a_new_checkpoint_changes_nothing(spark, message_files, tmp_path):
    targets = ingest.Targets(spark, str(tmp_path / "out"))
    run(spark, message_files, targets, tmp_path / "first")
    before = tables(targets)
    run(spark, message_files, targets, tmp_path / "second", files=5)
    assert tables(targets) == before


def test_failed_batch_is_repeated_in_full(spark, message_files, tmp_path, monkeypatch):
    targets = ingest.Targets(spark, str(tmp_path / "out"))
    calls, real = [], ingest.live_buffer

    def fails_second_time(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("target is down")
        return real(*args)

    monkeypatch.setattr(ingest, "live_buffer", fails_second_time)
    checkpoint = tmp_path / "checkpoint"
    with pytest.raises(StreamingQueryException, match="target is down"):
        run(spark, message_files, targets, checkpoint)
    run(spark, message_files, targets, checkpoint)      # same checkpoint: goes on
    whole = ingest.Targets(spark, str(tmp_path / "whole"))
    run(spark, message_files, whole, tmp_path / "other")
    assert tables(targets) == tables(whole)
    deliveries = spark.read.parquet(message_files).count()
    assert ingest.read_raw(spark, targets.raw).count() == deliveries


def test_land_raw_appends_by_event_date(spark, message_files, tmp_path):
    out, checkpoint = str(tmp_path / "raw"), str(tmp_path / "checkpoint")
    for _ in range(2):                                   # nothing lands twice
        ingest.land_raw(stream(spark, message_files), out, checkpoint, ONCE).awaitTermination()
    landed = history.read_history(spark, out)
    assert landed.count() == spark.read.parquet(message_files).count()
    assert landed.filter(F.col("dt") != F.to_date("txn_timestamp")).isEmpty()


def test_dedupe_stream(spark, telemetry, message_files, tmp_path):
    single = ingest.dedupe_stream(stream(spark, message_files))
    out = str(tmp_path / "single")
    (single.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**ONCE)
     .start().awaitTermination())
    assert spark.read.parquet(out).count() == telemetry.count()


def test_message_without_time_takes_the_batch_time(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(b"M", b'{"reading_id": "a", "machine_id": "M"}', 0)],
                          "key binary, value binary, offset bigint").write.parquet(path)
    targets = ingest.Targets(spark, str(tmp_path / "out"))
    run(spark, path, targets, tmp_path / "checkpoint")
    row = ingest.read_raw(spark, targets.raw).first()
    assert row["txn_timestamp"] == row["arrived_at"] is not None


def test_compacted_log_reads_the_same_and_takes_more(spark, message_files, tmp_path):
    targets = ingest.Targets(spark, str(tmp_path / "out"))
    run(spark, message_files, targets, tmp_path / "checkpoint")
    packed = str(tmp_path / "packed")
    ingest.compact_log(spark, targets.log, packed)
    read = lambda path: rows(ingest.read_log(spark, path), schemas.LOG.names)
    assert read(packed) == read(targets.log)
    later = batch(spark, message_files).limit(1).select(
        *schemas.LOG.names, F.current_timestamp().alias("arrived_at"), "offset")
    later = later.withColumn("cycle_temperature", F.lit(99.5).cast(schemas.TEMPERATURE))
    changed = later.first()["reading_id"]
    ingest.append_batch(later, packed, "1-later")
    log = ingest.read_log(spark, packed)
    assert log.count() == len(read(targets.log))
    assert float(log.filter(F.col("reading_id") == changed).first()["cycle_temperature"]) == 99.5


def test_counts_over_empty_buffer(spark):
    empty = spark.createDataFrame([], schemas.READING)
    assert tuple(ingest.live_counts(empty).first()) == (0, 0, 0)
    assert aggregates.reading_counts(empty).count() == 1


def test_message_files_grow_with_the_readings(spark, telemetry, tmp_path, monkeypatch):
    from thermoline.plans import queries
    monkeypatch.setattr(queries, "FILE_ROWS", 125, raising=False)
    monkeypatch.setattr(queries, "scratch_path", lambda _spark, name: str(tmp_path / name))
    stream, batches = queries.message_stream(telemetry, "in"), []
    run = (stream.writeStream.foreachBatch(lambda batch, _: batches.append(batch.count()))
           .option("checkpointLocation", str(tmp_path / "checkpoint"))
           .trigger(availableNow=True).start())
    run.awaitTermination()
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "in").glob("*.parquet")]
    assert len(batches) == 2 and sum(batches) == sum(sizes) == telemetry.count() * 11 // 10
    assert len(sizes) > 8       # two parts, each of eight files, as far as machines fill them
