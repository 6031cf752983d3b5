"""From a stream of messages to raw history, machine states, readings log and live buffer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from thermoline import constants as C
from thermoline import schemas
from thermoline.operators import aggregates, cleaning, combine, sequence
from thermoline.sources import history, topic
from thermoline.sources.levels import LeveledTable
from thermoline.sources.versions import VersionedTable

_LANDING = [T.StructField("arrived_at", T.TimestampType()), T.StructField("offset", T.LongType()),
            T.StructField("dt", T.DateType()), T.StructField("batch", T.StringType())]
RAW_FILES = T.StructType([*schemas.READING.fields, *_LANDING])
LOG_FILES = T.StructType([*schemas.LOG.fields, *_LANDING])
STATE_FILES = T.StructType([*schemas.STATUS.fields, *_LANDING[:2]])
STATE_ORDER = {"event": ("last_updated", "reading_id", "arrived_at", "batch", "offset"),
               "arrival": ("last_updated", "batch", "offset", "reading_id")}


def decoded_stream(messages: DataFrame) -> DataFrame:
    """Messages (key, value, offset) → typed, classified readings with `reject_reason` and the
    message's `raw_value`. Stateless. Rows with a reason are no readings: what is not a JSON
    object, and what has a time that cannot be read.

    `arrived_at` is the micro-batch's own time, which the checkpoint records: a replayed batch
    gives the same rows, also where a missing event time falls back to it.
    """
    arrived = topic.check_records(messages).withColumns({
        "arrived_at": F.current_timestamp(), "raw_value": F.col("value").cast("string")})
    rows = topic.normalize_records(topic.decode_records(arrived), now=F.col("arrived_at"),
                                   unreadable="_unreadable")
    return rows.withColumn("reject_reason", F.coalesce(
        "reject_reason", F.when(F.col("_unreadable"), F.lit(C.UNREADABLE_TIME)))).drop(
            "_unreadable")


def telemetry_stream(messages: DataFrame) -> DataFrame:
    """The readings of `decoded_stream`."""
    return decoded_stream(messages).filter("reject_reason IS NULL").drop(
        "reject_reason", "raw_value")


def rejected_stream(messages: DataFrame) -> DataFrame:
    """The other messages: raw_value, reject_reason, arrived_at and what places them."""
    return _rejects(decoded_stream(messages))


def _rejects(decoded: DataFrame) -> DataFrame:
    places = [c for c in ("partition", "offset") if c in decoded.columns]
    return decoded.filter("reject_reason IS NOT NULL").select(
        "raw_value", "reject_reason", "arrived_at", *places)


def dedupe_stream(readings: DataFrame, delay: str = "1 hour", key: str = "reading_id",
                  time: str = "arrived_at") -> DataFrame:
    """Drops redeliveries that arrive within `delay` of the first; the state holds the ids of that
    span only. `time` is the time of arrival, which never runs behind, so that a first delivery
    is kept however old its event is. Readings without id are kept."""
    known = readings.withColumn("_key", F.coalesce(F.col(key), F.uuid()))
    return known.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def land_raw(readings: DataFrame, path: str, checkpoint: str,
             trigger: dict[str, object] | None = None) -> StreamingQuery:
    """Appends readings to the raw history by event date. The file sink's log makes each batch
    land exactly once; the trigger interval sets how large the files get."""
    dated = cleaning.with_partition_date(readings)
    return (dated.writeStream.format("parquet").partitionBy("dt").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


@dataclass(frozen=True)
class Targets:
    """Where `run_pipeline` keeps its four tables, and the messages that are no readings.

    A machine's state is its last event, or (`status_by="arrival"`) the last to arrive. Log and
    states are kept in levels: `fanout` batches or runs make a run of the next level, in `buckets`
    files by key."""

    spark: SparkSession
    root: str
    status_by: str = "event"
    buckets: int = 16
    fanout: int = 8

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def log(self) -> str:
        return f"{self.root}/log"

    @property
    def log_table(self) -> LeveledTable:
        return log_table(self.spark, self.log, self.buckets, self.fanout)

    @property
    def status(self) -> LeveledTable:
        return LeveledTable(self.spark, f"{self.root}/machine_states_by_{self.status_by}",
                            STATE_FILES, "machine_id", STATE_ORDER[self.status_by],
                            buckets=self.buckets, fanout=self.fanout)

    @property
    def live(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/live_buffer", schemas.READING)


def append_batch(rows: DataFrame, path: str, batch: str, time: str = "txn_timestamp") -> None:
    """Lands one micro-batch under dt=…/batch=…; a replay overwrites its own folders only."""
    dated = cleaning.with_partition_date(rows, time=time).withColumn("batch", F.lit(batch))
    history.write_history(dated, path, ("dt", "batch"))


def live_buffer(current: DataFrame, batch: DataFrame, n: int = C.LIVE_BUFFER) -> DataFrame:
    """The `n` newest readings of the buffer and a batch. The batch is cut to its own newest
    readings first, so the union stays small."""
    names = schemas.READING.names
    last = [F.desc("txn_timestamp"), F.desc("offset")]
    fresh = sequence.newest(sequence.dedupe(batch.select(*names, "offset"), "reading_id", last), n)
    known = current.select(*names, F.lit(-1).cast("bigint").alias("offset"))
    both = sequence.dedupe(known.unionByName(fresh), "reading_id", last)
    return sequence.newest(both, n).drop("offset")


def live_counts(buffer: DataFrame) -> DataFrame:
    """Alert and normal readings in the live buffer."""
    return aggregates.reading_counts(buffer).select(
        F.col("returned_readings_count").alias("buffer_size"),
        F.col("alert_readings_count").alias("live_alert_count"),
        F.col("normal_readings_count").alias("live_normal_count"))


def write_batch(readings: DataFrame, targets: Targets, batch: str,
                buffer_size: int = C.LIVE_BUFFER) -> None:
    """Writes one micro-batch of readings to the four tables, and those with a `reject_reason` to
    the rejects. Each write is idempotent, so a batch that failed half-way is simply repeated.

    Log and states take the batch by itself: a write costs the size of the batch, not of the
    table. Once enough batches wait they are folded, in place."""
    decoded = readings.persist()
    try:
        if "reject_reason" in decoded.columns:
            append_batch(_rejects(decoded), targets.rejects, batch, "arrived_at")
            readings = decoded.filter("reject_reason IS NULL").drop("reject_reason", "raw_value")
        append_batch(readings, targets.raw, batch)
        append_batch(readings.select(*schemas.LOG.names, "arrived_at", "offset")
                     .filter(F.col("reading_id").isNotNull()), targets.log, batch)
        targets.status.append(batch_states(readings, targets.status_by), batch)
        live = targets.live
        live.replace(live_buffer(live.read(), readings, buffer_size))
        live.prune()
    finally:
        decoded.unpersist()
    targets.log_table.compact()
    targets.status.compact()


def batch_states(readings: DataFrame, status_by: str = "event") -> DataFrame:
    """The last state of each machine of a micro-batch, with its `arrived_at` and `offset`."""
    updated = "arrived_at" if status_by == "arrival" else "txn_timestamp"
    states = readings.select(
        *[c for c in schemas.STATUS.names if c != "last_updated"],
        F.col(updated).alias("last_updated"), "arrived_at", "offset")
    order = [c for c in STATE_ORDER[status_by] if c != "batch"]
    return sequence.latest_per_key(states, "machine_id", order)


def run_pipeline(readings: DataFrame, targets: Targets, checkpoint: str,
                 trigger: dict[str, object] | None = None) -> StreamingQuery:
    """Feeds every micro-batch to `write_batch`. Offsets are committed after the batch is
    written; a failing write fails the batch, and a restart repeats it."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        # The query id lives in the checkpoint: a new checkpoint never reuses old folders.
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_batch(batch, targets, f"{query}-{batch_id:012d}")

    return (readings.writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Landed raw history, every delivery."""
    return history.read_history(spark, path, RAW_FILES)


def log_table(spark: SparkSession, path: str, buckets: int = 16, fanout: int = 8) -> LeveledTable:
    """The readings log: first delivery wins, but for `combine.LOG_UPDATES`, which follow the
    last one."""
    return LeveledTable(spark, path, LOG_FILES, "reading_id",
                        ("arrived_at", "batch", "offset", "txn_timestamp"), combine.LOG_UPDATES,
                        ("dt", "batch"), buckets, fanout)


def read_log(spark: SparkSession, path: str,
             update_cols: tuple[str, ...] | str = combine.LOG_UPDATES) -> DataFrame:
    """The readings log: one row per reading, merged on read over the runs and the batches that
    are in no run yet. Only the latter are shuffled."""
    return log_table(spark, path).read(update_cols)


def compact_log(spark: SparkSession, path: str, target: str, batch: str = "0-compacted") -> None:
    """Writes the merged log to a new place, in the layout that `read_log` reads and that later
    batches may be appended to."""
    merged = cleaning.with_partition_date(read_log(spark, path)).withColumn("batch", F.lit(batch))
    history.write_history(merged, target, ("dt", "batch"))
