"""Registered queries: each operator run over the whole given tables, with the SQL that must
give the same rows. Outputs go through `present`, so times are text and decimals doubles."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline import schemas
from thermoline.functions import values
from thermoline.operators import aggregates, cleaning, combine, filters, learning, sequence
from thermoline.plans import inputs, insights, publish
from thermoline.plans import learning as learning_jobs
from thermoline.plans.oracles import (DELIVERIES, EDGES, LATEST, MESSAGES, ODD_IDS, RAW, shown,
                                      sql)
from thermoline.session import materialize, scratch_path
from thermoline.sources import history, models, topic
from thermoline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of the telemetry readings."""
    def register(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: cleaning.present(
            build(inputs.telemetry(spark, folder)))
        if oracle is not None:
            ORACLES[name] = oracle
        return build
    return register


def table_query(name: str, table: str, oracle: str):
    """Registers a function of one given table: the operators take any keyed table."""
    def register(build: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return cleaning.present(build(spark.read.parquet(f"{folder}/{table}.parquet")))

        QUERIES[name], ORACLES[name] = run, oracle
        return build
    return register


READING = "reading_id, machine_id, branch, cast(cycle_temperature AS double) AS cycle_temperature"
FULL = (f"{READING}, vibration_hz, power_kw, water_pressure_bar, error_code, "
        f"{shown('txn_timestamp')}, status, breakdown_soon")
LOG = f"{READING}, {shown('txn_timestamp')}, status, breakdown_soon"
STATUS = (f"machine_id, reading_id, branch, cast(cycle_temperature AS double) AS "
          f"cycle_temperature, status, breakdown_soon, {shown('last_updated')}")
READING_COLUMNS = schemas.READING.names
LOG_COLUMNS = schemas.LOG.names


# -- sources ---------------------------------------------------------------------------------

def land(df: DataFrame, name: str, file_format: str = "parquet") -> str:
    path = scratch_path(df.sparkSession, name)
    history.write_history(inputs.raw(df).select(*READING_COLUMNS, "dt"), path,
                          file_format=file_format)
    return path


def land_mixed(df: DataFrame, name: str) -> str:
    """Even days as Parquet, odd days as JSON Lines whose time field is `timestamp`."""
    rows = inputs.raw(df).select(*READING_COLUMNS, "dt")
    path = scratch_path(df.sparkSession, name)
    even = F.dayofmonth("dt") % 2 == 0
    history.write_history(rows.filter(even), path)
    history.write_history(
        rows.filter(~even).withColumnRenamed("txn_timestamp", "timestamp"), path,
        file_format="json")
    return path


@query("s1_read_history", sql(f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    return history.read_history(t.sparkSession, land(t, "s1"))


@query("s2_read_history_json", sql(f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    return cleaning.canonicalize(
        history.read_history_json(t.sparkSession, land(t, "s2", "json")))


@query("s3_load_history", sql(f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    return history.load_history(t.sparkSession, land_mixed(t, "s3"))


@query("s3_load_history_dedupe", sql(f"SELECT {FULL} FROM telemetry"))
def _(t):
    twice = t.unionByName(t)
    rows = history.load_history(t.sparkSession, land_mixed(twice, "s3d"), dedupe=True)
    return rows.drop("dt")


@query("s3_dedupe_keeps_rows_without_id", sql("""
SELECT CASE WHEN event_id % 3 <> 0 THEN reading_id END AS reading_id, machine_id,
       CASE WHEN event_id % 3 = 0 THEN copy END AS copy
FROM telemetry, (SELECT unnest([1, 2]) AS copy) WHERE event_id % 3 = 0 OR copy = 1"""))
def _(t):
    twice = t.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({
        "reading_id": F.when(F.col("event_id") % 3 != 0, F.col("reading_id")),
        "breakdown_soon": F.col("copy")})
    rows = history.load_history(t.sparkSession, land_mixed(twice, "s3n"), dedupe=True)
    without = F.col("reading_id").isNull()
    return rows.select("reading_id", "machine_id",
                       F.when(without, F.col("breakdown_soon")).alias("copy"))


@query("s3_dedupe_takes_the_latest_copy", sql(f"""
SELECT {READING} FROM (
  SELECT *, row_number() OVER (PARTITION BY reading_id
                               ORDER BY txn_timestamp DESC, cycle_temperature) AS rn
  FROM deliveries) WHERE rn = 1""", DELIVERIES))
def _(t):
    rows = history.load_history(t.sparkSession, land_mixed(inputs.deliveries(t), "s3c"),
                                dedupe=True)
    return rows.select("reading_id", "machine_id", "branch", "cycle_temperature")


@query("s3_seed_files_beside_sink_files", sql(f"""
SELECT {READING}, {shown('txn_timestamp')}, status, breakdown_soon,
       cast(cast(txn_timestamp AS date) AS varchar) AS dt FROM telemetry"""))
def _(t):
    # Rows as a data-frame library writes them, as our sink does, and as lines, in one tree.
    path, rows = scratch_path(t.sparkSession, "s3s"), inputs.raw(t)
    kind = F.col("event_id") % 3
    seed = rows.filter(kind == 0).select(
        "reading_id", "machine_id", "branch", F.col("cycle_temperature").cast("double"),
        F.date_format("txn_timestamp", cleaning.TIME_FORMAT).alias("txn_timestamp"), "status",
        F.col("breakdown_soon").cast("bigint"), "dt")
    names = [*READING_COLUMNS, "dt"]
    seed.write.option("compression", "gzip").partitionBy("dt").parquet(path)
    rows.filter(kind == 1).select(*names).write.mode("append").option(
        "compression", "zstd").partitionBy("dt").parquet(path)
    rows.filter(kind == 2).select(*names).write.mode("append").option(
        "timestampFormat", history.JSON_TIME).partitionBy("dt").json(path)
    read = history.load_history(t.sparkSession, path,
                                layouts=(("*.gz.parquet", None), ("*.zstd.parquet", None)))
    return read.select("reading_id", "machine_id", "branch", "cycle_temperature",
                       "txn_timestamp", "status", "breakdown_soon", "dt")


@query("s3_columns_of_all_files", sql(f"""
SELECT {READING}, CASE WHEN event_id % 2 = 0 THEN vibration_hz END AS vibration_hz,
       CASE WHEN event_id % 2 = 1 THEN event_id END AS event_id FROM telemetry"""))
def _(t):
    # Half of the files lack one column, the other half another.
    path, rows = scratch_path(t.sparkSession, "s3l"), inputs.raw(t).select(
        *READING_COLUMNS, "event_id", "dt")
    even = F.col("event_id") % 2 == 0
    rows.filter(even).drop("event_id").write.partitionBy("dt").parquet(path)
    rows.filter(~even).drop("vibration_hz").write.mode("append").partitionBy("dt").parquet(path)
    return history.load_history(t.sparkSession, path).select(
        "reading_id", "machine_id", "branch", "cycle_temperature", "vibration_hz", "event_id")


@query("s3_three_schemas_in_one_date", sql(f"""
SELECT {READING}, {shown('txn_timestamp')}, status, breakdown_soon,
       CASE WHEN event_id % 3 > 0 THEN vibration_hz END AS vibration_hz,
       CASE WHEN event_id % 3 = 2 THEN event_id END AS event_id,
       cast(cast(txn_timestamp AS date) AS varchar) AS dt FROM telemetry"""))
def _(t):
    # Three writers that differ in types and columns; nobody tells the reader which is which.
    path, rows = scratch_path(t.sparkSession, "s3w"), inputs.raw(t)
    kind, time = F.col("event_id") % 3, F.col("txn_timestamp")
    temperature = F.col("cycle_temperature")
    names = ["reading_id", "machine_id", "branch", "cycle_temperature", "txn_timestamp", "status",
             "breakdown_soon", "vibration_hz", "event_id", "dt"]
    doubles = rows.withColumns({
        "cycle_temperature": temperature.cast("double"),
        "txn_timestamp": F.date_format(time, cleaning.TIME_FORMAT),
        "breakdown_soon": F.col("breakdown_soon").cast("bigint")}).select(*names)
    texts = rows.withColumns({
        "cycle_temperature": temperature.cast("string"),
        "vibration_hz": F.col("vibration_hz").cast("string")}).select(*names)
    for written in (doubles.filter(kind == 0).drop("vibration_hz", "event_id"),
                    rows.select(*names).filter(kind == 1).drop("event_id"),
                    texts.filter(kind == 2).withColumnRenamed("txn_timestamp", "timestamp")):
        written.write.mode("append").partitionBy("dt").parquet(path)
    return history.load_history(t.sparkSession, path).select(*names)


@query("s2_broken_lines", sql("""
SELECT (SELECT count(*) FROM telemetry) AS good,
       (SELECT count(*) FROM telemetry WHERE event_id % 10 = 0) AS rejected"""))
def _(t):
    path = scratch_path(t.sparkSession, "s2b")
    line = F.to_json(F.struct("reading_id", "machine_id"))
    broken = F.when(F.col("event_id") % 20 == 0, '{"machine_id":').otherwise("[1,2]")
    both = t.select(F.to_date("txn_timestamp").alias("dt"), F.explode(F.when(
        F.col("event_id") % 10 == 0, F.array(line, broken)).otherwise(
            F.array(line))).alias("value"))
    both.write.partitionBy("dt").text(path)
    good = history.read_history_json(t.sparkSession, path, names="*.txt")
    bad = history.rejected_lines(t.sparkSession, path, names="*.txt")
    return good.agg(F.count("*").alias("good")).withColumn(
        "rejected", bad.agg(F.count("*")).scalar())


@query("s5_decode_records", sql(f"SELECT {FULL} FROM telemetry"))
def _(t):
    messages = topic.encode_records(t.select(*READING_COLUMNS))
    return cleaning.canonicalize(topic.decode_records(messages))


@query("s6_load_first", sql(f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    landed = land(t, "s6")
    return history.load_first(t.sparkSession, [
        lambda s: history.read_history(s, landed + "-missing"),
        lambda s: history.read_history(s, landed)])


@query("s7_recent_landed", sql(f"""
SELECT {FULL} FROM raw WHERE dt = DATE '2024-01-15'
ORDER BY raw.txn_timestamp DESC, reading_id DESC LIMIT 25""", RAW))
def _(t):
    landed = history.read_history(t.sparkSession, land(t, "s7"))
    return sequence.recent_landed(landed, "2024-01-15").drop("dt")


# -- sinks -----------------------------------------------------------------------------------

@query("k1_ensure_columns", sql(f"""
SELECT {LOG}, cast(NULL AS double) AS vibration_hz, cast(NULL AS double) AS power_kw,
       cast(NULL AS double) AS water_pressure_bar, 'NORMAL' AS error_code
FROM telemetry"""))
def _(t):
    return cleaning.ensure_columns(combine.log_rows(t), schemas.READING,
                                   {"error_code": C.NO_ERROR})


AVERAGES = """
SELECT branch, cast(round(avg(cycle_temperature), 2) AS double) AS avg_temperature
FROM telemetry GROUP BY branch"""


@query("k2_write_result", sql(AVERAGES))
def _(t):
    path = scratch_path(t.sparkSession, "k2")
    history.write_result(t.select("branch"), path)
    history.write_result(aggregates.avg_by_group(t), path)
    return t.sparkSession.read.parquet(path)


@query("k3_insights_snapshot", sql("""
SELECT replace(replace(cast(to_json(struct_pack(
  avg_by_branch := (
    SELECT list(struct_pack(branch := branch, avg_temperature := m) ORDER BY m DESC, branch)
    FROM (SELECT branch, round(avg(cycle_temperature), 2) AS m FROM telemetry GROUP BY branch)),
  time_in_alert := (
    SELECT list(struct_pack(machine_id := machine_id, branch := branch, alert_count := n)
                ORDER BY n DESC, machine_id, branch)
    FROM (SELECT machine_id, branch, count(*) AS n FROM telemetry
          WHERE cycle_temperature > 70 GROUP BY ALL
          ORDER BY n DESC, machine_id, branch LIMIT 15)),
  busiest_hour := (
    SELECT list(struct_pack(hour := h, alert_count := n) ORDER BY n DESC, h)
    FROM (SELECT hour(txn_timestamp) AS h, count(*) AS n FROM telemetry
          WHERE cycle_temperature > 70 GROUP BY h)),
  good_condition_count := (SELECT count(*) FROM telemetry WHERE breakdown_soon = 0),
  normal_temp_count := (
    SELECT count(*) FROM telemetry WHERE cycle_temperature BETWEEN 30 AND 70),
  total_machines := (SELECT count(*) FROM telemetry))) AS varchar),
  ', ', ','), ': ', ':') AS snapshot"""))
def _(t):
    return insights.snapshot(insights.insights(insights.profile(t)), C.TOP_MACHINES)


@query("k3_snapshot_all_machines", sql("""
SELECT machine_id, branch, count(*) AS alert_count FROM telemetry
WHERE cycle_temperature > 70 GROUP BY ALL"""))
def _(t):
    lines = insights.snapshot_lines(insights.insights(insights.profile(t)))
    entry = F.from_json(F.ltrim("value", F.lit(",")),
                        "machine_id string, branch string, alert_count bigint")
    return lines.select(entry.alias("e")).where("e.machine_id is not null").select("e.*")


@query("k3_run_insights_time_in_alert", sql("""
SELECT machine_id, branch, count(*) AS alert_count FROM telemetry
WHERE cycle_temperature > 70 GROUP BY ALL"""))
def _(t):
    out = scratch_path(t.sparkSession, "k3")
    insights.run_insights(t.sparkSession, land_mixed(t, "k3raw"), out)
    return t.sparkSession.read.parquet(f"{out}/time_in_alert")


# The history after the changes that `_refreshed` makes: late files, a rewritten and a gone span.
CHANGED = f"""changed AS (
  SELECT * FROM raw
  WHERE dt >= DATE '2024-01-05' AND (dt >= DATE '2024-01-10' OR event_id % 2 = 0))"""


def _refreshed(t: DataFrame, name: str) -> str:
    """Insights kept up to date by date: a first run, changes of some dates, a second run."""
    spark = t.sparkSession
    source, out = scratch_path(spark, f"{name}in"), scratch_path(spark, name)
    late = F.col("txn_timestamp") >= F.lit("2024-01-25").cast("timestamp")
    _append(t.filter(~late | (F.col("event_id") % 3 > 0)), source)
    insights.run_insights(spark, source, out, profiles=f"{out}-profiles")
    _append(t.filter(late & (F.col("event_id") % 3 == 0)), source)
    fewer = t.filter("txn_timestamp >= '2024-01-05' and txn_timestamp < '2024-01-10'")
    history.write_history(inputs.raw(fewer.filter("event_id % 2 = 0")).select(
        *READING_COLUMNS, "dt"), source)
    history.drop_dates(spark, source, [f"2024-01-{d:02d}" for d in range(1, 5)])
    insights.run_insights(spark, source, out, profiles=f"{out}-profiles")
    return out


@query("a1_average_after_changed_dates", sql("""
SELECT branch, cast(round(avg(cycle_temperature), 2) AS double) AS avg_temperature
FROM changed GROUP BY branch""", RAW, CHANGED))
def _(t):
    return t.sparkSession.read.parquet(f"{_refreshed(t, 'a1r')}/avg_temp_by_branch")


@query("a2_alerts_after_changed_dates", sql("""
SELECT machine_id, branch, count(*) AS alert_count FROM changed
WHERE cycle_temperature > 70 GROUP BY ALL""", RAW, CHANGED))
def _(t):
    return t.sparkSession.read.parquet(f"{_refreshed(t, 'a2r')}/time_in_alert")


@query("a3_hours_after_changed_dates", sql("""
SELECT hour(txn_timestamp) AS hour, count(*) AS alert_count FROM changed
WHERE cycle_temperature > 70 GROUP BY ALL""", RAW, CHANGED))
def _(t):
    return t.sparkSession.read.parquet(f"{_refreshed(t, 'a3r')}/busiest_alert_hour")


@query("a8_health_after_changed_dates", sql("""
SELECT count(*) FILTER (breakdown_soon = 0) AS good_condition_count,
       count(*) FILTER (cycle_temperature BETWEEN 30 AND 70) AS normal_temp_count,
       count(*) AS total_machines FROM changed""", RAW, CHANGED))
def _(t):
    return t.sparkSession.read.parquet(f"{_refreshed(t, 'a8r')}/fleet_health")


@query("k4_land_raw", sql(f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    spark = t.sparkSession
    source = scratch_path(spark, "k4in")
    t.select(*READING_COLUMNS).write.parquet(source)
    stream = spark.readStream.schema(schemas.READING).parquet(source)
    out = scratch_path(spark, "k4")
    ingest.land_raw(stream, out, out + "-checkpoint", {"availableNow": True}).awaitTermination()
    return history.read_history(spark, out)


@query("k5_upsert_status", sql(f"SELECT {STATUS} FROM machine_status", LATEST))
def _(t):
    middle = F.lit("2024-01-16").cast("timestamp")
    known = inputs.machine_status(t.filter(F.col("txn_timestamp") < middle))
    later = t.filter(F.col("txn_timestamp") >= F.lit("2024-01-10").cast("timestamp"))
    return combine.upsert_status(known, combine.status_rows(later))


def _merge_sql(update_cols: tuple[str, ...]) -> str:
    columns = [c for c in LOG_COLUMNS if c != "reading_id"]
    pick = [f"{'max_by' if c in update_cols else 'min_by'}({c}, arrival) AS {c}" for c in columns]
    return sql(f"""
SELECT {LOG} FROM (
  SELECT reading_id, {', '.join(pick)} FROM deliveries GROUP BY reading_id)""", DELIVERIES)


def _merged(t: DataFrame, update_cols) -> DataFrame:
    """First deliveries of the first half are the table; all others are the batch."""
    rows = inputs.deliveries(t).select(*LOG_COLUMNS, "arrival")
    in_table = ((F.col("arrival") < 10 ** 12)
                & (F.col("txn_timestamp") < F.lit("2024-01-16").cast("timestamp")))
    merged = combine.merge_by_key(rows.filter(in_table), rows.filter(~in_table), "reading_id",
                                  update_cols, ("arrival",))
    return merged.drop("arrival")


@query("k6_merge_by_key", _merge_sql(("cycle_temperature", "status")))
def _(t):
    return _merged(t, combine.LOG_UPDATES)


@query("k6_merge_by_key_with_flag", _merge_sql(("cycle_temperature", "status", "breakdown_soon")))
def _(t):
    return _merged(t, ("cycle_temperature", "status", "breakdown_soon"))


@query("k6_merge_whole_row", _merge_sql(tuple(LOG_COLUMNS)))
def _(t):
    return _merged(t, "all")


@query("k6_merge_first_wins", _merge_sql(()))
def _(t):
    return _merged(t, "none")


@query("k7_encode_records", sql("""
SELECT machine_id AS key, reading_id, branch, cast(cycle_temperature AS varchar) AS temperature,
       strftime(txn_timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, status,
       cast(breakdown_soon AS varchar) AS breakdown_soon
FROM (SELECT * REPLACE (cast(cycle_temperature AS double) AS cycle_temperature) FROM telemetry)"""))
def _(t):
    sent = topic.encode_records(t.select(*READING_COLUMNS))
    text = F.col("value").cast("string")
    return sent.select(
        F.col("key").cast("string").alias("key"),
        *[F.get_json_object(text, f"$.{field}").alias(name) for field, name in (
            ("reading_id", "reading_id"), ("branch", "branch"),
            ("cycle_temperature", "temperature"), ("timestamp", "timestamp"),
            ("status", "status"), ("breakdown_soon", "breakdown_soon"))])


@query("k8_sync_partitions", sql(f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    target = scratch_path(t.sparkSession, "k8")
    source = land_mixed(t, "k8in")
    history.sync_partitions(t.sparkSession, source, target)
    history.sync_partitions(t.sparkSession, source, target)
    return history.read_history(t.sparkSession, target)


@query("k8_only_changed_dates", sql("""
SELECT cast(dt AS varchar) AS dt FROM raw WHERE dt >= DATE '2024-01-25' GROUP BY dt""", RAW))
def _(t):
    spark, target = t.sparkSession, scratch_path(t.sparkSession, "k8d")
    source = land(t, "k8din")
    early = [r[0] for r in history.partitions(spark, source).filter(
        "dt < '2024-01-25'").select(F.col("dt").cast("string")).collect()]
    history.sync_partitions(spark, source, target, early)
    return history.changed_dates(spark, source, target)


def _append(t: DataFrame, path: str) -> None:
    inputs.raw(t).select(*READING_COLUMNS, "dt").write.mode("append").partitionBy("dt").parquet(
        path)


def _touch(spark: SparkSession, path: str, only: set[str], time: str) -> None:
    """Gives the files of `path` that are not in `only` another time, as copying tools do."""
    jvm = spark.sparkContext._jvm
    moment = jvm.java.time.Instant.parse(time).toEpochMilli()
    for row in history.source_files(spark, path).select("path").collect():
        if row["path"] not in only:
            file = jvm.org.apache.hadoop.fs.Path(row["path"])
            file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).setTimes(
                file, moment, -1)


def _names(spark: SparkSession, path: str) -> set[str]:
    return {r["path"] for r in history.source_files(spark, path).select("path").collect()}


@query("k8_late_files_with_older_times", sql(
    f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    spark = t.sparkSession
    source, target = (scratch_path(spark, n) for n in ("k8o", "k8ot"))
    _append(t.filter("event_id % 2 = 0"), source)
    history.sync_partitions(spark, source, target)
    known = _names(spark, source)
    _append(t.filter("event_id % 2 = 1"), source)
    _touch(spark, source, known, "2001-01-01T00:00:00Z")
    history.sync_partitions(spark, source, target)
    return history.read_history(spark, target)


@query("k8_removed_and_rewritten_files", sql(f"""
SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw
WHERE dt >= DATE '2024-01-05' AND (dt >= DATE '2024-01-10' OR event_id % 2 = 0)""", RAW))
def _(t):
    spark = t.sparkSession
    source, target = land(t, "k8r"), scratch_path(spark, "k8rt")
    history.sync_partitions(spark, source, target)
    fewer = t.filter("txn_timestamp >= '2024-01-05' and txn_timestamp < '2024-01-10'")
    history.write_history(inputs.raw(fewer.filter("event_id % 2 = 0")).select(
        *READING_COLUMNS, "dt"), source)
    _touch(spark, source, set(), "2001-01-01T00:00:00Z")
    history.drop_dates(spark, source, [f"2024-01-{d:02d}" for d in range(1, 5)])
    history.sync_partitions(spark, source, target)
    return history.read_history(spark, target)


@query("k8_files_landing_meanwhile", sql(
    f"SELECT {FULL}, cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    spark = t.sparkSession
    source, target = (scratch_path(spark, n) for n in ("k8m", "k8mt"))
    _append(t.filter("event_id % 3 > 0"), source)
    listing = materialize(history.source_files(spark, source), "listing")
    _append(t.filter("event_id % 3 = 0"), source)
    history.sync_partitions(spark, source, target, files=listing)
    history.sync_partitions(spark, source, target)
    return history.read_history(spark, target)


@query("k9_sync_report", sql(f"""
SELECT cast(dt AS varchar) AS dt, row_count, {shown('first_reading')}, {shown('last_reading')}
FROM (SELECT dt, count(*) AS row_count, min(txn_timestamp) AS first_reading,
             max(txn_timestamp) AS last_reading FROM raw GROUP BY dt)""", RAW))
def _(t):
    return history.sync_report(history.read_history(t.sparkSession, land(t, "k9")))


@query("k9_report_after_publish", sql(f"""
SELECT cast(dt AS varchar) AS dt, row_count, {shown('first_reading')}, {shown('last_reading')}
FROM (SELECT dt, count(*) AS row_count, min(txn_timestamp) AS first_reading,
             max(txn_timestamp) AS last_reading FROM raw GROUP BY dt)""", RAW))
def _(t):
    source, target = (scratch_path(t.sparkSession, n) for n in ("k9p", "k9t"))
    history.write_history(inputs.raw(t).select(*READING_COLUMNS, "dt"), f"{source}/raw")
    return publish.publish(t.sparkSession, source, target)


# -- cleaning --------------------------------------------------------------------------------

@query("c1_validate", sql("""
SELECT event_id, CASE WHEN machine_id IS NULL THEN 'Missing required field: machine_id'
                      WHEN branch IS NULL THEN 'Missing required field: branch'
                      WHEN cycle_temperature IS NULL
                        THEN 'Missing required field: cycle_temperature'
                      WHEN timestamp IS NULL THEN 'Missing required field: timestamp'
                      WHEN status IS NULL THEN 'Missing required field: status' END
                 AS reject_reason
FROM messages""", MESSAGES))
def _(t):
    return cleaning.validate(inputs.messages(t)).select("event_id", "reject_reason")


@query("c1_accepted_and_rejected", sql("""
SELECT CASE WHEN machine_id IS NULL OR branch IS NULL OR cycle_temperature IS NULL
              OR timestamp IS NULL OR status IS NULL THEN 'rejected' ELSE 'accepted' END AS side,
       count(*) AS readings
FROM messages GROUP BY side""", MESSAGES))
def _(t):
    checked = cleaning.validate(inputs.messages(t))
    sides = (cleaning.accepted(checked).select(F.lit("accepted").alias("side"))
             .unionAll(cleaning.rejected(checked).select(F.lit("rejected"))))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("readings"))


@query("c2_parse_payload", sql("""
SELECT event_id,
       CASE event_id % 6 WHEN 0 THEN 'Invalid JSON body'
                         WHEN 1 THEN 'Payload must be a JSON object'
                         WHEN 2 THEN 'Payload must be a JSON object'
                         WHEN 3 THEN 'Missing required field: machine_id' END AS payload_error,
       CASE WHEN event_id % 6 > 3 THEN machine_id END AS machine_id,
       CASE WHEN event_id % 6 > 3 THEN branch END AS branch
FROM telemetry"""))
def _(t):
    parsed = cleaning.parse_payload(inputs.payloads(t))
    return parsed.select("event_id", "payload_error", "machine_id", "branch")


ESTIMATES = """
round(25.0 + (cast({t} AS decimal(9,4)) * 0.7) % 65, 1) AS est_vibration,
round(2.0 + (cast({t} AS decimal(9,4)) * 0.05) % 4.5, 2) AS est_power,
round(1.5 + (cast({t} AS decimal(9,4)) * 0.03) % 2.5, 2) AS est_pressure"""


@query("c3_impute_reading", sql(f"""
SELECT event_id, coalesce(reading_id, 'id-' || event_id) AS reading_id, machine_id,
       coalesce(branch, 'Kigali') AS branch, cast(temp AS double) AS cycle_temperature,
       vib AS vibration_hz, cast(est_power AS double) AS power_kw,
       cast(est_pressure AS double) AS water_pressure_bar,
       CASE WHEN temp > 70 THEN 'E01_OVERHEAT' ELSE 'NORMAL' END AS error_code,
       strftime(true_time, '%Y-%m-%d %H:%M:%S.%f') AS txn_timestamp,
       coalesce(status, CASE WHEN temp > 70 OR vib > 90 THEN 'ALERT' ELSE 'NORMAL' END) AS status,
       CASE WHEN temp > 70 OR vib > 90 THEN 1 ELSE 0 END AS breakdown_soon
FROM (SELECT *, coalesce(try_cast(vibration_hz AS double), cast(est_vibration AS double)) AS vib
      FROM (SELECT *, {ESTIMATES.format(t='temp')}
            FROM (SELECT *, coalesce(try_cast(cycle_temperature AS decimal(5,2)), 45.0) AS temp
                  FROM messages)))""", MESSAGES))
def _(t):
    filled = cleaning.impute_reading(
        inputs.messages(t), inputs.at(inputs.NOW),
        F.concat(F.lit("id-"), F.col("event_id").cast("string")))
    return filled.select("event_id", *READING_COLUMNS)


@query("c4_backfill_sensors", sql(f"""
SELECT {LOG}, cast(est_vibration AS double) AS vibration_hz,
       cast(est_power AS double) AS power_kw, cast(est_pressure AS double) AS water_pressure_bar,
       CASE WHEN cycle_temperature > 70 THEN 'E01_OVERHEAT' ELSE 'NORMAL' END AS error_code
FROM (SELECT *, {ESTIMATES.format(t='cycle_temperature')} FROM t) JOIN (
      SELECT reading_id, status, breakdown_soon FROM telemetry) USING (reading_id)"""))
def _(t):
    return cleaning.backfill_sensors(combine.log_rows(t))


@query("c5_normalize_timestamp", sql(f"""
SELECT event_id, {shown('true_time').replace('AS true_time', 'AS txn_timestamp')}
FROM messages""", MESSAGES))
def _(t):
    parsed = cleaning.normalize_timestamp(inputs.messages(t), now=inputs.at(inputs.NOW))
    return parsed.select("event_id", "txn_timestamp")


@query("c5_unreadable_times", sql("""
SELECT count(*) AS all_rows, count(*) FILTER (event_id % 5 = 4) AS unreadable
FROM messages""", MESSAGES))
def _(t):
    parsed = cleaning.normalize_timestamp(inputs.messages(t), now=inputs.at(inputs.NOW),
                                          unreadable="odd")
    return parsed.agg(F.count("*").alias("all_rows"), F.count_if("odd").alias("unreadable"))


@query("c3_default_ids_unique", sql("""
SELECT count(*) AS readings, count(*) AS ids FROM telemetry"""))
def _(t):
    # No id, no time, one machine: the bodies differ in place and in one field at most.
    bare = t.select(F.lit("WM_0001").alias("machine_id"), F.lit("Huye").alias("branch"),
                    F.lit(None).cast("string").alias("cycle_temperature"),
                    F.col("event_id").alias("offset"), F.lit(0).alias("partition"))
    filled = cleaning.impute_reading(bare, inputs.at(inputs.NOW))
    return filled.agg(F.count("*").alias("readings"),
                      F.count_distinct("reading_id").alias("ids"))


@query("c6_wild_temperatures", sql("""
SELECT event_id, cast(cast(cycle_temperature AS decimal(9,2)) * 100 AS double)
                   AS cycle_temperature FROM telemetry"""))
def _(t):
    wild = t.select("event_id", (F.col("cycle_temperature") * 100).cast("string").alias(
        "cycle_temperature"))
    return cleaning.normalize_temperature(wild).select("event_id", "cycle_temperature")


@query("c6_to_number", sql("""
SELECT event_id, coalesce(try_cast(cycle_temperature AS double), 45.0) AS ingress_value,
       coalesce(try_cast(cycle_temperature AS double), 0.0) AS stream_value
FROM messages""", MESSAGES))
def _(t):
    text = F.col("cycle_temperature")
    return inputs.messages(t).select(
        "event_id", values.to_number(text, 45.0).alias("ingress_value"),
        values.to_number(text, 0.0).alias("stream_value"))


@query("c7_classify_status", sql("""
SELECT event_id, CASE WHEN cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS by_temp,
       CASE WHEN cycle_temperature > 70 OR vibration_hz > 90 THEN 'ALERT' ELSE 'NORMAL' END
         AS by_both
FROM edges""", EDGES))
def _(t):
    rows = inputs.edges(t)
    rows = cleaning.classify_status(rows).withColumnRenamed("status", "by_temp")
    rows = cleaning.classify_status(rows, "temp_or_vibration")
    return rows.select("event_id", "by_temp", F.col("status").alias("by_both"))


@query("c8_flag_breakdown", sql("""
SELECT event_id, cast(cycle_temperature > 68 AS int) AS over_68,
       cast(cycle_temperature > 70 AS int) AS over_70,
       cast(cycle_temperature > 68 OR vibration_hz > 90 AS int) AS over_68_or_shaking
FROM edges""", EDGES))
def _(t):
    rows = inputs.edges(t)
    for name, threshold, vibration in (("over_68", C.BREAKDOWN_TEMPERATURE, None),
                                       ("over_70", C.ALERT_TEMPERATURE, None),
                                       ("over_68_or_shaking", C.BREAKDOWN_TEMPERATURE, 90.0)):
        rows = cleaning.flag_breakdown(rows, threshold, vibration).withColumnRenamed(
            "breakdown_soon", name)
    return rows.select("event_id", "over_68", "over_70", "over_68_or_shaking")


@query("c9_derive_error_code", sql("""
SELECT event_id, CASE WHEN cycle_temperature > 70 THEN 'E01_OVERHEAT' ELSE 'NORMAL' END
                   AS error_code
FROM edges""", EDGES))
def _(t):
    return cleaning.derive_error_code(inputs.edges(t).drop("error_code")).select(
        "event_id", "error_code")


@query("c10_with_partition_date", sql("""
SELECT reading_id, cast(dt AS varchar) AS dt, '2024-02-01' AS arrival_dt FROM raw""", RAW))
def _(t):
    arrival = cleaning.with_partition_date(t, "arrival", inputs.at(inputs.NOW))
    return cleaning.with_partition_date(
        arrival.withColumnRenamed("dt", "arrival_dt")).select("reading_id", "dt", "arrival_dt")


@query("c11_present", sql(f"""
SELECT {READING}, vibration_hz, round(power_kw, 2) AS power_kw,
       round(water_pressure_bar, 2) AS water_pressure_bar, error_code,
       strftime(txn_timestamp, '%Y-%m-%d %H:%M:%S') AS txn_timestamp, status, breakdown_soon
FROM telemetry"""))
def _(t):
    return cleaning.present(t.select(*READING_COLUMNS), 2, "yyyy-MM-dd HH:mm:ss")


@query("c12_normalize_predictions", sql("""
SELECT machine_id, branch, prediction, prediction AS breakdown_soon,
       CASE WHEN prediction = 1 THEN 'HIGH BREAKDOWN RISK (>70°C)' ELSE 'NORMAL (<=70°C)' END
         AS risk_status,
       CASE WHEN event_id % 4 <> 0 THEN '2024-02-01 18:00:00' ELSE '' END AS scored_at
FROM (SELECT *, coalesce(CASE WHEN event_id % 3 = 0 THEN 1 - breakdown_soon END,
                         CASE WHEN event_id % 5 <> 0 THEN breakdown_soon END, 0) AS prediction
      FROM telemetry)"""))
def _(t):
    event = F.col("event_id")
    rows = t.select(
        "machine_id", "branch",
        F.when(event % 3 == 0, 1 - F.col("breakdown_soon")).alias("prediction"),
        F.when(event % 5 != 0, F.col("breakdown_soon")).alias("breakdown_soon"),
        F.when(event % 4 != 0, inputs.at(inputs.SCORED_AT)).alias("scored_at"))
    return cleaning.normalize_predictions(rows)


@query("c13_canonicalize", sql(f"SELECT {FULL} FROM telemetry"))
def _(t):
    event = F.col("event_id")
    mixed = t.select(
        *[c for c in READING_COLUMNS if c not in ("cycle_temperature", "txn_timestamp")],
        F.col("cycle_temperature").cast("double").alias("cycle_temperature"),
        F.when(event % 2 == 0, F.col("txn_timestamp")).alias("txn_timestamp"),
        F.date_format("txn_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))
    return cleaning.canonicalize(mixed)


@query("c14_hour_of_day", sql("""
SELECT cast(hour(txn_timestamp) AS int) AS hour, count(*) AS readings
FROM telemetry GROUP BY ALL"""))
def _(t):
    return t.groupBy(F.hour("txn_timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("readings"))


@query("c15_repair_status", sql("""
SELECT machine_id, coalesce(reading_id, 'new-' || machine_id) AS reading_id,
       coalesce(branch, 'Kigali') AS branch, cast(temp AS double) AS cycle_temperature,
       CASE WHEN temp > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status,
       cast(temp > 70 AS int) AS breakdown_soon
FROM (SELECT *, coalesce(cycle_temperature, 45.0) AS temp FROM (
        SELECT machine_id, CASE WHEN event_id % 13 <> 0 THEN reading_id END AS reading_id,
               CASE WHEN event_id % 17 <> 0 THEN branch END AS branch,
               CASE WHEN event_id % 19 <> 0 THEN cycle_temperature END AS cycle_temperature
        FROM telemetry))"""))
def _(t):
    event = F.col("event_id")
    rows = t.select("machine_id", F.when(event % 13 != 0, F.col("reading_id")).alias("reading_id"),
                    F.when(event % 17 != 0, F.col("branch")).alias("branch"),
                    F.when(event % 19 != 0, F.col("cycle_temperature")).alias("cycle_temperature"),
                    "status", "breakdown_soon")
    return cleaning.repair_status(rows, F.concat(F.lit("new-"), F.col("machine_id")))


@query("c16_repair_log", sql("""
SELECT event_id, status,
       CASE WHEN status = 'ALERT' OR cycle_temperature > 70.0 THEN 1
            WHEN status = 'NORMAL' AND cycle_temperature <= 70.0 THEN 0
            ELSE breakdown_soon END AS breakdown_soon
FROM (SELECT event_id, cycle_temperature,
             CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'UNKNOWN' ELSE status END AS status,
             CASE WHEN event_id % 11 <> 0 THEN 1 - breakdown_soon END AS breakdown_soon
      FROM edges)""", EDGES))
def _(t):
    kind = F.col("event_id") % 7
    rows = inputs.edges(t).select(
        "event_id", "cycle_temperature",
        F.when(kind == 1, F.lit("UNKNOWN")).when(kind != 0, F.col("status")).alias("status"),
        F.when(F.col("event_id") % 11 != 0, 1 - F.col("breakdown_soon")).alias("breakdown_soon"))
    return cleaning.repair_log(rows).select("event_id", "status", "breakdown_soon")


# -- filters ---------------------------------------------------------------------------------

@query("f1_over_threshold", sql(f"SELECT {LOG} FROM edges WHERE cycle_temperature > 70", EDGES))
def _(t):
    return combine.log_rows(filters.over_threshold(inputs.edges(t)))


@query("f2_filter_readings", sql(f"""
SELECT {LOG} FROM telemetry
WHERE lower(branch) = 'musanze' AND upper(status) = 'ALERT' AND breakdown_soon = 1"""))
def _(t):
    return combine.log_rows(filters.filter_readings(t, branch="muSANze", status="alert",
                                                    breakdown_soon="1"))


@query("f2_filter_by_machine", sql(f"SELECT {LOG} FROM telemetry WHERE machine_id = 'WM_0007'"))
def _(t):
    return combine.log_rows(filters.filter_readings(t, "wm_0007", breakdown_soon="many"))


@query("f3_history", sql(f"""
SELECT {FULL} FROM raw WHERE dt = (SELECT max(dt) FROM raw) AND lower(branch) = 'kigali'
ORDER BY raw.txn_timestamp DESC, reading_id DESC LIMIT 50""", RAW))
def _(t):
    landed = history.read_history(t.sparkSession, land(t, "f3"))
    return filters.history(landed, branch="KIGALI", limit="all").drop("dt")


@query("f3_history_of_date", sql(f"""
SELECT {FULL} FROM raw WHERE dt = DATE '2024-01-10' AND status = 'ALERT'
ORDER BY raw.txn_timestamp DESC, reading_id DESC LIMIT 500""", RAW))
def _(t):
    landed = history.read_history(t.sparkSession, land(t, "f3d"))
    return filters.history(landed, "2024-01-10", status="alert", limit=9999).drop("dt")


@query("f3_history_total", sql("""
SELECT count(*) AS total_partition_records FROM raw
WHERE dt = (SELECT max(dt) FROM raw) AND status = 'ALERT'""", RAW))
def _(t):
    return filters.history_total(inputs.raw(t), status="ALERT")


@query("f7_clamped_limits", sql("""
SELECT least(500, count(*)) AS most, least(50, count(*)) AS usual, least(7, count(*)) AS few
FROM telemetry"""))
def _(t):
    found = [filters.clamp_limit(n, *C.READINGS_LIMIT) for n in (9999, "all", 7)]
    return t.limit(max(found)).agg(*[F.least(F.lit(n), F.count("*")).alias(name)
                                     for n, name in zip(found, ("most", "usual", "few"),
                                                        strict=True)])


NUMBER = "coalesce(try_cast(regexp_extract(substring(machine_id, 4), '^([0-9]+)', 1) AS bigint), 0)"
VALID = {
    "pattern": f"regexp_matches(upper(machine_id), '^WM_[0-9]{{4}}$') AND {NUMBER} <= 1000",
    "range": f"{NUMBER} BETWEEN 1 AND 1000",
    "prefix": f"upper(machine_id) LIKE 'WM_%' AND {NUMBER} BETWEEN 1 AND 1000",
    "strict": f"upper(machine_id) LIKE 'WM_____' AND {NUMBER} BETWEEN 1 AND 1000",
}


def _register_validity(mode: str) -> None:
    @query(f"f4_keep_valid_machines_{mode}",
           sql(f"SELECT event_id, machine_id FROM odd_ids WHERE {VALID[mode]}", ODD_IDS))
    def _(t):
        return filters.keep_valid_machines(inputs.odd_ids(t), mode=mode).select(
            "event_id", "machine_id")

    @query(f"a10_trim_report_{mode}", sql(f"""
SELECT count(*) AS rows_before, count(*) FILTER (WHERE keep) AS rows_in_range,
       count(*) FILTER (WHERE NOT keep) AS rows_removed,
       count(*) - count(*) FILTER (WHERE NOT keep) AS rows_after
FROM (SELECT {VALID[mode]} AS keep FROM odd_ids)""", ODD_IDS))
    def _(t):
        return aggregates.trim_report(inputs.odd_ids(t),
                                      filters.valid_machine(F.col("machine_id"), mode=mode))


for _mode in VALID:
    _register_validity(_mode)


@query("f5_filter_predictions", sql("""
SELECT machine_id, branch, prediction, strftime(scored_at, '%Y-%m-%d %H:%M:%S.%f') AS scored_at
FROM predictions WHERE prediction = 1 AND lower(branch) = 'huye'""", LATEST))
def _(t):
    return filters.filter_predictions(inputs.predictions(t), "1", "HUYE")


NEXT = """
SELECT reading_id, machine_id, branch, cycle_temperature AS temp, txn_timestamp AS at,
       lead(cycle_temperature) OVER (PARTITION BY machine_id ORDER BY txn_timestamp, reading_id)
         AS next_temp
FROM telemetry"""


@query("f6_drop_without_successor", sql(f"""
SELECT reading_id, cast(next_temp AS double) AS next_temp FROM ({NEXT})
WHERE next_temp IS NOT NULL"""))
def _(t):
    return sequence.with_next(t).filter(F.col("next_temp").isNotNull()).select(
        "reading_id", "next_temp")


@query("f8_normal_band", sql(f"""
SELECT {LOG} FROM edges WHERE cycle_temperature BETWEEN 30 AND 70""", EDGES))
def _(t):
    return combine.log_rows(inputs.edges(t).filter(filters.normal_band()))


# -- aggregates ------------------------------------------------------------------------------

@query("a1_avg_by_group", sql(AVERAGES))
def _(t):
    return aggregates.avg_by_group(t, ordered=True)


@query("a2_alert_counts", sql("""
SELECT machine_id, branch, count(*) AS alert_count FROM telemetry
WHERE cycle_temperature > 70 GROUP BY ALL"""))
def _(t):
    return aggregates.alert_counts(t)


@query("a3_alert_hours", sql("""
SELECT cast(hour(txn_timestamp) AS int) AS hour, count(*) AS alert_count FROM telemetry
WHERE cycle_temperature > 70 GROUP BY ALL"""))
def _(t):
    return aggregates.alert_hours(t)


@query("a3_alert_hours_by_status", sql("""
SELECT cast(hour(txn_timestamp) AS int) AS hour, count(*) AS alert_count FROM telemetry
WHERE status = 'ALERT' GROUP BY ALL"""))
def _(t):
    return aggregates.alert_hours(t, "status")


@query("a4_fleet_summary", sql("""
SELECT count(*) AS total_machines_tracked, count(*) FILTER (WHERE status = 'ALERT') AS in_alert,
       count(*) FILTER (WHERE status = 'NORMAL') AS normal
FROM machine_status""", LATEST))
def _(t):
    return aggregates.fleet_summary(inputs.machine_status(t))


@query("a5_status_summary", sql("""
SELECT status, count(*) AS count FROM machine_status GROUP BY status""", LATEST))
def _(t):
    return aggregates.status_summary(inputs.machine_status(t))


COUNTS = """
count(*) AS {total},
count(*) FILTER (WHERE status = 'ALERT' OR cycle_temperature > 70) AS {alert},
count(*) FILTER (WHERE NOT (status = 'ALERT' OR cycle_temperature > 70)) AS {normal}"""


@query("a6_reading_counts", sql("SELECT " + COUNTS.format(
    total="returned_readings_count", alert="alert_readings_count",
    normal="normal_readings_count") + " FROM edges", EDGES))
def _(t):
    return aggregates.reading_counts(inputs.edges(t))


@query("a7_prediction_summary", sql("""
SELECT count(*) AS total_scored_machines, sum(prediction)::bigint AS flagged_breakdown_soon,
       (count(*) - sum(prediction))::bigint AS normal_machines,
       cast(round(cast(100 * sum(prediction) AS decimal(18,8)) / count(*), 1) AS double)
         AS fleet_breakdown_risk_pct
FROM predictions""", LATEST))
def _(t):
    return aggregates.prediction_summary(inputs.predictions(t))


@query("a8_health_summary", sql("""
SELECT count(*) FILTER (WHERE breakdown_soon = 0) AS good_condition_count,
       count(*) FILTER (WHERE cycle_temperature BETWEEN 30 AND 70) AS normal_temp_count,
       count(*) AS total_machines
FROM edges""", EDGES))
def _(t):
    return aggregates.health_summary(inputs.edges(t))


@query("a9_partition_catalog", sql("""
SELECT cast(dt AS varchar) AS dt, count(*) AS row_count FROM raw GROUP BY dt""", RAW))
def _(t):
    return aggregates.partition_catalog(history.read_history(t.sparkSession, land(t, "a9")))


@query("a9_listed_partitions", sql("SELECT DISTINCT cast(dt AS varchar) AS dt FROM raw", RAW))
def _(t):
    return history.partitions(t.sparkSession, land_mixed(t, "a9l")).select("dt")


@query("a9_partition_count", sql("SELECT count(DISTINCT dt) AS total_partitions FROM raw", RAW))
def _(t):
    return aggregates.partition_count(inputs.raw(t))


@query("a11_fleet_kpis", sql("""
SELECT (SELECT count(*) FROM machine_status) AS total_machines,
       (SELECT count(*) FROM machine_status WHERE status = 'ALERT') AS machines_in_alert,
       (SELECT cast(round(avg(cycle_temperature), 2) AS double) FROM machine_status)
         AS avg_fleet_temperature,
       (SELECT count(*) FROM predictions WHERE prediction = 1) AS predicted_failures""", LATEST))
def _(t):
    return aggregates.fleet_kpis(inputs.machine_status(t), inputs.predictions(t))


@query("a12_top_overheating", sql("""
SELECT machine_id, branch, count(*) AS alert_count FROM telemetry
WHERE cycle_temperature > 70 GROUP BY ALL
ORDER BY alert_count DESC, machine_id, branch LIMIT 15"""))
def _(t):
    return aggregates.top_overheating(t)


# -- sequences and top-n -----------------------------------------------------------------------

@query("w1_with_next", sql(f"""
SELECT reading_id, machine_id, cast(temp AS double) AS cycle_temperature,
       cast(next_temp AS double) AS next_temp FROM ({NEXT})"""))
def _(t):
    return sequence.with_next(t).select("reading_id", "machine_id", "cycle_temperature",
                                        "next_temp")


# A third of all rows belong to one machine, half of these to one instant.
HOT = """
hot AS (
  SELECT 'same-beginning-' || reading_id AS reading_id,
         CASE WHEN event_id % 3 = 0 THEN 'WM_0001' ELSE machine_id END AS machine_id,
         cycle_temperature,
         CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE txn_timestamp END
           AS txn_timestamp
  FROM telemetry)"""


@query("w1_with_next_hot_keys", sql("""
SELECT reading_id, machine_id, cast(cycle_temperature AS double) AS cycle_temperature,
       cast(lead(cycle_temperature) OVER (PARTITION BY machine_id
                                          ORDER BY txn_timestamp, reading_id) AS double)
         AS next_temp
FROM hot""", HOT))
def _(t):
    event = F.col("event_id")
    hot = t.withColumns({
        "reading_id": F.concat(F.lit("same-beginning-"), "reading_id"),
        "machine_id": F.when(event % 3 == 0, "WM_0001").otherwise(F.col("machine_id")),
        "txn_timestamp": F.when(event % 6 == 0, F.lit("2024-01-10").cast("timestamp")).otherwise(
            F.col("txn_timestamp"))})
    return sequence.with_next(hot).select("reading_id", "machine_id", "cycle_temperature",
                                          "next_temp")


@query("w2_latest_per_key", sql(f"SELECT {FULL} FROM latest", LATEST))
def _(t):
    return sequence.latest_per_key(t).select(*READING_COLUMNS)


@query("w3_partition_sample", sql(f"""
SELECT {FULL}, cast(dt AS varchar) AS dt FROM (
  SELECT *, row_number() OVER (PARTITION BY dt ORDER BY txn_timestamp, reading_id) AS rn
  FROM raw) s
WHERE rn <= 3 ORDER BY s.dt DESC, rn LIMIT 5""", RAW))
def _(t):
    landed = history.read_history(t.sparkSession, land(t, "w3"))
    return sequence.partition_sample(landed).select(*READING_COLUMNS, "dt")


@query("o1_newest", sql(f"""
SELECT {LOG} FROM telemetry ORDER BY telemetry.txn_timestamp DESC, reading_id DESC LIMIT 50"""))
def _(t):
    return sequence.newest(combine.log_rows(t))


@query("o1_newest_landed", sql(f"""
SELECT {FULL} FROM telemetry ORDER BY telemetry.txn_timestamp DESC, reading_id DESC LIMIT 1000"""))
def _(t):
    landed = history.read_history(t.sparkSession, land(t, "o1"))
    return sequence.newest_landed(landed, 1000).drop("dt")


@query("o1_newest_landed_with_null_times", sql("""
SELECT count(*) AS listed, count(txn_timestamp) AS timed FROM telemetry"""))
def _(t):
    gaps = t.withColumn("txn_timestamp", F.when(F.col("event_id") % 4 != 0, F.col("txn_timestamp")))
    landed = history.read_history(t.sparkSession, land(gaps.unionByName(t), "o1n"))
    # As many as there are rows: those without a time come last, and are listed all the same.
    listed = sequence.newest_landed(landed, 2 ** 31 - 1).filter(
        "txn_timestamp is null or reading_id is not null")
    whole = listed.agg(F.count("*").alias("n"), F.count("txn_timestamp").alias("timed"))
    quarter = t.agg(F.count_if(F.col("event_id") % 4 == 0)).scalar()
    return whole.select((F.col("n") / 2).cast("bigint").alias("listed"),
                        ((F.col("timed") + quarter) / 2).cast("bigint").alias("timed"))


@query("o2_newest_states", sql(f"""
SELECT {STATUS} FROM machine_status
ORDER BY machine_status.last_updated DESC, machine_id DESC LIMIT 100""", LATEST))
def _(t):
    return sequence.newest_states(inputs.machine_status(t))


@query("o2_all_states", sql(f"SELECT {STATUS} FROM machine_status", LATEST))
def _(t):
    return sequence.newest_states(inputs.machine_status(t), None)


@query("o3_recent_buffer", sql(f"""
SELECT {FULL} FROM telemetry ORDER BY telemetry.txn_timestamp DESC, reading_id DESC LIMIT 100"""))
def _(t):
    return sequence.recent_buffer(t.select(*READING_COLUMNS))


# -- union, dedupe, joins ----------------------------------------------------------------------

# The buffer has changed status texts, the log holds the mornings, the raw history everything.
RECENT = f"""
WITH_BUFFER AS (
  SELECT * REPLACE ('ALERT' AS status), 'buffer' AS source, 0 AS source_rank FROM telemetry
  ORDER BY txn_timestamp DESC, reading_id DESC LIMIT 100),
WITH_LOG AS (
  SELECT * EXCLUDE (est_vibration, est_power, est_pressure) REPLACE (
           cast(est_vibration AS double) AS vibration_hz, cast(est_power AS double) AS power_kw,
           cast(est_pressure AS double) AS water_pressure_bar,
           CASE WHEN cycle_temperature > 70 THEN 'E01_OVERHEAT' ELSE 'NORMAL' END AS error_code,
           CASE WHEN cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status),
         'log' AS source, 1 AS source_rank
  FROM (SELECT *, {ESTIMATES.format(t='cycle_temperature')} FROM telemetry
        WHERE hour(txn_timestamp) < 12)),
singles AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY source_rank) AS rn
    FROM (SELECT * FROM WITH_BUFFER UNION ALL SELECT * FROM WITH_LOG
          UNION ALL SELECT *, 'raw' AS source, 2 AS source_rank FROM telemetry))
  WHERE rn = 1)"""


def _recent(t: DataFrame, **wanted) -> DataFrame:
    rows = t.select(*READING_COLUMNS)
    buffer = sequence.recent_buffer(rows).withColumn("status", F.lit(C.ALERT))
    log = cleaning.classify_status(combine.log_rows(t.filter(F.hour("txn_timestamp") < 12)))
    return combine.recent_telemetry(buffer, log, inputs.raw(t), **wanted)


@query("u1_recent_telemetry", sql(f"""
SELECT {FULL}, source FROM singles WHERE status = 'ALERT'
ORDER BY singles.txn_timestamp DESC, reading_id DESC LIMIT 500""", RECENT))
def _(t):
    return _recent(t, limit=500, status="alert")


@query("u1_recent_of_machine", sql(f"""
SELECT {FULL}, source FROM singles
WHERE machine_id = 'WM_0007' AND breakdown_soon = 0 AND txn_timestamp >= DATE '2024-01-05'
ORDER BY singles.txn_timestamp DESC, reading_id DESC LIMIT 50""", RECENT))
def _(t):
    return _recent(t, machine_id="wm_0007", breakdown_soon=0, since="2024-01-05")


@query("u1_newest_first", sql(f"""
SELECT {FULL}, source FROM singles WHERE lower(branch) = 'huye' AND status = 'ALERT'
ORDER BY singles.txn_timestamp DESC, reading_id DESC LIMIT 100""", RECENT))
def _(t):
    return _recent(t, limit=100, branch="huye", status="alert")


@query("u1_without_filter", sql(f"""
SELECT {FULL}, source FROM singles
ORDER BY singles.txn_timestamp DESC, reading_id DESC LIMIT 500""", RECENT))
def _(t):
    return _recent(t, limit=500)


@query("u1_overruled_by_old_copies", sql(f"""
SELECT {FULL}, source FROM (
  SELECT * REPLACE (CASE WHEN source = 'log' THEN TIMESTAMP '2023-12-31 00:00:00'
                         ELSE txn_timestamp END AS txn_timestamp) FROM singles) s
ORDER BY s.txn_timestamp DESC, reading_id DESC LIMIT 200""", RECENT))
def _(t):
    # Most of the newest candidates turn out to be old, so more are taken until none can enter.
    rows = t.select(*READING_COLUMNS)
    buffer = sequence.recent_buffer(rows).withColumn("status", F.lit(C.ALERT))
    log = cleaning.classify_status(combine.log_rows(t.filter(F.hour("txn_timestamp") < 12)))
    old = cleaning.backfill_sensors(log).withColumn(
        "txn_timestamp", F.lit("2023-12-31").cast("timestamp"))
    return combine.newest_resolved(
        [("buffer", buffer), ("log", old), ("raw", inputs.raw(t))], 200, first=16)


@query("u1_rare_machine_overruled", sql(f"""
SELECT {FULL}, source FROM (
  SELECT * REPLACE (CASE WHEN source = 'log' THEN TIMESTAMP '2023-12-31 00:00:00'
                         ELSE txn_timestamp END AS txn_timestamp) FROM singles) s
WHERE machine_id = 'WM_0009' AND status = 'NORMAL'
ORDER BY s.txn_timestamp DESC, reading_id DESC LIMIT 50""", RECENT))
def _(t):
    # What the log holds, it holds with an old time and its own status, and the log comes first.
    rows = t.select(*READING_COLUMNS)
    buffer = sequence.recent_buffer(rows).withColumn("status", F.lit(C.ALERT))
    log = cleaning.classify_status(combine.log_rows(t.filter(F.hour("txn_timestamp") < 12)))
    old = log.withColumn("txn_timestamp", F.lit("2023-12-31").cast("timestamp"))
    return combine.recent_telemetry(buffer, old, inputs.raw(t), machine_id="WM_0009",
                                    status="normal")


@query("u2_dedupe", sql(f"""
SELECT {LOG} FROM (
  SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY arrival) AS rn
  FROM deliveries) WHERE rn = 1""", DELIVERIES))
def _(t):
    return combine.log_rows(sequence.dedupe(inputs.deliveries(t), "reading_id", ["arrival"]))


# The batch holds the copies, without copies for the first days and with new ids for the last.
@query("j1_outer_merge", sql(f"""
SELECT {LOG} FROM (
  SELECT coalesce(n.reading_id, o.reading_id) AS reading_id,
         coalesce(o.machine_id, n.machine_id) AS machine_id,
         coalesce(o.branch, n.branch) AS branch,
         CASE WHEN n.reading_id IS NOT NULL THEN n.cycle_temperature
              ELSE o.cycle_temperature END AS cycle_temperature,
         coalesce(o.txn_timestamp, n.txn_timestamp) AS txn_timestamp,
         CASE WHEN n.reading_id IS NOT NULL THEN n.status ELSE o.status END AS status,
         coalesce(o.breakdown_soon, n.breakdown_soon) AS breakdown_soon
  FROM (SELECT * FROM telemetry WHERE txn_timestamp < TIMESTAMP '2024-01-21') o
  FULL JOIN (SELECT * REPLACE (cast(134 - cycle_temperature AS decimal(5,2)) AS cycle_temperature,
                               CASE WHEN event_id % 6 <> 0 THEN status END AS status)
             FROM telemetry WHERE txn_timestamp >= TIMESTAMP '2024-01-11') n
  ON o.reading_id = n.reading_id)"""))
def _(t):
    time = F.col("txn_timestamp")
    old = combine.log_rows(t.filter(time < F.lit("2024-01-21").cast("timestamp")))
    changed = t.withColumns({
        "cycle_temperature": (F.lit(134) - F.col("cycle_temperature")).cast("decimal(5,2)"),
        "status": F.when(F.col("event_id") % 6 != 0, F.col("status"))})
    new = combine.log_rows(changed.filter(time >= F.lit("2024-01-11").cast("timestamp")))
    return combine.outer_merge(old, new)


@query("j2_status_with_predictions", sql(f"""
SELECT {STATUS}, prediction, {shown('scored_at')}
FROM machine_status LEFT JOIN (
  SELECT machine_id, breakdown_soon AS prediction, txn_timestamp AS scored_at FROM (
    SELECT *, row_number() OVER (PARTITION BY machine_id
                                 ORDER BY txn_timestamp DESC, breakdown_soon DESC) AS rn
    FROM telemetry WHERE branch <> 'Huye') WHERE rn = 1) USING (machine_id)""", LATEST))
def _(t):
    scored = t.filter(F.col("branch") != "Huye").select(
        "machine_id", "branch", F.col("breakdown_soon").alias("prediction"),
        F.col("txn_timestamp").alias("scored_at"))
    return combine.status_with_predictions(inputs.machine_status(t), scored)


# -- learning ----------------------------------------------------------------------------------

@query("m1_label_next_breach", sql(f"""
SELECT reading_id, cast(next_temp AS double) AS next_temp,
       cast(next_temp > 70 AS int) AS breakdown_soon
FROM ({NEXT}) WHERE next_temp IS NOT NULL"""))
def _(t):
    return learning.label_next_breach(t).select("reading_id", "next_temp", "breakdown_soon")


INDEXED = """
indexed AS (
  SELECT branch, cast(row_number() OVER (ORDER BY count(*) DESC, branch) - 1 AS double)
                   AS branch_idx
  FROM telemetry GROUP BY branch)"""


@query("m2_index_branch", sql("SELECT branch, branch_idx FROM indexed", INDEXED))
def _(t):
    return learning.index_branch(t).transform(t).select("branch", "branch_idx").distinct()


@table_query("m2_index_many_values", "lineitem", """
SELECT l_orderkey, cast(row_number() OVER (ORDER BY n DESC, cast(l_orderkey AS varchar)) - 1
                        AS double) AS branch_idx
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def _(lines):
    keys = lines.select(F.col("l_orderkey").cast("string").alias("key"))
    index = learning.index_values(keys, "key", "branch_idx")
    return learning.with_index(keys, index, "key", "branch_idx").distinct().select(
        F.col("key").cast("bigint").alias("l_orderkey"), "branch_idx")


@query("m3_feature_vector", sql("""
SELECT reading_id, cast(cycle_temperature AS double) AS temperature, branch_idx
FROM telemetry JOIN indexed USING (branch)""", INDEXED))
def _(t):
    indexed = learning.index_branch(t).transform(learning.with_temperature(t))
    vectors = learning.feature_assembler().transform(indexed)
    features = vector_to_array("features")
    return vectors.select("reading_id", features[0].alias("temperature"),
                          features[1].alias("branch_idx"))


# The model by Newton steps on the counts: twelve from zero, features scaled, solved by Cramer's
# rule. Margins above zero are predicted failures.
FIT = f"""
labelled AS (
  SELECT cast(('0x' || substring(md5(reading_id || ':42'), 1, 8)) AS bigint) % 100 < 80 AS training,
         cast(temp AS double) AS temp, branch, cast(next_temp > 70 AS int) AS y,
         cast(count(*) AS double) AS w
  FROM ({NEXT}) WHERE next_temp IS NOT NULL GROUP BY ALL),
places AS (
  SELECT branch, row_number() OVER (ORDER BY sum(w) DESC, branch) - 1 AS i
  FROM labelled WHERE training GROUP BY branch),
points AS (
  SELECT training, (temp - 60) / 20 AS x, coalesce(i, (SELECT count(*) FROM places)) / 6.0 AS z,
         y, w
  FROM labelled LEFT JOIN places USING (branch)),
fit(step, a, b, c) AS (
  SELECT 0, 0.0::double, 0.0::double, 0.0::double
  UNION ALL
  SELECT step + 1,
    a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2)
         + h02 * (g1 * h12 - h11 * g2)) / det,
    b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02)
         + h02 * (h01 * g2 - g1 * h02)) / det,
    c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02)
         + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (
    SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02)
              + h02 * (h01 * h12 - h11 * h02) AS det
    FROM fit, LATERAL (
      SELECT sum(w * (y - p)) AS g0, sum(w * (y - p) * x) AS g1, sum(w * (y - p) * z) AS g2,
             sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x) AS h01,
             sum(w * p * (1 - p) * z) AS h02, sum(w * p * (1 - p) * x * x) AS h11,
             sum(w * p * (1 - p) * x * z) AS h12, sum(w * p * (1 - p) * z * z) AS h22
      FROM (SELECT *, 1 / (1 + exp(-(fit.a + fit.b * x + fit.c * z))) AS p
            FROM points WHERE training)) WHERE step < 12)),
model AS (SELECT a, b, c FROM fit WHERE step = 12)"""


def fitted_sql(body: str, *parts: str) -> str:
    return sql(body, *parts, FIT).replace("WITH", "WITH RECURSIVE", 1)


def predicted_sql(table: str) -> str:
    return fitted_sql(f"""
SELECT machine_id, t.branch, cast(a + b * (cast(cycle_temperature AS double) - 60) / 20
         + c * coalesce(i, (SELECT count(*) FROM places)) / 6.0 > 0 AS int) AS prediction,
       strftime(TIMESTAMP '{inputs.SCORED_AT}', '%Y-%m-%d %H:%M:%S.%f') AS scored_at
FROM {table} t LEFT JOIN places ON t.branch = places.branch, model""", LATEST)


@query("m4_train", fitted_sql("""
SELECT cast(sum(w) FILTER (WHERE training) AS bigint) AS train_rows,
       cast(sum(w) FILTER (WHERE NOT training) AS bigint) AS test_rows,
       any_value(auc) AS auc, any_value(weighted_precision) AS weighted_precision,
       any_value(weighted_recall) AS weighted_recall, any_value(failure_recall) AS failure_recall
FROM points, (
  SELECT round(sum(w * y * (below + same / 2)) / (p * (n - p)), 2) AS auc,
         round(CASE WHEN tp + fp > 0 THEN p / n * tp / (tp + fp) ELSE 0 END
               + CASE WHEN n > tp + fp THEN (n - p) / n * tn / (n - tp - fp) ELSE 0 END, 2)
           AS weighted_precision,
         round((tp + tn) / n, 2) AS weighted_recall, round(tp / p, 2) AS failure_recall
  FROM (
    SELECT *, sum(w * (1 - y)) OVER (PARTITION BY m) AS same,
           coalesce(sum(w * (1 - y)) OVER (ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING
                                           AND CURRENT ROW EXCLUDE GROUP), 0) AS below,
           sum(w) OVER () AS n, sum(w * y) OVER () AS p,
           coalesce(sum(w * y) FILTER (WHERE m > 0) OVER (), 0) AS tp,
           coalesce(sum(w * (1 - y)) FILTER (WHERE m > 0) OVER (), 0) AS fp,
           coalesce(sum(w * (1 - y)) FILTER (WHERE m <= 0) OVER (), 0) AS tn
    FROM (SELECT y, w, a + b * x + c * z AS m FROM points, model WHERE NOT training))
  GROUP BY n, p, tp, fp, tn)"""))
def _(t):
    metrics = learning_jobs.train_on(t)[1]
    return metrics.select("train_rows", "test_rows", *[
        F.round(c, 2).alias(c) for c in metrics.columns if not c.endswith("_rows")])


@query("m4_fit_conditions", sql(f"""
SELECT count(*) AS train_rows, cast(sum(y) AS bigint) AS failures,
       cast(sum(y) AS bigint) AS expected_failures, 1.0::double AS temperature_ratio
FROM (SELECT cast(next_temp > 70 AS int) AS y,
             cast(('0x' || substring(md5(reading_id || ':42'), 1, 8)) AS bigint) % 100 < 80
               AS training
      FROM ({NEXT}) WHERE next_temp IS NOT NULL)
WHERE training"""))
def _(t):
    # At the optimum the expected failures equal the observed ones, also weighted by feature.
    counts = materialize(learning.labelled_counts(learning.label_next_breach(t)),
                         "counts").filter("training")
    scored = learning.train(counts).transform(learning.with_temperature(counts))
    weight, label = F.col(learning.WEIGHT), F.col("breakdown_soon")
    chance, heat = vector_to_array("probability")[1], F.col("temperature")
    return scored.agg(
        F.sum(weight).cast("bigint").alias("train_rows"),
        F.sum(weight * label).cast("bigint").alias("failures"),
        F.round(F.sum(weight * chance)).cast("bigint").alias("expected_failures"),
        F.round(F.sum(weight * chance * heat) / F.sum(weight * label * heat), 3)
        .alias("temperature_ratio"))


@query("m5_split", sql("""
SELECT reading_id, cast(('0x' || substring(md5(reading_id || ':42'), 1, 8)) AS bigint) % 100 < 80
                     AS training
FROM telemetry"""))
def _(t):
    return t.select("reading_id", learning.split_column().alias("training"))


@query("m5_split_counts", sql("""
SELECT count(*) FILTER (WHERE training) AS train_rows,
       count(*) FILTER (WHERE NOT training) AS test_rows
FROM (SELECT cast(('0x' || substring(md5(reading_id || ':42'), 1, 8)) AS bigint) % 100 < 80
               AS training FROM telemetry)"""))
def _(t):
    return learning.split_counts(t)


@query("m5_labelled_counts", sql(f"""
SELECT cast(('0x' || substring(md5(reading_id || ':42'), 1, 8)) AS bigint) % 100 < 80 AS training,
       cast(temp AS double) AS cycle_temperature, branch,
       cast(next_temp > 70 AS int) AS breakdown_soon, cast(count(*) AS double) AS weight
FROM ({NEXT}) WHERE next_temp IS NOT NULL GROUP BY ALL"""))
def _(t):
    return learning.labelled_counts(learning.label_next_breach(t))


# Coefficients given from outside; the margin adds up in the same order on both sides.
INTERCEPT, SLOPE, BRANCH_SLOPE = -3.5125, 0.0625, 0.03125
KNOWN = {name: i for i, name in enumerate(C.BRANCHES[:12])}
MARGIN = f"""
margins AS (
  SELECT *, {INTERCEPT} + {SLOPE}::double * cast(cycle_temperature AS double)
              + {BRANCH_SLOPE}::double * cast(CASE branch {' '.join(
                  f"WHEN '{b}' THEN {i}" for b, i in KNOWN.items())} ELSE 12 END AS double)
              AS margin
  FROM telemetry)"""


@query("m8_score_with_coefficients", sql("""
SELECT reading_id, round(1 / (1 + exp(-margin)), 9) AS probability,
       cast(margin > 0 AS int) AS prediction
FROM margins""", MARGIN))
def _(t):
    scored = learning.score_with_coefficients(t, INTERCEPT, SLOPE, BRANCH_SLOPE, KNOWN)
    return scored.select("reading_id", F.round("probability", 9).alias("probability"),
                         F.col("prediction").cast("int").alias("prediction"))


@query("m6_evaluate", sql(f"""
SELECT round((sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc,
       round((p / n) * tp / (tp + fp) + ((n - p) / n) * tn / (tn + fn), 9)
         AS weighted_precision,
       round((tp + tn) / n, 9) AS weighted_recall, round(tp / p, 9) AS failure_recall
FROM (
  SELECT y, r, count(*) OVER ()::double AS n, sum(y) OVER ()::double AS p,
         count(*) FILTER (WHERE y = 1 AND c = 1) OVER ()::double AS tp,
         count(*) FILTER (WHERE y = 0 AND c = 1) OVER ()::double AS fp,
         count(*) FILTER (WHERE y = 0 AND c = 0) OVER ()::double AS tn,
         count(*) FILTER (WHERE y = 1 AND c = 0) OVER ()::double AS fn
  FROM (SELECT y, c, (rank() OVER (ORDER BY margin))
                       + (count(*) OVER (PARTITION BY margin) - 1) / 2.0 AS r
        FROM (SELECT margin, cast(margin > 0 AS int) AS c, cast(next_temp > 70 AS int) AS y
              FROM margins JOIN ({NEXT}) USING (reading_id) WHERE next_temp IS NOT NULL)))
GROUP BY n, p, tp, fp, tn, fn""", MARGIN))
def _(t):
    scored = learning.score_with_coefficients(learning.label_next_breach(t), INTERCEPT, SLOPE,
                                              BRANCH_SLOPE, KNOWN)
    metrics = learning.evaluate(scored, raw="margin")
    return metrics.select(*[F.round(c, 9).alias(c) for c in metrics.columns])


@query("m7_score_latest", predicted_sql("latest"))
def _(t):
    model, _metrics = learning_jobs.train_on(t)
    return learning.score(model, t, "latest", inputs.at(inputs.SCORED_AT))


@query("k10_saved_model_scores_all", predicted_sql("telemetry"))
def _(t):
    path = scratch_path(t.sparkSession, "model")
    model, _metrics = learning_jobs.train_on(t)
    models.save_model(model, path)
    loaded = models.load_model([path + "-missing", path])
    return learning.score(loaded, t, "all", inputs.at(inputs.SCORED_AT))


# -- streaming ---------------------------------------------------------------------------------

FILE_ROWS = 50_000


def message_stream(t: DataFrame, name: str, again: bool = True, files: int = 4) -> DataFrame:
    """The deliveries as a stream of message files, the repeated ones last, in several batches:
    `files` of every four files make one, or as many times more as a file would hold more than
    FILE_ROWS readings. So batches are as many for any input, and no task reads a fixed share."""
    spark, path = t.sparkSession, scratch_path(t.sparkSession, name)
    sent, times = inputs.deliveries(t), max(1, math.ceil(t.count() / (4 * FILE_ROWS)))
    for part in (F.col("arrival") < 10 ** 12, F.col("arrival") >= 10 ** 12)[:1 + again]:
        rows = sent.filter(part)
        pairs = topic.encode_records(rows.select(*READING_COLUMNS, "arrival"))
        numbered = pairs.withColumn(
            "offset", F.get_json_object(F.col("value").cast("string"), "$.arrival").cast("bigint"))
        numbered.repartition(4 * times, "key").write.mode("append").parquet(path)
    return (spark.readStream.schema("key binary, value binary, offset bigint")
            .option("maxFilesPerTrigger", files * times).parquet(path))


def _run(t: DataFrame, name: str, files: int = 4, **levels: int) -> ingest.Targets:
    targets = ingest.Targets(t.sparkSession, scratch_path(t.sparkSession, name), **levels)
    stream = ingest.telemetry_stream(message_stream(t, name + "-in", files=files))
    ingest.run_pipeline(stream, targets, targets.root + "/checkpoint",
                          {"availableNow": True}).awaitTermination()
    return targets


def _written(stream: DataFrame, name: str) -> DataFrame:
    out = scratch_path(stream.sparkSession, name)
    (stream.writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    return stream.sparkSession.read.parquet(out)


NORMALIZED = f"""
SELECT {READING}, vibration_hz, power_kw, water_pressure_bar, error_code,
       {shown('txn_timestamp')},
       CASE WHEN cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status,
       cast(cycle_temperature > 68 AS int) AS breakdown_soon"""


@query("t1_telemetry_stream", sql(f"{NORMALIZED} FROM deliveries", DELIVERIES))
def _(t):
    stream = ingest.telemetry_stream(message_stream(t, "t1-in"))
    return _written(stream, "t1").select(*READING_COLUMNS)


DIRTY = """
dirty AS (
  SELECT event_id, CASE WHEN event_id % 10 = 1 THEN 'Invalid JSON body'
                        WHEN event_id % 10 = 2 THEN 'Payload must be a JSON object'
                        WHEN event_id % 10 = 3 THEN 'Unreadable time' END AS reason
  FROM telemetry)"""


def dirty_stream(t: DataFrame, name: str) -> DataFrame:
    """The readings as messages, three in ten of them broken in different ways."""
    path, kind = scratch_path(t.sparkSession, name), F.col("event_id") % 10
    text = F.to_json(F.struct("reading_id", "machine_id", "cycle_temperature", F.when(
        kind == 3, "yesterday").otherwise(F.date_format(
            "txn_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("timestamp")))
    value = F.when(kind == 1, '{"machine_id":').when(kind == 2, "[1,2]").otherwise(text)
    t.select(F.col("machine_id").cast("binary").alias("key"), value.cast("binary").alias("value"),
             F.col("event_id").alias("offset")).write.parquet(path)
    return t.sparkSession.readStream.schema("key binary, value binary, offset bigint").parquet(path)


@query("t1_reject_side", sql("""
SELECT coalesce(reason, 'good') AS side, count(*) AS messages FROM dirty GROUP BY 1""", DIRTY))
def _(t):
    targets = ingest.Targets(t.sparkSession, scratch_path(t.sparkSession, "t1r"))
    stream = ingest.decoded_stream(dirty_stream(t, "t1r-in"))
    ingest.run_pipeline(stream, targets, targets.root + "/checkpoint",
                        {"availableNow": True}).awaitTermination()
    bad = t.sparkSession.read.parquet(targets.rejects).select(F.col("reject_reason").alias("side"))
    good = ingest.read_raw(t.sparkSession, targets.raw).select(F.lit("good").alias("side"))
    return bad.unionAll(good).groupBy("side").agg(F.count("*").alias("messages"))


@query("t2_fan_out_raw", sql(f"{NORMALIZED} FROM deliveries", DELIVERIES))
def _(t):
    return ingest.read_raw(t.sparkSession, _run(t, "t2r").raw).select(*READING_COLUMNS)


LAST_DELIVERY = """
last_delivery AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY arrival DESC) AS rn
    FROM deliveries) WHERE rn = 1)"""


STATES = sql("""
SELECT machine_id, reading_id, branch, cast(cycle_temperature AS double) AS cycle_temperature,
       CASE WHEN cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status,
       cast(cycle_temperature > 68 AS int) AS breakdown_soon,
       strftime(txn_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS last_updated
FROM (SELECT *, row_number() OVER (PARTITION BY machine_id
                                   ORDER BY txn_timestamp DESC, reading_id DESC) AS rn
      FROM last_delivery) WHERE rn = 1""", DELIVERIES, LAST_DELIVERY)
LOGGED = sql(f"""
SELECT {READING}, {shown('txn_timestamp')},
       CASE WHEN cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status,
       cast(first_temperature > 68 AS int) AS breakdown_soon
FROM last_delivery JOIN (SELECT reading_id, cycle_temperature AS first_temperature FROM telemetry)
     USING (reading_id)""", DELIVERIES, LAST_DELIVERY)


@query("t2_fan_out_status", STATES)
def _(t):
    return _run(t, "t2s").status.read().select(*schemas.STATUS.names)


@query("t2_fan_out_log", LOGGED)
def _(t):
    log = ingest.read_log(t.sparkSession, _run(t, "t2l").log)
    return log.select(*LOG_COLUMNS)


@query("k5_states_in_levels", STATES)
def _(t):
    # Four batches, folded two by two into runs of levels 1 and 2, then a run of level 3.
    return _run(t, "k5l", files=2, fanout=2).status.read().select(*schemas.STATUS.names)


@query("k6_log_in_levels", LOGGED)
def _(t):
    log = _run(t, "k6l", files=3, fanout=2).log
    return ingest.read_log(t.sparkSession, log).select(*LOG_COLUMNS)


@query("t4_dedupe_stream", sql("SELECT reading_id, machine_id FROM telemetry"))
def _(t):
    stream = ingest.telemetry_stream(message_stream(t, "t4-in"))
    single = ingest.dedupe_stream(stream, "60 days")
    return _written(single, "t4").select("reading_id", "machine_id")


@query("t4_late_first_delivery", sql("SELECT reading_id, machine_id FROM telemetry"))
def _(t):
    # The newest days come first, so that all others are late by more than the delay. Each part
    # is delivered before a run of its own; the runs share a checkpoint.
    spark, root = t.sparkSession, scratch_path(t.sparkSession, "t4l")
    newest = F.col("txn_timestamp") >= F.lit("2024-01-25").cast("timestamp")
    for part in (newest, ~newest, newest):
        pairs = topic.encode_records(t.filter(part).select(*READING_COLUMNS))
        pairs.withColumn("offset", F.lit(0).cast("bigint")).write.mode("append").parquet(
            f"{root}/in")
        stream = spark.readStream.schema("key binary, value binary, offset bigint").parquet(
            f"{root}/in")
        single = ingest.dedupe_stream(ingest.telemetry_stream(stream), "1 hour")
        ingest.land_raw(single, f"{root}/out", f"{root}/checkpoint",
                        {"availableNow": True}).awaitTermination()
    return history.read_history(spark, f"{root}/out").select("reading_id", "machine_id")


@query("t3_failed_batch_is_repeated", sql(
    f"{NORMALIZED}, cast(1 AS bigint) AS times FROM deliveries", DELIVERIES))
def _(t):
    # The first try of the batch fails after the raw history is written; a second run repeats it.
    spark, root = t.sparkSession, scratch_path(t.sparkSession, "t3")
    targets = ingest.Targets(spark, root)
    stream = ingest.decoded_stream(message_stream(t, "t3-in"))
    tries = []

    def sink(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        name = f"{run}-{number:012d}"
        tries.append(name)
        if len(tries) == 1:
            ingest.append_batch(batch.filter("reject_reason IS NULL").drop(
                "reject_reason", "raw_value"), targets.raw, name)
            raise RuntimeError("the store is away")
        ingest.write_batch(batch, targets, name)

    for _ in range(2):
        run = stream.writeStream.foreachBatch(sink).option(
            "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except StreamingQueryException as error:
            if "the store is away" not in str(error):
                raise
    return ingest.read_raw(spark, targets.raw).groupBy(*READING_COLUMNS, "offset").agg(
        F.count("*").alias("times")).drop("offset")


@query("t5_live_buffer", sql(f"""
{NORMALIZED} FROM last_delivery
ORDER BY last_delivery.txn_timestamp DESC, reading_id DESC LIMIT 50""", DELIVERIES, LAST_DELIVERY))
def _(t):
    return _run(t, "t5").live.read()


@query("t6_live_counts", sql("SELECT " + COUNTS.format(
    total="buffer_size", alert="live_alert_count", normal="live_normal_count") + """
FROM (SELECT cycle_temperature,
             CASE WHEN cycle_temperature > 70 THEN 'ALERT' ELSE 'NORMAL' END AS status
      FROM last_delivery ORDER BY txn_timestamp DESC, reading_id DESC LIMIT 50)""",
    DELIVERIES, LAST_DELIVERY))
def _(t):
    return ingest.live_counts(_run(t, "t6").live.read())


@query("t7_next_from_shuffled_arrival", sql(f"""
SELECT reading_id, cast(next_temp AS double) AS next_temp FROM ({NEXT})"""))
def _(t):
    stream = ingest.telemetry_stream(message_stream(t, "t7-in", again=False))
    return sequence.with_next(_written(stream, "t7")).select("reading_id", "next_temp")


# -- the same operators on other keyed tables ----------------------------------------------------

@table_query("a1_avg_price_by_flag", "lineitem", """
SELECT l_returnflag, cast(round(avg(cast(l_extendedprice AS decimal(9,2))), 2) AS double)
                       AS avg_price
FROM lineitem GROUP BY l_returnflag""")
def _(lines):
    price = lines.select("l_returnflag",
                         F.col("l_extendedprice").cast("decimal(9,2)").alias("price"))
    return aggregates.avg_by_group(price, "l_returnflag", "price", 2, "avg_price", ordered=True)


@table_query("w1_next_order_of_customer", "orders", """
SELECT o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey
                                            ORDER BY o_orderdate, o_orderkey) AS next_price
FROM orders""")
def _(orders):
    return sequence.with_next(orders, "o_totalprice", "o_custkey", "o_orderdate", "o_orderkey",
                              "next_price").select("o_orderkey", "next_price")


@table_query("w2_latest_order_of_customer", "orders", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey
                               ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def _(orders):
    return sequence.latest_per_key(orders, "o_custkey", ("o_orderdate", "o_orderkey")).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@table_query("u2_first_line_of_order", "lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
                               ORDER BY l_linenumber, l_partkey, l_quantity) AS rn
  FROM lineitem) WHERE rn = 1""")
def _(lines):
    return sequence.dedupe(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@table_query("o1_newest_orders", "orders", """
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate
FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def _(orders):
    return sequence.newest(orders, 50, "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderdate")
