import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from thermoline import schemas, session
from thermoline.operators import aggregates, cleaning, combine
from thermoline.plans import insights, reports
from thermoline.sources import history, jdbc, topic
from thermoline.sources.versions import VersionedTable


def dated(df):
    return cleaning.with_partition_date(df)


def test_mixed_tree_with_both_time_names(spark, readings, tmp_path):
    path = str(tmp_path / "raw")
    history.write_history(dated(readings([("a", "WM_0001", 71, "2024-01-01 10:00:00")])), path)
    folder = tmp_path / "raw" / "dt=2024-01-01"
    (folder / "stream_history.json").write_text(
        json.dumps({"reading_id": "b", "machine_id": "WM_0002", "cycle_temperature": 60.5,
                    "timestamp": "2024-01-01T11:00:00.5+00:00", "breakdown_soon": 1}) + "\n"
        + '{"reading_id": broken\n')
    (folder / "notes.txt").write_text("not data")
    rows = {r["reading_id"]: r for r in history.load_history(spark, path).collect()}
    assert set(rows) == {"a", "b"}
    refused = history.rejected_lines(spark, path).collect()
    assert [(str(r["dt"]), r["line"], r["reject_reason"]) for r in refused] == [
        ("2024-01-01", '{"reading_id": broken', "Invalid JSON body")]
    assert str(rows["b"]["txn_timestamp"]) == "2024-01-01 11:00:00.500000"
    assert str(rows["b"]["dt"]) == "2024-01-01" and rows["b"]["breakdown_soon"] == 1
    assert history.load_history(spark, path, dedupe=True).count() == 2


def test_json_only_tree(spark, tmp_path):
    folder = tmp_path / "dt=2024-01-01"
    folder.mkdir()
    (folder / "part.json").write_text('{"reading_id": "a", "txn_timestamp": "2024-01-01 01:00:00"}')
    rows = history.load_history(spark, str(tmp_path)).collect()
    assert [r["reading_id"] for r in rows] == ["a"]


def test_load_first_only_skips_missing_paths(spark, readings, tmp_path):
    good = str(tmp_path / "good")
    readings([("a", "M", 1, "2024-01-01")]).write.parquet(good)
    gone = lambda s: s.read.parquet(str(tmp_path / "gone"))
    there = lambda s: s.read.parquet(good)
    wrong = lambda s: s.read.parquet(good).select("no_such_column")
    assert history.load_first(spark, [gone, there]).count() == 1
    with pytest.raises(AnalysisException):
        history.load_first(spark, [wrong, there])
    with pytest.raises(AnalysisException):
        history.load_first(spark, [gone, gone])


def test_write_history_replaces_only_its_dates(spark, readings, tmp_path):
    path = str(tmp_path / "raw")
    history.write_history(dated(readings([("a", "M", 1, "2024-01-01"),
                                          ("b", "M", 1, "2024-01-02")])), path)
    history.write_history(dated(readings([("c", "M", 1, "2024-01-02")])), path)
    assert sorted(r[0] for r in history.read_history(spark, path).select("reading_id")
                  .collect()) == ["a", "c"]


def test_sync_compacts_and_repeats(spark, telemetry, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    rows = dated(telemetry).select(*schemas.READING.names, "dt")
    rows.repartition(16).write.partitionBy("dt").parquet(source)
    history.sync_partitions(spark, source, target)
    history.sync_partitions(spark, source, target)
    copied = history.read_history(spark, target)
    assert copied.exceptAll(rows).isEmpty() and copied.count() == rows.count()
    files = [f for _, _, fs in os.walk(target) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 2 * 30
    report = history.sync_report(copied).collect()
    assert [r["dt"] for r in report] == sorted((r["dt"] for r in report), reverse=True)
    assert sum(r["row_count"] for r in report) == rows.count()


def test_records_survive_encoding(spark, telemetry):
    rows = telemetry.select(*schemas.READING.names)
    sent = topic.encode_records(rows)
    assert sent.first()["key"].decode() == rows.first()["machine_id"]
    back = cleaning.canonicalize(topic.decode_records(sent))
    assert back.exceptAll(rows).isEmpty()


def test_bad_messages_are_set_aside(spark):
    df = spark.createDataFrame([(b"M", b'{"cycle_temperature": "hot"}'), (b"M", b"junk"), (b"M", b"[1,2]")],
                               "key binary, value binary")
    now = F.lit("2024-01-01").cast("timestamp")
    checked = topic.check_records(df)
    assert [r["reject_reason"] for r in checked.collect()] == [
        None, "Invalid JSON body", "Payload must be a JSON object"]
    good = topic.decode_records(checked.filter("reject_reason is null"))
    rows = topic.normalize_records(good, now=now).collect()
    assert [(float(r["cycle_temperature"]), r["status"], str(r["txn_timestamp"]))
            for r in rows] == [(0.0, "NORMAL", "2024-01-01 00:00:00")]


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), schemas.PREDICTION)
    assert table.read().count() == 0 and table.versions() == []
    for i in range(5):
        row = spark.createDataFrame([(f"M{i}", "Huye", 1, None)], schemas.PREDICTION)
        table.replace(table.read().unionByName(row))
    assert table.read().count() == 5
    table.prune(2)
    assert table.versions() == [3, 4] and table.read().count() == 5
    # A version without its success mark is not read.
    os.makedirs(tmp_path / "t" / "version=000000000009")
    assert table.read().count() == 5


def test_failed_replace_keeps_current_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), schemas.PREDICTION)
    table.replace(spark.createDataFrame([("M", "Huye", 1, None)], schemas.PREDICTION))
    broken = table.read().withColumn("branch", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        table.replace(broken)
    assert table.read().count() == 1


def test_jdbc_options():
    slices = jdbc.Slices("txn_timestamp", "2024-01-01", "2024-02-01", 64)
    options = jdbc.read_options("jdbc:x", "readings_log", {"user": "u"}, slices)
    assert options["partitionColumn"] == "txn_timestamp" and options["numPartitions"] == "64"
    assert options["dbtable"] == "readings_log" and options["user"] == "u"
    assert "partitionColumn" not in jdbc.read_options("jdbc:x", "t")
    assert jdbc.write_options("jdbc:x", "t", connections=4)["numPartitions"] == "4"


def test_scratch_lies_in_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    own = f"{folder}/{spark.sparkContext.applicationId}/x-"
    assert session.scratch_path(spark, "x").startswith(own)


def test_materialize(spark, telemetry):
    small = telemetry.groupBy("branch").count()
    kept = session.materialize(small, "kept")
    assert kept.schema == small.schema or kept.columns == small.columns
    assert kept.exceptAll(small).isEmpty() and len(kept.inputFiles()) > 0


def test_insights_job(spark, telemetry, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    history.write_history(dated(telemetry).select(*schemas.READING.names, "dt"), raw)
    insights.run_insights(spark, raw, out, top_n=5)
    shown = json.loads(insights.snapshot(insights.insights(insights.profile(telemetry)),
                                         5).first()[0])
    assert list(shown) == ["avg_by_branch", "time_in_alert", "busiest_hour",
                           "good_condition_count", "normal_temp_count", "total_machines"]
    assert len(shown["time_in_alert"]) == 5 and len(shown["avg_by_branch"]) == 13
    means = {r[0]: r[1] for r in aggregates.avg_by_group(telemetry).collect()}
    assert {r["branch"]: r["avg_temperature"] for r in shown["avg_by_branch"]} == means
    whole = spark.read.parquet(f"{out}/time_in_alert")
    assert whole.exceptAll(aggregates.alert_counts(telemetry)).isEmpty()
    again = insights.run_insights(spark, raw, out)        # replaces its results
    files = sorted(p for p in os.listdir(f"{out}/latest_insights") if p.startswith("part-"))
    text = "".join(open(f"{out}/latest_insights/{p}").read() for p in files)
    machines = json.loads(text)["time_in_alert"]
    assert len(machines) == aggregates.alert_counts(telemetry).count() < again.count()
    assert machines == sorted(machines, key=lambda m: (-m["alert_count"], m["machine_id"]))
    report = reports.insights_report(spark, out)
    assert report["top_overheating_machines"].collect() == aggregates.top_overheating(
        telemetry).collect()
    assert report["hourly_alert_distribution"].collect() == aggregates.alert_hours(
        telemetry).collect()
    assert report["fleet_health_summary"].first()["total_machines"] == telemetry.count()


def test_reports(spark, telemetry):
    from thermoline.operators import sequence
    raw = dated(telemetry)
    log = combine.log_rows(telemetry)
    status = combine.status_rows(sequence.latest_per_key(telemetry))
    recent = reports.readings_report(sequence.recent_buffer(telemetry), log, raw, 20,
                                     status="alert")
    assert recent["readings"].count() == 20
    assert tuple(recent["counts"].first()) == (20, 20, 0)
    stored = reports.storage_report(raw)
    assert stored["total"].first()[0] == 30 and stored["sample"].count() == 5
    day = reports.history_report(raw, limit=3)
    assert day["records"].count() == 3 <= day["total"].first()[0]
    operations = reports.operations_report(status, log, "x")
    assert operations["readings"].count() == 50 and operations["machines"].count() == 15
    scored = status.select("machine_id", "branch", F.col("breakdown_soon").alias("prediction"),
                           F.col("last_updated").alias("scored_at"))
    predicted = reports.predictions_report(scored, risk="0")
    assert predicted["predictions"].count() == predicted["summary"].first()["normal_machines"]
    fleet = reports.fleet_report(status, scored)
    assert fleet["machines"].count() == fleet["kpis"].first()["total_machines"] == 15
    nothing = spark.createDataFrame([], schemas.READING)
    live = reports.live_report(nothing, sequence.recent_buffer(telemetry, 50))
    assert live["readings"].count() == 25 and live["counts"].first()["buffer_size"] == 50


def test_ingress(spark):
    from thermoline.plans import ingress
    bodies = spark.createDataFrame([
        ('{"machine_id": "WM_0001", "cycle_temperature": 80}',),
        ('{"machine_id": "WM_0002", "branch": "Huye", "cycle_temperature": "50", '
         '"timestamp": "2024-01-01T00:00:00Z", "status": "NORMAL"}',),
        ('{"branch": "Huye"}',), ("[]",), ("{",)], "body string")
    now = F.lit("2024-05-01").cast("timestamp")
    readings, refused = ingress.receive(bodies, now=now)
    assert [(r["machine_id"], r["status"], str(r["txn_timestamp"])) for r in readings.collect()] \
        == [("WM_0001", "ALERT", "2024-05-01 00:00:00"), ("WM_0002", "NORMAL",
                                                         "2024-01-01 00:00:00")]
    assert [r["payload_error"] for r in refused.collect()] == [
        "Missing required field: machine_id", "Payload must be a JSON object",
        "Invalid JSON body"]
    strict, refused = ingress.receive_strict(bodies, now=now)
    assert [r["machine_id"] for r in strict.collect()] == ["WM_0002"]
    assert refused.first()["payload_error"] == "Missing required field: branch"
    sent = topic.normalize_records(topic.decode_records(ingress.messages(readings)), now=now)
    assert sent.select("reading_id", "txn_timestamp").exceptAll(
        readings.select("reading_id", "txn_timestamp")).isEmpty()


def test_publish(spark, telemetry, tmp_path):
    from thermoline.plans import publish
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    rows = dated(telemetry).select(*schemas.READING.names, "dt")
    history.write_history(rows, f"{source}/raw")
    insights.run_insights(spark, f"{source}/raw", f"{source}/insights")
    for _ in range(2):
        report = publish.publish(spark, source, target)
    assert sum(r["row_count"] for r in report.collect()) == rows.count()
    for name in publish.RESULTS[:4]:
        copied, given = (spark.read.parquet(f"{p}/{name}") for p in (target, source))
        assert copied.exceptAll(given).isEmpty() and copied.count() == given.count()
    assert not os.path.exists(f"{target}/predictions")
    assert os.path.exists(f"{target}/insights/latest_insights/_SUCCESS")
    held = {r["folder"] for r in publish.store_report(spark, target).collect()}
    assert "insights/fleet_health" in held and "raw/dt=2024-01-01" in held


def test_parquet_files_with_different_columns(spark, tmp_path):
    """Rows as a data-frame library writes them, beside rows as a topic sink writes them."""
    plain = spark.sql("SELECT 'a' reading_id, 'WM_0001' machine_id, 'Huye' branch, "
                      "71.25D cycle_temperature, '2024-01-01 10:00:00' txn_timestamp, "
                      "'ALERT' status, 1L breakdown_soon")
    sink = spark.sql("SELECT 'b' reading_id, 'WM_0002' machine_id, 60.5D cycle_temperature, "
                     "95.5D vibration_hz, '2024-01-01T11:00:00.5+00:00' timestamp, "
                     "0L breakdown_soon")
    folder = str(tmp_path / "dt=2024-01-01")
    plain.write.mode("append").parquet(folder)
    sink.write.mode("append").parquet(folder)
    rows = {r["reading_id"]: r for r in history.load_history(
        spark, str(tmp_path), merge_schema=True).collect()}
    assert str(rows["a"]["txn_timestamp"]) == "2024-01-01 10:00:00"
    assert str(rows["b"]["txn_timestamp"]) == "2024-01-01 11:00:00.500000"
    assert (rows["a"]["vibration_hz"], rows["b"]["vibration_hz"]) == (None, 95.5)
    assert str(rows["a"]["cycle_temperature"]) == "71.25"


def test_jdbc_merge_reads_all_before_it_writes(spark, readings, monkeypatch):
    target = combine.log_rows(readings([("a", "M", 10, "2024-01-01")]))
    batch = combine.log_rows(readings([("a", "M", 80, "2024-01-02"), ("b", "M", 5, "2024-01-02")]))
    written = []
    monkeypatch.setattr(jdbc, "read_table_jdbc", lambda *args: target)
    monkeypatch.setattr(jdbc, "write_table_jdbc", lambda df, *args: written.append(df))
    jdbc.merge_table_jdbc(batch, "jdbc:x", "readings_log")
    rows = {r["reading_id"]: float(r["cycle_temperature"]) for r in written[0].collect()}
    assert rows == {"a": 80.0, "b": 5.0}
    assert written[0].inputFiles()               # files of the shared folder, not the table


def test_heavy_date_is_written_by_several_tasks(spark, telemetry, tmp_path):
    rows = telemetry.select(*schemas.READING.names).repartition(8)
    rows = rows.withColumn("dt", F.lit("2024-01-01").cast("date"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        history.write_history(rows, str(tmp_path / "raw"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
    landed = history.read_history(spark, str(tmp_path / "raw"))
    assert len(landed.inputFiles()) > 2 and landed.count() == telemetry.count()
