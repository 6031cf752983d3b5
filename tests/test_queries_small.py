"""Filters, aggregates, sequences and merges on hand-made rows."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline import schemas
from thermoline.operators import aggregates, combine, filters, sequence


@pytest.mark.parametrize("value, expected", [
    (None, 50), ("x", 50), ("", 50), (0, 1), (-5, 1), ("7", 7), (9999, 500), (500, 500)])
def test_clamp_limit(value, expected):
    assert filters.clamp_limit(value, *C.READINGS_LIMIT) == expected


def test_filter_flag_rules(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "id string, breakdown_soon int")
    keep = lambda flag, rows=df: [r["id"] for r in
                                  filters.filter_readings(rows, breakdown_soon=flag).collect()]
    assert keep("1") == ["a", "c"]
    assert keep(0) == ["b", "c"]
    assert keep("many") == ["a", "b", "c"]
    assert keep(1, df.drop("breakdown_soon")) == []
    assert keep(0, df.drop("breakdown_soon")) == ["a", "b", "c"]


@pytest.mark.parametrize("mode, kept", [
    ("pattern", ["WM_0000", "WM_0001", "WM_1000", "wm_0005"]),
    ("range", ["WM_0001", "WM_1000", "XX_0007", "WM_12AB", "WM_00009", "wm_0005"]),
    ("prefix", ["WM_0001", "WM_1000", "WM_12AB", "WM_00009", "wm_0005"]),
    ("strict", ["WM_0001", "WM_1000", "WM_12AB", "wm_0005"])])
def test_valid_machines(spark, mode, kept):
    ids = ["WM_0000", "WM_0001", "WM_1000", "WM_1001", "XX_0007", "WM_12AB", "WM_00009",
           "wm_0005", "WM_ABCD", ""]
    df = spark.createDataFrame([(i,) for i in ids], "machine_id string")
    assert [r[0] for r in filters.keep_valid_machines(df, mode=mode).collect()] == kept
    report = aggregates.trim_report(df, filters.valid_machine(F.col("machine_id"),
                                                              mode=mode)).first()
    assert report["rows_before"] == len(ids)
    assert report["rows_in_range"] == report["rows_after"] == len(kept)


def test_newest_partition_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.READING).withColumn("dt", F.to_date("txn_timestamp"))
    assert filters.history(empty).count() == 0
    assert filters.history_total(empty).first()[0] == 0


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.READING)
    none = spark.createDataFrame([], schemas.PREDICTION)
    assert tuple(aggregates.prediction_summary(none).first()) == (0, 0, 0, 0.0)
    assert tuple(aggregates.reading_counts(empty).first()) == (0, 0, 0)
    assert tuple(aggregates.health_summary(empty).first()) == (0, 0, 0)
    assert tuple(aggregates.fleet_kpis(combine.status_rows(empty), none).first()) == (
        0, 0, None, 0)
    assert aggregates.avg_by_group(empty).count() == 0


def test_exact_mean_is_exact(spark):
    df = spark.createDataFrame([("a", Decimal("0.01")), ("a", Decimal("0.02")), ("a", None),
                                ("b", None)], "branch string, cycle_temperature decimal(5,2)")
    means = {r[0]: r[1] for r in aggregates.avg_by_group(df).collect()}
    assert means == {"a": 0.02, "b": None}      # 0.015 rounds up; a float mean may not
    doubles = df.withColumn("cycle_temperature", F.col("cycle_temperature").cast("double"))
    assert aggregates.avg_by_group(doubles, digits=3).filter("branch = 'a'").first()[1] == 0.015


def test_totals_add_up(telemetry):
    status = combine.status_rows(sequence.latest_per_key(telemetry))
    fleet = aggregates.fleet_summary(status).first()
    assert fleet["in_alert"] + fleet["normal"] == fleet["total_machines_tracked"] == 15
    counts = aggregates.reading_counts(telemetry).first()
    assert counts[1] + counts[2] == counts[0] == telemetry.count()


def test_next_of_equal_times_and_last(readings):
    df = readings([("b", "M", 2, "2024-01-01 10:00:00"), ("a", "M", 1, "2024-01-01 10:00:00"),
                   ("c", "M", 3, "2024-01-02 00:00:00"), ("x", "N", 9, "2024-01-01"),
                   ("n", None, 5, "2024-01-01"), ("m", None, 6, "2024-01-02")])
    for grain in sequence.GRAINS:
        found = {r["reading_id"]: r["next_temp"]
                 for r in sequence.with_next(df, grain=grain).collect()}
        assert found == {"a": 2, "b": 3, "c": None, "x": None, "n": None, "m": None}, grain


def test_null_value_is_a_next_value(readings):
    df = readings([("a", "M", 1, "2024-01-01"), ("b", "M", None, "2024-01-02"),
                   ("c", "M", 3, "2024-01-03")])
    for grain in ("year", "day"):
        found = {r[0]: r[1] for r in sequence.with_next(df, grain=grain)
                 .select("reading_id", "next_temp").collect()}
        assert found == {"a": None, "b": 3, "c": None}


def test_next_of_many_rows_of_one_instant(readings):
    same = readings([(f"same-{i:04d}", "M", i % 90, "2024-01-01") for i in range(40)])
    found = {r["reading_id"]: r["next_temp"] for r in sequence.with_next(same).collect()}
    assert found == {f"same-{i:04d}": (i + 1) % 90 if i < 39 else None for i in range(40)}
    with pytest.raises(ValueError):
        sequence.with_next(same, grain="hour")


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from("AB"), st.integers(1, 4), st.integers(0, 50)),
                     min_size=1, max_size=25))
def test_next_in_slices_equals_plain(spark, readings, rows):
    df = readings([(f"{i:03d}", machine, temp, f"2024-01-0{day} 00:00:00")
                   for i, (machine, day, temp) in enumerate(rows)])
    window = Window.partitionBy("machine_id").orderBy("txn_timestamp", "reading_id")
    plain = df.select("reading_id", F.lead("cycle_temperature").over(window).alias("next_temp"))
    sliced = sequence.with_next(df).select("reading_id", "next_temp")
    assert str(sorted(plain.collect())) == str(sorted(sliced.collect()))


def test_latest_breaks_ties_by_id(readings):
    df = readings([("a", "M", 1, "2024-01-01"), ("b", "M", 2, "2024-01-01"),
                   ("z", "M", 3, "2023-01-01"), ("n", None, 3, "2025-01-01")])
    rows = sequence.latest_per_key(df).collect()
    assert [r["reading_id"] for r in rows] == ["b"]


def test_dedupe_and_rows_without_id(readings):
    df = readings([("a", "M", 1, "2024-01-01"), ("a", "M", 2, "2024-01-02"),
                   (None, "M", 3, "2024-01-01"), (None, "M", 3, "2024-01-01")])
    rows = [(r["reading_id"], r["cycle_temperature"]) for r in sequence.dedupe(df).collect()]
    assert sorted(rows, key=str) == [("a", 1), (None, 3), (None, 3)]
    assert sequence.dedupe(df, keep_keyless=False).count() == 1


def log(readings, rows, **constants):
    return combine.log_rows(readings(rows, **constants))


def by_id(df):
    return {r["reading_id"]: r for r in df.collect()}


def test_merge_updates_only_listed_columns(readings):
    target = log(readings, [("a", "M", 10, "2024-01-01"), ("k", "M", 11, "2024-01-01")])
    batch = log(readings, [("a", "X", 80, "2024-02-01"), ("b", "X", 50, "2024-02-01"),
                           ("b", "Y", 60, "2024-02-02"), (None, "X", 1, "2024-01-01")],
                status="ALERT", breakdown_soon=1)
    rows = by_id(combine.merge_by_key(target, batch))
    assert set(rows) == {"a", "k", "b"}
    a, b = rows["a"], rows["b"]
    assert (a["machine_id"], a["cycle_temperature"], a["status"], a["breakdown_soon"]) == (
        "M", 80, "ALERT", 0)
    assert (b["machine_id"], b["cycle_temperature"]) == ("X", 60)
    whole = by_id(combine.merge_by_key(target, batch, update_cols="all"))
    assert whole["a"]["machine_id"] == "X" and whole["b"]["machine_id"] == "Y"
    ignore = by_id(combine.merge_by_key(target, batch, update_cols="none"))
    assert ignore["a"]["cycle_temperature"] == 10 and ignore["b"]["cycle_temperature"] == 50


def test_merge_writes_nulls_and_is_idempotent(readings):
    target = log(readings, [("a", "M", 10, "2024-01-01")])
    batch = log(readings, [("a", "M", None, "2024-01-01"), ("b", "M", 5, "2024-01-01")])
    once = combine.merge_by_key(target, batch)
    assert by_id(once)["a"]["cycle_temperature"] is None
    twice = combine.merge_by_key(once, batch)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_status_upsert(readings):
    state = combine.status_rows
    known = state(readings([("a", "M", 10, "2024-01-05"), ("x", "N", 1, "2024-01-01")]))
    late = state(readings([("b", "M", 90, "2024-01-04"), ("y", "N", 2, "2024-01-02"),
                           ("n", None, 2, "2024-01-02")]))
    merged = combine.upsert_status(known, late)
    assert sorted(r["reading_id"] for r in merged.collect()) == ["a", "y"]
    again = state(readings([("a", "M", 44, "2024-01-05")]))
    row = combine.upsert_status(known, again).filter("machine_id = 'M'").first()
    assert row["cycle_temperature"] == 44


def test_recent_prefers_earlier_source(readings):
    buffer = readings([("a", "M", 99, "2024-01-03")], status="ALERT")
    lines = log(readings, [("a", "M", 10, "2024-01-03"), ("b", "M", 80, "2024-01-02")])
    raw = readings([("a", "M", 11, "2024-01-03"), ("b", "M", 12, "2024-01-02"),
                    ("c", "M", 13, "2024-01-01"), ("c", "M", 13, "2024-01-01"),
                    (None, "M", 13, "2024-01-01")])
    rows = combine.recent_telemetry(buffer, lines, raw).collect()
    assert [(r["reading_id"], r["source"]) for r in rows] == [
        ("a", "buffer"), ("b", "log"), ("c", "raw")]
    assert rows[1]["error_code"] == "E01_OVERHEAT"
    normal = combine.recent_telemetry(buffer, lines, raw, status="normal").collect()
    assert [r["reading_id"] for r in normal] == ["b", "c"]


def test_listing_looks_for_older_copies(readings):
    raw = readings([(f"r{i:02d}", "M", i, f"2024-01-{i:02d}") for i in range(1, 31)])
    raw = raw.withColumn("dt", F.to_date("txn_timestamp"))
    nothing = readings([])
    # The log holds r30 with a time far back and another status: it must not be listed.
    lines = log(readings, [("r30", "M", 90, "2024-01-02")], status="ALERT")
    listed = combine.recent_telemetry(nothing, lines, raw, 3, status="normal").collect()
    assert [r["reading_id"] for r in listed] == ["r29", "r28", "r27"]
    assert combine.recent_telemetry(nothing, lines, raw, 3, machine_id="m").count() == 3
    assert combine.recent_telemetry(nothing, lines, raw, 3, branch="none").count() == 0


def test_predictions_join_keeps_machines_without_one(spark, readings):
    states = combine.status_rows(readings([("a", "M", 1, "2024-01-01"),
                                           ("b", "N", 1, "2024-01-01")]))
    scored = spark.createDataFrame(
        [("M", "Huye", 0, "2024-01-01"), ("M", "Huye", 1, "2024-01-02")],
        "machine_id string, branch string, prediction int, scored_at string")
    rows = {r["machine_id"]: r["prediction"] for r in
            combine.status_with_predictions(states, scored).collect()}
    assert rows == {"M": 1, "N": None}


def test_status_by_arrival(spark, readings):
    rows = readings([("b", "M", 90, "2024-01-09"), ("a", "M", 10, "2024-01-01")])
    arrived = F.lit("2024-02-01").cast("timestamp")
    numbered = rows.withColumn("offset", F.when(F.col("reading_id") == "a", 2).otherwise(1)
                               .cast("bigint"))
    empty = spark.createDataFrame([], schemas.STATUS)
    by_event = combine.upsert_status(empty, combine.status_rows(numbered))
    assert by_event.first()["reading_id"] == "b"
    by_arrival = combine.upsert_status(empty, combine.status_rows(numbered, arrived), "arrival")
    assert by_arrival.first()["reading_id"] == "a"


def test_next_with_numeric_ties(spark):
    rows = [(1, i, 1.0 * i) for i in (9, 10, 100, 11)] + [(2, 5, 0.5)]
    df = spark.createDataFrame(rows, "k int, n long, v double").withColumn(
        "t", F.lit("2024-01-01").cast("timestamp"))
    for grain in ("year", "day"):
        found = {r["n"]: r["next"] for r in
                 sequence.with_next(df, "v", "k", "t", "n", "next", grain).collect()}
        assert found == {9: 10.0, 10: 11.0, 11: 100.0, 100: None, 5: None}
