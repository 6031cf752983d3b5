from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline import schemas
from thermoline.functions import rules, values as parse
from thermoline.operators import cleaning


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def results(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize("temperature, status, flag68, flag70", [
    ("70.00", "NORMAL", 1, 0), ("70.01", "ALERT", 1, 1), ("68.00", "NORMAL", 0, 0),
    ("68.01", "NORMAL", 1, 0), (None, "NORMAL", 0, 0)])
def test_thresholds_are_strict(readings, temperature, status, flag68, flag70):
    df = readings([("a", "WM_0001", temperature, "2024-01-01")], vibration_hz=90.0)
    row = cleaning.flag_breakdown(cleaning.classify_status(df, "temp_or_vibration"),
                                  C.BREAKDOWN_TEMPERATURE, 90.0).first()
    assert (row["status"], row["breakdown_soon"]) == (status, flag68)
    assert cleaning.flag_breakdown(df, C.ALERT_TEMPERATURE).first()["breakdown_soon"] == flag70


def test_vibration_alone_alerts(readings):
    df = readings([("a", "WM_0001", 20, "2024-01-01")], vibration_hz=90.1)
    assert cleaning.classify_status(df).first()["status"] == "NORMAL"
    assert cleaning.classify_status(df, "temp_or_vibration").first()["status"] == "ALERT"
    with pytest.raises(ValueError):
        cleaning.classify_status(df, "other")


def test_parse_timestamp(spark):
    df = column(spark, ["2026-09-19T18:30:00Z", "2026-09-19T18:30:00.123456+00:00",
                        "2026-09-19 18:30:00+02:00", "2026-09-19", " 2026-09-19 18:30:00 ",
                        "junk", "", None, "18:30:00", "2026", "2026-13-40"])
    shown = F.date_format(parse.parse_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    assert results(df, shown) == [
        "2026-09-19 18:30:00.000000", "2026-09-19 18:30:00.123456",
        "2026-09-19 16:30:00.000000", "2026-09-19 00:00:00.000000",
        "2026-09-19 18:30:00.000000", None, None, None, None, None, None]


def test_to_number(spark):
    df = column(spark, ["74.5", " 7 ", "1e2", "n/a", "", None, "NaN", "1d", "2f", "-3", "inf",
                        "-Infinity", "1e999"])
    assert results(df, parse.to_number(F.col("v"), 45.0)) == [
        74.5, 7.0, 100.0, 45.0, 45.0, 45.0, 45.0, 45.0, 45.0, -3.0, 45.0, 45.0, 45.0]


def test_wild_numbers_do_not_fail_the_job(spark):
    df = spark.createDataFrame([("1500", "1e12"), ("-1e9", "x"), ("999.994", "1.0")],
                               "cycle_temperature string, breakdown_soon string")
    rows = cleaning.classify_status(cleaning.canonicalize(df)).collect()
    assert [(str(r["cycle_temperature"]), r["status"], r["breakdown_soon"]) for r in rows] == [
        ("1500.00", "ALERT", None), ("None", "NORMAL", None), ("999.99", "ALERT", 1)]
    doubles = spark.createDataFrame([(1e6,), (1e9,), (float("nan"),)],
                                    "cycle_temperature double")
    assert [r[0] for r in cleaning.canonicalize(doubles).select("cycle_temperature").collect()] \
        == [Decimal("1000000.00"), None, None]


def test_machine_number(spark):
    df = column(spark, ["WM_0007", "WM_12AB", "WM_ABCD", "WM_", "", None, "XX_1000",
                        "WM_99999999999999999999"])
    assert results(df, parse.machine_number(F.col("v"))) == [
        7, 12, 0, 0, 0, None, 1000, 2 ** 63 - 1]


def test_sensor_estimates(spark):
    df = column(spark, [Decimal("74.50"), Decimal("45.00"), Decimal("110.00")], "decimal(5,2)")
    estimate = {s: results(df, rules.sensor_estimate(F.col("v"), s)) for s in C.SENSOR_ESTIMATES}
    assert estimate["vibration_hz"] == [77.2, 56.5, 37.0]
    assert estimate["power_kw"] == [5.73, 4.25, 3.0]
    assert estimate["water_pressure_bar"] == [3.74, 2.85, 2.3]


def test_validate_names_first_missing_field(spark):
    df = spark.createDataFrame(
        [("WM_1", "Huye", "70", "2024", "NORMAL"), (None, None, "70", "2024", "NORMAL"),
         ("WM_1", "Huye", None, None, "NORMAL"), ("WM_1", "Huye", "1", "2024", None)],
        "machine_id string, branch string, cycle_temperature string, timestamp string, "
        "status string")
    checked = cleaning.validate(df)
    assert [r["reject_reason"] for r in checked.collect()] == [
        None, "Missing required field: machine_id", "Missing required field: cycle_temperature",
        "Missing required field: status"]
    assert cleaning.accepted(checked).count() == 1
    assert cleaning.rejected(checked).count() == 3


def test_parse_payload_messages(spark):
    bodies = ['{"machine_id":', "[1,2]", '"x"', "{}", "null", "17", None, "",
              '[{"machine_id":"WM_1"}]', ' {"machine_id": "WM_1", "cycle_temperature": 71.5} ',
              '{"machine_id": "WM_1", "cycle_temperature": "n/a", "extra": [1]}']
    df = cleaning.parse_payload(column(spark, bodies), "v").orderBy("i")
    rows = df.collect()
    invalid, not_object = "Invalid JSON body", "Payload must be a JSON object"
    assert [r["payload_error"] for r in rows] == [
        invalid, not_object, not_object, "Missing required field: machine_id", not_object,
        not_object, invalid, invalid, not_object, None, None]
    assert [r["cycle_temperature"] for r in rows[-2:]] == ["71.5", "n/a"]
    assert rows[8]["machine_id"] is None


def test_impute_is_repeatable_and_fills_everything(spark):
    df = spark.createDataFrame([("WM_0001", "80"), ("WM_0002", "n/a"), ("WM_0002", None)],
                               "machine_id string, cycle_temperature string")
    now = F.lit("2024-05-01").cast("timestamp")
    rows = cleaning.impute_reading(df, now).collect()
    assert rows == cleaning.impute_reading(df, now).collect()
    assert all(v is not None for r in rows for v in r)
    assert [(r["status"], r["breakdown_soon"], r["error_code"]) for r in rows] == [
        ("ALERT", 1, "E01_OVERHEAT"), ("NORMAL", 0, "NORMAL"), ("NORMAL", 0, "NORMAL")]
    assert rows[1]["cycle_temperature"] == Decimal("45.00")
    assert rows[0]["branch"] == "Kigali"


def test_impute_keeps_what_is_there(spark):
    df = spark.createDataFrame(
        [("r", "WM_1", "Huye", "20", "95", "3", "4", "X", "2024-01-01", "ODD", "0")],
        "reading_id string, machine_id string, branch string, cycle_temperature string, "
        "vibration_hz string, power_kw string, water_pressure_bar string, error_code string, "
        "timestamp string, status string, breakdown_soon string")
    row = cleaning.impute_reading(df).first()
    assert (row["reading_id"], row["branch"], row["vibration_hz"], row["error_code"],
            row["status"], row["breakdown_soon"]) == ("r", "Huye", 95.0, "X", "ODD", 0)


def test_canonicalize_adds_missing_and_keeps_others(spark):
    df = spark.createDataFrame([("a", 70.005, "2024-01-01T10:00:00Z", "x")],
                               "reading_id string, cycle_temperature double, timestamp string, "
                               "note string")
    out = cleaning.canonicalize(df)
    assert out.columns == [*schemas.READING.names, "note"]
    row = out.first()
    assert str(row["txn_timestamp"]) == "2024-01-01 10:00:00"
    assert row["vibration_hz"] is None and row["note"] == "x"


def test_repair_log_follows_three_valued_logic(spark):
    df = spark.createDataFrame(
        [("ALERT", None, 0), (None, Decimal("70.01"), 0), (None, Decimal("70.00"), 1),
         ("NORMAL", Decimal("70.00"), 1), ("NORMAL", Decimal("71"), 0), ("NORMAL", None, 1),
         ("ODD", Decimal("1"), None)],
        "status string, cycle_temperature decimal(5,2), breakdown_soon int")
    assert [r["breakdown_soon"] for r in cleaning.repair_log(df).collect()] == [
        1, 1, 1, 0, 1, 1, None]


def test_repair_status_fills_blank_text(spark):
    df = spark.createDataFrame([("WM_1", "", "", None, "ALERT", 1)],
                               "machine_id string, reading_id string, branch string, "
                               "cycle_temperature decimal(5,2), status string, breakdown_soon int")
    row = cleaning.repair_status(df).first()
    assert (row["branch"], row["status"], row["breakdown_soon"]) == ("Kigali", "NORMAL", 0)
    assert row["reading_id"]


def test_ensure_columns_is_idempotent(spark):
    df = spark.createDataFrame([("a",)], "reading_id string")
    once = cleaning.ensure_columns(df, schemas.LOG, {"breakdown_soon": 0})
    assert once.schema["cycle_temperature"].dataType == schemas.TEMPERATURE
    assert once.first()["breakdown_soon"] == 0
    assert cleaning.ensure_columns(once, schemas.LOG).columns == once.columns


def test_normalize_predictions_without_prediction(spark):
    df = spark.createDataFrame([("WM_1", "Huye", 1, None)],
                               "machine_id string, branch string, breakdown_soon int, "
                               "scored_at string")
    row = cleaning.normalize_predictions(df).first()
    assert (row["prediction"], row["risk_status"], row["scored_at"]) == (
        1, "HIGH BREAKDOWN RISK (>70°C)", "")


def test_present_renders_every_kind(spark):
    df = spark.sql("SELECT cast(1.239 as decimal(5,3)) d, timestamp '2024-01-01 00:00:01' t, "
                   "date '2024-01-02' y, cast(1 as tinyint) i, 1.239D x")
    row = cleaning.present(df, 2, "yyyy-MM-dd HH:mm:ss").first()
    assert tuple(row) == (1.24, "2024-01-01 00:00:01", "2024-01-02", 1, 1.24)


def test_arrival_date(readings):
    df = readings([("a", "WM_1", 20, "2024-01-01 23:59:59")])
    assert str(cleaning.with_partition_date(df).first()["dt"]) == "2024-01-01"
    arrival = cleaning.with_partition_date(df, "arrival", F.lit("2024-03-01").cast("timestamp"))
    assert str(arrival.first()["dt"]) == "2024-03-01"
    with pytest.raises(ValueError):
        cleaning.with_partition_date(df, "other")
