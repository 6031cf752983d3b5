"""Inputs of the registered queries, derived from the given tables as DataFrames."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline.functions import rules
from thermoline.operators import combine, sequence
from thermoline.sources import events

SCORED_AT = "2024-02-01 18:00:00"
NOW = "2024-02-01 00:00:00"


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return events.load_telemetry(spark, folder)


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def machine_status(readings: DataFrame) -> DataFrame:
    return combine.status_rows(sequence.latest_per_key(readings))


def predictions(readings: DataFrame) -> DataFrame:
    return sequence.latest_per_key(readings).select(
        "machine_id", "branch", F.col("breakdown_soon").alias("prediction"),
        at(SCORED_AT).alias("scored_at"))


def raw(readings: DataFrame) -> DataFrame:
    return readings.withColumn("dt", F.to_date("txn_timestamp"))


def deliveries(readings: DataFrame) -> DataFrame:
    """Every reading, and every tenth again with another temperature. `arrival` orders them."""
    event, other = F.col("event_id"), F.lit(134) - F.col("cycle_temperature")
    again = (readings.filter(event % 10 == 0)
             .withColumn("cycle_temperature", other.cast("decimal(5,2)"))
             .withColumns({"status": rules.status_of(F.col("cycle_temperature")),
                           "breakdown_soon": 1 - F.col("breakdown_soon"),
                           "arrival": F.lit(1_000_000_000_000) + event}))
    return readings.withColumn("arrival", event * 2).unionByName(again)


def _unless(modulus: int, name: str) -> Column:
    return F.when(F.col("event_id") % modulus != 0, F.col(name).cast("string")).alias(name)


def messages(readings: DataFrame) -> DataFrame:
    """Readings as text with gaps, bad numbers and five time formats."""
    event, time = F.col("event_id"), F.col("txn_timestamp")
    kind = event % 5
    text = (F.when(kind == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(kind == 1, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
            .when(kind == 2, F.date_format(time, "yyyy-MM-dd HH:mm:ss'+02:00'"))
            .when(kind == 3, F.date_format(time, "yyyy-MM-dd"))
            .otherwise(F.lit("junk")))
    temperature = (F.when(event % 29 == 0, F.lit("n/a"))
                   .when(event % 19 != 0, F.col("cycle_temperature").cast("string")))
    return readings.select(
        "event_id", _unless(13, "reading_id"), _unless(23, "machine_id"), _unless(17, "branch"),
        temperature.alias("cycle_temperature"), _unless(11, "vibration_hz"),
        text.alias("timestamp"), _unless(7, "status"))


def payloads(readings: DataFrame) -> DataFrame:
    """Request bodies: broken JSON, arrays, texts, objects without and with a machine."""
    kind = F.col("event_id") % 6
    whole = F.to_json(F.struct("reading_id", "machine_id", "branch",
                               F.col("cycle_temperature").cast("double")
                               .alias("cycle_temperature")))
    body = (F.when(kind == 0, F.lit('{"machine_id":')).when(kind == 1, F.lit("[1,2]"))
            .when(kind == 2, F.lit('"x"')).when(kind == 3, F.lit("{}")).otherwise(whole))
    return readings.select("event_id", body.alias("body"))


def odd_ids(readings: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 31
    odd = ["WM_0000", "WM_4885", "XX_0001", "WM_12AB", "wm_0007", "WM_00012"]
    machine = F.when(kind == 0, odd[0])
    for i, name in enumerate(odd[1:], 1):
        machine = machine.when(kind == i, name)
    return readings.withColumn("machine_id", machine.otherwise(F.col("machine_id")))


def edges(readings: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 9
    exact = ["70.00", "68.00", "30.00", "70.01", "29.99"]
    temperature = F.when(kind == 0, F.lit(Decimal(exact[0])))
    for i, text in enumerate(exact[1:], 1):
        temperature = temperature.when(kind == i, F.lit(Decimal(text)))
    return readings.withColumns({
        "cycle_temperature": temperature.otherwise(F.col("cycle_temperature"))
        .cast("decimal(5,2)"),
        "vibration_hz": F.when(F.col("event_id") % 10 == 0, F.lit(C.VIBRATION_LIMIT))
        .otherwise(F.col("vibration_hz"))})
