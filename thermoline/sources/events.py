"""Telemetry readings derived from a generic `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline import schemas
from thermoline.functions import rules


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Each event as one reading: the user is the machine, the value its temperature."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    event, user = F.col("event_id"), F.col("user_id")
    branches = F.array(*[F.lit(b) for b in C.BRANCHES])
    codes = F.array(*[F.lit(c) for c in C.ERROR_CODES])
    base = events.select(
        "event_id",
        F.md5(event.cast("string")).alias("reading_id"),
        F.concat(F.lit("WM_"), F.lpad((user + 1).cast("string"), 4, "0")).alias("machine_id"),
        F.get(branches, (user % len(C.BRANCHES)).cast("int")).alias("branch"),
        F.least(F.lit(110.0), F.greatest(F.lit(24.0), F.col("value")))
        .cast(schemas.TEMPERATURE).alias("cycle_temperature"),
        ((F.lit(120) + k * 11).cast("double") / 10).alias("vibration_hz"),
        ((F.lit(150) + event % 701).cast("double") / 100).alias("power_kw"),
        ((F.lit(120) + event % 381).cast("double") / 100).alias("water_pressure_bar"),
        F.col("ts").cast("timestamp").alias("txn_timestamp"))
    temperature, vibration = F.col("cycle_temperature"), F.col("vibration_hz")
    hit = rules.breaches(temperature, C.ALERT_TEMPERATURE, vibration)
    return base.withColumns({
        "error_code": F.when(hit, F.get(codes, (event % len(C.ERROR_CODES)).cast("int")))
        .otherwise(F.lit(C.NO_ERROR)),
        "status": rules.status_of(temperature, vibration),
        "breakdown_soon": rules.breakdown_flag(temperature, C.BREAKDOWN_TEMPERATURE, vibration),
    })


def load_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/events.parquet")


def load_telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry_from_events(load_events(spark, folder))
