"""Ingress of request bodies: check, fill, and turn into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline import schemas
from thermoline.operators import cleaning
from thermoline.sources import topic


def receive(bodies: DataFrame, column: str = "body",
            now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lenient ingress: (complete readings, refused bodies with `payload_error`). Only broken
    bodies and bodies without machine_id are refused; other gaps are filled."""
    parsed = cleaning.parse_payload(bodies, column)
    good = parsed.filter(F.col("payload_error").isNull()).select(*schemas.MESSAGE.names)
    sent = good.withColumn("timestamp", F.coalesce("timestamp", "txn_timestamp"))
    readings = cleaning.impute_reading(sent.drop("txn_timestamp"), now)
    refused = parsed.filter(F.col("payload_error").isNotNull())
    return (readings.select(*schemas.READING.names),
            refused.select(*bodies.columns, "payload_error"))


def receive_strict(bodies: DataFrame, column: str = "body",
                   now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Strict ingress: (readings, refused bodies with `payload_error`). Every required field
    must be there, and nothing is filled but an id."""
    parsed = cleaning.validate(cleaning.parse_payload(bodies, column))
    error = F.coalesce("payload_error", "reject_reason")
    checked = parsed.withColumn("payload_error", error)
    readings = cleaning.impute_reading(
        checked.filter(F.col("payload_error").isNull())
        .select(*[n for n in schemas.MESSAGE.names if n != "txn_timestamp"]), now)
    refused = checked.filter(F.col("payload_error").isNotNull())
    return (readings.select(*schemas.READING.names),
            refused.select(*bodies.columns, "payload_error"))


def messages(readings: DataFrame) -> DataFrame:
    """Readings as (key, value) messages, keyed by machine."""
    return topic.encode_records(readings)
