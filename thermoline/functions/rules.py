"""Threshold rules as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from thermoline import constants as C


def exceeds(temperature: Column, threshold: Decimal = C.ALERT_TEMPERATURE) -> Column:
    """temperature > threshold. The literal is a decimal, so on the decimal history column
    the comparison needs no cast and reaches the Parquet scan."""
    return temperature > F.lit(Decimal(threshold))


def breaches(temperature: Column, threshold: Decimal, vibration: Column | None = None,
             vibration_limit: float = C.VIBRATION_LIMIT) -> Column:
    """Over the temperature or, where given, the vibration limit; unknown values do not count."""
    hit = F.coalesce(exceeds(temperature, threshold), F.lit(False))
    if vibration is not None:
        hit = hit | F.coalesce(vibration > F.lit(vibration_limit), F.lit(False))
    return hit


def status_of(temperature: Column, vibration: Column | None = None) -> Column:
    hit = breaches(temperature, C.ALERT_TEMPERATURE, vibration)
    return F.when(hit, F.lit(C.ALERT)).otherwise(F.lit(C.NORMAL))


def breakdown_flag(temperature: Column, threshold: Decimal = C.BREAKDOWN_TEMPERATURE,
                   vibration: Column | None = None,
                   vibration_limit: float = C.VIBRATION_LIMIT) -> Column:
    return breaches(temperature, threshold, vibration, vibration_limit).cast("int")


def error_code_of(temperature: Column) -> Column:
    hit = breaches(temperature, C.ALERT_TEMPERATURE)
    return F.when(hit, F.lit(C.OVERHEAT_ERROR)).otherwise(F.lit(C.NO_ERROR))


def sensor_estimate(temperature: Column, sensor: str) -> Column:
    """Stand-in for a missing sensor value, computed in decimals: over doubles the rounding
    of ties depends on the engine."""
    rule = C.SENSOR_ESTIMATES[sensor]
    base, slope, span = (F.lit(Decimal(rule[k])) for k in ("base", "slope", "span"))
    t = temperature.cast("decimal(9,4)")
    return F.round(base + F.pmod(t * slope, span), rule["digits"]).cast("double")
