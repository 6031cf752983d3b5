"""Aggregations. All are partial + final hash aggregates: a hot key shuffles one row per
map task, however many readings it has."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline import constants as C
from thermoline.functions import rules
from thermoline.operators.filters import normal_band, over_threshold


def _count() -> Column:
    return F.count(F.lit(1))


def exact_mean(df: DataFrame, value: str, digits: int) -> Column:
    """Mean rounded to `digits`, as double.

    A short decimal is summed as whole units (cents) in a bigint: exact in any order, inside
    codegen, and safe to some 1e15 rows, where a decimal(5,2) sum overflows at 1e11.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 9:
        units = (F.col(value) * F.lit(10 ** kind.scale)).cast("bigint")
        total = F.sum(units).cast("decimal(20,0)")
        parts = (F.count(value) * F.lit(10 ** kind.scale)).cast("decimal(18,0)")
        return F.round(total / parts, digits).cast("double")
    return F.round(F.avg(value), digits).cast("double")


def avg_by_group(df: DataFrame, key: str = "branch", value: str = "cycle_temperature",
                 digits: int = 2, out: str = "avg_temperature",
                 ordered: bool = False) -> DataFrame:
    """Mean per group; `ordered` sorts the highest mean first."""
    means = df.groupBy(key).agg(exact_mean(df, value, digits).alias(out))
    return means.orderBy(F.desc(out), key) if ordered else means


def count_alerts(df: DataFrame, keys: Sequence[str] = ("machine_id", "branch"),
                 threshold: Decimal = C.ALERT_TEMPERATURE) -> DataFrame:
    """Over-threshold readings per key, in no order."""
    return (over_threshold(df, threshold).groupBy(*keys)
            .agg(_count().alias("alert_count")))


def alert_counts(df: DataFrame, keys: Sequence[str] = ("machine_id", "branch"),
                 threshold: Decimal = C.ALERT_TEMPERATURE) -> DataFrame:
    """Over-threshold readings per key, most first."""
    return count_alerts(df, keys, threshold).orderBy(F.desc("alert_count"), *keys)


def top_overheating(df: DataFrame, n: int = C.TOP_MACHINES,
                    threshold: Decimal = C.ALERT_TEMPERATURE) -> DataFrame:
    """The `n` machines with most over-threshold readings."""
    return alert_counts(df, threshold=threshold).limit(n)


def alert_hours(df: DataFrame, by: str = "temperature",
                threshold: Decimal = C.ALERT_TEMPERATURE,
                time: str = "txn_timestamp") -> DataFrame:
    """Alerts per hour of day, busiest first; an alert is an over-threshold temperature or
    (`by="status"`) the status ALERT."""
    if by not in ("temperature", "status"):
        raise ValueError(f"unknown alert rule: {by}")
    alerts = (over_threshold(df, threshold) if by == "temperature"
              else df.filter(F.col("status") == C.ALERT))
    return (alerts.groupBy(F.hour(time).alias("hour")).agg(_count().alias("alert_count"))
            .orderBy(F.desc("alert_count"), "hour"))


def fleet_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        _count().alias("total_machines_tracked"),
        F.count_if(F.col("status") == C.ALERT).alias("in_alert"),
        F.count_if(F.col("status") == C.NORMAL).alias("normal"))


def status_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(_count().alias("count"))


def reading_counts(df: DataFrame) -> DataFrame:
    """Total, alert and normal readings; status ALERT or over 70 °C is an alert."""
    alert = F.coalesce(F.col("status") == C.ALERT, F.lit(False)) | rules.breaches(
        F.col("cycle_temperature"), C.ALERT_TEMPERATURE)
    return df.agg(_count().alias("returned_readings_count"),
                  F.count_if(alert).alias("alert_readings_count"),
                  F.count_if(~alert).alias("normal_readings_count"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Scored, flagged and normal machines, and the share flagged in percent (0.0 of none)."""
    counts = predictions.agg(
        _count().alias("total_scored_machines"),
        F.count_if(F.col("prediction") == 1).alias("flagged_breakdown_soon"))
    total, flagged = F.col("total_scored_machines"), F.col("flagged_breakdown_soon")
    share = F.round((flagged * 100).cast("decimal(18,0)") / total.cast("decimal(18,0)"), 1)
    return counts.select(
        total, flagged, (total - flagged).alias("normal_machines"),
        F.when(total > 0, share.cast("double")).otherwise(F.lit(0.0))
        .alias("fleet_breakdown_risk_pct"))


def health_summary(df: DataFrame) -> DataFrame:
    """Readings in good condition (flag 0), in the normal band, and in all."""
    return df.agg(F.count_if(F.col("breakdown_soon") == 0).alias("good_condition_count"),
                  F.count_if(normal_band()).alias("normal_temp_count"),
                  _count().alias("total_machines"))


def partition_catalog(df: DataFrame) -> DataFrame:
    """Date partitions, newest first, with their rows."""
    return df.groupBy("dt").agg(_count().alias("row_count")).orderBy(F.desc("dt"))


def partition_count(df: DataFrame) -> DataFrame:
    """How many date partitions there are."""
    return df.agg(F.count_distinct("dt").alias("total_partitions"))


def trim_report(df: DataFrame, keep: Column) -> DataFrame:
    """What a trim by `keep` would do: rows before, in range, removed, after. As in a SQL
    delete, a row whose test is unknown is not removed."""
    removed = F.count_if(~keep)
    return df.agg(_count().alias("rows_before"), F.count_if(keep).alias("rows_in_range"),
                  removed.alias("rows_removed"), (_count() - removed).alias("rows_after"))


def fleet_kpis(status: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fleet size, machines in alert, mean temperature, predicted failures: one aggregate
    over both inputs stacked, so no join is needed."""
    stacked = (status.select(F.lit(1).alias("machine"),
                             (F.col("status") == C.ALERT).cast("int").alias("alert"),
                             "cycle_temperature",
                             F.lit(None).cast("int").alias("failure"))
               .unionAll(predictions.select(
                   F.lit(None).cast("int"), F.lit(None).cast("int"),
                   F.lit(None).cast(status.schema["cycle_temperature"].dataType),
                   (F.col("prediction") == 1).cast("int"))))
    zero = F.lit(0).cast("bigint")
    return stacked.agg(
        F.count("machine").alias("total_machines"),
        F.coalesce(F.sum("alert"), zero).alias("machines_in_alert"),
        exact_mean(stacked, "cycle_temperature", 2).alias("avg_fleet_temperature"),
        F.coalesce(F.sum("failure"), zero).alias("predicted_failures"))
