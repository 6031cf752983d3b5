"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline import constants as C
from thermoline.functions import rules, values


def clamp_limit(value: object, default: int, maximum: int) -> int:
    """Limit within 1..maximum; `default` where `value` is no integer."""
    try:
        number = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default
    return min(max(number, 1), maximum)


def _as_int(value: object) -> int | None:
    try:
        return int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return None


def over_threshold(df: DataFrame, threshold: Decimal = C.ALERT_TEMPERATURE,
                   column: str = "cycle_temperature") -> DataFrame:
    return df.filter(rules.exceeds(F.col(column), threshold))


def normal_band(column: str = "cycle_temperature") -> Column:
    low, high = C.NORMAL_BAND
    return F.col(column).between(F.lit(low), F.lit(high))


def filter_readings(df: DataFrame, machine_id: str | None = None, branch: str | None = None,
                    status: str | None = None, breakdown_soon: object = None) -> DataFrame:
    """Keeps the rows that match every filter given. Text matches in any case. A row whose
    flag is null passes the flag filter; a frame without the column counts as flag 0; a
    flag that is no integer filters nothing."""
    if machine_id:
        df = df.filter(F.upper("machine_id") == machine_id.upper())
    if branch:
        df = df.filter(F.lower("branch") == branch.lower())
    if status:
        df = df.filter(F.upper("status") == status.upper())
    flag = _as_int(breakdown_soon)
    if flag is not None:
        have = F.col("breakdown_soon") if "breakdown_soon" in df.columns else F.lit(0)
        df = df.filter(have.isNull() | (have == flag))
    return df


def filter_predictions(df: DataFrame, risk: object = None,
                       branch: str | None = None) -> DataFrame:
    value = _as_int(risk)
    if value is not None:
        df = df.filter(F.col("prediction") == value)
    if branch:
        df = df.filter(F.lower("branch") == branch.lower())
    return df


def in_partition(df: DataFrame, dt: str | None = None) -> DataFrame:
    """Rows of one date partition, the newest by default. The newest date is a scalar
    subquery on the partition column, so even then the scan reads one partition."""
    if dt is not None:
        return df.filter(F.col("dt") == F.lit(dt).cast("date"))
    newest = df.agg(F.max("dt")).scalar()
    return df.filter(F.col("dt") == newest)


def history_rows(df: DataFrame, dt: str | None = None, branch: str | None = None,
                 status: str | None = None) -> DataFrame:
    """Time travel: all rows of one date partition that pass the filters."""
    return filter_readings(in_partition(df, dt), branch=branch, status=status)


def history(df: DataFrame, dt: str | None = None, branch: str | None = None,
            status: str | None = None, limit: object = None) -> DataFrame:
    """The newest of `history_rows`, with `limit` clamped."""
    return (history_rows(df, dt, branch, status)
            .orderBy(F.desc("txn_timestamp"), F.desc("reading_id"))
            .limit(clamp_limit(limit, *C.READINGS_LIMIT)))


def history_total(df: DataFrame, dt: str | None = None, branch: str | None = None,
                  status: str | None = None) -> DataFrame:
    """How many rows `history` found before its limit."""
    return history_rows(df, dt, branch, status).agg(
        F.count(F.lit(1)).alias("total_partition_records"))


def valid_machine(column: Column, low: int = C.MACHINE_RANGE[0], high: int = C.MACHINE_RANGE[1],
                  mode: str = "strict") -> Column:
    """Is the machine id valid?

    pattern  WM_ and four digits, number up to `high` (so WM_0000 is kept)
    range    number within low..high, whatever the prefix
    prefix   WM, one character, anything; number within low..high
    strict   WM and exactly five characters; number within low..high
    """
    number, name = values.machine_number(column), F.upper(column)
    if mode == "pattern":
        return name.rlike(C.MACHINE_PATTERN) & (number <= high)
    in_range = number.between(low, high)
    if mode == "range":
        return in_range
    if mode == "prefix":
        return name.like("WM_%") & in_range
    if mode == "strict":
        return name.like("WM_____") & in_range
    raise ValueError(f"unknown mode: {mode}")


def keep_valid_machines(df: DataFrame, low: int = C.MACHINE_RANGE[0],
                        high: int = C.MACHINE_RANGE[1], mode: str = "strict") -> DataFrame:
    return df.filter(valid_machine(F.col("machine_id"), low, high, mode))
