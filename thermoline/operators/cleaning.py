"""Validation, normalisation, imputation, classification and repair of readings."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline import constants as C
from thermoline import schemas
from thermoline.functions import rules, values

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# What tells one message from another with the same content.
IDENTITY = ("topic", "partition", "offset", "file", "position")


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def validate(df: DataFrame, required: Sequence[str] = C.REQUIRED_FIELDS,
             reason: str = "reject_reason") -> DataFrame:
    """Adds `reason`: the first required field that is missing, or null for a good row."""
    checks = [F.when(F.col(name).isNull(), F.lit(C.MISSING_FIELD + name)) for name in required]
    return df.withColumn(reason, F.coalesce(*checks))


def accepted(validated: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return validated.filter(F.col(reason).isNull()).drop(reason)


def rejected(validated: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return validated.filter(F.col(reason).isNotNull())


def parse_payload(df: DataFrame, column: str = "body",
                  schema: T.StructType = schemas.MESSAGE) -> DataFrame:
    """Expands a JSON text column into the message fields and `payload_error`.

    A body must parse, must be an object and must hold machine_id; the first rule broken
    gives the error, and the fields of a broken body are null.
    """
    text = F.trim(F.col(column))
    valid = F.try_parse_json(text).isNotNull()
    record = F.when(valid & text.startswith("{"), F.from_json(text, schema))
    out = df.withColumn("_record", record)
    error = (F.when(~F.coalesce(valid, F.lit(False)), F.lit(C.INVALID_JSON))
             .when(~text.startswith("{"), F.lit(C.NOT_AN_OBJECT))
             .when(F.col("_record.machine_id").isNull(),
                   F.lit(C.MISSING_FIELD + "machine_id")))
    fields = [F.col("_record")[f.name].alias(f.name) for f in schema.fields]
    return out.select(*df.columns, *fields, error.alias("payload_error"))


def canonicalize(df: DataFrame) -> DataFrame:
    """One name and type per field: `txn_timestamp` (else `timestamp`) as timestamp,
    temperature as decimal, sensors as double, flag as int. Sensor columns that are
    absent appear as nulls; other columns pass through."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def time_of(name: str) -> Column:
        if isinstance(kinds[name], T.StringType):
            return values.parse_timestamp(F.col(name))
        return F.col(name).cast("timestamp")

    times = [time_of(n) for n in ("txn_timestamp", "timestamp") if n in kinds]
    when = F.coalesce(*times) if times else None

    def typed(field: T.StructField) -> Column:
        have, want = kinds.get(field.name), field.dataType
        column = _or_null(df, field.name)
        if have is None or have == want:
            return column.cast(want)
        if isinstance(want, T.StringType):
            return column.cast(want)
        number = (values.to_number(column, None) if isinstance(have, T.StringType)
                  else values.finite(column.cast("double")))
        return (values.to_decimal(number, want) if isinstance(want, T.DecimalType)
                else number.try_cast(want))

    columns = [(when if when is not None else F.lit(None).cast("timestamp"))
               .alias("txn_timestamp") if field.name == "txn_timestamp"
               else typed(field).alias(field.name) for field in schemas.READING.fields]
    known = set(schemas.READING.names) | {"timestamp"}
    return df.select(*columns, *[n for n in df.columns if n not in known])


def normalize_timestamp(df: DataFrame, source: str = "timestamp", out: str = "txn_timestamp",
                        now: Column | None = None, unreadable: str | None = None) -> DataFrame:
    """Parsed event time; missing or unreadable → `now`. With `unreadable` a column of that name
    tells which rows had a time that could not be read, so that they can be set aside."""
    fallback = F.current_timestamp() if now is None else now
    parsed = values.parse_timestamp(F.col(source))
    made = {out: F.coalesce(parsed, fallback)}
    if unreadable is not None:
        given = F.trim(F.col(source).cast("string")) != ""
        made[unreadable] = F.coalesce(given & parsed.isNull(), F.lit(False))
    return df.withColumns(made)


def normalize_temperature(df: DataFrame, column: str = "cycle_temperature",
                          default: float = C.DEFAULT_TEMPERATURE) -> DataFrame:
    """Number or `default`, as decimal. Text that is no number, or none that the type holds,
    counts as missing."""
    number = values.to_decimal(values.to_number(F.col(column), None), schemas.TEMPERATURE)
    return df.withColumn(column, F.coalesce(
        number, F.lit(float(default)).cast(schemas.TEMPERATURE)))


def impute_reading(df: DataFrame, now: Column | None = None,
                   fill_id: Column | None = None) -> DataFrame:
    """Fills what a reading lacks: id, branch, temperature, sensors, error code, time, status
    and flag. The default id is a hash of where the message came from (those of IDENTITY that the
    table has) and of all its fields: a replay gives the same id, and two messages that differ in
    any field, or come from different places, never share one."""
    out = df
    for name in ("reading_id", "branch", "vibration_hz", "power_kw", "water_pressure_bar",
                 "error_code", "timestamp", "status", "breakdown_soon"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    if fill_id is None:
        fill_id = values.hash_id(*[F.col(n) for n in (*IDENTITY, *schemas.MESSAGE.names)
                                   if n in out.columns])
    out = out.withColumn("reading_id", F.coalesce("reading_id", fill_id))
    out = normalize_temperature(out)
    temperature = F.col("cycle_temperature")
    out = out.withColumns({
        sensor: F.coalesce(values.to_number(F.col(sensor), None),
                           rules.sensor_estimate(temperature, sensor))
        for sensor in C.SENSOR_ESTIMATES
    })
    vibration = F.col("vibration_hz")
    out = out.withColumns({
        "branch": F.coalesce("branch", F.lit(C.DEFAULT_BRANCH)),
        "error_code": F.coalesce("error_code", rules.error_code_of(temperature)),
        "status": F.coalesce("status", rules.status_of(temperature, vibration)),
        "breakdown_soon": F.coalesce(
            values.to_number(F.col("breakdown_soon"), None).try_cast("int"),
            rules.breakdown_flag(temperature, C.ALERT_TEMPERATURE, vibration)),
    })
    return normalize_timestamp(out, now=now).drop("timestamp")


def backfill_sensors(df: DataFrame) -> DataFrame:
    """Sensor and error columns for log rows, which carry none."""
    temperature = F.coalesce(F.col("cycle_temperature"),
                             F.lit(Decimal(str(C.DEFAULT_TEMPERATURE)))
                             .cast(schemas.TEMPERATURE))
    filled = {s: F.coalesce(_or_null(df, s, "double"), rules.sensor_estimate(temperature, s))
              for s in C.SENSOR_ESTIMATES}
    filled["error_code"] = F.coalesce(_or_null(df, "error_code"),
                                      rules.error_code_of(temperature))
    return df.withColumns(filled)


def classify_status(df: DataFrame, rule: str = "temp") -> DataFrame:
    """status = ALERT over 70 °C (`temp`), or also over 90 Hz (`temp_or_vibration`)."""
    if rule not in ("temp", "temp_or_vibration"):
        raise ValueError(f"unknown status rule: {rule}")
    vibration = F.col("vibration_hz") if rule == "temp_or_vibration" else None
    return df.withColumn("status", rules.status_of(F.col("cycle_temperature"), vibration))


def flag_breakdown(df: DataFrame, threshold: Decimal = C.BREAKDOWN_TEMPERATURE,
                   vibration_limit: float | None = None) -> DataFrame:
    """breakdown_soon = 1 over `threshold` or, where a limit is given, over that vibration."""
    vibration = None if vibration_limit is None else F.col("vibration_hz")
    flag = rules.breakdown_flag(F.col("cycle_temperature"), threshold, vibration,
                                vibration_limit or C.VIBRATION_LIMIT)
    return df.withColumn("breakdown_soon", flag)


def derive_error_code(df: DataFrame) -> DataFrame:
    """Fills a missing error code from the temperature."""
    derived = rules.error_code_of(F.col("cycle_temperature"))
    return df.withColumn("error_code", F.coalesce(_or_null(df, "error_code"), derived))


def with_partition_date(df: DataFrame, by: str = "event", arrival: Column | None = None,
                        time: str = "txn_timestamp") -> DataFrame:
    """dt = day of the event, or (`by="arrival"`) of its arrival."""
    if by not in ("event", "arrival"):
        raise ValueError(f"unknown partition date: {by}")
    when = F.col(time) if by == "event" else (
        F.current_timestamp() if arrival is None else arrival)
    return df.withColumn("dt", F.to_date(when))


def present(df: DataFrame, digits: int | None = None, time_format: str = TIME_FORMAT) -> DataFrame:
    """Output rendering: times and dates as text, decimals as doubles, small ints as int;
    doubles rounded where `digits` is given."""
    def render(field: T.StructField) -> Column:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, time_format)
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.DecimalType):
            column = (column if digits is None else F.round(column, digits)).cast("double")
        elif isinstance(kind, (T.DoubleType, T.FloatType)) and digits is not None:
            column = F.round(column.cast("double"), digits)
        elif isinstance(kind, (T.ByteType, T.ShortType)):
            column = column.cast("int")
        return column.alias(field.name)

    return df.select(*[render(f) for f in df.schema.fields])


def normalize_predictions(df: DataFrame) -> DataFrame:
    """prediction, else breakdown_soon, else 0; with the risk text."""
    value = F.coalesce(_or_null(df, "prediction", "int").cast("int"),
                       _or_null(df, "breakdown_soon", "int").cast("int"), F.lit(0))
    risk = F.when(F.col("prediction") == 1, C.HIGH_RISK_TEXT).otherwise(C.LOW_RISK_TEXT)
    return (df.withColumn("prediction", value)
            .select("machine_id", "branch", "prediction",
                    F.col("prediction").alias("breakdown_soon"),
                    risk.alias("risk_status"),
                    F.coalesce(F.col("scored_at").cast("string"), F.lit("")).alias("scored_at")))


def repair_status(df: DataFrame, fill_id: Column | None = None) -> DataFrame:
    """Fills temperature, branch and id of a status table; status and flag follow the
    temperature again."""
    if fill_id is None:
        fill_id = values.hash_id(F.col("machine_id"))
    filled = df.withColumns({
        "cycle_temperature": F.coalesce(
            "cycle_temperature", F.lit(Decimal(str(C.DEFAULT_TEMPERATURE)))
            ).cast(schemas.TEMPERATURE),
        "branch": F.coalesce(F.nullif(F.col("branch"), F.lit("")), F.lit(C.DEFAULT_BRANCH)),
        "reading_id": F.coalesce(F.nullif(F.col("reading_id"), F.lit("")), fill_id),
    })
    return flag_breakdown(classify_status(filled), C.ALERT_TEMPERATURE)


def repair_log(df: DataFrame) -> DataFrame:
    """Sets the flag of clear cases: 1 if ALERT or over 70, 0 if NORMAL and not over 70;
    every other row keeps its flag."""
    temperature, status = F.col("cycle_temperature"), F.col("status")
    limit = F.lit(C.ALERT_TEMPERATURE)
    flag = (F.when((status == C.ALERT) | (temperature > limit), F.lit(1))
            .when((status == C.NORMAL) & (temperature <= limit), F.lit(0))
            .otherwise(F.col("breakdown_soon")))
    return df.withColumn("breakdown_soon", flag)


def ensure_columns(df: DataFrame, schema: T.StructType,
                   defaults: dict[str, object] | None = None) -> DataFrame:
    """Adds the columns of `schema` that `df` lacks, typed, null or with the given default."""
    defaults = defaults or {}
    missing = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType)
               for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df
