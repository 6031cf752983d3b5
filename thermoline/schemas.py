"""Schemas of the telemetry tables."""

from pyspark.sql import types as T

# Wide enough that no reading of a sensor, however wild, changes its value.
TEMPERATURE = T.DecimalType(9, 2)

READING = T.StructType([
    T.StructField("reading_id", T.StringType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("cycle_temperature", TEMPERATURE),
    T.StructField("vibration_hz", T.DoubleType()),
    T.StructField("power_kw", T.DoubleType()),
    T.StructField("water_pressure_bar", T.DoubleType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("txn_timestamp", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("breakdown_soon", T.IntegerType()),
])

# A message before cleaning: every field is text, so that one bad number or
# time never spoils the rest of its record.
MESSAGE = T.StructType([
    T.StructField("reading_id", T.StringType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("cycle_temperature", T.StringType()),
    T.StructField("vibration_hz", T.StringType()),
    T.StructField("power_kw", T.StringType()),
    T.StructField("water_pressure_bar", T.StringType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("txn_timestamp", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("breakdown_soon", T.StringType()),
])

LOG = T.StructType([
    T.StructField("reading_id", T.StringType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("cycle_temperature", TEMPERATURE),
    T.StructField("txn_timestamp", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("breakdown_soon", T.IntegerType()),
])

STATUS = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("reading_id", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("cycle_temperature", TEMPERATURE),
    T.StructField("status", T.StringType()),
    T.StructField("breakdown_soon", T.IntegerType()),
    T.StructField("last_updated", T.TimestampType()),
])

PREDICTION = T.StructType([
    T.StructField("machine_id", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("scored_at", T.TimestampType()),
])
