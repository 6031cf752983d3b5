"""Keyed topic: message encoding, decoding and connector options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline import constants as C
from thermoline import schemas
from thermoline.functions import values
from thermoline.operators import cleaning

MAX_OFFSETS = 1_000_000


def encode_records(df: DataFrame, key: str = "machine_id") -> DataFrame:
    """Rows as (key, value): UTF-8 key and JSON object. The event time travels under its
    message name `timestamp`, in ISO form with offset."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        name = "timestamp" if field.name == "txn_timestamp" else field.name
        columns.append(column.alias(name))
    return df.select(F.col(key).cast("string").cast("binary").alias("key"),
                     F.to_json(F.struct(*columns)).cast("binary").alias("value"))


def decode_records(df: DataFrame, schema: T.StructType = schemas.MESSAGE) -> DataFrame:
    """Messages as text fields; `schema` names the fields. Other columns pass through."""
    others = [c for c in df.columns if c not in ("key", "value")]
    record = F.from_json(F.col("value").cast("string"), schema)
    return df.withColumn("_record", record).select(
        *[F.col("_record")[f.name].alias(f.name) for f in schema.fields], *others)


def check_records(df: DataFrame) -> DataFrame:
    """Adds `reject_reason`: why a message (column value) is no record, or null. A record is a JSON
    object; its fields may be missing or odd."""
    text = F.trim(F.col("value").cast("string"))
    parsed = F.try_parse_json(text).isNotNull()
    return df.withColumn("reject_reason", F.when(~F.coalesce(parsed, F.lit(False)),
                                                 F.lit(C.INVALID_JSON))
                         .when(~text.startswith("{"), F.lit(C.NOT_AN_OBJECT)))


def normalize_records(messages: DataFrame, now: Column | None = None,
                      default_temperature: float = 0.0,
                      unreadable: str | None = None) -> DataFrame:
    """Decoded messages as typed readings with status and flag by temperature. Works the same
    on a stream and on a table. `unreadable` names a column that tells unreadable times."""
    typed = cleaning.normalize_temperature(messages, default=default_temperature)
    typed = typed.withColumn("timestamp", F.coalesce("timestamp", "txn_timestamp"))
    typed = cleaning.normalize_timestamp(typed, now=now, unreadable=unreadable).drop("timestamp")
    typed = typed.withColumns({s: values.to_number(F.col(s), None) for s in C.SENSOR_ESTIMATES})
    typed = cleaning.flag_breakdown(cleaning.classify_status(typed))
    known = schemas.READING.names
    return typed.select(*known, *[c for c in typed.columns if c not in known])


def read_topic(spark: SparkSession, servers: str, topic: str = C.TOPIC,
               options: dict[str, str] | None = None) -> DataFrame:
    """Stream of (key, value, partition, offset) from the earliest offset, at most MAX_OFFSETS
    messages a batch unless the options say otherwise, so that a backlog comes in pieces. Needs the
    Kafka connector package. Messages of one machine share a topic partition, so `offset` orders
    them; with `partition` it names a message."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest")
              .option("maxOffsetsPerTrigger", str(MAX_OFFSETS)))
    return reader.options(**(options or {})).load().select("key", "value", "partition", "offset")


def write_topic(df: DataFrame, servers: str, topic: str = C.TOPIC, retries: int = 3,
                options: dict[str, str] | None = None) -> None:
    """Publishes (key, value) rows. Needs the Kafka connector package."""
    (df.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).option("kafka.retries", str(retries))
     .options(**(options or {})).save())
