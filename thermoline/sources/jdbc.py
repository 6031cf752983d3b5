"""Operational tables over JDBC."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from thermoline.operators import combine
from thermoline.session import materialize


@dataclass(frozen=True)
class Slices:
    """How to read a table in parallel: ranges of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    count: int

    def options(self) -> dict[str, str]:
        return {"partitionColumn": self.column, "lowerBound": self.lower,
                "upperBound": self.upper, "numPartitions": str(self.count)}


def read_options(url: str, table: str, properties: dict[str, str] | None = None,
                 slices: Slices | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    return {"url": url, "dbtable": table, "fetchsize": str(fetch_size),
            "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true",
            **(properties or {}), **(slices.options() if slices else {})}


def read_table_jdbc(spark: SparkSession, url: str, table: str,
                    properties: dict[str, str] | None = None,
                    slices: Slices | None = None) -> DataFrame:
    """A table, one task per slice; without slices one task reads it all."""
    return (spark.read.format("jdbc")
            .options(**read_options(url, table, properties, slices)).load())


def write_options(url: str, table: str, properties: dict[str, str] | None = None,
                  connections: int = 8, batch_size: int = 5_000) -> dict[str, str]:
    return {"url": url, "dbtable": table, "numPartitions": str(connections),
            "batchsize": str(batch_size), **(properties or {})}


def write_table_jdbc(df: DataFrame, url: str, table: str,
                     properties: dict[str, str] | None = None, mode: str = "overwrite",
                     connections: int = 8) -> None:
    """Writes a merged table. `overwrite` truncates and keeps the table's definition;
    `connections` bounds what the database sees."""
    (df.write.format("jdbc").options(**write_options(url, table, properties, connections))
     .option("truncate", "true").mode(mode).save())


def merge_table_jdbc(batch: DataFrame, url: str, table: str, key: str = "reading_id",
                     update_cols: Sequence[str] | str = combine.LOG_UPDATES,
                     order: Sequence[str] = ("txn_timestamp",),
                     properties: dict[str, str] | None = None,
                     slices: Slices | None = None) -> None:
    """Merges a batch into a table by key. The merged rows are written to the shared folder
    before the table is replaced: it must not be emptied while it is still being read, and a
    failed load can be repeated from there."""
    spark = batch.sparkSession
    target = read_table_jdbc(spark, url, table, properties, slices)
    merged = combine.merge_by_key(target, batch, key, update_cols, order)
    write_table_jdbc(materialize(merged, "jdbc-merge"), url, table, properties)
