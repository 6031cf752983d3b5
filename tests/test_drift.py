"""Histories whose files differ in columns and types."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from thermoline.operators import cleaning
from thermoline.sources import history


def put(rows, path):
    rows.write.mode("append").partitionBy("dt").parquet(path)


@pytest.fixture
def dated(readings):
    def build(*rows):
        return cleaning.with_partition_date(readings(rows)).select(
            "reading_id", "machine_id", "cycle_temperature", "txn_timestamp", "vibration_hz", "dt")
    return build


def shown(spark, path, *names):
    rows = history.load_history(spark, path).orderBy("reading_id").select("reading_id", *names)
    return [tuple(r) for r in rows.collect()]


def test_columns_that_some_files_lack(spark, dated, tmp_path):
    path = str(tmp_path / "raw")
    put(dated(("a", "M", 1, "2024-01-01")).drop("vibration_hz"), path)
    put(dated(("b", "M", 2, "2024-01-01")).withColumn("note", F.lit("n")), path)
    assert len(history.read_drifted(spark, path)) == 1
    assert shown(spark, path, "vibration_hz", "note") == [("a", None, None), ("b", 50.0, "n")]


def test_types_that_differ(spark, dated, tmp_path):
    path = str(tmp_path / "raw with space")
    plain = dated(("a", "M", 1.25, "2024-01-01"), ("n", "M", None, None))
    put(plain, path)
    temperature = F.col("cycle_temperature")
    put(dated(("b", "M", 2.5, "2024-01-01")).withColumn(
        "cycle_temperature", temperature.cast("double")).drop("vibration_hz"), path)
    put(dated(("c", "M", 3.5, "2024-01-02")).withColumn(
        "cycle_temperature", temperature.cast("string")).withColumn("note", F.lit("n")), path)
    # Lacks what the others disagree on, so it is read with one of them.
    put(dated(("d", "M", 4, "2024-01-02")).drop("cycle_temperature"), path)
    assert len(history.read_drifted(spark, path)) == 3
    assert shown(spark, path, "cycle_temperature", "vibration_hz", "note", "dt") == [
        (i, t, v, n, d and date(2024, 1, d)) for i, t, v, n, d in [
            ("a", Decimal("1.25"), 50.0, None, 1), ("b", Decimal("2.50"), None, None, 1),
            ("c", Decimal("3.50"), 50.0, "n", 2), ("d", None, 50.0, None, 2),
            ("n", None, 50.0, None, None)]]


def test_publishing_keeps_columns_and_types(spark, dated, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    put(dated(("a", "M", 1, "2024-01-01")).drop("vibration_hz"), source)
    put(dated(("b", "M", 2, "2024-01-01")).withColumn(
        "cycle_temperature", F.col("cycle_temperature").cast("double")), source)
    history.sync_partitions(spark, source, target)
    assert shown(spark, target, "cycle_temperature", "vibration_hz") == [
        ("a", Decimal("1.00"), None), ("b", Decimal("2.00"), 50.0)]


def test_one_layout_a_schema(spark, dated, tmp_path):
    path = str(tmp_path / "raw")
    for k in range(3):
        put(dated((f"r{k}", "M", k, f"2024-01-0{k + 1}")), path)
    put(dated(("x", "M", 1, "2024-01-01")).drop("vibration_hz"), path)
    found = history.file_layouts(spark, path)
    assert found.select("layout").distinct().count() == 2 and found.count() == 4


def test_schemas_are_grouped_by_the_types_they_share(spark):
    kinds = ["a int, b int", "a double, c int", "c int, d int", "A int, d int", "c string"]
    groups = history._together([spark.createDataFrame([], k).schema for k in kinds])
    assert [places for _, places in groups] == [[0, 2, 3], [1], [4]]
    assert [c.lower() for c in groups[0][0].names] == ["a", "b", "c", "d"]
