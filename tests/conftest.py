import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thermoline.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.driver.memory": "4g",
        "spark.sql.maxMetadataStringLength": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def telemetry(spark):
    from thermoline.sources.events import load_telemetry
    return load_telemetry(spark, SMALL)


@pytest.fixture
def readings(spark):
    """Builds readings from (reading_id, machine_id, temperature, time, extra…) tuples."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    from thermoline import schemas

    def build(rows, **constants):
        data = [(r[0], r[1], None if r[2] is None else Decimal(str(r[2])), r[3]) for r in rows]
        df = spark.createDataFrame(
            data, "reading_id string, machine_id string, cycle_temperature decimal(9,2), "
                  "txn_timestamp string")
        df = df.withColumn("txn_timestamp", F.col("txn_timestamp").cast("timestamp"))
        defaults = {"branch": "Huye", "vibration_hz": 50.0, "power_kw": 2.0,
                    "water_pressure_bar": 2.0, "error_code": "NORMAL", "status": "NORMAL",
                    "breakdown_soon": 0, **constants}
        for field in schemas.READING.fields:
            if field.name in defaults:
                df = df.withColumn(field.name, F.lit(defaults[field.name]).cast(field.dataType))
        return df.select(*schemas.READING.names)

    return build


@pytest.fixture
def values():
    """Values of one column, in row order."""
    return lambda df, name: [row[name] for row in df.select(name).collect()]
