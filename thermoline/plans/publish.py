"""Publishing a store: raw history by date, and the results beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.plans import insights
from thermoline.sources import history

INSIGHTS = ("avg_temp_by_branch", "time_in_alert", "busiest_alert_hour", "fleet_health")
RESULTS = (*(f"insights/{name}" for name in INSIGHTS), "predictions/scored")


def publish(spark: SparkSession, source: str, target: str,
            dates: Sequence[str] | None = None) -> DataFrame:
    """Copies raw dates (those that changed, unless named) and the results that exist, each
    replacing what is there, and writes both snapshots, which other readers take, beside the
    copies they are made of. Returns what the target then holds per date."""
    history.sync_partitions(spark, f"{source}/raw", f"{target}/raw", dates)
    copied = {}
    for name in RESULTS:
        try:
            result = spark.read.parquet(f"{source}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        history.write_result(result, f"{target}/{name}")
        copied[name.split("/")[1]] = spark.read.parquet(f"{target}/{name}")
    if all(name in copied for name in INSIGHTS):
        insights.snapshot_lines(copied).write.mode("overwrite").text(
            f"{target}/insights/latest_insights")
    if "scored" in copied:
        history.write_result_json(copied["scored"], f"{target}/predictions/latest_predictions")
    return history.sync_report(history.read_history(spark, f"{target}/raw"))


def store_report(spark: SparkSession, target: str) -> DataFrame:
    """(folder, files, bytes) of all that a store holds, from the file listing alone."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target))
    folder = F.regexp_extract("path", r"/(raw|insights|predictions)/([^/]*)/", 0)
    return listed.groupBy(F.trim(folder, F.lit("/")).alias("folder")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))
