"""Batch insights: three results, their health summary and one snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoline import constants as C
from thermoline import schemas
from thermoline.functions import rules
from thermoline.operators import filters
from thermoline.session import materialize
from thermoline.sources import history


def profile(readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Readings counted by (machine, branch, hour of day), and by the columns `by` if given, with
    all that the insights need. One scan of four or five columns; its size depends on the fleet,
    not on the history. Profiles of disjoint readings, one under the other, are a profile of all."""
    temperature = F.col("cycle_temperature")
    return readings.groupBy(*by, "machine_id", "branch",
                            F.hour("txn_timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.count(temperature).alias("measured"),
        F.sum((temperature.cast(schemas.TEMPERATURE) * 100).cast("bigint")).alias("cents"),
        F.count_if(rules.exceeds(temperature)).alias("alerts"),
        F.count_if(F.col("breakdown_soon") == 0).alias("good"),
        F.count_if(filters.normal_band()).alias("in_band"))


# Columns of the profiles that are kept by date.
DAILY = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("machine_id", "branch")],
    T.StructField("hour", T.IntegerType()),
    *[T.StructField(n, T.LongType())
      for n in ("readings", "measured", "cents", "alerts", "good", "in_band")],
    T.StructField("dt", T.DateType())])


def refresh_profiles(spark: SparkSession, raw: str, profiles: str) -> DataFrame:
    """Profiles of the history by date, kept at `profiles`: only dates whose files changed since
    the last refresh are read and counted again, and dates that are gone go. What was counted is
    the manifest beside them, committed last, so a refresh that fails is repeated."""
    history.sync_partitions(spark, raw, profiles, derive=lambda rows: profile(rows, ["dt"]))
    try:
        return history.read_history(spark, profiles, DAILY)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # no files were ever there
            raise
        return spark.createDataFrame([], DAILY)


def insights(profiled: DataFrame) -> dict[str, DataFrame]:
    """The three results and the health summary, from a profile."""
    hot = profiled.filter(F.col("alerts") > 0)
    mean = F.round(F.sum("cents").cast("decimal(20,0)")
                   / (F.sum("measured") * 100).cast("decimal(18,0)"), 2).cast("double")
    return {
        "avg_temp_by_branch": profiled.groupBy("branch").agg(mean.alias("avg_temperature"))
        .orderBy(F.desc("avg_temperature"), "branch"),
        "time_in_alert": hot.groupBy("machine_id", "branch")
        .agg(F.sum("alerts").alias("alert_count"))
        .orderBy(F.desc("alert_count"), "machine_id", "branch"),
        "busiest_alert_hour": hot.groupBy("hour").agg(F.sum("alerts").alias("alert_count"))
        .orderBy(F.desc("alert_count"), "hour"),
        "fleet_health": profiled.agg(F.sum("good").alias("good_condition_count"),
                                     F.sum("in_band").alias("normal_temp_count"),
                                     F.sum("readings").alias("total_machines")),
    }


def _items(results: dict[str, DataFrame], top_n: int | None) -> list[tuple]:
    """(name, rows, order, fields) of the lists in a snapshot."""
    machines = results["time_in_alert"]
    most = -F.col("alert_count")
    return [
        ("avg_by_branch", results["avg_temp_by_branch"],
         [-F.col("avg_temperature"), F.col("branch")], ["branch", "avg_temperature"]),
        ("time_in_alert", machines if top_n is None else machines.limit(top_n),
         [most, F.col("machine_id"), F.col("branch")], ["machine_id", "branch", "alert_count"]),
        ("busiest_hour", results["busiest_alert_hour"], [most, F.col("hour")],
         ["hour", "alert_count"])]


def snapshot(results: dict[str, DataFrame], top_n: int | None = None) -> DataFrame:
    """One row with one JSON object: branch means, machines in alert (the `top_n` first, if
    given), hours, health. It holds an entry for each branch, hour and machine in alert; for a
    fleet too large for one row `snapshot_lines` gives the same object line by line."""
    parts = []
    for name, rows, order, fields in _items(results, top_n):
        numbered = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)],
                            F.struct(*fields).alias("item"))
        parts.append(rows.agg(F.transform(F.sort_array(F.collect_list(numbered)),
                                          lambda x: x["item"]).alias(name)))
    parts.append(results["fleet_health"])
    names = [n for part in parts for n in part.columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    single = stacked.agg(*[F.any_value(n, F.lit(True)).alias(n) for n in names])
    return single.select(F.to_json(F.struct(*names)).alias("snapshot"))


def snapshot_lines(results: dict[str, DataFrame], top_n: int | None = None) -> DataFrame:
    """The snapshot as lines of text, in order: one after the other they are one JSON object. No
    list passes one task: each entry is a line, written where the sort by range puts it."""
    def line(section: int, text: Column, rows: DataFrame, order: list[Column]) -> DataFrame:
        # Numbers come first in each order; names, and hours of two digits, settle ties.
        number = order[0].cast("double") if order else F.lit(0.0)
        ties = [F.lpad(c.cast("string"), 2, "0") if "hour" in rows.columns else c
                for c in order[1:]]
        return rows.select(F.lit(section).alias("section"), number.alias("number"),
                           F.array(*ties, F.lit("")).alias("ties"), text.alias("value"))

    single = results["fleet_health"]
    out = line(-1, F.lit("{"), single, [])
    lists = _items(results, top_n)
    for k, (name, rows, order, fields) in enumerate(lists):
        # Every entry but the first of its list begins with a comma.
        first = rows.agg(F.min(F.struct(*order))).scalar()
        entry = F.concat(F.when(F.struct(*order) == first, "").otherwise(","),
                         F.to_json(F.struct(*fields)))
        out = (out.unionAll(line(3 * k, F.lit(f'"{name}":['), single, []))
               .unionAll(line(3 * k + 1, entry, rows, order))
               .unionAll(line(3 * k + 2, F.lit("],"), single, [])))
    health = F.substr(F.to_json(F.struct(*single.columns)), F.lit(2))
    out = out.unionAll(line(3 * len(lists), health, single, []))
    return out.orderBy("section", "number", "ties").select("value")


def run_insights(spark: SparkSession, raw: str, out: str, top_n: int | None = None,
                 dedupe: bool = False, profiles: str | None = None) -> DataFrame:
    """Reads the history once, writes every result as Parquet and the snapshot as text: one JSON
    object over the lines of its files, in the order of their names. Returns the lines.

    With `profiles`, a folder where counts by date are kept between runs, only dates that changed
    are read. Copies of a reading may lie in several dates, so that excludes `dedupe`."""
    if profiles is not None and dedupe:
        raise ValueError("profiles kept by date count every copy of a reading")
    profiled = (materialize(profile(history.load_history(spark, raw, dedupe)), "profile")
                if profiles is None else refresh_profiles(spark, raw, profiles))
    results = insights(profiled)
    for name, result in results.items():
        history.write_result(result, f"{out}/{name}")
    snapshot_lines(results, top_n).write.mode("overwrite").text(f"{out}/latest_insights")
    return spark.read.text(f"{out}/latest_insights")
