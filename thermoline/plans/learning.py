"""Batch training and scoring jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermoline.operators import learning
from thermoline.session import materialize
from thermoline.sources import history, models


def train_on(readings: DataFrame) -> tuple[PipelineModel, DataFrame]:
    """Fits and evaluates on readings: (model, one row of metrics and sample counts)."""
    labelled = learning.label_next_breach(
        readings.select("reading_id", "machine_id", "branch", "cycle_temperature",
                        "txn_timestamp"))
    counts = materialize(learning.labelled_counts(labelled), "labelled-counts")
    model = learning.train(counts.filter("training"))
    metrics = learning.evaluate_model(model, counts.filter("NOT training"))
    rows = counts.agg(
        F.sum(F.when(F.col("training"), F.col(learning.WEIGHT))).cast("bigint")
        .alias("train_rows"),
        F.sum(F.when(~F.col("training"), F.col(learning.WEIGHT))).cast("bigint")
        .alias("test_rows")).first()
    return model, metrics.select(F.lit(rows["train_rows"]).alias("train_rows"),
                                 F.lit(rows["test_rows"]).alias("test_rows"), "*")


def run_training(spark: SparkSession, raw: str, model_path: str) -> DataFrame:
    """History → fitted model at `model_path`; returns the metrics. Repeated deliveries count
    once: two copies of a reading would each be the other's next reading."""
    model, metrics = train_on(history.load_history(spark, raw, dedupe=True))
    models.save_model(model, model_path)
    return metrics


def run_scoring(spark: SparkSession, model_paths: Sequence[str], readings: DataFrame, out: str,
                scope: str = "all", scored_at: Column | None = None) -> DataFrame:
    """Scores readings with a saved model and replaces the predictions, as Parquet for the
    engine and JSON Lines for other readers. Tasks write both."""
    scored = learning.score(models.load_model(model_paths), readings, scope, scored_at)
    history.write_result(scored, f"{out}/scored")
    written = spark.read.parquet(f"{out}/scored")
    history.write_result_json(written, f"{out}/latest_predictions")
    return written
