"""Labelling, training, evaluation and scoring of the next-reading failure model.

Features are a two-decimal temperature and a branch, so the labelled history has few distinct
(temperature, branch, label) rows. They are counted first, and the model is fitted and
evaluated on the counts as weights: the same objective as on the single readings, while
every MLlib pass runs over a table whose size does not grow with the history.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import (BinaryClassificationEvaluator,
                                   MulticlassClassificationEvaluator)
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from thermoline import constants as C
from thermoline.functions import values
from thermoline.operators import sequence
from thermoline.session import materialize, scratch_path
from thermoline.sources import models

WEIGHT = "weight"


def label_next_breach(df: DataFrame) -> DataFrame:
    """breakdown_soon = does the machine's next reading exceed 70 °C? The last reading of a
    machine has no label and is left out."""
    following = sequence.with_next(df.filter(F.col("machine_id").isNotNull()))
    return (following.filter(F.col("next_temp").isNotNull())
            .withColumn("breakdown_soon",
                        (F.col("next_temp") > F.lit(C.ALERT_TEMPERATURE)).cast("int")))


def split_column(key: str = "reading_id", train_percent: int = C.TRAIN_SHARE,
                 seed: int = C.SPLIT_SEED) -> Column:
    """True for the training share. It hangs on the key alone, so neither partitioning nor a
    retried task moves a row to the other side."""
    return values.hash_bucket(F.col(key), 100, seed) < train_percent


def split(df: DataFrame, key: str = "reading_id", train_percent: int = C.TRAIN_SHARE,
          seed: int = C.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    training = split_column(key, train_percent, seed)
    return df.filter(training), df.filter(~training)


def split_counts(df: DataFrame, key: str = "reading_id",
                 train_percent: int = C.TRAIN_SHARE, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Training and test samples, in one pass."""
    training = split_column(key, train_percent, seed)
    return df.agg(F.count_if(training).alias("train_rows"),
                  F.count_if(~training).alias("test_rows"))


def labelled_counts(labelled: DataFrame, key: str = "reading_id",
                    train_percent: int = C.TRAIN_SHARE, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Labelled readings counted by (training, temperature, branch, label)."""
    return (labelled.withColumn("training", split_column(key, train_percent, seed))
            .groupBy("training", "cycle_temperature", "branch", "breakdown_soon")
            .agg(F.count(F.lit(1)).cast("double").alias(WEIGHT)))


def index_branch(df: DataFrame, column: str = "branch", out: str = "branch_idx",
                 weight: str | None = None) -> StringIndexerModel:
    """Index by falling frequency, ties by name; an unseen value gets the index after the last.

    As with MLlib's own indexer the labels are part of the model and pass the driver: one entry
    per distinct value, however many rows there are.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = (df.filter(F.col(column).isNotNull()).groupBy(column).agg(size.alias("n"))
            .orderBy(F.desc("n"), column).select(F.col(column).cast("string")).collect())
    return StringIndexerModel.from_labels([r[0] for r in rows], inputCol=column,
                                          outputCol=out, handleInvalid="keep")


def index_values(df: DataFrame, column: str, out: str,
                 weight: str | None = None) -> DataFrame:
    """(column, out): `index_branch`'s index of every distinct value, as a written table, for
    columns with more values than a driver should hold.

    The counts are put in order by ranges of (count, value); a value's index is its place within
    its range after all values of the ranges before. Only the sizes of the ranges are added up in
    one place.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(size.alias("_n"))
    text = F.col(column).cast("string")
    ranked = counts.withColumn("_text", text).repartitionByRange(F.desc("_n"), "_text")
    # The number holds the range in its upper bits and the place within it in the lower 33.
    placed = materialize(ranked.sortWithinPartitions(F.desc("_n"), "_text").select(
        column, F.monotonically_increasing_id().alias("_place")), "ranked_values")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_at"))
    return placed.withColumn("_part", part).join(offsets, "_part").select(
        column, (F.col("_at") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .cast("double").alias(out))


def with_index(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    """`df` with the index of `index_values`; a value that it lacks, or null, gets the index after
    the last."""
    return df.join(index, column, "left").withColumn(out, F.coalesce(
        out, index.agg(F.count("*").cast("double")).scalar()))


def with_temperature(df: DataFrame) -> DataFrame:
    return df.withColumn("temperature", F.col("cycle_temperature").cast("double"))


def feature_assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=["temperature", "branch_idx"], outputCol="features")


def train(counts: DataFrame, max_iter: int = C.LEARNING_ITERATIONS) -> PipelineModel:
    """Fits index, features and logistic regression on the counts of training readings.

    The model is read back from the shared folder: as fitted, it has its training summary and
    with it the session, which cannot go to the tasks once the session has been observed.
    """
    data = with_temperature(counts)
    stages = [index_branch(counts, weight=WEIGHT), feature_assembler(),
              LogisticRegression(labelCol="breakdown_soon", featuresCol="features",
                                 weightCol=WEIGHT, maxIter=max_iter)]
    path = scratch_path(counts.sparkSession, "fitted")
    models.save_model(Pipeline(stages=stages).fit(data), path)
    return models.load_model([path])


def evaluate(scored: DataFrame, raw: str = "rawPrediction",
             weight: str | None = None) -> DataFrame:
    """One row of metrics: area under ROC, weighted precision, weighted recall, and the
    recall of the failures alone. `raw` is MLlib's raw prediction or a plain margin.

    The evaluators make several passes. Plain margins are therefore counted by (margin,
    prediction, label) first; rows with MLlib's vectors should come counted already.
    """
    size = F.lit(1.0) if weight is None else F.col(weight)
    rows = scored.select("breakdown_soon", raw, size.alias(WEIGHT),
                         F.col("prediction").cast("double").alias("prediction"))
    if isinstance(scored.schema[raw].dataType, DoubleType):
        counted = rows.groupBy("breakdown_soon", raw, "prediction").agg(
            F.sum(WEIGHT).alias(WEIGHT))
        rows = materialize(counted, "margins").withColumn(
            raw, array_to_vector(F.array(-F.col(raw), F.col(raw))))
    common = {"labelCol": "breakdown_soon", "weightCol": WEIGHT}

    def by_label(name: str, **extra: float) -> float:
        return MulticlassClassificationEvaluator(metricName=name, **common,
                                                 **extra).evaluate(rows)

    area = BinaryClassificationEvaluator(rawPredictionCol=raw, numBins=0, **common)
    metrics = {
        "auc": area.evaluate(rows),
        "weighted_precision": by_label("weightedPrecision"),
        "weighted_recall": by_label("weightedRecall"),
        "failure_recall": by_label("recallByLabel", metricLabel=1.0),
    }
    return scored.sparkSession.createDataFrame(
        [tuple(metrics.values())], ", ".join(f"{name} double" for name in metrics))


def evaluate_model(model: PipelineModel, counts: DataFrame) -> DataFrame:
    return evaluate(model.transform(with_temperature(counts)), weight=WEIGHT)


def score(model: PipelineModel, readings: DataFrame, scope: str = "all",
          scored_at: Column | None = None) -> DataFrame:
    """Predictions of every reading, or (`scope="latest"`) of each machine's last one."""
    if scope not in ("all", "latest"):
        raise ValueError(f"unknown scope: {scope}")
    rows = readings if scope == "all" else sequence.latest_per_key(readings)
    when = F.current_timestamp() if scored_at is None else scored_at
    return model.transform(with_temperature(rows)).select(
        "machine_id", "branch", F.col("prediction").cast("int").alias("prediction"),
        when.alias("scored_at"))


def score_with_coefficients(readings: DataFrame, intercept: float, temperature: float,
                            branch: float, indexes: Mapping[str, int],
                            threshold: float = 0.5) -> DataFrame:
    """Scores by given coefficients as plain columns: `margin`, `probability`, `prediction`.
    A branch that has no index takes the one after the last."""
    index = F.lit(float(len(indexes)))
    if indexes:
        pairs = [F.lit(x) for name, i in indexes.items() for x in (name, float(i))]
        index = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("branch")), index)
    margin = (F.lit(intercept) + F.lit(temperature) * F.col("cycle_temperature").cast("double")
              + F.lit(branch) * index)
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    return (readings.withColumn("margin", margin).withColumn("probability", probability)
            .withColumn("prediction", (F.col("probability") > threshold).cast("double")))
