import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Observation
from pyspark.sql import functions as F

from thermoline import schemas
from thermoline.operators import cleaning, learning
from thermoline.plans import learning as jobs
from thermoline.sources import history, models


@pytest.fixture(scope="module")
def labelled(telemetry):
    return learning.label_next_breach(telemetry)


def test_last_reading_of_a_machine_has_no_label(telemetry, labelled):
    assert labelled.count() == telemetry.count() - 15


def test_label_is_strict(readings):
    df = readings([("a", "M", 90, "2024-01-01"), ("b", "M", 70, "2024-01-02"),
                   ("c", "M", "70.01", "2024-01-03"), ("n", None, 1, "2024-01-01")])
    rows = {r["reading_id"]: r["breakdown_soon"] for r in learning.label_next_breach(df).collect()}
    assert rows == {"a": 0, "b": 1}


def test_split_does_not_depend_on_partitioning(labelled):
    training, test = learning.split(labelled)
    again, _ = learning.split(labelled.repartition(13, "branch"))
    ids = lambda df: sorted(r[0] for r in df.select("reading_id").collect())
    assert ids(training) == ids(again)
    total = labelled.count()
    assert len(ids(training)) + test.count() == total
    assert 0.74 < len(ids(training)) / total < 0.86
    counts = learning.split_counts(labelled).first()
    assert tuple(counts) == (len(ids(training)), total - len(ids(training)))


def test_counted_fit_equals_fit_on_rows(labelled):
    training, _ = learning.split(labelled)
    counts = learning.labelled_counts(labelled)
    counted = learning.train(counts.filter("training")).stages[-1]
    rows = Pipeline(stages=[
        learning.index_branch(training),
        VectorAssembler(inputCols=["temperature", "branch_idx"], outputCol="features"),
        LogisticRegression(labelCol="breakdown_soon", maxIter=20)]).fit(
            learning.with_temperature(training)).stages[-1]
    assert counted.intercept == pytest.approx(rows.intercept, abs=1e-4)
    assert list(counted.coefficients) == pytest.approx(list(rows.coefficients), abs=1e-4)


def test_index_order_follows_frequency(spark):
    df = spark.createDataFrame([(b,) for b in "ccbbaad"], "branch string")
    assert list(learning.index_branch(df).labels) == ["a", "b", "c", "d"]
    counts = df.groupBy("branch").agg(F.count(F.lit(1)).cast("double").alias(learning.WEIGHT))
    counted = learning.index_branch(counts, weight=learning.WEIGHT)
    assert list(counted.labels) == ["a", "b", "c", "d"]
    fitted = StringIndexer(inputCol="branch", outputCol="i", handleInvalid="keep").fit(df)
    assert list(fitted.labels) == list(counted.labels)


def test_separable_readings_are_told_apart(readings):
    rows, time = [], 0
    for machine in range(30):
        for step in range(20):                       # hot and cold runs of five
            hot = (step // 5) % 2
            rows.append((f"{machine}-{step:02d}", f"WM_{machine:04d}", 85 if hot else 40,
                         f"2024-01-01 00:{step:02d}:00"))
    labelled = learning.label_next_breach(readings(rows))
    sure = labelled.filter((F.col("cycle_temperature") > 70).cast("int")
                           == F.col("breakdown_soon"))
    model = learning.train(learning.labelled_counts(sure).filter("training"))
    metrics = learning.evaluate_model(model, learning.labelled_counts(sure)
                                      .filter("NOT training")).first()
    assert metrics["auc"] == metrics["weighted_recall"] == metrics["failure_recall"] == 1.0


def test_training_and_scoring_jobs(spark, telemetry, tmp_path):
    raw, model, out = (str(tmp_path / n) for n in ("raw", "model", "out"))
    landed = cleaning.with_partition_date(telemetry).select(*schemas.READING.names, "dt")
    history.write_history(landed.unionByName(landed), raw)      # each reading twice
    metrics = jobs.run_training(spark, raw, model).first()
    assert metrics["train_rows"] + metrics["test_rows"] == telemetry.count() - 15
    assert 0.3 < metrics["auc"] < 0.7
    unseen = telemetry.limit(1).withColumn("branch", F.lit("Elsewhere"))
    scored = jobs.run_scoring(spark, [model + "-gone", model], telemetry.unionByName(unseen), out)
    assert scored.count() == telemetry.count() + 1
    assert scored.columns == ["machine_id", "branch", "prediction", "scored_at"]
    latest = jobs.run_scoring(spark, [model], telemetry, out, "latest")
    assert latest.count() == 15
    assert spark.read.json(f"{out}/latest_predictions").count() == 15
    with pytest.raises(ValueError):
        learning.score(models.load_model([model]), telemetry, "some")
    with pytest.raises(Exception):
        models.load_model([model + "-gone"])


def test_index_of_many_values(spark):
    df = spark.range(12_000).select(F.col("id").cast("string").alias("branch"))
    assert len(learning.index_branch(df).labels) == 12_000


def test_model_of_an_observed_session(readings, labelled):
    # An observation stays in the session for good; a model that holds the session can't be sent.
    seen = Observation()
    readings([("a", "M", 1, "2024-01-01")]).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 1}
    counts = learning.labelled_counts(labelled)
    model = learning.train(counts.filter("training"))
    metrics = learning.evaluate_model(model, counts.filter("NOT training")).first()
    assert 0.3 < metrics["auc"] < 0.7


def test_damaged_model_is_an_error(spark, tmp_path):
    from thermoline.sources import models
    (tmp_path / "bad" / "metadata").mkdir(parents=True)
    (tmp_path / "bad" / "metadata" / "part-00000").write_text("{")
    with pytest.raises(Exception):
        models.load_model([str(tmp_path / "bad"), str(tmp_path / "gone")])


def test_given_coefficients_match_the_model(telemetry, labelled):
    model = learning.train(learning.labelled_counts(labelled).filter("training"))
    fitted = model.stages[-1]
    known = {name: i for i, name in enumerate(model.stages[0].labels)}
    by_hand = learning.score_with_coefficients(telemetry, fitted.intercept,
                                               *list(fitted.coefficients), known)
    by_model = learning.score(model, telemetry).groupBy("prediction").count()
    hand = by_hand.groupBy(F.col("prediction").cast("int").alias("prediction")).count()
    assert sorted(map(tuple, hand.collect())) == sorted(map(tuple, by_model.collect()))
