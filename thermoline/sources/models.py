"""Fitted models on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel

# How Spark and the file systems below it say that a path is not there.
MISSING = ("PATH_NOT_FOUND", "Path does not exist", "Input path does not exist")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(paths: Sequence[str]) -> PipelineModel:
    """The model at the first path that exists. Only a missing path moves on to the next; a
    damaged or unreachable model is an error."""
    missing: Exception | None = None
    for path in paths:
        try:
            return PipelineModel.load(path)
        except (PySparkException, Py4JJavaError) as error:
            if not any(mark in str(error) for mark in MISSING):
                raise
            missing = error
    raise missing if missing is not None else ValueError("no path given")
