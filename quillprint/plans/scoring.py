"""Score and evaluate several models on one test table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators.confusion import model_metrics
from quillprint.operators.linear import score_linear
from quillprint.operators.scoring import threshold_predictions
from quillprint.operators.structural import structural_features
from quillprint.operators.trees import score_trees
from quillprint.plans import layout
from quillprint.sources.artifacts import load_model
from quillprint.sources.metrics import write_records
from quillprint.sources.predictions import read_predictions, write_predictions
from quillprint.sources.tasks import read_snippets

Scorer = Callable[[DataFrame, str], DataFrame]
SUMMARY_SCHEMA = "model string, accuracy double, f1_macro double, error string"


def _load(reader, folder: str):
    model = load_model(reader, f"{folder}/{layout.MODEL}")
    if model is None:
        raise FileNotFoundError(f"no model in {folder}")
    return model


def linear_scorer(test: DataFrame, folder: str) -> DataFrame:
    return score_linear(test, _load(LogisticRegressionModel, folder))


def trees_scorer(test: DataFrame, folder: str) -> DataFrame:
    return score_trees(structural_features(test), _load(PipelineModel, folder))


SCORERS: dict[str, Scorer] = {"linear": linear_scorer, "trees": trees_scorer}


def score_one(test: DataFrame, scorer: Scorer, folder: str) -> dict[str, float]:
    """Write test predictions of one model and evaluate what was written."""
    path = f"{folder}/{layout.TEST_PREDICTIONS}"
    scored = threshold_predictions(scorer(test, folder))
    write_predictions(scored.select("id", "y_true", "y_pred", "y_proba"), path)
    written = read_predictions(test.sparkSession, path)
    row = model_metrics(written, [], ["accuracy", "f1_macro"]).drop("n")
    write_records(row, f"{folder}/{layout.TEST_METRICS}")
    return row.first().asDict()


def score_all(
    spark: SparkSession,
    test_path: str,
    experiments: str,
    task: str = "task_a",
    models: Sequence[str] = layout.MODELS,
    extra: Mapping[str, Scorer] | None = None,
) -> DataFrame:
    """``(model, accuracy, f1_macro, error)``; a model that fails does not stop the rest.

    ``extra`` maps further model names to functions from the test table and the
    experiment folder to prediction rows.
    """
    scorers = {**SCORERS, **(extra or {})}
    test = read_snippets(spark, test_path)
    rows = []
    for model in models:
        folder = layout.experiment(experiments, model, task)
        try:
            if model not in scorers:
                raise ValueError(f"no scorer for model {model!r}")
            found = score_one(test, scorers[model], folder)
            rows.append((model, found["accuracy"], found["f1_macro"], None))
        except Exception as error:
            rows.append((model, None, None, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(rows, SUMMARY_SCHEMA).orderBy(F.col("model"))
