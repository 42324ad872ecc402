"""Train one model on one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillprint.operators.confusion import model_metrics
from quillprint.operators.linear import HISTORY_SCHEMA, train_linear
from quillprint.operators.structural import structural_features
from quillprint.operators.trees import feature_importance, train_trees
from quillprint.operators.vectors import DEFAULT_BUCKETS
from quillprint.plans import layout
from quillprint.sources.artifacts import cached_tables, save_model
from quillprint.sources.metrics import read_records, write_records, write_summary
from quillprint.sources.paths import open_or_none
from quillprint.sources.predictions import write_predictions
from quillprint.sources.tasks import load_task


def _finish(predictions: DataFrame, folder: str, metrics: list[str]) -> DataFrame:
    path = f"{folder}/{layout.PREDICTIONS}"
    write_predictions(predictions, path)
    # Metrics are taken from what was written, so the model scores once.
    spark = predictions.sparkSession
    written = spark.read.schema(predictions.schema).option("header", True).csv(path)
    result = model_metrics(written, [], metrics).drop("n")
    write_records(result, f"{folder}/{layout.METRICS}")
    return result


def train_linear_job(
    train_df: DataFrame, dev_df: DataFrame, folder: str, buckets: int = DEFAULT_BUCKETS, **options
) -> DataFrame:
    """Feature vectors are kept in ``folder`` and read back by later runs."""
    spark = train_df.sparkSession
    path = layout.text_features(folder, buckets)
    fit = train_linear(train_df, dev_df, buckets, features_path=path, **options)
    save_model(fit.model, f"{folder}/{layout.MODEL}")
    history = spark.createDataFrame(fit.history, HISTORY_SCHEMA)
    write_summary(history, f"{folder}/{layout.HISTORY}")
    return _finish(fit.predictions, folder, ["accuracy", "f1_macro"])


def train_trees_job(
    train_df: DataFrame, dev_df: DataFrame, folder: str, **options
) -> DataFrame:
    """Both feature tables are kept in ``folder`` and read back by later runs."""
    spark = train_df.sparkSession
    paths = [f"{folder}/{layout.TRAIN_FEATURES}", f"{folder}/{layout.DEV_FEATURES}"]
    tables = cached_tables(
        spark,
        {
            paths[0]: lambda: structural_features(train_df),
            paths[1]: lambda: structural_features(dev_df),
        },
    )
    fit = train_trees(tables[paths[0]], tables[paths[1]], **options)
    save_model(fit.model, f"{folder}/{layout.MODEL}")
    write_summary(fit.history, f"{folder}/{layout.HISTORY}")
    write_summary(feature_importance(fit.model), f"{folder}/importance.csv")
    return _finish(fit.predictions, folder, ["accuracy", "f1_macro"])


JOBS = {"linear": train_linear_job, "trees": train_trees_job}


def train(
    spark: SparkSession,
    model: str,
    task: str,
    data_root: str,
    experiments: str,
    skip_if_trained: bool = False,
    **options,
) -> DataFrame:
    """Fit ``model`` on ``task``; dev metrics, predictions and the model are kept.

    With ``skip_if_trained`` an experiment that finished before is not run
    again: the metrics it left, which are written last, are returned.
    """
    if model not in JOBS:
        raise ValueError(f"unknown model {model!r}; valid: {', '.join(JOBS)}")
    folder = layout.experiment(experiments, model, task)
    if skip_if_trained:
        left = open_or_none(lambda path: read_records(spark, path), f"{folder}/{layout.METRICS}")
        if left is not None:
            return left
    train_df, dev_df, _ = load_task(spark, data_root, task)
    return JOBS[model](train_df, dev_df, folder, **options)
