"""Quick looks at data and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators import confusion
from quillprint.plans import layout
from quillprint.sources.predictions import read_predictions
from quillprint.sources.tasks import load_task, load_task_split


def inspect_data(
    spark: SparkSession, data_root: str, task: str = "task_a", rows: int = 5
) -> dict[str, DataFrame]:
    """Label counts per split, and the first test rows by key."""
    test = load_task(spark, data_root, task)[2]
    splits = load_task_split(spark, data_root, task)
    return {
        "labels": confusion.value_counts(splits, "split", "label"),
        "head": test.orderBy("id").select("label", "code").limit(rows),
    }


def inspect_predictions(
    spark: SparkSession,
    experiments: str,
    task: str = "task_a",
    models: Sequence[str] = layout.MODELS,
) -> dict[str, DataFrame] | None:
    """Value counts, class report and confusion matrix by model; absent ones are left out."""
    frames = []
    for model in models:
        path = f"{layout.experiment(experiments, model, task)}/{layout.TEST_PREDICTIONS}"
        try:
            preds = read_predictions(spark, path)
        except FileNotFoundError:
            continue
        frames.append(preds.select(F.lit(model).alias("model"), "y_true", "y_pred"))
    if not frames:
        return None
    preds = reduce(DataFrame.unionByName, frames)
    both = preds.unpivot("model", ["y_true", "y_pred"], "column", "value")
    return {
        "counts": confusion.value_counts(both, "model", "column", "value"),
        "report": confusion.classification_report(preds, ["model"]),
        "confusion": confusion.confusion_matrix(preds, ["model"]),
    }
