"""Metric records, curves and comparison tables over written predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators import confusion
from quillprint.operators.curves import areas_of_sweep, pr_of_sweep, roc_of_sweep, sweep
from quillprint.plans import layout
from quillprint.sources.metrics import write_nested, write_records, write_summary
from quillprint.sources.predictions import load_predictions, read_predictions

RECORD = ["accuracy", "f1_macro", "precision_macro", "recall_macro"]


@dataclass
class Report:
    summary: DataFrame
    classes: DataFrame
    cells: DataFrame
    roc: DataFrame
    pr: DataFrame
    skipped: dict[str, str]


def evaluate_predictions(preds: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Accuracy and macro scores; with ``out_dir`` also the confusion matrix as files."""
    record = confusion.model_metrics(preds, [], RECORD).drop("n")
    if out_dir:
        write_records(record, f"{out_dir}/{layout.METRICS}")
        write_summary(confusion.confusion_heatmap(preds), f"{out_dir}/confusion_matrix.csv")
    return record


def evaluate_csv(spark: SparkSession, pred_csv: str, out_dir: str | None = None) -> DataFrame:
    return evaluate_predictions(read_predictions(spark, pred_csv), out_dir)


def report(
    spark: SparkSession,
    experiments: str,
    out_dir: str | None = None,
    task: str = "task_a",
    models: Sequence[str] = layout.MODELS,
) -> Report | None:
    """Tables behind every chart, for all models with predictions; None if there are none.

    The predictions of all models form one table with a ``model`` column, so
    each report is one aggregation however many models there are.
    """
    found, skipped = [], {}
    for model in models:
        folder = layout.experiment(experiments, model, task)
        try:
            preds = load_predictions(spark, folder)
        except (FileNotFoundError, ValueError) as error:
            skipped[model] = str(error)
            continue
        rows = preds.select(F.lit(model).alias("model"), "y_true", "y_pred", "y_proba")
        found.append((model, folder, rows))
    if not found:
        return None
    preds = reduce(DataFrame.unionByName, [rows for _, _, rows in found])
    keys = ["model"]
    basic = confusion.model_metrics(preds, keys, ["accuracy", "f1_macro"]).drop("n")
    # One sweep serves both curves and their areas.
    swept = sweep(preds, keys)
    summary = basic.join(areas_of_sweep(swept, keys), keys, "left")
    result = Report(
        summary=summary,
        classes=confusion.classification_report(preds, keys),
        cells=confusion.confusion_heatmap(preds, keys),
        roc=roc_of_sweep(swept, keys),
        pr=pr_of_sweep(swept, keys),
        skipped=skipped,
    )
    if out_dir:
        for model, folder, _ in found:
            own = F.col("model") == model
            write_records(basic.where(own).drop("model"), f"{folder}/{layout.TEST_METRICS}")
            write_summary(summary.where(own).drop("model"), f"{out_dir}/{model}_{task}/summary_metrics.csv")
        write_summary(summary, f"{out_dir}/summary_{task}.csv")
        write_summary(result.classes, f"{out_dir}/classes_{task}.csv")
        write_summary(result.cells, f"{out_dir}/confusion_{task}.csv")
        write_summary(confusion.comparison_table(summary), f"{out_dir}/comparison_{task}.csv")
        result.roc.write.mode("overwrite").parquet(f"{out_dir}/roc_{task}.parquet")
        result.pr.write.mode("overwrite").parquet(f"{out_dir}/pr_{task}.parquet")
    return result


def compare_models(
    predictions: Mapping[str, Mapping[str, DataFrame]], path: str | None = None
) -> DataFrame:
    """Accuracy and weighted F1 per split and model of ``{split: {model: predictions}}``."""
    frames = [
        preds.select(F.lit(model).alias("model"), F.lit(split).alias("split"), "y_true", "y_pred")
        for split, models in predictions.items()
        for model, preds in models.items()
    ]
    table = confusion.model_metrics(
        reduce(DataFrame.unionByName, frames), ["model", "split"], ["accuracy", "f1_weighted"]
    ).drop("n")
    if path:
        write_nested(table, path)
    return table
