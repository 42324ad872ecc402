"""Evaluating a fitted model while its predictions are written.

Accuracy and weighted F1 need only a few sums over the predictions. The sums are
observed on the rows that the write job sends to their file, so the input is read
and scored once and nothing is read back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillprint.operators.scoring import score_fitted
from quillprint.sources.predictions import write_predictions

TWO_CLASSES = (0, 1)
EVALUATION_SCHEMA = "model string, split string, accuracy double, f1_weighted double, n long, unlabelled long"


@dataclass(frozen=True)
class Evaluation:
    """Metrics of ``n`` labelled predictions; both are null where there is none."""

    accuracy: float | None
    f1_weighted: float | None
    n: int
    unlabelled: int


def _sums(labels: Sequence[int]) -> dict[str, Column]:
    """Per label the rows that truly have it, that are given it, and that are both."""
    true, given = F.col("y_true"), F.col("y_pred")
    labelled = true.isNotNull()
    out = {
        "n": F.count_if(labelled),
        "unlabelled": F.count_if(~labelled),
        "hits": F.count_if(true == given),
        "strange": F.count_if(labelled & ~(true.isin(*labels) & F.coalesce(given.isin(*labels), F.lit(False)))),
    }
    for i, label in enumerate(labels):
        out[f"true_{i}"] = F.count_if(true == label)
        out[f"given_{i}"] = F.count_if(labelled & (given == label))
        out[f"both_{i}"] = F.count_if((true == label) & (given == label))
    return out


def _evaluation(sums: dict[str, int], labels: Sequence[int]) -> Evaluation:
    if sums["strange"]:
        raise ValueError(f"{sums['strange']} rows have a label or a prediction that is not among {list(labels)}")
    n = sums["n"]
    if not n:
        return Evaluation(None, None, 0, sums["unlabelled"])
    weighted = 0.0
    for i in range(len(labels)):
        true, both = sums[f"true_{i}"], sums[f"given_{i}"] + sums[f"true_{i}"]
        weighted += true * (2 * sums[f"both_{i}"] / both if both else 0.0)
    return Evaluation(sums["hits"] / n, weighted / n, n, sums["unlabelled"])


def write_and_evaluate(
    preds: DataFrame, write: Callable[[DataFrame], None], labels: Sequence[int] = TWO_CLASSES
) -> Evaluation:
    """Metrics of ``preds (y_true, y_pred, ..)``, gathered by the job that ``write`` runs.

    ``write`` must compute every row of the table it is given, once. Rows without
    a ``y_true`` are written and counted, but enter no metric; a label outside
    ``labels``, or a labelled row without prediction, is an error, raised after
    the write. A retried task is counted once.
    """
    seen = Observation()
    sums = _sums(labels)
    write(preds.observe(seen, *[c.alias(n) for n, c in sums.items()]))
    return _evaluation(seen.get, labels)


def evaluate_model(
    features: DataFrame,
    model: Transformer,
    path: str,
    labels: Sequence[int] = TWO_CLASSES,
    threshold: float = 0.5,
    format: str = "parquet",
) -> Evaluation:
    """Score a feature table with any fitted two-class model, keep the predictions, return the metrics."""
    return write_and_evaluate(
        score_fitted(features, model, threshold), lambda rows: write_predictions(rows, path, format), labels
    )


def evaluate_models(
    splits: dict[str, DataFrame], models: dict[str, Transformer], folder: str, threshold: float = 0.5
) -> DataFrame:
    """``(model, split, accuracy, f1_weighted, n, unlabelled)`` of every model on every feature table.

    The predictions are kept as ``<folder>/<model>/<split>``.
    """
    rows = []
    for split, features in splits.items():
        for name, model in models.items():
            found = evaluate_model(features, model, f"{folder}/{name}/{split}", threshold=threshold)
            rows.append((name, split, found.accuracy, found.f1_weighted, found.n, found.unlabelled))
    spark = next(iter(splits.values())).sparkSession
    return spark.createDataFrame(rows, EVALUATION_SCHEMA)
