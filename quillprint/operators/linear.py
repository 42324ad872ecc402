"""The linear text classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.operators.confusion import model_metrics
from quillprint.operators.lengths import LENGTH_COLUMNS
from quillprint.operators.scoring import score_fitted
from quillprint.operators.vectors import DEFAULT_BUCKETS, text_features
from quillprint.session import fresh_path
from quillprint.sources.artifacts import cached_table

HISTORY_SCHEMA = "epoch int, accuracy double, f1_macro double"


@dataclass
class LinearFit:
    model: LogisticRegressionModel
    history: list[tuple[int, float, float]]
    best_epoch: int
    predictions: DataFrame


def train_linear(
    train: DataFrame,
    dev: DataFrame,
    buckets: int = DEFAULT_BUCKETS,
    epochs: int = 5,
    alpha: float = 1e-5,
    patience: int = 3,
    passes_per_epoch: int = 4,
    standardize: bool = True,
    aggregation_depth: int = 2,
    code_col: str = "code",
    features_path: str | None = None,
) -> LinearFit:
    """Fit with growing iteration budgets and keep the one with the best dev macro-F1.

    Each candidate is a full-batch fit of ``epoch * passes_per_epoch`` passes,
    so row order and batch size play no part. Standardising scales the four
    length columns, which are orders of magnitude above the unit text vector.
    A strictly better F1 replaces the kept model; after ``patience`` candidates
    without one, training stops. ``aggregation_depth`` above 2 spares the
    driver when thousands of tasks each return a dense gradient.

    Feature vectors are written once, to ``features_path`` or the shared folder,
    and every pass reads them there: a lost executor costs no text processing.
    """
    spark = train.sparkSession

    def features() -> DataFrame:
        # Keys are only needed to pair dev predictions.
        parts = [
            df.select("id", code_col, "label", F.lit(part).alias("part"))
            for df, part in ((train, "train"), (dev, "dev"))
        ]
        made = text_features(
            parts[0].unionByName(parts[1]), buckets, code_col, ("id", "label", "part")
        )
        return made.withColumn("label", F.col("label").cast("double"))

    table = cached_table(
        spark, features_path or fresh_path(spark, "text-features"), features, ("part",)
    )
    train_set = table.where("part = 'train'").select("label", "features")
    train_set = train_set.persist(StorageLevel.MEMORY_AND_DISK)
    dev_set = table.where("part = 'dev'").select("id", "label", "features")
    odd = table.where("label IS NULL OR label NOT IN (0, 1)").select("label").first()
    if odd:
        raise ValueError(f"labels must be 0 or 1, not {odd['label']}")
    best, best_f1, best_at, history, idle = None, -1.0, 0, [], 0
    try:
        for epoch in range(1, epochs + 1):
            model = LogisticRegression(
                maxIter=epoch * passes_per_epoch,
                regParam=alpha,
                elasticNetParam=0.0,
                standardization=standardize,
                aggregationDepth=aggregation_depth,
                tol=0.0,
            ).fit(train_set)
            row = model_metrics(score_fitted(dev_set, model), []).first()
            accuracy, f1 = row["accuracy"] or 0.0, row["f1_macro"] or 0.0
            history.append((epoch, accuracy, f1))
            if best is None or f1 > best_f1:
                best, best_f1, best_at, idle = model, f1, epoch, 0
            else:
                idle += 1
            if idle >= patience:
                break
    finally:
        train_set.unpersist()
    return LinearFit(best, history, best_at, score_fitted(dev_set, best))


def score_linear(
    df: DataFrame, model: LogisticRegressionModel, threshold: float = 0.5, code_col: str = "code"
) -> DataFrame:
    """Prediction rows; the bucket count follows from the model's width."""
    buckets = model.numFeatures - len(LENGTH_COLUMNS)
    return score_fitted(text_features(df, buckets, code_col), model, threshold)
