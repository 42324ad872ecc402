"""Where a run keeps its files: ``<experiments>/<model>_<task>/``."""

from __future__ import annotations

MODELS = ("linear", "trees")

PREDICTIONS = "predictions.csv"
TEST_PREDICTIONS = "predictions_test.csv"
METRICS = "metrics.json"
TEST_METRICS = "metrics_test.json"
MODEL = "model"
HISTORY = "history.csv"
TRAIN_FEATURES = "features_train.parquet"
DEV_FEATURES = "features_dev.parquet"


def experiment(root: str, model: str, task: str) -> str:
    return f"{root.rstrip('/')}/{model}_{task}"


def text_features(folder: str, buckets: int) -> str:
    """Vectors of another width are another table."""
    return f"{folder}/features_text_{buckets}.parquet"
