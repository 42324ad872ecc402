"""Prediction tables: CSV and Parquet folders, with optional score side files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators.scoring import pair_scores
from quillprint.sources.paths import open_or_none

STORE_KEYS = ("model", "split")
STORE_SCHEMA = "id string, y_true int, y_pred int, y_proba double, model string, split string"

# Names tried in turn, predictions and then scores.
PREDICTION_FILES = ("predictions_test.csv", "predictions.csv")
SCORE_FILES = (
    "preds_proba.parquet",
    "pred_probs.parquet",
    "probs.parquet",
    "preds_proba.csv",
    "pred_probs.csv",
)


def _csv(spark: SparkSession) -> Callable[[str], DataFrame]:
    # Every column as text; the columns we use are cast by name.
    return lambda path: spark.read.option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One prediction CSV, with labels as ints and scores as doubles."""
    found = open_or_none(_csv(spark), path)
    if found is None:
        raise FileNotFoundError(f"nothing to read at {path}")
    return _typed(found, path)


def _typed(df: DataFrame, path: str) -> DataFrame:
    absent = {"y_true", "y_pred"} - set(df.columns)
    if absent:
        raise ValueError(f"{path} has no column {', '.join(sorted(absent))}")
    # Positions written as "1.0" are labels too.
    casts = {c: F.col(c).cast("double").cast("int") for c in ("y_true", "y_pred")}
    casts |= {c: F.col(c).cast("double") for c in ("y_proba", "probs") if c in df.columns}
    if "id" in df.columns:
        casts["id"] = F.coalesce(F.col("id").try_cast("bigint").cast("string"), F.col("id"))
    return df.withColumns(casts)


def _scores(spark: SparkSession, folder: str) -> DataFrame | None:
    """``(id, p)`` of the first side file that can be read; others are passed over."""
    for name in SCORE_FILES:
        read = _csv(spark) if name.endswith(".csv") else spark.read.parquet
        try:
            found = open_or_none(read, f"{folder}/{name}")
        except (AnalysisException, Py4JJavaError):
            continue
        if found is None or "id" not in found.columns or len(found.columns) < 2:
            continue
        value = next(c for c in found.columns if c != "id")
        return found.select(
            F.col("id").cast("string").alias("id"), F.col(value).try_cast("double").alias("p")
        )
    return None


def load_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of an experiment folder, ``y_proba`` null where there is no score.

    Scores come from a side file matched by ``id``, else from a ``y_proba`` or
    ``probs`` column.
    """
    for name in PREDICTION_FILES:
        found = open_or_none(_csv(spark), f"{folder}/{name}")
        if found is not None:
            break
    else:
        raise FileNotFoundError(f"no predictions in {folder}")
    preds = _typed(found, f"{folder}/{name}")
    side = _scores(spark, folder) if "id" in preds.columns else None
    if side is not None:
        preds = pair_scores(preds, side)
    else:
        own = [F.col(c) for c in ("y_proba", "probs") if c in preds.columns]
        preds = preds.withColumn("y_proba", F.coalesce(*own, F.lit(None).cast("double")))
    key = ["id"] if "id" in preds.columns else []
    return preds.select(*key, "y_true", "y_pred", "y_proba")


def write_predictions(preds: DataFrame, path: str, format: str = "csv") -> None:
    """A prediction folder, as CSV with a header or as Parquet."""
    writer = preds.write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_store(preds: DataFrame, root: str) -> None:
    """Add predictions ``(id, y_true, y_pred, y_proba, model, split)`` to a store, one folder a model and split.

    Folders of models and splits that occur in ``preds`` are replaced as a
    whole, all others stay as they are, so a rerun of one model touches nothing
    else. A null model or split is a folder like others; an empty string counts
    as null. Further columns are left out.
    """
    names = [c.split()[0] for c in STORE_SCHEMA.split(", ")]
    casts = dict(c.split() for c in STORE_SCHEMA.split(", "))
    rows = preds.select(*[F.col(n).cast(casts[n]).alias(n) for n in names])
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*STORE_KEYS).parquet(root)


def read_store(
    spark: SparkSession, root: str, models: Sequence[str] | None = None, splits: Sequence[str] | None = None
) -> DataFrame:
    """Predictions of the wanted models and splits, all of them by default; other folders are not opened."""
    found = open_or_none(spark.read.schema(STORE_SCHEMA).parquet, root)
    if found is None:
        raise FileNotFoundError(f"nothing to read at {root}")
    for column, wanted in zip(STORE_KEYS, (models, splits), strict=True):
        if wanted is not None:
            found = found.where(F.col(column).isin(*wanted))
    return found
