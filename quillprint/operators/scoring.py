"""Turning fitted or pluggable models into prediction rows.

A prediction row is ``(id, y_true, y_pred, y_proba)``; rows carry their key, so
nothing depends on row order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.functions.scores import (
    argmax_label,
    label_text_to_id,
    softmax_probability,
    threshold_label,
)


def prediction_rows(
    df: DataFrame, y_pred: Column, y_proba: Column | None = None, key: str = "id", label: str = "label"
) -> DataFrame:
    """Prediction rows of a table that still has its label, if any."""
    truth = F.col(label).cast("int") if label in df.columns else F.lit(None).cast("int")
    probability = y_proba if y_proba is not None else F.lit(None).cast("double")
    return df.select(
        key,
        truth.alias("y_true"),
        y_pred.cast("int").alias("y_pred"),
        probability.cast("double").alias("y_proba"),
    )


def portable(model: Transformer) -> Transformer:
    """The model without its training summary, which would drag the session into every task."""
    if isinstance(model, PipelineModel):
        return PipelineModel([portable(stage) for stage in model.stages])
    if not getattr(model, "hasSummary", False):
        return model
    bare = model.copy()
    bare._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return bare


def score_fitted(
    features: DataFrame, model: Transformer, threshold: float = 0.5, key: str = "id"
) -> DataFrame:
    """Prediction rows of a fitted two-class classifier over a feature table."""
    if getattr(model, "numClasses", 2) > 2:
        raise ValueError(f"the threshold decides between two classes, the model has {model.numClasses}")
    scored = portable(model).transform(features)
    scored = scored.withColumn("_p", vector_to_array("probability")[1])
    return prediction_rows(scored, threshold_label(F.col("_p"), threshold), F.col("_p"), key)


def score_batches(
    df: DataFrame,
    make_predict: Callable,
    inputs: Sequence[str],
    batch_size: int = 64,
    input_shapes: list[list[int]] | None = None,
    key: str = "id",
    label: str = "label",
) -> DataFrame:
    """Prediction rows of a model that maps batches to logits.

    ``make_predict`` loads the model once per Python worker and returns a
    function from NumPy batches of ``inputs`` to a logit matrix.
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    scored = df.withColumn("_logits", predict(*[F.col(c) for c in inputs]))
    logits = F.col("_logits")
    return prediction_rows(scored, argmax_label(logits), softmax_probability(logits), key, label)


def threshold_predictions(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Decide by probability where there is one; otherwise the prediction stands."""
    by_probability = threshold_label(F.col("y_proba"), threshold)
    return preds.withColumn("y_pred", F.coalesce(by_probability, F.col("y_pred")))


def score_label_texts(
    df: DataFrame,
    make_predict: Callable,
    inputs: Sequence[str],
    label_ids: dict[str, int],
    batch_size: int = 32,
    input_shapes: list[list[int]] | None = None,
    key: str = "id",
    label: str = "label",
) -> DataFrame:
    """Prediction rows of a model that returns one label text per row.

    A batch result that is not a sequence of that length fails the job.
    """
    predict = predict_batch_udf(
        make_predict,
        return_type=T.StringType(),
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    scored = df.withColumn("_text", predict(*[F.col(c) for c in inputs]))
    return prediction_rows(scored, label_text_to_id(F.col("_text"), label_ids), None, key, label)


def pair_labels(preds: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Predictions with the true label of the same key; null where there is none."""
    truth = labels.select(key, F.col(label).cast("int").alias("y_true"))
    return preds.drop("y_true").join(truth, key, "left")


def pair_scores(preds: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """Predictions with the probability of the same key in a score table.

    Where the table has none, a ``y_proba`` or ``probs`` column steps in.
    """
    own = [F.col(c).cast("double") for c in ("y_proba", "probs") if c in preds.columns]
    side = scores.select(key, F.col("p").cast("double").alias("_side"))
    joined = preds.join(side, key, "left")
    return joined.withColumn("y_proba", F.coalesce("_side", *own)).drop("_side", "probs")
