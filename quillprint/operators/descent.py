"""The linear text classifier, trained in one run of mini-batch descent.

Every epoch reads the rows once, in an order of its own, and goes on from the
weights of the epoch before. A step sends the weights to the tasks, sums the
batch's gradient per partition and then over groups of partitions, and moves the
weights by rates that adapt to each feature. The state is written after every
epoch; a run that was cut short goes on from the last one that is complete.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators.confusion import model_metrics
from quillprint.operators.epochs import epoch_batches
from quillprint.operators.lengths import LENGTH_COLUMNS
from quillprint.operators.scoring import score_fitted
from quillprint.operators.selection import latest_checkpoint
from quillprint.operators.vectors import DEFAULT_BUCKETS, text_features
from quillprint.session import fresh_path
from quillprint.sources.artifacts import cached_table, child_folders
from quillprint.sources.paths import open_or_none

#: Partitions whose gradients are summed by one task before the rest.
TREE_WIDTH = 32
EPSILON = 1e-8
STATE_SCHEMA = (
    "epoch int, accuracy double, f1_macro double, options string, weights array<double>, squares array<double>"
)


@dataclass
class DescentModel:
    """Weights of the features as they are, and the intercept."""

    coefficients: np.ndarray
    intercept: float
    numClasses: int = 2

    @property
    def numFeatures(self) -> int:
        return len(self.coefficients)

    def transform(self, features: DataFrame) -> DataFrame:
        """``features`` with ``probability``, a vector of two classes."""
        p = 1 / (1 + F.exp(-F.col("_margin")))
        scored = with_margin(features, self.coefficients, self.intercept)
        return scored.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_margin")

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        spark = spark or SparkSession.getActiveSession()
        rows = [(self.coefficients.tolist(), float(self.intercept))]
        made = spark.createDataFrame(rows, "coefficients array<double>, intercept double")
        made.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> DescentModel:
        row = SparkSession.getActiveSession().read.parquet(path).first()
        return cls(np.array(row["coefficients"]), row["intercept"])


@dataclass
class DescentFit:
    model: DescentModel
    history: list[tuple[int, float, float]]
    best_epoch: int
    predictions: DataFrame


@dataclass
class _State:
    """Weights and squared gradients; the last element is the intercept's."""

    weights: np.ndarray
    squares: np.ndarray


def with_margin(features: DataFrame, coefficients: np.ndarray, intercept: float) -> DataFrame:
    """``features`` with ``_margin``, the weighted sum of the vector plus the intercept, over its filled places only."""
    weigh = ElementwiseProduct(scalingVec=DenseVector(coefficients), inputCol="features", outputCol="_weighed")
    total = F.aggregate(F.unwrap_udt("_weighed")["values"], F.lit(float(intercept)), lambda a, v: a + v)
    return weigh.transform(features).withColumn("_margin", total).drop("_weighed")


def gradient(batch: DataFrame, weights: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, int]:
    """The mean gradient of the logistic loss over ``batch (label, features)``, intercept last, and the rows.

    Features count as multiplied by ``scale``. Summed per partition, then by
    groups of ``TREE_WIDTH`` partitions, then once more: the task that ends it
    sees one vector a group, however many partitions there are.
    """
    wrong = 1 / (1 + F.exp(-F.col("_margin"))) - F.col("label")
    rows = with_margin(batch, weights[:-1] * scale, weights[-1]).select("features", wrong.alias("wrong"))
    # Weights of a sum must be positive: two is added to all, and twice the plain sum is taken off.
    rows = rows.select(
        "features",
        "wrong",
        (F.col("wrong") + 2).alias("weight"),
        F.floor(F.spark_partition_id() / TREE_WIDTH).alias("group"),
    )
    partial = rows.groupBy("group").agg(
        Summarizer.sum(F.col("features"), F.col("weight")).alias("raised"),
        Summarizer.sum(F.col("features")).alias("plain"),
        F.sum("wrong").alias("wrong"),
        F.count(F.lit(1)).alias("n"),
    )
    # Grouped, since a sum of vectors over no rows at all is an error.
    found = partial.groupBy(F.lit("all")).agg(
        Summarizer.sum(F.col("raised")).alias("raised"),
        Summarizer.sum(F.col("plain")).alias("plain"),
        F.sum("wrong").alias("wrong"),
        F.sum("n").alias("n"),
    ).first()
    if found is None:
        return np.zeros_like(weights), 0
    sums = (found["raised"].toArray() - 2 * found["plain"].toArray()) * scale
    return np.append(sums, found["wrong"]) / found["n"], found["n"]


def _scales(train: DataFrame, width: int) -> np.ndarray:
    """Ones for the unit text vector, and what brings the length columns to its order of magnitude."""
    spread = train.groupBy(F.lit("all")).agg(Summarizer.std(F.col("features")).alias("s")).first()
    tail = spread["s"].toArray()[-len(LENGTH_COLUMNS) :] if spread else np.ones(len(LENGTH_COLUMNS))
    scale = np.ones(width)
    scale[-len(LENGTH_COLUMNS) :] = 1 / np.where(tail > 0, tail, 1.0) / 10
    return scale


def _saved(spark: SparkSession, state_path: str) -> DataFrame | None:
    """The states below a folder, complete ones only."""
    folders = child_folders(spark, state_path, "checkpoint-")
    done = folders.where(F.col("path").rlike("checkpoint-[0-9]+$")).collect()
    # A state that was being written when the run ended has no commit marker.
    complete = [
        r["path"] for r in done
        if open_or_none(spark.read.format("binaryFile").load, f"{r['path']}/_SUCCESS") is not None
    ]
    return spark.read.schema(STATE_SCHEMA).parquet(*complete) if complete else None


def train_descent(
    train: DataFrame,
    dev: DataFrame,
    buckets: int = DEFAULT_BUCKETS,
    epochs: int = 5,
    alpha: float = 1e-5,
    patience: int = 3,
    steps: int = 4,
    rate: float = 0.5,
    seed: int = 42,
    code_col: str = "code",
    features_path: str | None = None,
    state_path: str | None = None,
) -> DescentFit:
    """Fit on ``train (id, code, label)`` and keep the epoch with the best dev macro-F1.

    An epoch makes ``steps`` steps, each over its share of the rows in that
    epoch's order, so five epochs read the features five times. A strictly better
    F1 replaces the kept model; after ``patience`` epochs without one, training
    stops. ``alpha`` is the weight of the squared penalty.

    Every epoch's state is kept in ``state_path`` as ``checkpoint-<epoch>``. A run
    that finds states there goes on after the latest; they must come from the
    same options. Rows are found again by ``id``: null or repeated ids are rows
    like others. Labels must be 0 or 1; without training rows every weight is
    zero.
    """
    spark = train.sparkSession
    state_path = state_path or fresh_path(spark, "descent")

    def features() -> DataFrame:
        parts = [
            df.select("id", code_col, "label", F.lit(part).alias("part"))
            for df, part in ((train, "train"), (dev, "dev"))
        ]
        made = text_features(parts[0].unionByName(parts[1]), buckets, code_col, ("id", "label", "part"))
        return made.withColumn("label", F.col("label").cast("double"))

    table = cached_table(spark, features_path or fresh_path(spark, "text-features"), features, ("part",))
    odd = table.where("label IS NULL OR label NOT IN (0, 1)").select("label").first()
    if odd:
        raise ValueError(f"labels must be 0 or 1, not {odd['label']}")
    train_set = table.where("part = 'train'").select("id", "label", "features")
    dev_set = table.where("part = 'dev'").select("id", "label", "features")
    width = buckets + len(LENGTH_COLUMNS)
    scale = _scales(train_set, width)
    options = f"buckets={buckets} alpha={alpha} steps={steps} rate={rate} seed={seed}"

    def model_of(weights: np.ndarray) -> DescentModel:
        return DescentModel(weights[:-1] * scale, float(weights[-1]))

    history, state = [], _State(np.zeros(width + 1), np.zeros(width + 1))
    saved = _saved(spark, state_path)
    if saved is not None:
        rows = saved.select("epoch", "accuracy", "f1_macro", "options").orderBy("epoch").collect()
        other = {r["options"] for r in rows} - {options}
        if other:
            raise ValueError(f"{state_path} holds states of other options: {', '.join(sorted(other))}")
        history = [(r["epoch"], r["accuracy"], r["f1_macro"]) for r in rows]
        paths = saved.select(F.lit("descent").alias("model"), F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("path"))
        last = latest_checkpoint(paths).first()["path"]
        row = spark.read.parquet(last).first()
        state = _State(np.array(row["weights"]), np.array(row["squares"]))
    while len(history) < epochs and not _idle(history, patience):
        epoch = len(history) + 1
        batches = fresh_path(spark, f"epoch-{epoch}")
        n = epoch_batches(train_set, epoch, steps, batches, seed=seed)
        for step in range(steps if n else 0):
            # The schema is known: a read need not look for it, and a missing batch is empty.
            batch = open_or_none(spark.read.schema(train_set.schema).parquet, f"{batches}/step={step}")
            if batch is None:
                continue
            slope, seen = gradient(batch, state.weights, scale)
            if seen:
                slope[:-1] += alpha * state.weights[:-1]
                state.squares += slope**2
                state.weights -= rate * slope / np.sqrt(state.squares + EPSILON)
        found = model_metrics(score_fitted(dev_set, model_of(state.weights)), []).first()
        accuracy, f1 = (found["accuracy"] or 0.0, found["f1_macro"] or 0.0) if found else (0.0, 0.0)
        row = [(epoch, accuracy, f1, options, state.weights.tolist(), state.squares.tolist())]
        spark.createDataFrame(row, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/checkpoint-{epoch}")
        history.append((epoch, accuracy, f1))
    best = max(history, key=lambda h: (h[2], -h[0]), default=(0, 0.0, 0.0))[0]
    weights = state.weights
    if best:
        weights = np.array(spark.read.parquet(f"{state_path}/checkpoint-{best}").first()["weights"])
    model = model_of(weights)
    return DescentFit(model, history, best, score_fitted(dev_set, model))


def _idle(history: list[tuple[int, float, float]], patience: int) -> bool:
    """Whether the last ``patience`` epochs were no better than the best before them."""
    best = max(history, key=lambda h: (h[2], -h[0]), default=(0, 0.0, 0.0))[0]
    return len(history) - best >= patience


def score_descent(df: DataFrame, model: DescentModel, threshold: float = 0.5, code_col: str = "code") -> DataFrame:
    """Prediction rows; the bucket count follows from the model's width."""
    return score_fitted(text_features(df, model.numFeatures - len(LENGTH_COLUMNS), code_col), model, threshold)
