"""Boosted trees over structural features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators.columns import align_to, int_label
from quillprint.operators.scoring import score_fitted
from quillprint.session import ensure_checkpoints, fresh_path

HISTORY_SCHEMA = "split string, iteration int, log_loss double"


@dataclass
class TreeFit:
    model: PipelineModel
    history: DataFrame
    predictions: DataFrame


def _feature_columns(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def train_trees(
    train: DataFrame,
    dev: DataFrame,
    rounds: int = 200,
    depth: int = 6,
    learning_rate: float = 0.1,
    bins: int = 256,
    seed: int = 42,
    log_loss: bool = True,
) -> TreeFit:
    """Fit on feature tables ``(id, label, features...)``; dev takes train's columns.

    All rounds run: there is no early stop. ``history`` holds the log-loss of
    both tables after each round. The tables are read by the fit, which keeps its
    own form of them, and once more for the history; give written tables.
    """
    spark = train.sparkSession
    ensure_checkpoints(spark)
    columns = [c for c in train.columns if c not in ("id", "label")]
    keep = ["id", "label"]
    train_set = int_label(align_to(train, columns, keep))
    dev_set = int_label(align_to(dev, columns, keep))
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=columns, outputCol="features"),
            GBTClassifier(
                maxIter=rounds,
                maxDepth=depth,
                stepSize=learning_rate,
                maxBins=bins,
                seed=seed,
                checkpointInterval=10,
            ),
        ]
    ).fit(train_set)
    if log_loss:
        assemble, trees = model.stages
        parts = [df.withColumn("split", F.lit(split)) for split, df in (("train", train_set), ("dev", dev_set))]
        rows = loss_history(assemble.transform(parts[0].unionByName(parts[1])), trees)
    else:
        rows = spark.createDataFrame([], HISTORY_SCHEMA)
    return TreeFit(model, rows, score_trees(dev, model))


def leaf_values(spark: SparkSession, model: GBTClassificationModel) -> list[np.ndarray]:
    """What each tree adds to the margin at each of its leaves, in the order that ``leafCol`` numbers them.

    Read from the written model: as many numbers as the model has leaves.
    """
    path = fresh_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0")
    rows = nodes.select("treeID", "nodeData.id", "nodeData.prediction").orderBy("treeID", "id").collect()
    values: list[list[float]] = [[] for _ in model.treeWeights]
    for row in rows:
        values[row["treeID"]].append(row["prediction"] * model.treeWeights[row["treeID"]])
    return [np.array(v) for v in values]


def loss_history(features: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """``(split, iteration, log_loss)`` of ``features (split, label, features)`` after every round, in one pass.

    Each row is dropped through all trees at once; the running sum of what its
    leaves add gives its margin, and loss, after every round. A task returns one
    sum for each split and round it saw. Rows without a label are left out.
    """
    spark = features.sparkSession
    values = leaf_values(spark, model)
    starts = np.cumsum([0, *[len(v) for v in values[:-1]]])
    flat = np.concatenate(values)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            splits = np.array(batch.column(0).to_pylist(), object)
            signs = 2 * batch.column(1).to_numpy(zero_copy_only=False) - 1
            leaves = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
            margins = np.cumsum(flat[leaves + starts], axis=1)
            each = np.logaddexp(0, -2 * margins * signs[:, None])
            for split in set(splits):
                own = splits == split
                sums[split] = sums.get(split, 0.0) + each[own].sum(axis=0)
                counts[split] = counts.get(split, 0) + int(own.sum())
        rounds = np.arange(1, len(starts) + 1, dtype=np.int32)
        for split, total in sums.items():
            columns = [pa.array([split] * len(rounds)), pa.array(rounds), pa.array(total), pa.array(np.full(len(rounds), counts[split]))]
            yield pa.RecordBatch.from_arrays(columns, names=["split", "iteration", "total", "n"])

    leaf = vector_to_array("leaf").alias("leaf")
    rows = model.copy().setLeafCol("leaf").transform(features).where("label IS NOT NULL")
    found = rows.select("split", F.col("label").cast("double").alias("label"), leaf)
    partial = found.mapInArrow(losses, "split string, iteration int, total double, n long")
    return partial.groupBy("split", "iteration").agg((F.sum("total") / F.sum("n")).alias("log_loss"))


def score_trees(features: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """Prediction rows; the table is aligned to the columns the model was fitted on."""
    keep = [c for c in ("id", "label") if c in features.columns]
    return score_fitted(align_to(features, _feature_columns(model), keep), model, threshold)


def feature_importance(model: PipelineModel) -> DataFrame:
    """``(feature, importance)``, largest first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(_feature_columns(model), weights))
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
