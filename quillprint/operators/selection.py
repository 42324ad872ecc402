"""Choosing among training epochs and saved checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_epoch(
    history: DataFrame,
    keys: Sequence[str] = ("run",),
    epoch: str = "epoch",
    metric: str = "f1_macro",
    patience: int | None = 3,
) -> DataFrame:
    """The epoch each run keeps, and how many epochs it ran.

    An epoch improves when its metric is strictly above all earlier ones; the
    first always counts. After ``patience`` epochs without improvement the run
    stops; ``None`` lets every run finish.
    """
    order = Window.partitionBy(*keys).orderBy(epoch)
    best_before = F.max(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = history.select(
        *keys,
        F.col(epoch).alias("epoch"),
        F.col(metric).alias("metric"),
        F.row_number().over(order).alias("_step"),
        (best_before.isNull() | (F.col(metric) > best_before)).alias("_better"),
    )
    order = Window.partitionBy(*keys).orderBy("_step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("_last", F.max(F.when(F.col("_better"), F.col("_step"))).over(so_far))
    if patience is not None:
        stop = F.max((F.col("_step") - F.col("_last") >= patience).cast("int")).over(before)
        steps = steps.withColumn("_stopped", F.coalesce(stop, F.lit(0))).where("_stopped = 0")
    kept = F.max_by(
        F.struct(F.col("epoch").alias("best_epoch"), F.col("metric").alias("best_metric")),
        F.when(F.col("_better"), F.col("_step")),
    )
    return (
        steps.groupBy(*keys)
        .agg(kept.alias("_kept"), F.count(F.lit(1)).alias("epochs_run"))
        .select(*keys, "_kept.*", "epochs_run")
    )


def best_model(metrics: DataFrame, metric: str, name: str = "model") -> DataFrame:
    """The row with the highest metric; names break ties."""
    return metrics.orderBy(F.desc_nulls_last(metric), name).limit(1)


def checkpoint_step(path: Column) -> Column:
    """Integer after the last dash of a path's base name, 0 if there is none."""
    base = F.substring_index(path, "/", -1)
    return F.coalesce(F.substring_index(base, "-", -1).try_cast("bigint"), F.lit(0))


def latest_checkpoint(
    paths: DataFrame, keys: Sequence[str] = ("model",), path: str = "path"
) -> DataFrame:
    """Path with the highest step per key; equal steps go to the greatest path."""
    found = F.max(F.struct(checkpoint_step(F.col(path)).alias("step"), F.col(path).alias("path")))
    return paths.groupBy(*keys).agg(found.alias("_f")).select(*keys, "_f.path", "_f.step")
