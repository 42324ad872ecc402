"""Training rows in another order every epoch.

The order of an epoch sorts the rows by a hash of their key, the seed and the
epoch: a permutation that follows from the data alone, whatever the number of
partitions and however often a task is retried. Positions are counted within
ranges of hashes and shifted by the rows of the ranges before, so no task sorts
more than its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.operators.prefix import running_sums


def shuffle_rank(keys: Sequence[str], seed: int, epoch: int) -> Column:
    """The number by which an epoch sorts its rows."""
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), F.lit(epoch))


def epoch_order(rows: DataFrame, epoch: int, keys: Sequence[str] = ("id",), seed: int = 42, shuffle_first: bool = False) -> DataFrame:
    """``rows`` with ``position``, from 0 without gaps.

    The first epoch (1) keeps the order of the keys unless ``shuffle_first``;
    every later one has an order of its own. Rows with equal keys stand together
    in any order. Null keys are keys like others; they come first where the order
    is that of the keys.
    """
    if epoch < 1:
        raise ValueError(f"epochs count from 1, not {epoch}")
    marked = rows.withColumn("_one", F.lit(1))
    if epoch > 1 or shuffle_first:
        marked = marked.withColumn("_rank", shuffle_rank(keys, seed, epoch))
        order = ["_rank", *keys]
    else:
        order = list(keys)
    placed = running_sums(marked, [], order, ["_one"])
    return placed.withColumnRenamed("_one_before", "position").drop("_one", "_one_all", "_rank")


def batch_of(position: Column, rows: int, steps: int) -> Column:
    """The step, from 0, in which a position is used when ``rows`` are cut into ``steps`` batches of equal size."""
    return F.floor(position * steps / rows).cast("int")


def epoch_batches(
    rows: DataFrame, epoch: int, steps: int, path: str, keys: Sequence[str] = ("id",), seed: int = 42
) -> int:
    """Write an epoch's rows as ``steps`` batches, one folder a step; return the number of rows.

    A step then reads its own batch only. With fewer rows than steps some
    folders are missing.
    """
    n = rows.count()
    if n:
        placed = epoch_order(rows, epoch, keys, seed).withColumn("step", batch_of(F.col("position"), n, steps))
        placed.write.mode("overwrite").partitionBy("step").parquet(path)
    return n
