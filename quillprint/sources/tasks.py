"""The task catalog and its snippet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.sources.paths import open_required

SPLITS = ("train", "dev", "test")

# The files of each task.
TASK_FILES = {
    "task_a": {
        "train": "task_a_training_set_1.parquet",
        "dev": "task_a_validation_set.parquet",
        "test": "task_a_test_set_sample.parquet",
    },
    "task_b": {
        "train": "task_b_training_set.parquet",
        "dev": "task_b_validation_set.parquet",
        "test": "task_b_test_set_sample.parquet",
    },
    "task_c": {
        "train": "task_c_training_set_1.parquet",
        "dev": "task_c_validation_set.parquet",
        "test": "task_c_test_set_sample.parquet",
    },
}


def task_paths(data_root: str, task: str = "task_a") -> dict[str, str]:
    """Path of each split; the task name is taken in any case."""
    task = task.lower()
    if task not in TASK_FILES:
        raise ValueError(f"unknown task {task!r}; valid: {', '.join(TASK_FILES)}")
    return {s: f"{data_root.rstrip('/')}/{task}/{TASK_FILES[task][s]}" for s in SPLITS}


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """A snippet table with an ``id`` and, where there is a label, an int ``label``.

    A table without ``id`` gets one from each row's file and position in it,
    which stays the same however the scan is split or retried.
    """
    df = open_required(spark.read.parquet, path)
    if "id" not in df.columns:
        place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        df = df.select(place.alias("id"), *df.columns)
    if "label" in df.columns:
        df = df.withColumn("label", F.col("label").cast("int"))
    return df


def load_task(
    spark: SparkSession, data_root: str, task: str = "task_a"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, dev and test tables of a task."""
    paths = task_paths(data_root, task)
    train, dev, test = (read_snippets(spark, paths[s]) for s in SPLITS)
    return train, dev, test


def load_task_split(spark: SparkSession, data_root: str, task: str = "task_a") -> DataFrame:
    """All splits of a task as one table with a ``split`` column."""
    frames = dict(zip(SPLITS, load_task(spark, data_root, task)))
    tagged = [df.withColumn("split", F.lit(s)) for s, df in frames.items()]
    return tagged[0].unionByName(tagged[1], True).unionByName(tagged[2], True)
