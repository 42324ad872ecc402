"""Metric records as JSON and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators.confusion import metrics_long
from quillprint.sources.paths import open_required

NESTED = "map<string,map<string,map<string,double>>>"


def write_records(metrics: DataFrame, path: str) -> None:
    """One flat JSON object per row."""
    metrics.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return open_required(spark.read.json, path)


def nest_metrics(metrics: DataFrame) -> DataFrame:
    """One row ``json``: ``{split: {model: {metric: value}}}`` of a wide metric table.

    A metric table has one row per model and split, so each gathered list is
    as long as the list of models.
    """
    models = (
        metrics_long(metrics)
        .groupBy("split", "model")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    )
    splits = models.groupBy("split").agg(
        F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("s")
    )
    nested = splits.agg(F.map_from_entries(F.collect_list(F.struct("split", "s"))).alias("n"))
    return nested.select(F.to_json("n").alias("json"))


def unnest_metrics(nested: DataFrame, column: str = "json") -> DataFrame:
    """``(split, model, metric, value)`` rows of nested JSON texts."""
    parsed = nested.select(F.from_json(column, NESTED).alias("n"))
    splits = parsed.select(F.explode("n").alias("split", "models"))
    models = splits.select("split", F.explode("models").alias("model", "metrics"))
    return models.select("split", "model", F.explode("metrics").alias("metric", "value"))


def write_nested(metrics: DataFrame, path: str) -> None:
    nest_metrics(metrics).write.mode("overwrite").text(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Long metric rows of a nested JSON file; it may be one indented object."""
    whole = open_required(lambda p: spark.read.text(p, wholetext=True), path)
    return unnest_metrics(whole.where(F.trim("value") != ""), "value")


def write_summary(metrics: DataFrame, path: str) -> None:
    """One CSV line per model."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary(
    spark: SparkSession, path: str, texts: Sequence[str] = ("model", "split")
) -> DataFrame:
    """A summary CSV with every column but ``texts`` as a double."""
    df = open_required(lambda p: spark.read.option("header", True).csv(p), path)
    return df.select(
        *[F.col(c) if c in texts else F.col(c).cast("double").alias(c) for c in df.columns]
    )
