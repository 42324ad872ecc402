"""Materialised tables and fitted models that are built once and read after."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.util import JavaMLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.session import remove
from quillprint.sources.paths import is_missing, open_or_none


def cached_table(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The Parquet table at ``path``, built and written first if it is absent.

    A write that was cut short has no commit marker and is done again.
    """
    found = _complete(spark, path)
    if found is None:
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        found = spark.read.parquet(path)
    return found


def cached_tables(
    spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]]
) -> dict[str, DataFrame]:
    """Several cached tables; unless all exist, all are built again."""
    found = {path: _complete(spark, path) for path in builders}
    if any(table is None for table in found.values()):
        for path, build in builders.items():
            build().write.mode("overwrite").parquet(path)
            found[path] = spark.read.parquet(path)
    return found


def _complete(spark: SparkSession, path: str) -> DataFrame | None:
    # The commit marker tells a finished table from the rest of a failed job.
    marker = open_or_none(spark.read.format("binaryFile").load, f"{path}/_SUCCESS")
    return None if marker is None else spark.read.parquet(path)


def fingerprint(inputs: Sequence[DataFrame], options: Mapping[str, object] | None = None) -> dict[str, object]:
    """What a table is made from: schemas, the files behind them, options; and ``id``, a hash of all that.

    Files count by path, size and time of change, which Spark lists and sums
    without opening them. Inputs must be read from files.
    """
    described = []
    for df in inputs:
        paths = sorted(set(df.inputFiles()))
        if not paths:
            raise ValueError("a fingerprint needs inputs that are read from files")
        files = df.sparkSession.read.format("binaryFile").load(paths)
        seen = files.agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("length").alias("bytes"),
            F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("hash"),
        ).first()
        described.append({"schema": json.loads(df.schema.json()), **seen.asDict()})
    made_from = {"inputs": described, "options": dict(options or {})}
    text = json.dumps(made_from, sort_keys=True, default=str)
    return {"id": hashlib.sha256(text.encode()).hexdigest()[:32], "made_from": text}


def fingerprinted_table(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: Sequence[DataFrame],
    options: Mapping[str, object] | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The table below ``path`` that was made from these inputs and options; built first if there is none.

    Each table lies in a folder named by its fingerprint, beside a manifest of
    what it was made from. Once a new table is complete, tables of other
    fingerprints below ``path`` are removed: give every table a path of its
    own, and do not go on reading one that may be superseded.
    """
    made_from = fingerprint(inputs, options)
    target = f"{path.rstrip('/')}/table-{made_from['id']}"
    found = _complete(spark, target)
    if found is not None:
        return found
    manifest = spark.createDataFrame([(made_from["id"], made_from["made_from"])], "id string, made_from string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/manifest-{made_from['id']}")
    build().write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    for old in _tables(spark, path) - {made_from["id"]}:
        remove(spark, f"{path.rstrip('/')}/table-{old}")
        remove(spark, f"{path.rstrip('/')}/manifest-{old}")
    return spark.read.parquet(target)


def read_manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """What each table below ``path`` was made from, by fingerprint."""
    found = {old: f"{path.rstrip('/')}/manifest-{old}" for old in _tables(spark, path)}
    return {old: json.loads(spark.read.json(p).first()["made_from"]) for old, p in found.items()}


def _tables(spark: SparkSession, path: str) -> set[str]:
    """Fingerprints of the tables below a folder, finished or not."""
    folders = child_folders(spark, path, "manifest-").collect()
    return {r["path"].rsplit("-", 1)[1] for r in folders}


def load_model(reader: type[JavaMLReadable], path: str):
    """A fitted model, or None where there is none."""
    try:
        return reader.load(path)
    except Exception as error:
        if is_missing(error) or "does not exist" in str(error):
            return None
        raise


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def fit_once(reader: type[JavaMLReadable], path: str, fit: Callable[[], MLWritable]):
    """The model at ``path``; fitted and saved first if it is absent."""
    model = load_model(reader, path)
    if model is None:
        save_model(fit(), path)
        model = reader.load(path)
    return model


def child_folders(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``(path)`` of the folders below ``root`` that hold files and carry a prefix."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException as error:
        if is_missing(error):
            return spark.createDataFrame([], "path string")
        raise
    below = F.regexp_extract("path", rf"^(.*/{re.escape(prefix)}[^/]*)/", 1)
    return files.select(below.alias("path")).where("path != ''").distinct()
