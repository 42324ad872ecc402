"""Session construction and the shared folder used for durable intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillprint", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Nothing here fixes a partition count: adaptive execution sizes shuffles at
    run time, so the same settings serve one machine and a cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The durable folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would vanish with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="quillprint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let iterative estimators cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


_SCOPES: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in the folder of the innermost ``scratch_space`` if there is one."""
    folder = _SCOPES[-1] if _SCOPES else shared_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[str]:
    """A folder for the intermediate tables that operators write inside the block; removed at its end.

    Write an operator's result inside the block: it reads those tables until then.
    """
    folder = fresh_path(spark, "scratch")
    _SCOPES.append(folder)
    try:
        yield folder
    finally:
        _SCOPES.remove(folder)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the store that Spark writes to; nothing happens if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: later steps no longer depend on lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
