"""Fingerprinted tables and scratch space."""

from __future__ import annotations

import glob
import time

import pytest
from pyspark.sql import functions as F

from quillprint.operators.curves import curve_areas
from quillprint.session import scratch_space, shared_folder
from quillprint.sources.artifacts import fingerprint, fingerprinted_table, read_manifest


def test_changed_inputs_and_options_rebuild(spark, tmp_path):
    source, path, built = str(tmp_path / "source"), str(tmp_path / "cache"), []
    spark.range(10).write.parquet(source)

    def cached(size):
        df = spark.read.parquet(source)
        return fingerprinted_table(spark, path, lambda: (built.append(size), df.limit(size))[1], [df], {"size": size})

    assert cached(3).count() == cached(3).count() == 3
    assert built == [3]
    assert cached(4).count() == 4
    assert built == [3, 4]
    # The first table went when the second was complete.
    assert len(glob.glob(f"{path}/table-*")) == 1 == len(glob.glob(f"{path}/manifest-*"))
    (made,) = read_manifest(spark, path).values()
    assert made["options"] == {"size": 4} and made["inputs"][0]["files"] == len(glob.glob(f"{source}/*.parquet"))
    time.sleep(1)
    spark.range(20).write.mode("overwrite").parquet(source)
    assert cached(4).count() == 4
    assert built == [3, 4, 4]
    with pytest.raises(ValueError, match="read from files"):
        fingerprint([spark.createDataFrame([(1,)], "a int")])


def test_an_unfinished_table_is_built_again(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "cache")
    spark.range(10).write.parquet(source)
    df = spark.read.parquet(source)

    def dies():
        return df.select(F.raise_error(F.lit("gone")).alias("x"))

    with pytest.raises(Exception, match="gone"):
        fingerprinted_table(spark, path, dies, [df])
    assert fingerprinted_table(spark, path, lambda: df, [df]).count() == 10


def test_scratch_space_is_left_empty(spark, tmp_path):
    preds = spark.range(500).select(
        (F.col("id") % 2).cast("int").alias("y_true"), ((F.col("id") * 7) % 101 / 101.0).alias("y_proba")
    )
    shared = shared_folder(spark)
    before = set(glob.glob(f"{shared}/*"))
    with scratch_space(spark) as folder:
        curve_areas(preds).write.parquet(str(tmp_path / "out"))
        assert glob.glob(f"{folder}/*")
    assert set(glob.glob(f"{shared}/*")) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(KeyError), scratch_space(spark):
        curve_areas(preds)
        raise KeyError
    assert set(glob.glob(f"{shared}/*")) == before
