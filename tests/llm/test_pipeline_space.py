"""Stages leave little behind them in the shared folder."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from quillprint.session import scratch_space


def test_near_duplicates_leave_only_groups(spark, sf_dir):
    docs = spark.range(0, 60, 1, 2).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), (F.col("id") % 20).cast("string")) for i in range(12)]).alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(60).alias("n_chars"),
    )
    with scratch_space(spark) as folder:
        kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
        assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(20))
        there = {name.rsplit("-", 1)[0] for name in os.listdir(folder.removeprefix("file:")) if not name.startswith(".")}
    assert there == {"groups", "first", "repeated"}
