"""Models learn from all labels, however many there are."""

import re

import pytest
from pyspark.sql import functions as F

from quillprint.llm import ranking
from quillprint.llm.support import written


def test_ranking_uses_every_label(spark):
    n = 24_000
    poor = F.col("doc_id") % 3 == 0
    docs = spark.range(0, n, 1, 8).withColumnRenamed("id", "doc_id")
    words = F.array_repeat(F.lit("word"), (1 + F.pmod(F.xxhash64("doc_id"), F.lit(5))).cast("int"))
    docs = docs.select("doc_id", F.concat(F.array_join(words, " "), F.when(poor, " !!!").otherwise(".")).alias("text"))
    labels = docs.select("doc_id", (~poor).cast("int").alias("quality"))
    measured, name = ranking.features(docs)
    want = measured.agg(*[F.avg(F.get(name, F.lit(i))) for i in range(12)]).first()
    model = ranking.fit_ranking(docs, labels)
    assert model.mean == pytest.approx(list(want), rel=1e-9)
    scored = ranking.score_quality(docs, model)
    assert scored.where((F.col("quality_score") >= ranking.CUT) != ~poor).count() == 0


def test_quantiles_are_exact(spark):
    values = [((i * 7919) % 211) / 7 for i in range(400)] + [3.0] * 50
    rows = spark.createDataFrame([(v,) for v in values], "s double").repartition(5)
    shares = [0.0, 0.137, 0.25, 0.75, 1.0]
    want = rows.select(F.percentile("s", F.array(*map(F.lit, shares)))).first()[0]
    assert ranking.quantiles(rows, "s", len(values), shares) == pytest.approx(want, rel=1e-12)
    assert ranking.quantiles(rows.limit(1), "s", 1, [0.5]) == [rows.limit(1).first()[0]]


def test_ranking_shuffles_no_text(spark, monkeypatch):
    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 5).alias("text"))
    docs = written(docs, "docs")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    plans = {}

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return written(df, name)

    monkeypatch.setattr(ranking, "written", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ranking.fit_ranking(docs, labels)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shuffled = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", plans["labelled"])
    assert shuffled and not any("_text" in columns for columns in shuffled)
