"""Metrics gathered while predictions are written."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from quillprint.operators.confusion import model_metrics
from quillprint.operators.evaluation import TWO_CLASSES, evaluate_model, evaluate_models, write_and_evaluate

ROWS = [(i, i % 3 % 2, float(i % 5), float(i % 7 == 0)) for i in range(200)]


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame(ROWS, "id long, label int, a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).select("id", "label", "features")


def test_one_pass_over_the_input(spark, features, tmp_path):
    """An accumulator counts how often the rows are computed: once for scores, file and metrics together."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        reads.add(1)
        return x

    watched = features.withColumn("id", counted("id"))
    model = DecisionTreeClassifier(maxDepth=2).fit(features)
    path = str(tmp_path / "preds")
    found = evaluate_model(watched, model, path)
    assert reads.value == len(ROWS)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS) == found.n
    slow = model_metrics(back, [], ["accuracy", "f1_weighted"]).first()
    assert (found.accuracy, found.f1_weighted) == pytest.approx((slow["accuracy"], slow["f1_weighted"]))


def test_several_models_and_tables(features, tmp_path):
    models = {"tree": DecisionTreeClassifier(maxDepth=3).fit(features), "linear": LogisticRegression(maxIter=5).fit(features)}
    splits = {"val": features.where("id < 50"), "test": features.where("id >= 50")}
    rows = evaluate_models(splits, models, str(tmp_path / "all")).collect()
    assert {(r.model, r.split, r.n) for r in rows} == {(m, s, n) for m in models for s, n in (("val", 50), ("test", 150))}


def test_labels_that_are_missing_or_strange(spark, tmp_path):
    schema = "y_true int, y_pred int"

    def measured(rows, labels=TWO_CLASSES):
        preds = spark.createDataFrame(rows, schema)
        return write_and_evaluate(preds, lambda df: df.write.format("noop").mode("overwrite").save(), labels)

    assert measured([(None, 1), (None, 0)]) == measured([(None, 0), (None, None)])
    assert measured([]).accuracy is None
    assert measured([(1, 1), (1, 0), (None, 1)]).unlabelled == 1
    three = measured([(0, 0), (1, 2), (2, 2), (2, 1)], labels=(0, 1, 2))
    assert three.accuracy == 0.5 and three.f1_weighted == pytest.approx((1 * 1 + 1 * 0 + 2 * 0.5) / 4)
    for rows in ([(2, 1)], [(1, 2)], [(1, None)]):
        with pytest.raises(ValueError, match="not among"):
            measured(rows)
