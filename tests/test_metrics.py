"""Metric tables against arithmetic done by hand, and their identities."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from quillprint.operators import confusion as C
from quillprint.operators import curves as W
from quillprint.operators.selection import best_epoch, best_model, latest_checkpoint

SCHEMA = "id long, model string, split string, y_true int, y_pred int, y_proba double"


def make(spark, n=4000, seed=3, levels=97):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randint(0, 1)
        # A third of all rows share one score.
        s = 0.5 if rng.random() < 0.33 else min(1, max(0, round((t * 0.3 + rng.random()) / 1.3 * levels) / levels))
        rows.append((i, "AB"[i % 2], ("val", "test")[i % 3 == 0], t, int(s > 0.5), float(s)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute_curve(rows):
    scores = sorted({r[5] for r in rows}, reverse=True)
    p = sum(r[3] for r in rows)
    n = len(rows) - p
    roc, pr = [(math.inf, 0.0, 0.0)], []
    for s in scores:
        tp = sum(1 for r in rows if r[5] >= s and r[3] == 1)
        fp = sum(1 for r in rows if r[5] >= s and r[3] == 0)
        roc.append((s, fp / n, tp / p))
        pr.append((s, tp / (tp + fp), tp / p))
    pr_path = [(0.0, 1.0)] + [(r, q) for _, q, r in pr]
    roc_auc = sum((b[1] - a[1]) * (b[2] + a[2]) / 2 for a, b in zip(roc, roc[1:]))
    pr_auc = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(pr_path, pr_path[1:]))
    return roc, pr, roc_auc, pr_auc


def test_report_by_hand(spark):
    truth = [0, 0, 0, 1, 1, 2]
    guess = [0, 1, 0, 1, 1, 1]
    preds = spark.createDataFrame(
        [(i, "m", "s", t, g, None) for i, (t, g) in enumerate(zip(truth, guess))], SCHEMA
    )
    report = {r["row"]: r for r in C.classification_report(preds).collect()}
    assert report["0"]["precision"] == 1 and report["0"]["recall"] == pytest.approx(2 / 3)
    assert report["1"]["precision"] == 0.5 and report["1"]["recall"] == 1
    assert report["2"]["precision"] == 0 and report["2"]["f1"] == 0 and report["2"]["support"] == 1
    f1 = [0.8, 2 / 3, 0.0]
    assert report["macro avg"]["f1"] == pytest.approx(np.mean(f1))
    assert report["weighted avg"]["f1"] == pytest.approx(np.dot(f1, [3, 2, 1]) / 6)
    assert report["accuracy"]["f1"] == pytest.approx(4 / 6)
    assert report["weighted avg"]["support"] == 6
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in C.confusion_matrix(preds).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 6 and cells[(2, 1)] == 1 and cells[(1, 2)] == 0


def test_identities(spark):
    rows, preds = make(spark)
    for r in C.model_metrics(preds).collect():
        part = [x for x in rows if (x[1], x[2]) == (r["model"], r["split"])]
        assert r["n"] == len(part)
        assert r["accuracy"] == pytest.approx(sum(x[3] == x[4] for x in part) / len(part))
        assert r["recall_weighted"] == pytest.approx(r["accuracy"])
    assert C.confusion_matrix(preds, ["model"]).agg(F.sum("n")).first()[0] == len(rows)
    wide = C.confusion_wide(preds, keys=["model", "split"]).agg(F.sum(F.col("pred_0") + F.col("pred_1")))
    assert wide.first()[0] == len(rows)


def test_heatmap_flag(spark):
    _, preds = make(spark)
    cells = C.confusion_heatmap(preds).collect()
    top = max(r["n"] for r in cells)
    assert all(r["above_half"] == (r["n"] > top / 2) for r in cells)


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_curves_match_brute_force(spark, ranges):
    rows, preds = make(spark)
    part = [x for x in rows if (x[1], x[2]) == ("A", "val")]
    roc, pr, roc_auc, pr_auc = brute_curve(part)
    mine = W.roc_points(preds, ["model", "split"], ranges=ranges).where("model='A' and split='val'")
    got = sorted(((r["threshold"], r["fpr"], r["tpr"]) for r in mine.collect()), reverse=True)
    np.testing.assert_allclose(got, sorted(roc, reverse=True), rtol=1e-12)
    mine = W.pr_points(preds, ["model", "split"], ranges=ranges).where("model='A' and split='val'")
    got = [(r["threshold"], r["precision"], r["recall"]) for r in mine.collect()]
    assert (None, 1.0, 0.0) in got
    np.testing.assert_allclose(sorted(g for g in got if g[0] is not None), sorted(pr), rtol=1e-12)
    area = W.curve_areas(preds, ["model", "split"], ranges=ranges).where("model='A' and split='val'").first()
    assert area["roc_auc"] == pytest.approx(roc_auc, abs=1e-12)
    assert area["pr_auc"] == pytest.approx(pr_auc, abs=1e-12)


def test_roc_area_equals_spark_evaluator(spark):
    _, preds = make(spark, levels=10**6)
    mine = W.curve_areas(preds).first()["roc_auc"]
    other = BinaryClassificationEvaluator(
        rawPredictionCol="y_proba", labelCol="label", numBins=0
    ).evaluate(preds.withColumn("label", F.col("y_true").cast("double")))
    assert mine == pytest.approx(other, abs=1e-9)


def test_degenerate_curves(spark):
    tied = spark.createDataFrame([(i, "m", "s", i % 2, 0, 0.4) for i in range(10)], SCHEMA)
    row = W.curve_areas(tied).first()
    assert row["roc_auc"] == 0.5 and row["pr_auc"] == pytest.approx(0.75)
    negative = spark.createDataFrame([(i, "m", "s", 0, 0, i / 10) for i in range(10)], SCHEMA)
    row = W.curve_areas(negative).first()
    assert row["roc_auc"] is None and row["pr_auc"] == 0.5
    assert W.curve_areas(tied.withColumn("y_proba", F.lit(None).cast("double")), ["model"]).count() == 0


def test_one_class_predictions(spark):
    preds = spark.createDataFrame([(i, "m", "s", 1, 1, None) for i in range(5)], SCHEMA)
    row = C.model_metrics(preds).first()
    assert row["accuracy"] == 1 and row["f1_macro"] == 1
    assert C.confusion_matrix(preds).count() == 1


def test_long_form_skips_absent(spark):
    wide = spark.createDataFrame(
        [("a", "test", 0.5, None), ("b", "test", 0.6, 0.7)],
        "model string, split string, accuracy double, roc_auc double",
    )
    assert C.metrics_long(wide).count() == 3
    table = C.comparison_table(wide.drop("roc_auc"))
    assert table.columns == ["model", "accuracy", "f1_macro", "roc_auc"]
    assert best_model(wide, "roc_auc").first()["model"] == "b"


def test_best_epoch(spark):
    runs = {
        "stops": [0.3, 0.5, 0.5, 0.4, 0.45, 0.9],
        "first": [0.0, 0.0],
        "late": [0.1, 0.1, 0.1, 0.2],
    }
    rows = [(r, i + 1, f) for r, fs in runs.items() for i, f in enumerate(fs)]
    history = spark.createDataFrame(rows, "run string, epoch int, f1_macro double")
    got = {r["run"]: (r["best_epoch"], r["best_metric"], r["epochs_run"]) for r in best_epoch(history).collect()}
    assert got == {"stops": (2, 0.5, 5), "first": (1, 0.0, 2), "late": (4, 0.2, 4)}
    free = {r["run"]: r["best_epoch"] for r in best_epoch(history, patience=None).collect()}
    assert free["stops"] == 6


def test_latest_checkpoint(spark):
    paths = [("m", "x/checkpoint-9"), ("m", "x/checkpoint-100"), ("m", "x/checkpoint-last"), ("n", "y/checkpoint-x")]
    df = spark.createDataFrame(paths, "model string, path string")
    got = {r["model"]: (r["path"], r["step"]) for r in latest_checkpoint(df).collect()}
    assert got == {"m": ("x/checkpoint-100", 100), "n": ("y/checkpoint-x", 0)}


def test_wide_matrix_loses_no_label(spark):
    preds = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1)], "y_true int, y_pred int")
    wide = C.confusion_wide(preds).orderBy("y_true").collect()
    assert [tuple(r) for r in wide] == [(0, 1, 0, 0), (1, 0, 1, 1), (2, 0, 0, 1)]
    with pytest.raises(Exception, match="not listed"):
        C.confusion_wide(preds, labels=(0, 1)).collect()


def test_curves_read_their_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    preds = spark.range(1000).select((F.col("id") % 2).cast("int").alias("y_true"), ((F.col("id") % 37) / 37.0).alias("y_proba"))
    swept = W.sweep(preds.mapInArrow(counted, preds.schema))
    W.roc_of_sweep(swept).collect(), W.pr_of_sweep(swept).collect(), W.areas_of_sweep(swept).collect()
    assert reads.value == 1000
