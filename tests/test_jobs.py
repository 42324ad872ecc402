"""Sources, sinks and jobs from files to files."""

import json

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from quillprint.operators.scoring import score_batches
from quillprint.operators.selection import latest_checkpoint
from quillprint.plans import (
    compare_models,
    evaluate_csv,
    inspect_data,
    inspect_predictions,
    report,
    score_all,
    train,
)
from quillprint.sources import artifacts, metrics, predictions, tasks

HUMAN = "while (n) { total += read(n); }"
MACHINE = "result = compute_value(items)\nreturn result"


@pytest.fixture(scope="module")
def data_root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for split, (low, high) in {"train": (0, 120), "dev": (120, 160), "test": (160, 200)}.items():
        rows = [((HUMAN, MACHINE)[i % 2] + f"\nv{i}", "c", i % 2) for i in range(low, high)]
        df = spark.createDataFrame(rows, "code string, language string, label long")
        df.coalesce(1).write.parquet(tasks.task_paths(str(root), "task_a")[split])
    return str(root)


@pytest.fixture(scope="module")
def experiments(spark, data_root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("experiments"))
    linear = train(spark, "linear", "task_a", data_root, out, buckets=1 << 10, epochs=2).first()
    trees = train(spark, "trees", "task_a", data_root, out, rounds=3).first()
    assert linear["f1_macro"] == 1 and trees["f1_macro"] == 1
    again = train(spark, "trees", "task_a", "/nowhere", out, skip_if_trained=True).first()
    assert again["accuracy"] == trees["accuracy"]
    return out


def test_task_loading(spark, data_root):
    train_df, dev_df, test_df = tasks.load_task(spark, data_root, "TASK_A")
    assert (train_df.count(), dev_df.count(), test_df.count()) == (120, 40, 40)
    assert train_df.select("id").distinct().count() == 120
    assert dict(train_df.dtypes)["label"] == "int"
    once = sorted(r["id"] for r in train_df.select("id").collect())
    assert once == sorted(r["id"] for r in train_df.repartition(7).select("id").collect())
    both = tasks.load_task_split(spark, data_root)
    assert both.groupBy("split").count().count() == 3
    with pytest.raises(ValueError):
        tasks.task_paths(data_root, "task_z")
    with pytest.raises(FileNotFoundError):
        tasks.load_task(spark, data_root, "task_b")


def test_inspect_data(spark, data_root):
    found = inspect_data(spark, data_root)
    assert {(r["split"], r["label"], r["n"]) for r in found["labels"].collect()} == {
        ("train", 0, 60), ("train", 1, 60), ("dev", 0, 20), ("dev", 1, 20), ("test", 0, 20), ("test", 1, 20)
    }
    assert found["head"].count() == 5


def test_scoring_isolates_failures(spark, data_root, experiments):
    path = tasks.task_paths(data_root)["test"]

    def by_length(test, folder):
        def make():
            import numpy as np

            return lambda n: np.stack([60.0 - n, n - 20.0], axis=1)

        sized = test.withColumn("n", F.length("code").cast("double"))
        return score_batches(sized, make, ["n"], 64)

    rows = {
        r["model"]: r
        for r in score_all(
            spark, path, experiments, models=["linear", "trees", "absent", "length"],
            extra={"length": by_length},
        ).collect()
    }
    assert rows["linear"]["accuracy"] == 1 and rows["trees"]["error"] is None
    assert rows["absent"]["accuracy"] is None and "absent" in rows["absent"]["error"]
    assert rows["length"]["error"] is None and rows["length"]["accuracy"] > 0.5
    shown = inspect_predictions(spark, experiments, models=["linear", "trees", "none"])
    assert shown["confusion"].count() == 8
    assert shown["counts"].agg(F.sum("n")).first()[0] == 160
    assert inspect_predictions(spark, experiments, models=["none"]) is None


def test_report(spark, data_root, experiments, tmp_path):
    score_all(spark, tasks.task_paths(data_root)["test"], experiments)
    out = str(tmp_path / "plots")
    found = report(spark, experiments, out, models=["linear", "trees", "none"])
    assert list(found.skipped) == ["none"]
    summary = {r["model"]: r for r in metrics.read_summary(spark, f"{out}/summary_task_a.csv").collect()}
    assert summary["linear"]["roc_auc"] == 1 and summary["trees"]["pr_auc"] == 1
    assert spark.read.parquet(f"{out}/roc_task_a.parquet").count() > 2
    assert report(spark, experiments, models=["none"]) is None


def test_evaluate_csv(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("y_true,y_pred\n1,1\n0,1\n0,0\n1,1\n")
    row = evaluate_csv(spark, str(csv), str(tmp_path / "out")).first()
    assert row["accuracy"] == 0.75 and row["recall_macro"] == 0.75
    saved = metrics.read_records(spark, str(tmp_path / "out" / "metrics.json")).first()
    assert saved["accuracy"] == 0.75
    cells = spark.read.option("header", True).csv(str(tmp_path / "out" / "confusion_matrix.csv"))
    assert cells.count() == 4
    with pytest.raises(FileNotFoundError):
        evaluate_csv(spark, str(tmp_path / "none.csv"))
    csv.write_text("y_true,guess\n1,1\n")
    with pytest.raises(ValueError):
        evaluate_csv(spark, str(csv))


def test_prediction_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        predictions.load_predictions(spark, str(tmp_path))
    (tmp_path / "predictions.csv").write_text("id,y_true,y_pred,probs\n1,1,1,0.9\n2,0,1,0.6\n")
    got = predictions.load_predictions(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["y_proba"] for r in got] == [0.9, 0.6]
    # An unreadable file is passed over, the next candidate is used.
    (tmp_path / "preds_proba.parquet").write_text("not parquet")
    (tmp_path / "preds_proba.csv").write_text("id,p\n1,0.25\n")
    got = predictions.load_predictions(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["y_proba"] for r in got] == [0.25, 0.6]
    (tmp_path / "predictions_test.csv").write_text("y_true,y_pred\n1,0\n")
    got = predictions.load_predictions(spark, str(tmp_path)).collect()
    assert [(r["y_true"], r["y_pred"], r["y_proba"]) for r in got] == [(1, 0, None)]
    predictions.write_predictions(spark.createDataFrame([(1, 1, 0)], "id long, y_true int, y_pred int"), str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1


def test_nested_metrics(spark, tmp_path):
    preds = spark.createDataFrame([(1, 1), (0, 1)], "y_true int, y_pred int")
    path = str(tmp_path / "nested")
    table = compare_models({"val": {"A": preds}, "test": {"A": preds, "B": preds}}, path)
    text = spark.read.text(path).first()[0]
    assert json.loads(text)["test"]["B"]["accuracy"] == 0.5
    back = metrics.read_nested(spark, path)
    assert back.count() == 6 and table.count() == 3
    # One indented object, as other tools write it, reads the same.
    (tmp_path / "pretty.json").write_text(json.dumps(json.loads(text), indent=2))
    assert metrics.read_nested(spark, str(tmp_path / "pretty.json")).count() == 6
    with pytest.raises(FileNotFoundError):
        metrics.read_nested(spark, str(tmp_path / "gone"))


def test_caches_build_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "cache")
    for _ in range(3):
        assert artifacts.cached_table(spark, path, build).count() == 5
    assert len(calls) == 1
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert artifacts.cached_table(spark, path, build).count() == 5 and len(calls) == 2
    pair = {path: build, str(tmp_path / "other"): build}
    artifacts.cached_tables(spark, pair)
    artifacts.cached_tables(spark, pair)
    assert len(calls) == 4


def test_models_fit_once(spark, experiments, tmp_path):
    saved = f"{experiments}/linear_task_a/model"
    assert artifacts.load_model(LogisticRegressionModel, str(tmp_path / "none")) is None
    model = artifacts.fit_once(LogisticRegressionModel, saved, lambda: pytest.fail("fitted again"))
    assert model.numFeatures == (1 << 10) + 4


def test_checkpoint_folders(spark, tmp_path):
    for step in (5, 40, 300):
        folder = tmp_path / "run" / f"checkpoint-{step}"
        folder.mkdir(parents=True)
        (folder / "weights").write_text("x")
    found = artifacts.child_folders(spark, str(tmp_path / "run"), "checkpoint-")
    assert found.count() == 3
    top = latest_checkpoint(found.withColumn("model", F.lit("m"))).first()
    assert top["step"] == 300 and top["path"].endswith("checkpoint-300")
    assert artifacts.child_folders(spark, str(tmp_path / "gone")).count() == 0


def test_store_replaces_only_what_is_written(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [(str(i), i % 2, 1, 0.5, m, s) for i in range(6) for m in ("A", "B", None) for s in ("val", "test")]
    preds = spark.createDataFrame(rows, predictions.STORE_SCHEMA)
    predictions.write_store(preds.withColumn("more", F.lit(1)), root)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet") if "model=B" not in str(p)}
    predictions.write_store(preds.where("model = 'B' AND split = 'val'").withColumn("y_pred", F.lit(0)), root)
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert predictions.read_store(spark, root).count() == len(rows)
    one = predictions.read_store(spark, root, models=["B"], splits=["val"])
    assert {r["y_pred"] for r in one.collect()} == {0} and one.count() == 6
    assert {r["y_pred"] for r in predictions.read_store(spark, root, models=["B"], splits=["test"]).collect()} == {1}
    # Other folders are not opened.
    assert len(one.inputFiles()) < len(predictions.read_store(spark, root).inputFiles()) or "PartitionFilters" in one._jdf.queryExecution().toString()
    assert predictions.read_store(spark, root).where("model IS NULL").count() == 12
    with pytest.raises(FileNotFoundError):
        predictions.read_store(spark, str(tmp_path / "none"))
