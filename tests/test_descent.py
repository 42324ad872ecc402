"""Warm-started mini-batch descent, its gradient, and runs that go on."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from quillprint.operators import descent
from quillprint.operators.descent import DescentModel, gradient, score_descent, train_descent
from quillprint.sources.artifacts import load_model

HUMAN = "while (n) { total += read(n); }"
MACHINE = "result = compute_value(items)\nreturn result"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"{(HUMAN, MACHINE)[i % 2]}\n" * (1 + i % 3) + f"v{i}", i % 2) for i in range(240)]
    return spark.createDataFrame(rows, "id long, code string, label int")


@pytest.mark.parametrize("parts", [1, 70])
def test_gradient_beside_numpy(spark, parts):
    dice = np.random.default_rng(4)
    x, y = dice.normal(size=(200, 5)) * (dice.random((200, 5)) < 0.5), dice.integers(0, 2, 200)
    w, scale = dice.normal(size=6), np.array([1, 1, 2.0, 0.5, 3])
    rows = [(float(t), Vectors.sparse(5, {i: v for i, v in enumerate(r) if v})) for r, t in zip(x, y)]
    batch = spark.createDataFrame(rows, ["label", "features"]).repartition(parts)
    got, n = gradient(batch, w, scale)
    wrong = 1 / (1 + np.exp(-(x * scale @ w[:5] + w[5]))) - y
    assert n == 200
    assert got == pytest.approx(np.append((x * scale).T @ wrong, wrong.sum()) / 200)
    assert gradient(batch.limit(0), w, scale)[1] == 0


def test_it_learns_and_survives_disk(labelled, tmp_path):
    train, dev = labelled.where("id % 4 < 2"), labelled.where("id % 4 >= 2")
    fit = train_descent(train, dev, buckets=1 << 10, epochs=3)
    assert fit.history[fit.best_epoch - 1][2] == 1
    assert fit.predictions.where("y_true = y_pred").count() == dev.count()
    path = str(tmp_path / "model")
    fit.model.save(path)
    again = score_descent(dev, load_model(DescentModel, path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fit.predictions.collect()))
    assert load_model(DescentModel, str(tmp_path / "none")) is None


def test_a_broken_run_goes_on(labelled, tmp_path, monkeypatch):
    train, dev = labelled.where("id % 4 < 2"), labelled.where("id % 4 >= 2")
    options = {"buckets": 1 << 8, "epochs": 4, "patience": 9, "steps": 3, "rate": 0.01}
    whole = train_descent(train, dev, **options)
    state, real, done = str(tmp_path / "state"), descent.epoch_batches, []

    def dies(rows, epoch, *args, **more):
        if epoch == 3:
            raise KeyboardInterrupt
        done.append(epoch)
        return real(rows, epoch, *args, **more)

    monkeypatch.setattr(descent, "epoch_batches", dies)
    with pytest.raises(KeyboardInterrupt):
        train_descent(train, dev, state_path=state, **options)
    # A state that was not finished does not count.
    (tmp_path / "state" / "checkpoint-3").mkdir()
    (tmp_path / "state" / "checkpoint-3" / "part-0.parquet").write_bytes(b"cut short")
    monkeypatch.setattr(descent, "epoch_batches", lambda rows, epoch, *a, **k: (done.append(epoch), real(rows, epoch, *a, **k))[1])
    resumed = train_descent(train, dev, state_path=state, **options)
    assert done == [1, 2, 3, 4]
    assert resumed.history == whole.history
    assert resumed.model.coefficients == pytest.approx(whole.model.coefficients, abs=1e-9)
    assert resumed.model.intercept == pytest.approx(whole.model.intercept, abs=1e-9)
    # A finished run is read back, and other options are another run.
    assert train_descent(train, dev, state_path=state, **options).history == resumed.history
    assert done == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="other options"):
        train_descent(train, dev, state_path=state, **{**options, "rate": 0.1})


def test_early_stop_and_odd_tables(spark, labelled):
    fit = train_descent(labelled, labelled, buckets=1 << 10, epochs=5, patience=1)
    assert fit.best_epoch == 1 and len(fit.history) == 2
    none = train_descent(labelled.limit(0), labelled, buckets=16, epochs=1)
    assert not none.model.coefficients.any()
    odd = spark.createDataFrame([(i, f"w{i % 3} x", i % 3) for i in range(12)], "id long, code string, label int")
    with pytest.raises(ValueError, match="0 or 1"):
        train_descent(odd, odd, buckets=16, epochs=1)
    keyless = spark.createDataFrame([(None, "a b", 0), (None, None, 1), (1, "c", 1), (1, "a", 0)], "id long, code string, label int")
    assert train_descent(keyless, keyless, buckets=16, epochs=2).predictions.count() == 4
