"""Sequences, vectors, trainers and scorers."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from quillprint.functions import argmax_label, label_text_to_id, softmax_probability
from quillprint.operators import columns, scoring, sequences, trees, vectors
from quillprint.operators.linear import score_linear, train_linear
from quillprint.operators.structural import structural_features

HUMAN = "while (n) { total += read(n); }"
MACHINE = "result = compute_value(items)\nreturn result"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(240):
        body = (HUMAN, MACHINE)[i % 2]
        rows.append((i, f"{body}\n" * (1 + i % 3) + f"v{i}", "c", i % 2))
    return spark.createDataFrame(rows, "id long, code string, language string, label int")


def test_ngrams_and_unit_norm(spark):
    df = spark.createDataFrame([(1, "Ab cd\n\n\nef, cd"), (2, "x y"), (3, None)], "id long, code string")
    grams = {r["id"]: r["ngrams"] for r in vectors.word_ngrams(df).collect()}
    assert grams[1] == ["ab", "cd", "ef", "cd", "ab cd", "cd ef", "ef cd", "ab cd ef", "cd ef cd"]
    assert grams[2] == [] and grams[3] == []
    rows = vectors.hashed_vectors(df, 1 << 18).collect()
    norms = {r["id"]: r["text_vector"].norm(2) for r in rows}
    assert norms[1] == pytest.approx(1.0) and norms[2] == 0
    counts = vectors.hashed_counts(vectors.word_ngrams(df)).where("id = 1").first()["counts"]
    assert counts.values.sum() == 9
    wide = vectors.text_features(df, 64).where("id = 1").first()["features"]
    assert wide.size == 68 and wide.toArray()[64:].tolist() == [14.0, 4.0, 3.5, 0.0]


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame(
        [(1, "a b a ( c", 1), (2, "b a zz " * 10, 0), (3, None, 1)], "id long, code string, label int"
    )
    vocab = sequences.vocabulary(df, size=2)
    got = [(r["token"], r["n"], r["token_id"]) for r in vocab.orderBy("token_id").collect()]
    assert got == [("a", 12, 4), ("b", 11, 5)]
    rows = {r["id"]: r for r in sequences.encode_sequences(df, vocab, max_length=8).collect()}
    assert rows[1]["input_ids"] == [2, 4, 5, 4, 1, 1, 3, 0]
    assert rows[1]["attention_mask"] == [1, 1, 1, 1, 1, 1, 1, 0]
    assert rows[2]["input_ids"] == [2, 5, 4, 1, 5, 4, 1, 3] and rows[2]["labels"] == 0
    assert rows[3]["input_ids"] == [2, 3, 0, 0, 0, 0, 0, 0]
    loose = {r["id"]: r for r in sequences.encode_sequences(df, vocab, 8, pad=False).collect()}
    assert loose[1]["input_ids"] == [2, 4, 5, 4, 1, 1, 3] and loose[3]["attention_mask"] == [1, 1]


def test_encoding_keeps_every_row(spark):
    """Rows with equal or null keys stay apart, each within the length bound."""
    df = spark.createDataFrame([(1, "a a a a"), (1, "b b b b"), (None, "a"), (None, "a")], "id long, code string")
    vocab = sequences.vocabulary(df, size=2)
    got = sorted((str(r["id"]), r["input_ids"]) for r in sequences.encode_sequences(df, vocab, 6).collect())
    assert got == [
        ("1", [2, 4, 4, 4, 4, 3]), ("1", [2, 5, 5, 5, 5, 3]), ("None", [2, 4, 3, 0, 0, 0]), ("None", [2, 4, 3, 0, 0, 0]),
    ]


def test_encoding_without_broadcast(spark):
    df = spark.createDataFrame([(i, "a b c " * (i % 5)) for i in range(50)], "id long, code string")
    vocab = sequences.vocabulary(df, size=2)
    base = sorted(map(str, sequences.encode_sequences(df, vocab, 16).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, sequences.encode_sequences(df, vocab, 16).collect())) == base
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_must_be_binary(spark):
    df = spark.createDataFrame([(i, f"w{i % 3} x", i % 3) for i in range(12)], "id long, code string, label int")
    with pytest.raises(ValueError, match="0 or 1"):
        train_linear(df, df, buckets=16, epochs=1)


def test_unlabelled_predictions_stay(spark):
    preds = spark.createDataFrame([(1, 0), (2, 1)], "id long, y_pred int")
    labels = spark.createDataFrame([(1, 1)], "id long, label int")
    rows = {r["id"]: r["y_true"] for r in scoring.pair_labels(preds, labels).collect()}
    assert rows == {1: 1, 2: None}


def test_pluggable_tokenizer(spark):
    df = spark.createDataFrame([(1, "aa b", 1), (2, "cccc " * 9, 0)], "id long, code string, label int")

    def make():
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    rows = {r["id"]: r for r in sequences.encode_with(df, make, max_length=4).collect()}
    assert rows[1]["input_ids"] == [2, 1, 0, 0] and rows[2]["input_ids"] == [4, 4, 4, 4]
    assert rows[1]["attention_mask"] == [1, 1, 0, 0]


def test_tokenizers_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = tokenizers.models.WordLevel({"[UNK]": 0, "if": 1, "x": 2}, unk_token="[UNK]")
    tok = tokenizers.Tokenizer(words)
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    path = str(tmp_path / "tok.json")
    tok.save(path)

    def make():
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in loaded.encode_batch(list(texts))]

    df = spark.createDataFrame([(1, "if x y")], "id long, code string")
    assert sequences.encode_with(df, make, 5, pad=False).first()["input_ids"] == [1, 2, 0]


def test_score_expressions(spark):
    df = spark.createDataFrame(
        [(1, [1000.0, 1001.0], "human"), (2, [3.0, 3.0], "LABEL_7"), (3, [0.0, -2.0], "what_x"), (4, [0.0, 0.0], "a_-1")],
        "id long, z array<double>, t string",
    )
    rows = df.select(
        "id",
        softmax_probability(F.col("z")).alias("p"),
        argmax_label(F.col("z")).alias("k"),
        label_text_to_id(F.col("t"), {"human": 3}).alias("l"),
    ).orderBy("id").collect()
    assert [r["k"] for r in rows] == [1, 0, 0, 0]
    assert rows[0]["p"] == pytest.approx(1 / (1 + np.exp(-1))) and rows[1]["p"] == 0.5
    assert [r["l"] for r in rows] == [3, 7, 0, -1]


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2, None, "s")], "id long, a int, b double, lang string")
    out = columns.align_to(df, ["b", "zz", "a"], ["id"])
    assert out.columns == ["id", "b", "zz", "a"] and tuple(out.first()) == (1, 0.0, 0.0, 2.0)
    assert columns.numeric_columns(df, ["lang"]).columns == ["id", "a", "b", "lang"]
    assert columns.sorted_columns(df, ["lang"]).columns == ["lang", "a", "b", "id"]
    other = spark.createDataFrame([(2, 5.0)], "id long, c double")
    stacked = columns.stack(columns.as_doubles(df, ["id"]), other, fill=0.0)
    assert {tuple(r) for r in stacked.drop("lang").collect()} == {(1, 2.0, 0.0, 0.0), (2, 0.0, 0.0, 5.0)}


def test_linear_classifier_learns_and_survives_disk(spark, labelled, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    train, dev = labelled.where("id % 4 < 2"), labelled.where("id % 4 >= 2")
    fit = train_linear(train, dev, buckets=1 << 10, epochs=3)
    assert fit.history[fit.best_epoch - 1][2] == max(h[2] for h in fit.history)
    assert fit.predictions.where("y_true = y_pred").count() == dev.count()
    path = str(tmp_path / "lr")
    fit.model.write().overwrite().save(path)
    again = score_linear(dev, LogisticRegressionModel.load(path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fit.predictions.collect()))


def test_early_stop(spark, labelled):
    fit = train_linear(labelled, labelled, buckets=1 << 10, epochs=5, patience=1)
    assert fit.best_epoch == 1 and len(fit.history) == 2


def test_boosted_trees(spark, labelled):
    table = structural_features(labelled)
    train, dev = table.where("id % 4 < 2"), table.where("id % 4 >= 2").drop("num_try")
    fit = trees.train_trees(train, dev, rounds=5)
    assert fit.predictions.where("y_true = y_pred").count() == dev.count()
    losses = [r["log_loss"] for r in fit.history.where("split='dev'").orderBy("iteration").collect()]
    assert len(losses) == 5 and losses == sorted(losses, reverse=True)
    # The log-loss of the last round follows from the probabilities.
    p = np.array([(r["y_true"], r["y_proba"]) for r in fit.predictions.collect()])
    by_hand = -np.mean(np.log(np.where(p[:, 0] == 1, p[:, 1], 1 - p[:, 1])))
    assert losses[-1] == pytest.approx(by_hand)
    weights = trees.feature_importance(fit.model).collect()
    assert len(weights) == 21 and sum(r["importance"] for r in weights) == pytest.approx(1.0)


def test_batch_scoring(spark):
    # Local functions reach the workers by value; this module is not importable there.
    def make_linear():
        weights = np.array([0.5, -1.0, 2.0])

        def predict(batch):
            s = batch @ weights
            return np.stack([-s, s], axis=1)

        return predict

    def make_texts():
        def predict(batch):
            return np.array(["machine" if row.sum() > 0 else "LABEL_0" for row in batch])

        return predict

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(
        [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)],
        "id long, vec array<double>, label int",
    ).repartition(7)
    got = {r["id"]: r for r in scoring.score_batches(df, make_linear, ["vec"], 64, [[3]]).collect()}
    s = x @ np.array([0.5, -1.0, 2.0])
    for i in range(300):
        assert got[i]["y_proba"] == pytest.approx(1 / (1 + np.exp(-2 * s[i])))
        assert got[i]["y_pred"] == int(s[i] > 0) and got[i]["y_true"] == i % 2
    texts = scoring.score_label_texts(df, make_texts, ["vec"], {"machine": 1}, 32, [[3]])
    assert {r["id"]: r["y_pred"] for r in texts.collect()} == {i: int(x[i].sum() > 0) for i in range(300)}


def test_pairing(spark):
    preds = spark.createDataFrame([(1, 1, 0.2), (2, 0, None)], "id long, y_pred int, probs double")
    labels = spark.createDataFrame([(2, 1), (1, 0)], "id long, label int")
    side = spark.createDataFrame([(2, 0.9)], "id long, p double")
    rows = scoring.pair_scores(scoring.pair_labels(preds, labels), side).orderBy("id").collect()
    assert [(r["y_true"], r["y_pred"], r["y_proba"]) for r in rows] == [(0, 1, 0.2), (1, 0, 0.9)]
    decided = scoring.threshold_predictions(spark.createDataFrame([(1, 0.5), (1, 0.51), (1, None)], "y_pred int, y_proba double"))
    assert [r["y_pred"] for r in decided.collect()] == [0, 1, 1]


def test_loss_history_beside_the_estimator(spark, labelled):
    """One pass over both tables gives what the estimator finds with a pass for every tree."""
    table = structural_features(labelled).withColumn("label", ((F.col("id") % 2) * (F.col("id") % 5 > 0).cast("int")).cast("int"))
    train, dev = table.where("id % 4 < 2"), table.where("id % 4 >= 2")
    fit = trees.train_trees(train, dev, rounds=12, depth=4)
    assemble, model = fit.model.stages
    for split, part in (("train", train), ("dev", dev)):
        slow = [x / 2 for x in model.evaluateEachIteration(assemble.transform(part))]
        got = [r["log_loss"] for r in fit.history.where(F.col("split") == split).orderBy("iteration").collect()]
        assert got == pytest.approx(slow, abs=1e-9)
    half = assemble.transform(dev.withColumn("split", F.lit("x")).withColumn("label", F.when(F.col("id") % 3 > 0, F.col("label"))))
    assert trees.loss_history(half, model).count() == 12
    assert trees.loss_history(half.limit(0), model).count() == 0


def test_one_pass_of_ngrams_gives_vectors_and_counts(spark, monkeypatch, sf_dir):
    """The query cuts the n-grams of a text once, for the counts and for the unit vector."""
    from registered.queries import QUERIES

    cuts, cut = [], vectors.word_ngrams
    monkeypatch.setattr(vectors, "word_ngrams", lambda *args, **options: cuts.append(1) or cut(*args, **options))
    QUERIES["hashed_vectors"](spark, sf_dir)
    assert len(cuts) == 1
    df = spark.createDataFrame([(1, "ab cd\nab")], "id long, code string")
    row = vectors.hashed_vectors(df, 1 << 10, counts="n").first()
    assert sum(row["n"].values) == 6 and row["text_vector"].norm(2) == pytest.approx(1.0)
    assert set(row.asDict()) == {"id", "code", "n", "text_vector"}
