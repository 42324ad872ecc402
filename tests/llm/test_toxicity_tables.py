"""The toxicity model learns from every label, and its tables compare words as its counts do."""

import pytest
from pyspark.sql import functions as F

from quillprint.llm import toxicity


def test_every_labelled_document_is_learnt_from(spark):
    """12,000 documents, more than a class was once sampled to."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "awful w").otherwise("plain w"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    model = toxicity.fit_toxicity(docs, labels)
    curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(toxicity.CURVE_FOLDS)) == 0
    learnt = {r.toxic: r["count"] for r in labels.where(~curve).groupBy("toxic").count().collect()}
    counts = {r.gram: (r.ordinary, r.toxic) for r in model.grams.where("gram IN ('\naw', '\npl')").collect()}
    assert counts == {"\naw": (0, learnt[1]), "\npl": (learnt[0], 0)}
    assert not hasattr(toxicity, "MAX_GRAMS") and model.order == toxicity.ORDER


def test_steps_beside_plain_counts_and_both_ways(spark):
    texts = ["bad bat#", "good bag 한글", "bad, bad \U0001f600x", "a good dog", "bat (awful)", "do do", "say bad things", "say good things", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    labels = docs.select("doc_id", F.col("text").rlike("bad|bat").cast("int").alias("toxic"))
    words = ["bad", "bat", "goodness", "dab", "x", "", "한글", "\U0001f600", "unseenword", "things", "ba"]
    for order in (2, 3, 5):
        model = toxicity.fit_toxicity(docs, labels, order=order)
        comparison = toxicity.Comparison(model)
        grams = spark.createDataFrame(sorted({(g,) for w in words for g in toxicity.spelt(w, order)}), "gram string")
        known = toxicity.WordScores({r.gram: r.step for r in toxicity.gram_steps(grams, model).collect()}, order)
        assert [known[w] for w in words] == [pytest.approx(comparison.word(w), abs=1e-12) for w in words]
    more = docs.withColumn("row", F.create_map(F.lit("k"), "doc_id")).withColumn("block", F.lit("old"))
    out = [toxicity.with_features(more, model, "text", "x", held) for held in (0, 10**6)]
    assert [o.columns for o in out] == [["doc_id", "text", "row", "block", "x"]] * 2
    first, second = (sorted((r.doc_id, r.text or "", r.row["k"], r.block, r.x) for r in o.collect()) for o in out)
    assert first == second
    assert [r[:3] for r in first] == [(i, t or "", i) for i, t in enumerate(texts * 3)]
