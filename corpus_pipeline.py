"""A training corpus from raw documents: judged, ranked, deduplicated, cleaned of personal data, packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.llm import jaccard, packing, pii, ranking, rules
from quillprint.llm.support import fold_of, table, written
from quillprint.session import fresh_path, scratch_space

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Whole groups as signatures: at 0.8 they meet fewer unlinked sets than subsets of parts (figures in the README).
NEAR = jaccard.Rule(words=5, percent=80, errors=0, parts=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the surface rules and look more like trusted text than like the raw corpus."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.quality_rules(docs, rules.fit_ratios(docs, trusted)).where("quality.kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose strength lies above the learnt quantile."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold_of("doc_id", 4) != 2)
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Learnt from the labelled raw documents: the rules have already removed most of the poor ones from ``docs``.
    scored = ranking.score_quality(docs, ranking.fit_ranking(raw, labels))
    return scored.where(F.col("quality_score") >= ranking.CUT).select(*COLUMNS)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` returns, written; the tables it was made from are removed, since later stages need their space."""
    path = fresh_path(spark, name)
    with scratch_space(spark):
        made = build()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last.

    Rows are told apart by a hash of their id and text, so rows that share an id stay unless
    their texts are linked; of rows equal in both, one stays. Rows without words are linked with nothing
    but such repetitions of themselves.
    """
    marked = docs.select(F.xxhash64("doc_id", "text").alias("_row"), *COLUMNS)
    groups = settled(spark, "groups", lambda: jaccard.similar_documents(marked, NEAR, key="_row").select("_row", "component_id"))
    ids = marked.select("_row", "doc_id").join(groups.distinct(), "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_kept"))
    first = written(first, "first")
    kept = marked.join(first, F.col("_row") == F.col("_kept"), "left_semi")
    # Repetitions alone are compared as rows; they are few ids, whatever their number.
    again = written(groups.groupBy("_row").count().where("count > 1").select("_row"), "repeated")
    once = kept.join(again, "_row", "left_anti")
    return once.unionByName(kept.join(again, "_row", "left_semi").dropDuplicates(["_row"])).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    hidden = pii.mask_personal_data(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hidden.select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Hashed n-grams, a learnt ranking and token ids have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
