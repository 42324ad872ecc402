"""The operators applied to the driver's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.llm import chat, embeddings, infill, jaccard, lm, merkle, packing, pieces, pii, ranking, rules, shards, toxicity
from quillprint.llm.support import fold_of, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of the template's own marks, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = [(-1, 0, "user", chat.MARKS_SAMPLE), (-1, 1, "assistant", chat.MARKS_SAMPLE)]
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(turns.columns, mark, strict=True)]) for mark in marks]
    extra = spark.range(1).select(F.inline(F.array(*rows)))
    records = chat.laid_out(turns.unionByName(extra))
    formatted = chat.format_chats(records, "record")
    return chat.read_back_digest(formatted, "conv_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    judged = rules.quality_rules(docs, rules.fit_ratios(docs, trusted))
    return judged.select("doc_id", "quality.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_documents(docs, jaccard.Rule(words=3, percent=90))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, their checksum, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoding_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold_of("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    score = F.col("toxicity")
    return scored.select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embeddings.near_duplicates(vectors)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(docs)
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.BASE_KINDS), F.sha2(pii.span_digest(base), 256).alias("base_sha256"), pii.span_digest(F.col("pii")).alias("spans")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score_documents(docs, fold_of("doc_id", 10) != 0)
    return scored.withColumn("held_out", fold_of("doc_id", 10) == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold_of("doc_id", 4) != 2)
    scored = ranking.score_quality(docs, ranking.fit_ranking(docs, labels))
    score = F.col("quality_score")
    return scored.select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted")
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = infill.fill_in_middle(docs)
    fim = F.col("fim")
    back = infill.restored(fim["output"], fim["form"])
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2(fim["output"], 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shards.shard_documents(docs, 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, held against the root by a row that some have been tampered with."""
    docs = table(spark, sf_dir, "documents").select(*merkle.LEAF_COLUMNS)
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    forged = merkle.leaf_of([*map(F.col, merkle.LEAF_COLUMNS[:-1]), F.when(marked, lowered).otherwise(F.col("text"))])
    found = merkle.manifest(docs, carry={"shown": F.when(marked, forged)})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("shown", "leaf"), F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_quality_rules, op3_jaccard_join, op4_best_fit_packing, op5_sentencepiece, op6_toxicity,
        op7_embedding_near_dedup, op8_pii, op9_lm_scoring, op10_quality_classifier, op11_fill_in_middle, op12_sharding,
        op13_merkle_manifest,
    )
}
