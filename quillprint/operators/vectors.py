"""Hashed n-gram vectors and assembled feature vectors."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, NGram, Normalizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.functions.text import clean_code, word_tokens
from quillprint.operators.lengths import LENGTH_COLUMNS, length_features

DEFAULT_BUCKETS = 1 << 18


def word_ngrams(df: DataFrame, code_col: str = "code", longest: int = 3) -> DataFrame:
    """``df`` with ``ngrams``: word 1- to ``longest``-grams of the cleaned code."""
    out = df.withColumn("_gram1", word_tokens(clean_code(F.col(code_col))))
    for n in range(2, longest + 1):
        out = NGram(n=n, inputCol="_gram1", outputCol=f"_gram{n}").transform(out)
    parts = [f"_gram{n}" for n in range(1, longest + 1)]
    return out.withColumn("ngrams", F.concat(*parts)).drop(*parts)


def hashed_counts(
    df: DataFrame, buckets: int = DEFAULT_BUCKETS, output: str = "counts"
) -> DataFrame:
    """``df`` with the bucket counts of its ``ngrams``."""
    return HashingTF(numFeatures=buckets, inputCol="ngrams", outputCol=output).transform(df)


def hashed_vectors(
    df: DataFrame, buckets: int = DEFAULT_BUCKETS, code_col: str = "code", counts: str | None = None
) -> DataFrame:
    """``df`` with ``text_vector``: bucket counts at unit Euclidean length; with the counts too, if named."""
    counted = hashed_counts(word_ngrams(df, code_col), buckets, counts or "_counts")
    unit = Normalizer(p=2.0, inputCol=counts or "_counts", outputCol="text_vector")
    return unit.transform(counted).drop("_counts", "ngrams")


def text_features(
    df: DataFrame,
    buckets: int = DEFAULT_BUCKETS,
    code_col: str = "code",
    keep: tuple[str, ...] = ("id", "label"),
) -> DataFrame:
    """``keep`` columns that exist and ``features``: text vector, then four lengths.

    N-grams come from cleaned code, lengths from the code as it is.
    """
    kept = [c for c in keep if c in df.columns]
    source = df.select(*kept, code_col)
    measured = hashed_vectors(length_features(source, code_col), buckets, code_col)
    join = VectorAssembler(
        inputCols=["text_vector", *LENGTH_COLUMNS], outputCol="features", handleInvalid="keep"
    )
    # The assembler describes every one of the buckets in column metadata, which
    # each later plan would copy and compare; nothing reads it.
    bare = F.col("features").alias("features", metadata={})
    return join.transform(measured).select(*kept, bare)
