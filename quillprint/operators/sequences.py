"""Token vocabularies and token-id sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from quillprint.functions.text import WHITESPACE, WORD, clean_code, text_or_empty
from quillprint.session import fresh_path
from quillprint.sources.artifacts import cached_table

# Reserved ids of a sequence.
PAD_ID, UNKNOWN_ID, START_ID, END_ID = 0, 1, 2, 3
RESERVED_IDS = 4
#: Classes of counts to a doubling, in the histogram of a vocabulary.
CLASSES_PER_DOUBLING = 16


def code_tokens(code: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(code, F.lit(rf"[{WORD}]+|[^{WORD}{WHITESPACE}]"), F.lit(0))


def vocabulary(df: DataFrame, size: int = 30_000, code_col: str = "code") -> DataFrame:
    """The ``size`` most frequent tokens as ``(token, n, token_id)``; ties go by token.

    The counts combine on the map side, so a token that makes up a third of
    all text moves once per task. They are written, and a histogram of them
    tells which tokens are too rare to be among the first: the sort that ends
    in one task gets little more than the rows it keeps, but for ties. The
    numbering runs over ``size`` rows only.
    """
    spark = df.sparkSession
    tokens = df.select(F.explode(code_tokens(text_or_empty(F.col(code_col)))).alias("token"))
    counts = cached_table(
        spark,
        fresh_path(spark, "token-counts"),
        lambda: tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")),
    )
    classed = counts.withColumn("_class", F.floor(F.log2("n") * CLASSES_PER_DOUBLING))
    lowest, held = 0, 0
    # At most 64 doublings, so few rows whatever the corpus.
    for row in classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_class")).collect():
        lowest, held = row["_class"], held + row["n"]
        if held >= size:
            break
    frequent = classed.where(F.col("_class") >= lowest).drop("_class")
    top = frequent.orderBy(F.desc("n"), "token").limit(size)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))
    return top.select("token", "n", (rank + RESERVED_IDS - 1).cast("int").alias("token_id"))


def encode_sequences(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int = 512,
    pad: bool = True,
    key: str = "id",
    code_col: str = "code",
    label_col: str = "label",
) -> DataFrame:
    """``(key, labels, input_ids, attention_mask)``, truncated to ``max_length`` ids.

    Start and end ids count towards the length. Without ``pad`` the arrays end
    with the sequence. At most ``max_length`` tokens of a row are looked up
    and gathered again, one small group per input row, so rows with equal or
    null keys stay apart. Whether the vocabulary is copied or shuffled is left
    to the optimizer, and adaptive execution splits hot tokens.
    """
    carried = [F.col(label_col).cast("int").alias("labels")] if label_col in df.columns else []
    names = ["labels"] if carried else []
    head = F.slice(code_tokens(text_or_empty(F.col(code_col))), 1, max_length - 2)
    tagged = df.withColumn("_row", F.monotonically_increasing_id())
    tokens = tagged.select("_row", key, *carried, F.posexplode_outer(head).alias("_pos", "token"))
    found = tokens.join(vocab.select("token", "token_id"), "token", "left").select(
        "_row",
        key,
        *names,
        F.when(
            F.col("_pos").isNotNull(),
            F.struct("_pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id")),
        ).alias("_item"),
    )
    gathered = found.groupBy("_row", key, *names).agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    ids = F.concat(
        F.array(F.lit(START_ID)), F.col("_items")["id"], F.array(F.lit(END_ID))
    )
    return gathered.select(key, *names, ids.alias("input_ids")).select(
        key, *names, *_with_mask(max_length if pad else None)
    )


def _with_mask(padded_to: int | None) -> list[Column]:
    ids = F.col("input_ids")
    mask = F.array_repeat(F.lit(1), F.size(ids))
    if padded_to is None:
        return [ids, mask.alias("attention_mask")]
    gap = F.lit(padded_to) - F.size(ids)
    return [
        F.concat(ids, F.array_repeat(F.lit(PAD_ID), gap)).alias("input_ids"),
        F.concat(mask, F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    ]


def encode_with(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[int]]]],
    max_length: int = 512,
    pad: bool = True,
    key: str = "id",
    code_col: str = "code",
    label_col: str = "label",
    clean: bool = False,
) -> DataFrame:
    """Sequences by a tokenizer of the caller's, loaded once per Python worker.

    ``make_encoder`` returns a function from a batch of texts to lists of ids,
    special ids included; ids past ``max_length`` are cut.
    """

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series([list(ids)[:max_length] for ids in encoder(texts.tolist())])

    code = text_or_empty(F.col(code_col))
    carried = [F.col(label_col).cast("int").alias("labels")] if label_col in df.columns else []
    names = ["labels"] if carried else []
    ids = encode(clean_code(code) if clean else code)
    return df.select(key, *carried, ids.alias("input_ids")).select(
        key, *names, *_with_mask(max_length if pad else None)
    )
