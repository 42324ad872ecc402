"""Contiguous shards of nearly equal size, cut from prefix sums.

In the order of their keys, every document has a place: the bytes of all
documents before it. The places come from totals of ranges of keys, shifted by
the totals of the ranges before. Cutting the whole length at equal targets
gives shards that are ranges of keys. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import text_of, written
from quillprint.operators.prefix import running_sums

#: Bytes that a row takes besides its text.
OVERHEAD = 16
BROADCAST_SHARDS = 100_000


def row_size(text: str | Column, overhead: int = OVERHEAD) -> Column:
    """UTF-8 bytes of the text, none for null, plus the overhead."""
    return (F.octet_length(text_of(text)) + overhead).cast("long")


def text_checksum(text: str | Column) -> Column:
    """CRC-32 of the text's UTF-8 bytes, unsigned; a null text counts as empty."""
    return F.crc32(text_of(text).cast("binary"))


def shard_documents(
    docs: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    text: str = "text",
    overhead: int = OVERHEAD,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(key, size, text_crc32, keep..., shard, slot)``, one row for every row of ``docs``.

    Documents stand by key, null keys first, then by checksum and size; rows equal
    in all of these stand in any order. A document belongs to the shard its
    middle byte falls into when the whole length is cut into ``n_shards`` equal
    stretches, so a shard is off its target by half a document at each end.
    Shards count from 0 and ``slot`` from 0 within a shard, without gaps; a
    shard that lies within one large document stays empty. Null texts count no
    bytes. If nothing has any size, all rows are in shard 0. No rows give none.

    Keys and sizes move twice, texts only if they are among ``keep``, the columns
    of ``docs`` to carry along.
    """
    if n_shards < 1:
        raise ValueError(f"there must be a shard at least, not {n_shards}")
    carried = {f"_kept_{i}": F.col(c) for i, c in enumerate(keep)}
    rows = docs.select(
        F.col(key).alias("_key"), row_size(text, overhead).alias("size"), text_checksum(text).alias("crc"),
        F.lit(1).alias("row"), *[c.alias(n) for n, c in carried.items()],
    )
    placed = running_sums(written(rows, "sizes"), [], ["_key", "crc", "size"], ["size", "row"])
    # Decimals, since twice a length times the number of shards can pass the range of a long.
    middle = F.expr(f"CAST(2 * size_before + size AS DECIMAL(22, 0)) * {int(n_shards)} div CAST(2 * size_all AS DECIMAL(22, 0))")
    shard = F.least(F.coalesce(middle, F.lit(0)), F.lit(n_shards - 1)).cast("int")
    cut = placed.withColumn("shard", F.when(F.col("size_all") > 0, shard).otherwise(0))
    cut = written(cut.drop("size_before", "size_all", "row", "row_all"), "shards")
    first = cut.groupBy("shard").agg(F.min("row_before").alias("first"))
    # At most as many rows as there are shards.
    first = F.broadcast(first) if n_shards <= BROADCAST_SHARDS else first
    return cut.join(first, "shard").select(
        F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"),
        *[F.col(n).alias(c) for n, c in zip(carried, keep, strict=True)], "shard", (F.col("row_before") - F.col("first")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> None:
    """Write all columns of ``docs`` as Parquet, one folder a shard, rows in the order of their slots.

    A shard is written by as many tasks as its rows need. A column of ``docs``
    called ``shard`` or ``slot`` is replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot", key.lower(), "size", "text_crc32")]
    placed = shard_documents(docs, n_shards, key, text, overhead, keep)
    ranged = placed.select(key, *keep, "shard", "slot").repartitionByRange("shard", "slot")
    ranged.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
