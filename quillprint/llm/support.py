"""Pieces that several operators share: words, folds, written tables, fixed-size arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.session import written

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def spaced(column: str | Column) -> Column:
    """The text with every white-space character of the word rule made a space."""
    text = text_of(column)
    for other in SPACES[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return text


def words_of(column: str | Column) -> Column:
    """Words between runs of white space; an empty array for a text without any."""
    return F.array_remove(F.split(text_of(column), r"[\x20\x09-\x0D]+"), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where lambdas read it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of letters: ``name`` or a longer one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column, whose value is worked out before any filter or projection put on top.

    The value passes through a generator of one row. A filter on a plain column
    would be moved below the steps that lead to it, each use repeating them all.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], F.explode(F.array(value)).alias(name))


def settled_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``(_key, good)``: each key once, ``good`` where its labels are 1 more often than not.

    Null keys and labels are skipped, and so is a key whose labels are tied.
    """
    ones, rows = F.count_if(F.col(label) == 1), F.count(label)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((2 * ones - rows).alias("_lead"))
    return known.where("_lead != 0").select("_key", (F.col("_lead") > 0).alias("good"))


def fold_of(key: str, folds: int) -> Column:
    """The remainder of the key's checksum: which part of the rows a row belongs to."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def dense_array(df: DataFrame, index: str, values: dict[str, Column], size: int) -> DataFrame:
    """One row of arrays, one array a value, element i being the row with that index; zero where none is.

    ``size`` bounds the row. Every index must lie below it and occur once.
    """
    spark = df.sparkSession
    zeros = spark.range(size).select(
        F.col("id").cast("long").alias(index), *[F.lit(0).cast(t).alias(n) for n, t in df.dtypes if n in values]
    )
    full = df.select(F.col(index).cast("long").alias(index), *values).unionByName(zeros)
    one = full.groupBy(index).agg(*[F.sum(n).alias(n) for n in values])
    packed = one.agg(F.sort_array(F.collect_list(F.struct(index, *values))).alias("rows"))
    return packed.select(*[F.col(f"rows.{n}").alias(n) for n in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(side: DataFrame, limit: int) -> DataFrame:
    """The side of a join, broadcast only if it was counted and has at most ``limit`` narrow rows."""
    return F.broadcast(side) if side.count() <= limit else side
