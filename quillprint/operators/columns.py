"""Column-level shaping of feature tables: casting, aligning, stacking."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Only ``keep`` and the columns of a numeric type."""
    keep = set(keep)
    return df.select(
        *[
            f.name
            for f in df.schema.fields
            if f.name in keep or isinstance(f.dataType, T.NumericType)
        ]
    )


def as_doubles(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Numeric columns as doubles with missing and NaN values as 0."""
    keep = set(keep)

    def cast(f: T.StructField):
        if f.name in keep or not isinstance(f.dataType, T.NumericType):
            return F.col(f.name)
        return F.coalesce(F.nanvl(F.col(f.name).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(
            f.name
        )

    return df.select(*[cast(f) for f in df.schema.fields])


def sorted_columns(df: DataFrame, first: Iterable[str] = ()) -> DataFrame:
    """``first`` as given, then the other columns by name."""
    first = list(first)
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def align_to(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly ``keep`` and ``columns``: surplus ones dropped, absent or null ones 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
            if c in have
            else F.lit(0.0).alias(c)
            for c in columns
        ],
    )


def int_label(df: DataFrame, label: str = "label") -> DataFrame:
    """The label as an int, where there is one."""
    if label not in df.columns:
        return df
    return df.withColumn(label, F.col(label).cast("int"))


def stack(*frames: DataFrame, fill: float | None = None) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out if fill is None else out.fillna(fill)
