"""Running sums over an order of all rows, without a window that spans them."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillprint.session import written

#: Rows of a range, about, once there are more ranges than shuffle partitions.
RANGE_ROWS = 500_000
BROADCAST_RANGES = 100_000


def running_sums(
    rows: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    ranges: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """``rows`` with ``<value>_before`` and ``<value>_all`` for every column of ``values``.

    ``before`` sums the value over the rows of the same group that stand earlier
    in ``order`` (nulls first), ``all`` over the whole group; null values count
    zero, null keys are a group. Without ``groups`` all rows are one group. Rows
    that tie in the order stand in any order, one after the other; ``unique``
    says that there are none and spares the column that tells them apart.

    Rows are dealt to ranges of (group, order) of about equal size, so a group
    or a key that holds most of the rows is spread over many. The ranges are
    written once, which fixes them for retried tasks; each is summed by itself
    and shifted by the totals of the group's earlier ranges. Only these totals,
    one row a range and group, meet in one place. Without a number of ``ranges``
    the rows are counted first. Columns may not begin with ``_p_``.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = ranges or max(least, ceil(rows.count() / RANGE_ROWS))
    # Rows that tie in everything else are still dealt to several ranges.
    tie = [] if unique else ["_p_tie"]
    tied = rows if unique else rows.withColumn("_p_tie", F.monotonically_increasing_id())
    sort = [*groups, *order, *tie]
    placed = written(tied.repartitionByRange(parts, *sort).withColumn("_p_range", F.spark_partition_id()), "ranges")
    keys = [*groups, "_p_range"]
    totals = placed.groupBy(*keys).agg(*[F.sum(v).cast("long").alias(f"_p_{v}") for v in values])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_p_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_p_key{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_p_{v}").over(earlier), F.lit(0)).alias(f"_p_{v}") for v in values],
        *[F.coalesce(F.sum(f"_p_{v}").over(whole), F.lit(0)).alias(f"{v}_all") for v in values],
    )
    offsets = written(offsets, "range-totals")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_RANGES else offsets
    own = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in (*order, *tie)])
    own = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[F.coalesce(F.sum(v).over(own).cast("long"), F.lit(0)).alias(f"{v}_before") for v in values])
    same = [F.col(k).eqNullSafe(F.col(f"_p_key{i}")) for i, k in enumerate(keys)]
    sums = {f"{v}_before": F.col(f"{v}_before") + F.col(f"_p_{v}") for v in values}
    return inside.join(offsets, same).withColumns(sums).select(*rows.columns, *sums, *[f"{v}_all" for v in values])
