"""ROC and precision-recall curves at every distinct score.

The cumulative counts are a two-level prefix sum. Rows are first aggregated
per score, which also collapses any hot score; distinct scores are then dealt to
ranges of about equal size, summed within each range, and shifted by the totals
of the ranges above. No window ever spans a whole curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.operators.prefix import running_sums

INFINITY = float("inf")


def score_counts(
    preds: DataFrame, keys: Sequence[str] = (), score: str = "y_proba", label: str = "y_true"
) -> DataFrame:
    """Positives and negatives per distinct score; rows without a score are left out."""
    positive = F.col(label) == 1
    scored = preds.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    return scored.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def cumulative_counts(counts: DataFrame, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``counts`` with ``tp`` and ``fp`` at each threshold and the group's totals.

    The distinct scores are written once, dealt to ranges from the highest down;
    ``ranges`` is their number, that of the shuffle partitions if none is given.
    """
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    falling = counts.withColumn("_down", -F.col("score"))
    summed = running_sums(falling, list(keys), ["_down"], ["pos", "neg"], ranges, unique=True)
    return summed.select(
        *keys,
        "score",
        "pos",
        "neg",
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("neg_before") + F.col("neg")).alias("fp"),
        F.col("pos_all").alias("positives"),
        F.col("neg_all").alias("negatives"),
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole)


def _recall() -> Column:
    """True positive rate; 1 throughout where there is no positive at all."""
    return F.coalesce(_rate(F.col("tp"), F.col("positives")), F.lit(1.0))


def sweep(
    preds: DataFrame,
    keys: Sequence[str] = (),
    score: str = "y_proba",
    label: str = "y_true",
    ranges: int | None = None,
) -> DataFrame:
    """Cumulative counts of predictions: what all curves of a table are drawn from.

    The predictions are read once, here; the table reads what that wrote. Where
    several curves are wanted, pass it to the ``*_of_sweep`` functions.
    """
    return cumulative_counts(score_counts(preds, keys, score, label), keys, ranges)


def _at_top() -> Column:
    """Whether a threshold is the highest of its group."""
    return (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))


def roc_of_sweep(swept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    point = F.struct(
        F.col("score").alias("threshold"),
        _rate(F.col("fp"), F.col("negatives")).alias("fpr"),
        _rate(F.col("tp"), F.col("positives")).alias("tpr"),
    )
    start = F.struct(
        F.lit(INFINITY).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    rows = F.when(_at_top(), F.array(start, point)).otherwise(F.array(point))
    return swept.select(*keys, F.inline(rows))


def pr_of_sweep(swept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    point = F.struct(
        F.col("score").alias("threshold"),
        _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _recall().alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    rows = F.when(_at_top(), F.array(point, end)).otherwise(F.array(point))
    return swept.select(*keys, F.inline(rows))


def areas_of_sweep(swept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each threshold adds one trapezoid, whose other side follows from its own
    counts: the point before has ``tp - pos`` and ``fp - neg``.
    """
    pos, neg, tp, fp = (F.col(c) for c in ("pos", "neg", "tp", "fp"))
    tp_before, fp_before = tp - pos, fp - neg
    precision = _rate(tp, tp + fp)
    precision_before = F.coalesce(_rate(tp_before, tp_before + fp_before), F.lit(1.0))
    no_positives = F.col("positives") == 0
    step = F.when(no_positives, _at_top().cast("double")).otherwise(_rate(pos, F.col("positives")))
    # Twice the ROC area in whole units: exact up to the final division.
    # Decimals, since a product of two row counts can pass the range of a long.
    wide = "decimal(19,0)"
    roc_units = F.sum(neg.cast(wide) * (tp + tp_before).cast(wide))
    square = F.max("positives").cast("double") * F.max("negatives")
    return swept.groupBy(*keys).agg(
        F.try_divide(roc_units.cast("double") / 2, square).alias("roc_auc"),
        F.sum(step * (precision + precision_before) / 2).alias("pr_auc"),
    )


def roc_points(preds: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """``(keys, threshold, fpr, tpr)`` with the start point at an infinite threshold.

    ``options`` are those of ``sweep``, here and below.
    """
    return roc_of_sweep(sweep(preds, keys, **options), keys)


def pr_points(preds: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """``(keys, threshold, precision, recall)`` with the end point (1, 0)."""
    return pr_of_sweep(sweep(preds, keys, **options), keys)


def curve_areas(preds: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Trapezoid areas ``roc_auc`` and ``pr_auc`` per group.

    The ROC area is null when one class is missing.
    """
    return areas_of_sweep(sweep(preds, keys, **options), keys)
