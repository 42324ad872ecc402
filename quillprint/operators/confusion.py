"""Classification metrics from confusion counts.

Predictions are aggregated once to ``(keys, y_true, y_pred, n)``, combined on
the map side; every metric is arithmetic on that small table. ``keys`` are
usually ``model`` and ``split``; none means one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per distinct value, most frequent first."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *columns)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Non-empty confusion cells."""
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell over the union of true and predicted labels, empty ones as 0.

    The observed cells and one zero cell per label pair are summed, so the
    matrix costs one more small aggregation. Its size is the square of the
    number of classes because that is what a confusion matrix is.
    """
    cells = confusion_counts(preds, keys)
    seen = cells.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("label"))
    labels = seen.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = (
        labels.select(*keys, "labels", F.explode("labels").alias("y_true"))
        .select(*keys, "y_true", F.explode("labels").alias("y_pred"))
        .withColumn("n", F.lit(0).cast("long"))
    )
    return (
        cells.unionByName(grid).groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    )


def confusion_wide(
    preds: DataFrame, labels: Sequence[int] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per true or predicted label with a ``pred_<label>`` column each.

    Without ``labels`` the columns are those of the cells, looked up in one small
    job. With them, a label outside the list fails the job: no cell is lost.
    """
    cells = confusion_matrix(preds, keys)
    if labels is None:
        labels = [r[0] for r in cells.select("y_true").distinct().orderBy("y_true").collect()]
    else:
        known = F.col("y_pred").isin(*labels) & F.col("y_true").isin(*labels)
        message = F.concat(F.lit("a label is not listed: "), F.to_json(F.struct("y_true", "y_pred")))
        cells = cells.withColumn("n", F.when(known, F.col("n")).otherwise(F.raise_error(message).cast("long")))
    wide = cells.groupBy(*keys, "y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
    return wide.select(
        *keys,
        "y_true",
        *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"pred_{v}") for v in labels],
    )


def confusion_heatmap(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The matrix with a flag on cells above half of the largest one."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return confusion_matrix(preds, keys).withColumn(
        "above_half", F.col("n") > F.max("n").over(whole) / 2
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def class_metrics(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label seen as true or predicted."""
    n, hit = F.col("n"), F.col("y_true") == F.col("y_pred")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("y_true").alias("label"),
            F.when(hit, n).otherwise(zero).alias("tp"),
            n.alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col("y_pred").alias("label"),
            zero.alias("tp"),
            zero.alias("support"),
            n.alias("predicted"),
        ),
    )
    totals = (
        confusion_counts(preds, keys)
        .select(*keys, F.inline(sides))
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    return totals.select(
        *keys,
        "label",
        "tp",
        "predicted",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def _weighted(metric: str) -> Column:
    return F.sum(F.col(metric) * F.col("support")) / F.sum("support")


def _summary() -> dict[str, Column]:
    return {
        "accuracy": F.sum("tp").cast("double") / F.sum("support"),
        "f1_macro": F.avg("f1"),
        "precision_macro": F.avg("precision"),
        "recall_macro": F.avg("recall"),
        "f1_weighted": _weighted("f1"),
        "precision_weighted": _weighted("precision"),
        "recall_weighted": _weighted("recall"),
    }


def model_metrics(
    preds: DataFrame, keys: Sequence[str] = ("model", "split"), metrics: Sequence[str] | None = None
) -> DataFrame:
    """One row per group: accuracy, macro and weighted scores, row count."""
    summary = _summary()
    wanted = metrics or list(summary)
    return class_metrics(preds, keys).groupBy(*keys).agg(
        *[summary[m].alias(m) for m in wanted], F.sum("support").alias("n")
    )


def classification_report(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Report rows: each class, then ``accuracy``, ``macro avg`` and ``weighted avg``.

    Grouping sets give the class rows and the totals in one aggregation.
    """
    totals = _summary()
    columns = [F.col(k) for k in keys]
    levels = class_metrics(preds, keys).groupingSets(
        [[*columns, F.col("label")], columns], *columns, F.col("label")
    ).agg(
        F.grouping("label").alias("_total"),
        *[totals[m].alias(m) for m in totals],
        F.sum("support").alias("support"),
    )

    def row(name: Column, kind: str) -> Column:
        return F.struct(
            name.alias("row"),
            *[F.col(f"{m}_{kind}").alias(m) for m in ("precision", "recall", "f1")],
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("row"),
        *[F.col("accuracy").alias(m) for m in ("precision", "recall", "f1")],
    )
    rows = F.when(
        F.col("_total") == 1,
        F.array(accuracy, row(F.lit("macro avg"), "macro"), row(F.lit("weighted avg"), "weighted")),
    ).otherwise(F.array(row(F.col("label").cast("string"), "macro")))
    return levels.select(*keys, F.inline(rows), "support")


def metrics_long(metrics: DataFrame, keys: Sequence[str] = ("model", "split")) -> DataFrame:
    """``(keys, metric, value)`` rows; metrics a group does not have are skipped."""
    values = [c for c in metrics.columns if c not in keys]
    doubles = metrics.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(list(keys), values, "metric", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def comparison_table(
    metrics: DataFrame,
    keys: Sequence[str] = ("model",),
    wanted: Sequence[str] = ("accuracy", "f1_macro", "roc_auc"),
) -> DataFrame:
    """One row per model with the compared metrics, null where absent."""
    return metrics.select(
        *keys,
        *[
            (F.col(m).cast("double") if m in metrics.columns else F.lit(None).cast("double")).alias(m)
            for m in wanted
        ],
    )
