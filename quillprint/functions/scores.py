"""Expressions over logits, probabilities and label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold_label(probability: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, 0 at or below it."""
    return (probability > threshold).cast("int")


def softmax_probability(logits: Column, index: int = 1) -> Column:
    """Probability of one class, shifted by the largest logit for stability."""
    z = logits.cast("array<double>")
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.exp(F.get(z, F.lit(index)) - top) / total


def argmax_label(logits: Column) -> Column:
    """Index of the largest logit; the lowest index wins a tie."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def label_text_to_id(label: Column, ids: dict[str, int]) -> Column:
    """Known labels by name, others by the integer after the last underscore, else 0."""
    suffix = F.substring_index(label, "_", -1).try_cast("int")
    if not ids:
        return F.coalesce(suffix, F.lit(0))
    table = F.create_map(*[F.lit(v) for pair in ids.items() for v in pair])
    return F.coalesce(F.try_element_at(table, label), suffix, F.lit(0))
