"""Quality classifier: a Bradley-Terry ranking learnt from preference pairs.

A good document is preferred to a poor one. Logistic loss on the differences of
their features gives every document a strength; a quantile of the strengths of
the labelled documents becomes the threshold. Features are DataFrame
expressions of the text alone; the fit is Spark's logistic regression without
intercept over the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.rules import windows_of, without, word_hashes
from quillprint.llm.support import bound, settled_labels, spaced, spare, text_of, with_settled, written
from quillprint.operators.prefix import RANGE_ROWS, running_sums

SLOTS_PER_ROW = 4
CUT = 0.7
PUNCTUATION = {"symbols": "#*$%&|<>", "shouts": "!?", "stops": ".,", "digits": "0123456789"}


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the strength that scores ``CUT``."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    spread: float


def features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, an array of double, and its name; all zero for a text without words."""
    body = text_of(text)
    h, ls, ws, rs, name = (spare(docs, f"_r_{n}") for n in ("hashes", "lines", "windows", "runs", "features"))
    steps = docs.withColumns({h: word_hashes(text), ls: F.split(body, "\n")})
    hashes, lines = F.col(h), F.col(ls)
    steps = steps.withColumns(
        {
            ws: windows_of(hashes),
            rs: F.size(F.filter(F.transform(hashes, lambda x, i: x == F.get(hashes, i + 1)), lambda same: same)),
        }
    )
    windows, n, chars = F.col(ws), F.size(h), F.length(body)
    letters = F.length(without(spaced(text), " "))
    values = [
        F.log1p(n),
        F.log1p(letters / n),
        F.size(F.array_distinct(hashes)) / n,
        F.col(rs) / n,
        F.when(F.size(windows) > 0, F.size(F.array_distinct(windows)) / F.size(windows)).otherwise(1.0),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(chars / F.size(lines)),
        F.regexp_count(body, F.lit(r"\p{Lu}")) / chars,
        *[(chars - F.length(without(body, c))) / chars for c in PUNCTUATION.values()],
    ]
    measured = F.array(*[v.cast("double") for v in values])
    made = steps.withColumn(name, F.when(n > 0, measured).otherwise(doubles([0.0] * len(values))))
    return made.drop(h, ls, ws, rs), name


def preference_pairs(rows: DataFrame, slots: int, per_row: int = SLOTS_PER_ROW) -> DataFrame:
    """``(difference, label)``: good minus poor features, and the mirror image.

    Rows meet in slots chosen by hashes, a few for each row, so the number of
    pairs grows with the rows and not with their square.
    """
    dealt = rows.select(
        "good", "x", F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(slots)) for k in range(per_row)])).alias("slot")
    )
    good = dealt.where("good").select("slot", F.col("x").alias("a"))
    poor = dealt.where("NOT good").select("slot", F.col("x").alias("b"))
    gaps = good.join(poor, "slot").select(F.zip_with("a", "b", lambda a, b: a - b).alias("gap"))
    ways = [(F.col("gap"), 1.0), (F.transform("gap", lambda v: -v), 0.0)]
    return gaps.select(F.inline(F.array(*[F.struct(d.alias("difference"), F.lit(y).alias("label")) for d, y in ways])))


def fit_ranking(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    text: str = "text",
    regularization: float = 1e-3,
) -> Ranking:
    """Learn from the rows of ``labels`` (``key``, ``label`` 0 or 1; nulls are skipped).

    Of several labels of a key the more frequent counts, and none if they are tied.
    All of them are looked up in ``docs`` and used, for the moments, the pairs
    and the threshold. Rows are measured before they meet their labels: a join
    that shuffles moves a few numbers a row and no text. The threshold is the
    quantile of the strengths that leaves the share of poor labels below it. If
    one of the two labels is missing there is nothing to prefer: all weights are
    zero and every document gets the cut itself.
    """
    known = settled_labels(labels, key, label)
    measured, name = features(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text")
    found = measured.select("_key", F.col(name).alias("raw")).join(known, "_key")
    rows = written(found.select(F.col("_key").alias("id"), "good", "raw"), "labelled")
    width = rows.select(F.max(F.size("raw"))).first()[0]
    if not width:
        return Ranking([], [], [], 0.0, 1.0)
    moments = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((~F.col("good")).cast("int")).alias("poor"),
        *[F.avg(F.get("raw", F.lit(i))).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.get("raw", F.lit(i))).alias(f"s{i}") for i in range(width)],
    ).first()
    mean, scale = [moments[f"m{i}"] for i in range(width)], [moments[f"s{i}"] or 1.0 for i in range(width)]
    if not 0 < moments["poor"] < 1:
        return Ranking(mean, scale, [0.0] * width, 0.0, 1.0)
    ready = rows.select("id", "good", standardised(F.col("raw"), mean, scale).alias("x"))
    pairs = preference_pairs(ready, moments["n"]).select(array_to_vector("difference").alias("features"), "label")
    model = LogisticRegression(fitIntercept=False, regParam=regularization, standardization=False, maxIter=100).fit(
        written(pairs, "pairs")
    )
    weights = [float(w) for w in model.coefficients]
    strengths = written(ready.select("good", strength(F.col("x"), weights).alias("s")), "strengths")
    cut, low, high = quantiles(strengths, "s", moments["n"], [moments["poor"], 0.25, 0.75])
    edge = strengths.agg(
        F.max(F.when(~F.col("good") & (F.col("s") <= cut), F.col("s"))).alias("below"),
        F.min(F.when(F.col("good") & (F.col("s") >= cut), F.col("s"))).alias("above"),
    ).first()
    # Half way between the nearest labelled documents on both sides of the quantile.
    middle = cut if None in tuple(edge) else (edge["below"] + edge["above"]) / 2
    return Ranking(mean, scale, weights, middle, max(high - low, 1e-6))


def quantiles(rows: DataFrame, value: str, n: int, shares: Sequence[float]) -> list[float]:
    """Exact quantiles of the ``n`` values, those between two values in proportion; no task holds all of them."""
    places = [share * (n - 1) for share in shares]
    wanted = {int(edge(p)) for p in places for edge in (floor, ceil)}
    ones = rows.select(value, F.lit(1).alias("_q_one"))
    placed = running_sums(ones, [], [value], ["_q_one"], ranges=ceil(n / RANGE_ROWS))
    found = placed.where(F.col("_q_one_before").isin(*wanted)).select("_q_one_before", value).collect()
    at = {place: v for place, v in found}
    sides = [(p, at[floor(p)], at[ceil(p)]) for p in places]
    return [low if low == high else (ceil(p) - p) * low + (p - floor(p)) * high for p, low, high in sides]


def doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def standardised(raw: Column, mean: list[float], scale: list[float]) -> Column:
    """The features at mean 0 and scale 1; ``raw`` occurs once in the expression."""
    return F.zip_with(F.zip_with(raw, doubles(mean), lambda v, m: v - m), doubles(scale), lambda v, s: v / s)


def strength(x: Column, weights: list[float]) -> Column:
    """The weighted sum of the features; ``x`` occurs once in the expression."""
    return F.aggregate(F.zip_with(x, doubles(weights), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)


def score_quality(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``quality_score`` between 0 and 1.

    Strengths above the model's threshold score ``CUT`` or more. Null texts
    score like empty ones. Rows are scored one by one; other columns pass
    through whatever their names, and an existing ``quality_score`` is replaced.
    The score may be filtered on: it is settled before.
    """
    if not model.weights:
        return with_settled(docs, "quality_score", F.lit(CUT))
    made, name = features(docs, text)
    above = (strength(standardised(F.col(name), model.mean, model.scale), model.weights) - model.threshold) / model.spread

    # The logistic curve, moved so that the threshold itself scores the cut.
    def curve(above: Column) -> Column:
        odds = (1 - CUT) / CUT
        score = 1 / (1 + odds * F.exp(F.greatest(F.least(-above, F.lit(30.0)), F.lit(-30.0))))
        return F.when(above >= 0, F.greatest(score, F.lit(CUT))).otherwise(score)

    return with_settled(made, "quality_score", bound(above, curve)).drop(name)
