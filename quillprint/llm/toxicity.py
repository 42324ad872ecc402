"""Toxicity by class-conditional Kneser-Ney models of characters.

Two models give each character of a word a probability after the characters
before it: one learnt from toxic documents, one from ordinary ones. They differ
in their longest contexts only; below these both back off to the same counts,
so what neither class has seen counts for nothing. A word is compared by its
log-likelihoods divided by its length, a document by its mean word and by its
most toxic words; a logistic curve, fitted on labelled documents that the
models have not seen, makes the comparison a score.

The models are tables, learnt from all labelled documents. Joins with them work
out the difference that each distinct gram of the scored texts makes. If these are
few, every task gets them; if not, texts are dealt into blocks of bounded size, and
each block gets those of its own grams. A document's features are the same either way.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillprint.llm.support import settled_labels, small_or_shuffled, spare, text_of, with_settled, words_of, written

ORDER = 5
DISCOUNT = 0.75
#: One labelled document in so many fits the logistic curve and not the models.
CURVE_FOLDS = 4
#: Labels that are sent to every task instead of being shuffled with the texts.
BROADCAST_IDS = 200_000
#: Distinct words, and grams, that a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Differences of more grams than these are joined to blocks of texts instead of being sent to every task.
HELD_STEPS = 1_000_000
BLOCK_CHARS = 16_000_000
#: Tasks that blocks are dealt to, at most; a task takes its blocks one after the other.
BLOCK_TASKS = 20_000
EDGE = "\n"
# Marks that do not belong to a word at whose edge they stand.
MARKS = ".,;:!?\"'()|#$%&*<>"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOP_WORDS = 3
#: The mean word, the most toxic ones, and the logarithm of the number of words, against which those are judged.
WIDTH = TOP_WORDS + 2


@dataclass(frozen=True)
class Model:
    """Counts of characters after contexts: of each class for the longest, of both together for the shorter."""

    order: int
    grams: DataFrame | None = None  # gram, ordinary, toxic: context + character
    shorter: DataFrame | None = None  # gram, n: numbers of different characters before a shorter context + character
    weights: tuple[float, ...] = ()
    intercept: float = 0.0

    @cached_property
    def longest(self) -> tuple[dict[str, int], dict[str, int]]:
        """The counts of the ordinary and the toxic class, brought to the driver: for a look at small models."""
        rows = self.grams.collect()
        return tuple({r["gram"]: r[c] for r in rows if r[c]} for c in ("ordinary", "toxic"))

    @cached_property
    def shared(self) -> dict[str, int]:
        """The shorter counts, brought to the driver: for a look at small models."""
        return {r["gram"]: r["n"] for r in self.shorter.collect()}


class Comparison:
    """Length-normalised difference of a word's two log-likelihoods, by a small model's counts; what ``gram_steps`` does by joins."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.totals = [self.sums(c) for c in model.longest]
        self.shared = self.sums(model.shared)
        self.characters = len({g[-1] for g in model.shared}) + 1

    @staticmethod
    def sums(counts: dict[str, int]) -> dict[str, tuple[int, int]]:
        """Per context: the sum of its counts, and how many characters follow it."""
        out: dict[str, list[int]] = {}
        for gram, n in counts.items():
            s = out.setdefault(gram[:-1], [0, 0])
            s[0] += n
            s[1] += 1
        return {k: (a, b) for k, (a, b) in out.items()}

    def lower(self, context: str, ch: str) -> float:
        """The shared probability; the shortest context falls back on all characters alike."""
        p = 1 / self.characters
        for k in range(len(context), -1, -1):
            h = context[k:]
            if s := self.shared.get(h):
                p = (max(self.model.shared.get(h + ch, 0) - DISCOUNT, 0) + DISCOUNT * s[1] * p) / s[0]
        return p

    def step(self, gram: str) -> float:
        """The difference that the last character makes after those before it."""
        h, ch = gram[:-1], gram[-1]
        seen = [t.get(h) for t in self.totals]
        if seen == [None, None]:
            return 0.0
        p = self.lower(h[1:], ch)
        logs = []
        for s, counts in zip(seen, self.model.longest, strict=True):
            q = p if s is None else (max(counts.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * s[1] * p) / s[0]
            logs.append(math.log(q))
        return logs[1] - logs[0]

    def word(self, word: str) -> float:
        """The mean step."""
        grams = spelt(word, self.model.order)
        return sum(self.step(g) for g in grams) / len(grams)


def spelt(word: str, order: int) -> list[str]:
    """For each character of a word after its first edge, the context and itself."""
    marked = EDGE + word + EDGE
    return [marked[max(0, end - order) : end] for end in range(2, len(marked) + 1)]


class WordScores(dict):
    """The mean step of each word asked for; grams without a step make no difference."""

    def __init__(self, steps: dict[str, float], order: int) -> None:
        super().__init__()
        self.steps, self.order = steps, order

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        grams = spelt(word.strip(MARKS), self.order)
        self[word] = score = sum(self.steps.get(g, 0.0) for g in grams) / len(grams)
        return score


def features(text: str, known: WordScores) -> list[float]:
    """The mean word, then the most toxic different words; zeros stand for words that are not there."""
    words = Counter(WORDS.findall(text.lower()))
    if not words:
        return [0.0] * WIDTH
    scores = {w: known[w] for w in words}
    mean = sum(scores[w] * n for w, n in words.items()) / words.total()
    top = heapq.nlargest(TOP_WORDS, scores.values())
    return [mean, *top, *[0.0] * (TOP_WORDS - len(top)), math.log1p(words.total())]


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """``(gram, ordinary, toxic)`` of ``words (word, ordinary, toxic)``: contexts with the character after them."""
    marks = "[" + re.escape(MARKS) + "]+"
    word = F.concat(F.lit(EDGE), F.regexp_replace("word", f"^{marks}|{marks}$", ""), F.lit(EDGE))
    marked = words.select(word.alias("word"), "ordinary", "toxic")
    ends = F.sequence(F.lit(2), F.length("word"))
    size = F.least(F.lit(order), F.col("end"))
    grams = marked.select("word", "ordinary", "toxic", F.explode(ends).alias("end"))
    grams = grams.select("ordinary", "toxic", F.substring("word", F.col("end") - size + 1, size).alias("gram"))
    return grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def without_first(gram: str) -> Column:
    return F.expr(f"substring({gram}, 2)")


def context_of(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def continuation_counts(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, n)``: for every shorter gram, how many different longer ones of ``grams (gram)`` end in it, down to single characters."""
    layer, layers = grams.select("gram"), []
    for _ in range(max(1, order - 1)):
        shorter = layer.where(F.length("gram") > 1).groupBy(without_first("gram").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        layers.append(written(shorter, "shorter"))
        layer = layers[-1].select("gram")
    out = layers[0]
    for other in layers[1:]:
        out = out.unionByName(other)
    return out.groupBy("gram").agg(F.sum("n").alias("n"))


def gram_steps(grams: DataFrame, model: Model) -> DataFrame:
    """``(gram, step)`` of those distinct ``grams (gram)`` whose context some class has: the logarithm of toxic to ordinary probability."""
    classes = [[F.sum(c).alias(f"{c}_sum"), F.count_if(F.col(c) > 0).alias(f"{c}_types")] for c in ("ordinary", "toxic")]
    totals = model.grams.groupBy(context_of("gram").alias("context")).agg(*classes[0], *classes[1])
    asked = grams.withColumn("context", context_of("gram")).join(totals, "context").join(model.grams, "gram", "left")
    asked = written(asked, "asked")
    # The shared probability is built up from the shortest suffix; a context that was never seen passes its shorter one on.
    ends = asked.select("gram", F.explode(F.expr("sequence(1, length(gram) - 1)")).alias("k")).withColumn("suffix", F.expr("right(gram, k)"))
    sums = model.shorter.groupBy(context_of("gram").alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    counts = model.shorter.withColumnRenamed("gram", "suffix")
    suffixes = ends.select("suffix").distinct().withColumn("context", context_of("suffix"))
    suffixes = suffixes.join(sums, "context").join(counts, "suffix", "left").select("suffix", "n", "total", "types")
    found = ends.join(suffixes, "suffix").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("k", "n", "total", "types"))).alias("lower"))
    characters = model.shorter.select(F.expr("right(gram, 1)").alias("ch")).distinct().count() + 1

    def backed(n: Column, total: Column, types: Column, p: Column) -> Column:
        return (F.greatest(F.coalesce(n, F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * types * p) / total

    shared = F.aggregate(F.coalesce("lower", F.array()), F.lit(1 / characters), lambda p, x: backed(x["n"], x["total"], x["types"], p))
    both = asked.join(found, "gram", "left").withColumn("p", shared)
    logs = {
        c: F.log(F.when(F.col(f"{c}_types") == 0, F.col("p")).otherwise(backed(F.col(c), F.col(f"{c}_sum"), F.col(f"{c}_types"), F.col("p"))))
        for c in ("ordinary", "toxic")
    }
    return both.select("gram", (logs["toxic"] - logs["ordinary"]).alias("step"))


def own_grams(texts: Iterable[str | None], order: int, words: set[str], grams: set[str]) -> set[str]:
    """Grams of ``texts`` that are not among ``grams``, which they join, as their words join ``words``."""
    new = {w.strip(MARKS) for t in texts for w in WORDS.findall((t or "").lower())} - words
    found = {g for w in new for g in spelt(w, order)} - grams
    words |= new
    grams |= found
    return found


def distinct_grams(docs: DataFrame, order: int) -> DataFrame:
    """``(gram)``: the distinct grams of the words of ``docs (text)``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: set[str] = set()
        grams: set[str] = set()
        for batch in batches:
            for remembered in (words, grams):
                if len(remembered) > REMEMBERED:
                    remembered.clear()
            found = own_grams(batch.column(0).to_pylist(), order, words, grams)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["gram"])

    return docs.mapInArrow(find, "gram string").distinct()


def with_features(docs: DataFrame, model: Model, text: str, into: str, held: int = HELD_STEPS) -> DataFrame:
    """``docs`` with an array ``into`` besides its columns; rows in any order if there are more than ``held`` steps."""
    order = model.order
    steps = written(gram_steps(distinct_grams(docs.select(text_of(text).alias("text")), order), model), "steps")
    if steps.count() > held:
        return features_by_blocks(docs, steps, order, text, into)
    everywhere = {r["gram"]: r["step"] for r in steps.collect()}

    @F.pandas_udf("array<double>")
    def compare(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordScores(everywhere, order)
        for series in texts:
            yield pd.Series([features(t, known) for t in series], dtype=object)

    return docs.withColumn(into, compare(text_of(text)))


def features_by_blocks(docs: DataFrame, steps: DataFrame, order: int, text: str, into: str) -> DataFrame:
    """``docs`` with an array ``into``: texts meet the ``steps (gram, step)`` of their grams block by block."""
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    plain = text in docs.columns and docs.schema[text].dataType.typeName() == "string"
    carried = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text or not plain}
    row = F.struct(F.lit(0).alias("none"), *[quoted[c].alias(n) for c, n in carried.items()])
    rows = docs.select(quoted.get(text, F.col(text)).cast("string").alias("text"), row.alias("row"))
    chars = rows.agg(F.sum(F.length(text_of("text")).cast("long") + 1)).first()[0] or 1
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    # Equal texts are dealt by what else their rows hold. Hashes of collections are left out, since maps have none.
    atoms = [f"row.{n}" for c, n in carried.items() if docs.schema[c].dataType.typeName() not in ("map", "array", "struct", "variant")]
    block = F.pmod(F.xxhash64("text", *atoms), F.lit(n_blocks)).alias("block")
    # Read with all its columns both times, so that Spark shuffles the texts once.
    dealt = rows.select(block, "text", "row").repartition(min(n_blocks, BLOCK_TASKS), "block")

    def ask(texts: pa.Table) -> pa.Table:
        found = own_grams(texts.column("text").to_pylist(), order, set(), set())
        block = texts.column("block")[0].as_py() if texts.num_rows else 0
        return pa.table({"block": pa.array([block] * len(found), pa.int64()), "gram": pa.array(list(found), pa.string())})

    def compare(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = WordScores(dict(zip(answers.column("gram").to_pylist(), answers.column("step").to_pylist(), strict=True)), order)
        found = [features(t or "", known) for t in texts.column("text").to_pylist()]
        return pa.table({"text": texts.column("text"), "row": texts.column("row"), "x": pa.array(found, pa.list_(pa.float64()))})

    answers = dealt.groupBy("block").applyInArrow(ask, "block long, gram string").join(steps, "gram").select("block", "gram", "step")
    schema = StructType([*rows.schema, StructField("x", ArrayType(DoubleType()))])
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(compare, schema)
    return scored.select(*[F.col(f"row.{carried[c]}" if c in carried else "text").alias(c) for c in docs.columns], F.col("x").alias(into))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "toxic",
    text: str = "text",
    order: int = ORDER,
) -> Model:
    """Learn from the rows of ``labels`` (``key``, ``label`` 0 or 1; nulls are skipped).

    Of several labels of a key the more frequent counts, and none if they are
    tied. Every labelled document is learnt from: most by the models, one in
    ``CURVE_FOLDS`` by the curve. Without labels of both classes, every document
    scores the share of toxic labels.
    """
    known = settled_labels(labels, key, label).withColumnRenamed("good", "bad")
    n, bad = known.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if not 0 < bad < n:
        share = min(max(bad / n if n else 0.0, 1e-3), 1 - 1e-3)
        return Model(order, None, None, (0.0,) * WIDTH, math.log(share / (1 - share)))
    known = written(known.withColumn("curve", F.pmod(F.xxhash64("_key", F.lit("curve")), F.lit(CURVE_FOLDS)) == 0), "labels")
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = found.join(small_or_shuffled(known, BROADCAST_IDS), "_key")
    words = rows.where("NOT curve").select("bad", F.explode(words_of(F.lower("_text"))).alias("word"))
    words = words.groupBy("word").agg(F.count_if(~F.col("bad")).alias("ordinary"), F.count_if("bad").alias("toxic"))
    grams = written(gram_counts(words, order), "grams")
    model = Model(order, grams, written(continuation_counts(grams, order), "shorter"))
    seen = with_features(rows.where("curve").select("_text", "bad"), model, "_text", "x").select("bad", "x")
    seen = written(seen.select(array_to_vector("x").alias("features"), F.col("bad").cast("double").alias("label")), "curve")
    if seen.select("label").distinct().count() < 2:
        return replace(model, weights=(0.0, 8.0, *[0.0] * (WIDTH - 2)), intercept=-4.0)
    # Both classes weigh alike, so that the middle of the curve lies between them.
    poor, rich = seen.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    weighed = seen.withColumn("weight", F.when(F.col("label") == 1, 1 / poor).otherwise(1 / rich) * (poor + rich) / 2)
    curve = LogisticRegression(regParam=1e-3, maxIter=100, weightCol="weight").fit(weighed)
    return replace(model, weights=tuple(float(w) for w in curve.coefficients), intercept=float(curve.intercept))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``toxicity`` between 0 and 1, higher where it is likelier.

    Null texts score like empty ones. Whole texts are scored; rows may come back
    in any order. Other columns stay where they are whatever their names, and an
    existing ``toxicity`` is replaced. The score may be filtered on: it is settled before.
    """
    x = spare(docs, "_t_x")
    zeros = F.array(*[F.lit(0.0)] * WIDTH)
    scored = docs.withColumn(x, zeros) if model.grams is None else with_features(docs, model, text, x)
    z = F.aggregate(F.zip_with(x, F.array(*map(F.lit, model.weights)), lambda v, w: v * w), F.lit(model.intercept), lambda a, v: a + v)
    return with_settled(scored, "toxicity", 1 / (1 + F.exp(F.greatest(F.least(-z, F.lit(30.0)), F.lit(-30.0))))).drop(x)
