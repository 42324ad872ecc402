"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets.
Counts over the buckets, of trusted documents and of all documents, give every
bucket a log ratio; a document's score is the mean ratio of its n-grams. Texts are
dealt into folds, and each is scored by the counts of the other folds, so neither
its own words nor its exact copies speak for or against it. The score below which
documents are rejected is read off the trusted ones, scored in the same way.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import bound, dense_array, small_or_shuffled, spare, text_of, with_settled, words_of, written

N_BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Ratios are shifted so that the learnt cut lies here.
THRESHOLD = -0.06
FOLDS = 4
#: So many of a thousand trusted documents may lie below the place from which the cut is measured,
#: and the cut lies below that place by this part of its distance from their median.
BELOW_OF_1000 = 1
MARGIN = 0.25
#: Scores are counted in steps of this size to find the cut.
STEP = 1e-3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: So many different windows of a text are looked up one by one.
FEW_REPEATED = 16
# Stands for the successor of the last word of a text.
END = 0


def word_hashes(text: str | Column) -> Column:
    return F.transform(words_of(text), lambda word: F.xxhash64(word))


def buckets_of(word: Column, following: Column, n_buckets: int) -> tuple[Column, Column]:
    """Buckets of a hashed word and of the pair it forms with its successor, ``END`` after the last."""
    pair = F.xxhash64(word, F.coalesce(following, F.lit(END)))
    if n_buckets & (n_buckets - 1):
        return F.pmod(word, F.lit(n_buckets)).cast("int"), F.pmod(pair, F.lit(n_buckets)).cast("int")
    # The same remainders, faster.
    mask = F.lit(n_buckets - 1).cast("long")
    return word.bitwiseAND(mask).cast("int"), pair.bitwiseAND(mask).cast("int")


def fold_of_text(text: str | Column) -> Column:
    """The fold of a text; exact copies share it."""
    return F.pmod(F.xxhash64(text_of(text)), F.lit(FOLDS)).cast("int")


def bucket_counts(docs: DataFrame, trusted: Column, text: str = "text", n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(bucket, raw0, target0, raw1, ...)``: n-grams outside each fold, of all documents and of the trusted ones.

    Summed before the shuffle.
    """
    hashed = docs.select(trusted.alias("trusted"), fold_of_text(text).alias("fold"), word_hashes(text).alias("hashes"))
    placed = hashed.select("trusted", "fold", "hashes", F.posexplode("hashes").alias("at", "word"))
    both = F.array(*buckets_of(F.col("word"), F.get("hashes", F.col("at") + 1), n_buckets))
    grams = placed.select("trusted", "fold", F.explode(both).alias("bucket"))
    slots = grams.select("trusted", (F.col("bucket") * FOLDS + F.col("fold")).alias("slot"))
    counted = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target"))
    fold = F.col("slot") % FOLDS
    outside = [F.sum(F.when(fold != k, F.col(n)).otherwise(0)).alias(f"{n}{k}") for k in range(FOLDS) for n in ("raw", "target")]
    return counted.groupBy(F.expr(f"slot div {FOLDS}").alias("bucket")).agg(*outside)


def fit_ratios(
    docs: DataFrame,
    trusted_ids: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n_buckets: int = N_BUCKETS,
    smoothing: float = SMOOTHING,
    broadcast_ids: int = 200_000,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row: ``ratios``, for each fold an array of ``n_buckets`` log ratios of trusted over expected counts.

    All documents count as raw; those whose key occurs in ``trusted_ids`` (its
    one column) count as target too. The expected count is the trusted share of
    the raw one, and ``smoothing`` is added to both, so an unseen bucket has
    ratio zero. The ids are broadcast if at most ``broadcast_ids`` of them were
    counted, and joined by a shuffle otherwise. Trusted documents of
    ``min_words`` words or more set the cut, and ratios are shifted to put it at
    ``threshold``. Without any trusted document every ratio is zero.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = rows.join(small_or_shuffled(ids, broadcast_ids), F.col("_key") == F.col("_trusted"), "left")
    counts = bucket_counts(marked, F.col("_trusted").isNotNull(), "_text", n_buckets)
    names = [f"{n}{k}" for k in range(FOLDS) for n in ("raw", "target")]
    packed = dense_array(counts, "bucket", {n: F.col(n) for n in names}, n_buckets)
    total = {n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x) for n in names}
    packed = packed.select(*names, *[c.alias(f"all_{n}") for n, c in total.items()])

    def ratios_outside(k: int) -> Column:
        share = F.col(f"all_target{k}") / F.col(f"all_raw{k}")
        ratio = bound(share, lambda s: F.zip_with(f"target{k}", f"raw{k}", lambda t, r: F.log((t + smoothing) / (r * s + smoothing))))
        return F.when(F.col(f"all_target{k}") > 0, ratio).otherwise(F.transform(f"raw{k}", lambda _: F.lit(0.0)))

    unshifted = written(packed.select(F.array(*map(ratios_outside, range(FOLDS))).alias("ratios")), "unshifted")
    trusted = marked.where("_trusted IS NOT NULL").select("_text", word_hashes("_text").alias("_hashes"))
    own = F.get(unshifted.select("ratios").scalar(), fold_of_text("_text"))
    long = trusted.where(F.size("_hashes") >= min_words).withColumn("_ratios", own)
    scored = long.select(mean_ratio(F.col("_hashes"), F.col("_ratios"), n_buckets).alias("score"))
    cut = cut_of(scored)
    if cut is None:
        return unshifted
    shifted = F.transform("ratios", lambda fold: F.transform(fold, lambda x: x + (threshold - cut)))
    return written(unshifted.select(shifted.alias("ratios")), "ratios")


def cut_of(scored: DataFrame) -> float | None:
    """The score that trusted documents ``(score)`` set as the cut; none without any.

    Counts of rounded scores come to the driver: their number is bounded by the
    range of logarithms. The cut is never above zero, the score of unseen words.
    """
    steps = scored.groupBy(F.floor(F.col("score") / STEP).alias("step")).count().orderBy("step").collect()
    n = sum(r["count"] for r in steps)
    if not n:
        return None

    def place(rank: int) -> float:
        for r in steps:
            rank -= r["count"]
            if rank < 0:
                return r["step"] * STEP
        raise ValueError("the rank is not below the number of scores")

    low, middle = place(n * BELOW_OF_1000 // 1000), place(n // 2)
    return min(0.0, low - MARGIN * (middle - low))


def windows_of(hashes: Column) -> Column:
    """A hash of every 3-word window, in order."""
    every = F.transform(hashes, lambda w, i: F.xxhash64(w, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.slice(every, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))


def repeated_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more in the text.

    Where few windows repeat, as sorting shows, every window is looked up among
    them. Else windows are sorted with their places, which keeps very long and
    very repetitive texts from costing their square.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        beside = F.zip_with(
            s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
            lambda a, b: F.when(a["h"] == b["h"], F.array(*[x["i"] + k for x in (a, b) for k in range(3)])),
        )
        return F.size(F.array_distinct(F.flatten(F.array_compact(beside))))

    def of_few(twice: Column) -> Column:
        found = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
        return bound(F.array_compact(found), covered)

    def covered(at: Column) -> Column:
        # A window covers three words, or those up to the next such window.
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, n: a + n)

    def by_number(twice: Column) -> Column:
        return F.when(F.size(twice) <= FEW_REPEATED, of_few(twice)).otherwise(bound(placed, places))

    def equal_neighbours(s: Column) -> Column:
        following = F.slice(s, 2, F.size(s))
        return F.array_distinct(F.array_compact(F.zip_with(s, following, lambda a, b: F.when(a == b, a))))

    unique = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(unique, 0).otherwise(bound(bound(F.sort_array(windows), equal_neighbours), by_number))


def mean_ratio(hashes: Column, ratios: Column, n_buckets: int) -> Column:
    """Mean log ratio over the n-grams of a text, by the ratios of its fold; zero without words."""

    def of_pair(word: Column, at: Column) -> Column:
        one, two = buckets_of(word, F.get(hashes, at + 1), n_buckets)
        return F.get(ratios, one) + F.get(ratios, two)

    total = F.aggregate(F.transform(hashes, of_pair), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes))).otherwise(0.0)


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def quality_rules(
    docs: DataFrame,
    ratios: DataFrame,
    text: str = "text",
    n_buckets: int = N_BUCKETS,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """Every row of ``docs`` with one more column, ``quality``.

    It is a struct of ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (long), ``base_failed`` (too few words or too many repeated
    ones), ``ratio`` (the mean log ratio) and ``kept``. Words and windows are
    compared by 64-bit hashes. A null text is empty: no words, so it fails. Rows
    are judged one by one, so repeated rows, null keys and further columns pass
    through whatever their names; an existing ``quality`` column is replaced.
    Its fields may be filtered on: they are settled before.
    """
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    own, all_words, h, ls, ws, cs = (spare(docs, f"_q_{n}") for n in ("ratios", "words", "hashes", "lines", "windows", "counts"))
    # One projection a step: a value that lambdas read is worked out once, before them.
    # A scalar query hands the arrays of ratios to every task; only that of the text's fold goes with the row.
    known = docs.withColumns(
        {own: F.get(ratios.select("ratios").scalar(), fold_of_text(text)), all_words: words_of(text), ls: lines}
    )
    known = known.withColumn(h, F.transform(all_words, lambda word: F.xxhash64(word))).withColumn(ws, windows_of(F.col(h)))
    hashes, found = F.col(h), F.col(ls)
    counts = {
        "n_words": F.size(hashes),
        "word_chars": F.length(F.array_join(all_words, "")),
        "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size(found) - F.size(F.array_distinct(found)),
        "n_repeat_words": repeated_words(F.col(ws)),
    }
    counted = F.struct(
        *[c.cast("long").alias(n) for n, c in counts.items()],
        mean_ratio(hashes, F.col(own), n_buckets).alias("ratio"),
    )
    q = F.col(cs)
    failed = (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeated_percent * q["n_words"])
    verdict = F.struct(f"{cs}.*", failed.alias("base_failed"), (~failed & (q["ratio"] >= threshold)).alias("kept"))
    return with_settled(known.withColumn(cs, counted), "quality", verdict).drop(own, all_words, h, ls, ws, cs)
