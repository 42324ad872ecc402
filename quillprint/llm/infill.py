"""Fill-in-middle examples, cut by one match with repeated captures.

One pattern, a unit any number of times, matches a whole text, and the regex
library keeps the end of every repetition: their number and the two cut offsets
are read off the match itself. Hashes of the key choose the cuts and the form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import spare, text_of, with_settled

# A line with its end, or a last line without one.
LINE = r"[^\n]*+\n|[^\n]++"


@dataclass(frozen=True)
class Rule:
    """The unit of cutting, the share of texts cut and of those in suffix-first form, and the marks.

    ``unit`` is a pattern without groups of its own whose repetitions cover any text.
    """

    unit: str = LINE
    seed: str = "7"
    percent: int = 100
    suffix_first_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 that follow from the key; a null key counts as an empty one."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_points(text: Column, one: Column, two: Column, unit: str) -> Column:
    """``(n, first, second)``: the number of units, and the code points before the middle and before the suffix."""

    @F.pandas_udf("n long, first int, second int")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        units = regex.compile(f"({unit})*+")
        for texts, ones, twos in parts:
            rows = []
            for t, h, k in zip(texts, ones, twos, strict=True):
                match = units.fullmatch(t)
                if match is None:
                    raise ValueError(f"the unit {unit!r} does not cover a text")
                ends = match.ends(1)
                n = len(ends)
                a, b = sorted((h % (n + 1), k % (n + 1)))
                rows.append((n, ends[a - 1] if a else 0, ends[b - 1] if b else 0))
            yield pd.DataFrame(rows, columns=["n", "first", "second"])

    return cut(text, one, two)


def fill_in_middle(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``fim``: ``(n, form, prefix_chars, middle_chars, output)``.

    ``n`` counts the units of the text. ``form`` is ``psm`` (prefix, suffix,
    middle), ``spm`` (suffix, prefix, middle) or ``plain``: the text as it is,
    if it is empty, holds a mark, or is not chosen. The lengths of prefix and
    middle, in code points, are null for plain texts. Null texts are empty, rows
    with equal keys are cut alike as far as their texts are, and rows are
    treated one by one: other columns pass through whatever their names, an
    existing ``fim`` is replaced. Texts go to Python whole; only three numbers
    come back.
    """
    rule = rule or Rule()
    body, cuts, numbers = (spare(docs, f"_f_{n}") for n in ("text", "cuts", "draws"))
    made = docs.withColumns({body: text_of(text), numbers: F.array(*draws(F.col(key), rule.seed))})
    h1, h2, h3, h4 = (F.get(numbers, F.lit(i)) for i in range(4))
    made = made.withColumn(cuts, cut_points(F.col(body), h1, h2, rule.unit))
    marked = F.lit(False)
    for mark in rule.marks:
        marked |= F.contains(F.col(body), F.lit(mark))
    plain = (F.col(body) == "") | marked | (h3 % 100 >= rule.percent)
    form = F.when(plain, "plain").when(h4 % 100 < rule.suffix_first_percent, "spm").otherwise("psm")
    n, first, second = (F.col(f"{cuts}.{c}") for c in ("n", "first", "second"))
    prefix = F.concat(F.lit(rule.prefix), F.substring(body, F.lit(1), first))
    middle = F.concat(F.lit(rule.middle), F.substring(body, first + 1, second - first))
    suffix = F.concat(F.lit(rule.suffix), F.substring(body, second + 1, F.length(body) - second))
    output = F.when(form == "psm", F.concat(prefix, suffix, middle)).when(form == "spm", F.concat(suffix, prefix, middle))
    value = F.struct(
        n.alias("n"), form.alias("form"), F.when(~plain, first).cast("long").alias("prefix_chars"),
        F.when(~plain, second - first).cast("long").alias("middle_chars"), F.coalesce(output, F.col(body)).alias("output"),
    )
    return with_settled(made, "fim", value).drop(body, cuts, numbers)


def restored(output: Column, form: Column, rule: Rule | None = None) -> Column:
    """The text that an output was made from, read off the output and its form alone.

    A text that holds a mark is plain, so the first of each mark is the one that
    was put there.
    """
    rule = rule or Rule()

    def between(opening: str, closing: str | None) -> Column:
        rest = F.substring(output, F.instr(output, opening) + len(opening), F.length(output))
        return rest if closing is None else F.substring(rest, F.lit(1), F.instr(rest, closing) - 1)

    middle = between(rule.middle, None)
    psm = F.concat(between(rule.prefix, rule.suffix), middle, between(rule.suffix, rule.middle))
    spm = F.concat(between(rule.prefix, rule.middle), middle, between(rule.suffix, rule.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
