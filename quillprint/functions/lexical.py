"""Lexical counts over code text, free of array lambdas where possible.

Every expression expects a non-null text (see ``text.text_or_empty``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillprint.functions.text import (
    INLINE_SPACE,
    LINE_BREAK,
    WHITESPACE,
    WORD,
    count_chars,
    split_line_count,
)

# Fixed value: the identifier rule.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"

# Both run on the text with a newline in front, so that every line follows a
# break and the engine can skip quickly to the next one. A \r\n pair is one break.
_COMMENT_LINE = rf"[{LINE_BREAK}][{INLINE_SPACE}]*+(?:#|//|/\*|\*)"
_BLANK_LINE = (
    rf"[{LINE_BREAK}](?:(?<=\r)\n)?+"
    rf"(?:[{INLINE_SPACE}]*+(?=[{LINE_BREAK}])|[{INLINE_SPACE}]++\z)"
)


def char_count(c: Column) -> Column:
    return F.length(c)


def newline_line_count(c: Column) -> Column:
    """Newlines plus one; an empty text has one line."""
    return count_chars(c, "\n") + 1


def comment_line_count(c: Column) -> Column:
    """Lines whose first visible characters are ``#``, ``//``, ``/*`` or ``*``; a text without such marks is not searched."""
    marked = F.contains(c, F.lit("#")) | F.contains(c, F.lit("/")) | F.contains(c, F.lit("*"))
    return F.when(marked, F.regexp_count(F.concat(F.lit("\n"), c), F.lit(_COMMENT_LINE))).otherwise(0)


def blank_line_count(c: Column) -> Column:
    return F.regexp_count(F.concat(F.lit("\n"), c), F.lit(_BLANK_LINE))


def comment_ratio_by_lines(c: Column) -> Column:
    """Share of comment lines among the split lines."""
    return comment_line_count(c).cast("double") / F.greatest(F.lit(1), split_line_count(c))


def comment_ratio_by_newlines(c: Column) -> Column:
    """Comment lines over newlines plus one."""
    return comment_line_count(c).cast("double") / newline_line_count(c)


def blank_line_ratio(c: Column) -> Column:
    """Blank lines over newlines plus one."""
    return blank_line_count(c).cast("double") / newline_line_count(c)


def keyword_count(c: Column, keyword: str) -> Column:
    """Whole-word occurrences. The word comes first: its neighbours are looked at on a hit only."""
    return F.regexp_count(c, F.lit(rf"{keyword}(?![{WORD}])(?<![{WORD}]{keyword})"))


def call_count(c: Column) -> Column:
    """Opening parentheses that follow a word, spaces allowed between.

    One word character before the parenthesis decides, which spares the
    engine from rescanning long words. A text without parentheses is not searched.
    """
    return F.when(F.contains(c, F.lit("(")), F.regexp_count(c, F.lit(rf"[{WORD}][{WHITESPACE}]*+\("))).otherwise(0)


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))


def identifier_mean_length(ids: Column) -> Column:
    total = F.length(F.array_join(ids, "")).cast("double")
    return total / F.greatest(F.lit(1), F.size(ids))


def identifier_distinct(ids: Column) -> Column:
    return F.size(F.array_distinct(ids))


def python_route(c: Column, language: Column, unhinted_limit: int | None = None) -> Column:
    """Whether a snippet is to be read as Python; ``language`` is normalised.

    With an ``unhinted_limit``, longer snippets need the language to say so.
    """
    looks_python = (
        F.contains(c, F.lit("def "))
        | F.contains(c, F.lit("class "))
        | F.contains(c, F.lit("import "))
        | (F.contains(c, F.lit("if ")) & F.contains(c, F.lit(":")))
    )
    if unhinted_limit is not None:
        looks_python = (F.length(c) < unhinted_limit) & looks_python
    return language.isin("python", "py") | looks_python
