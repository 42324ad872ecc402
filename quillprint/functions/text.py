"""Text normalisation with Python's notion of whitespace, lines and words.

Java's ``\\s``, ``\\w`` and ``trim`` follow other rules than Python's ``str``
methods, so the character classes are written out. They are Java regex
escapes, hence the raw strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace accepts, those at which
# str.splitlines breaks, their difference, and Python's \w.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\n-\r\x1c-\x1e\x85\u2028\u2029"
INLINE_SPACE = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK_CHARS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"

# Language spellings and the grammar each one names.
GRAMMAR_BY_LANGUAGE = {
    "javascript": "javascript",
    "js": "javascript",
    "python": "python",
    "py": "python",
    "java": "java",
    "c": "c",
    "cpp": "cpp",
    "c++": "cpp",
    "csharp": "c_sharp",
}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_whitespace(c: Column) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def normalize_newlines(c: Column) -> Column:
    return strip_whitespace(F.replace(c, F.lit("\r\n"), F.lit("\n")))


def clean_code(c: Column) -> Column:
    """Normalised newlines, with every blank stretch reduced to one empty line."""
    return F.regexp_replace(normalize_newlines(text_or_empty(c)), rf"\n[{WHITESPACE}]*\n", "\n\n")


def split_lines(c: Column) -> Column:
    """Lines as an array; no trailing empty line and no line for an empty text."""
    parts = F.split(c, rf"\r\n|[{LINE_BREAK}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(
        parts
    )


def count_chars(c: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``."""
    total = F.lit(0)
    for char in chars:
        total += F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))
    return total


def split_line_count(c: Column) -> Column:
    """``size(split_lines(c))`` without building the array."""
    breaks = F.regexp_count(c, F.lit(rf"[{LINE_BREAK}](?:(?<=\r)\n)?+"))
    last = F.substring(c, -1, 1)
    unfinished = (last != "") & ~last.isin(*LINE_BREAK_CHARS)
    return breaks + unfinished.cast("int")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))


def normalize_language(c: Column) -> Column:
    return F.lower(strip_whitespace(text_or_empty(c)))


def language_grammar(c: Column) -> Column:
    """Grammar name of a language spelling; null where there is none."""
    table = F.create_map(*[F.lit(v) for pair in GRAMMAR_BY_LANGUAGE.items() for v in pair])
    return F.try_element_at(table, normalize_language(c))
