"""Length features of raw code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.functions import lexical
from quillprint.functions.text import text_or_empty

LENGTH_COLUMNS = ["char_count", "line_count", "avg_line_len", "comment_ratio"]


def length_features(df: DataFrame, code_col: str = "code") -> DataFrame:
    """``df`` with four length columns; code is taken as it is, not cleaned."""
    code = text_or_empty(F.col(code_col))
    chars = lexical.char_count(code).cast("long")
    lines = lexical.newline_line_count(code).cast("long")
    return df.withColumns(
        {
            "char_count": chars,
            "line_count": lines,
            "avg_line_len": chars.cast("double") / F.greatest(F.lit(1), lines),
            "comment_ratio": lexical.comment_ratio_by_lines(code),
        }
    )
