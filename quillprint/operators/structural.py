"""Structural features: one row of 21 doubles per snippet, in a single pass.

There is no join and no shuffle. Counts over text are expressions; counts over
a Python syntax tree are expressions over the node array that sits in the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions import lexical
from quillprint.functions.text import normalize_language, text_or_empty
from quillprint.operators.columns import int_label
from quillprint.operators.syntax import DEFINING, FAILED, PARSED, letter_of, syntax_outline

STRUCTURAL_COLUMNS = [
    "avg_identifier_len",
    "blank_line_ratio",
    "char_count",
    "comment_ratio",
    "line_count",
    "max_ast_depth",
    "num_assign",
    "num_braces",
    "num_calls",
    "num_classes",
    "num_colons",
    "num_for",
    "num_functions",
    "num_if",
    "num_imports",
    "num_parens",
    "num_semicolons",
    "num_try",
    "num_unique_identifiers",
    "num_while",
    "parse_error",
]

# Syntax node types behind each count.
PYTHON_NODE_TYPES = {
    "num_functions": ("FunctionDef", "AsyncFunctionDef"),
    "num_classes": ("ClassDef",),
    "num_imports": ("Import", "ImportFrom"),
    "num_if": ("If",),
    "num_for": ("For", "AsyncFor"),
    "num_while": ("While",),
    "num_assign": ("Assign",),
    "num_try": ("Try",),
    "num_calls": ("Call",),
}
#: Names of these enter the identifier mean twice.
DOUBLE_NAMED = DEFINING


def lexical_counts(code: Column, ids: Column) -> dict[str, Column]:
    """The counts taken from text alone; ``ids`` is ``identifiers(code)``."""
    return {
        "num_if": lexical.keyword_count(code, "if"),
        "num_for": lexical.keyword_count(code, "for"),
        "num_while": lexical.keyword_count(code, "while"),
        "num_assign": lexical.count_chars(code, "="),
        "num_calls": lexical.call_count(code),
        "avg_identifier_len": lexical.identifier_mean_length(ids),
        "num_unique_identifiers": lexical.identifier_distinct(ids),
    }


def punctuation_counts(code: Column) -> dict[str, Column]:
    return {
        "num_semicolons": lexical.count_chars(code, ";"),
        "num_braces": lexical.count_chars(code, "{}"),
        "num_parens": lexical.count_chars(code, "()"),
        "num_colons": lexical.count_chars(code, ":"),
    }


def lexical_features(df: DataFrame, code_col: str = "code") -> DataFrame:
    """``df`` with the text-only row: no tree, so tree counts are 0."""
    ids, code = F.col("_ids"), F.col("_code")
    counts = lexical_counts(code, ids)
    zeros = ["num_functions", "num_classes", "num_imports", "max_ast_depth", "parse_error"]
    staged = df.withColumn("_code", text_or_empty(F.col(code_col))).withColumn(
        "_ids", lexical.identifiers(F.col("_code"))
    )
    return staged.select(
        *df.columns,
        *[c.cast("double").alias(n) for n, c in counts.items()],
        *[F.lit(0.0).alias(n) for n in zeros],
        lexical.comment_ratio_by_lines(code).alias("comment_ratio"),
    )


def _occurrences(types: Column, wanted: Sequence[str]) -> Column:
    """How many of the letters ``types`` stand for ``wanted``."""
    return lexical.count_chars(types, "".join(letter_of(name) for name in wanted))


def _tree_counts(types: Column, depth: Column, names: Column) -> dict[str, Column]:
    counts = {n: _occurrences(types, wanted) for n, wanted in PYTHON_NODE_TYPES.items()}
    counts["max_ast_depth"] = depth
    counts["avg_identifier_len"] = lexical.identifier_mean_length(names)
    counts["num_unique_identifiers"] = lexical.identifier_distinct(names)
    return counts


def structural_features(
    df: DataFrame,
    code_col: str = "code",
    lang_col: str = "language",
    keep: Sequence[str] = ("id", "label"),
    with_status: bool = False,
    with_error: bool = False,
    parse_limit: int | None = None,
    unhinted_limit: int | None = None,
) -> DataFrame:
    """Structural feature table: ``keep`` columns that exist, then the 21 features.

    A snippet read as Python is parsed, however long it is and however deep its
    tree. If that fails, the text counts stand in and ``parse_error`` is 1;
    measures of the text itself never depend on the tree. ``parse_limit`` treats
    longer snippets as if parsing had failed, ``unhinted_limit`` reads snippets
    of that length or more as Python only where the language says so; both are off.
    ``with_status`` and ``with_error`` add what the parser said: a status, and the
    error of a snippet it could not read.
    """
    keep = [c for c in keep if c in df.columns]
    language = F.col(lang_col) if lang_col in df.columns else F.lit(None).cast("string")
    code, ids = F.col("_code"), F.col("_ids")

    routed = int_label(df).select(
        *keep,
        text_or_empty(F.col(code_col)).alias("_code"),
        normalize_language(language).alias("_language"),
    )
    routed = routed.withColumn("_python", lexical.python_route(code, F.col("_language"), unhinted_limit))
    parsed = routed.withColumn("_tree", syntax_outline(F.when(F.col("_python"), code), parse_limit))
    staged = parsed.select(
        *keep,
        "_code",
        "_python",
        F.col("_tree.status").alias("_status"),
        F.col("_tree.error").alias("_error"),
        F.col("_tree.types").alias("_types"),
        F.col("_tree.depth").alias("_depth"),
        F.concat("_tree.names", "_tree.defined").alias("_names"),
        # Only rows that need text counts pay for the identifier array.
        F.when(
            F.col("_tree.status").isNull() | (F.col("_tree.status") != PARSED),
            lexical.identifiers(code),
        ).alias("_ids"),
    )

    status = F.coalesce(F.col("_status"), F.lit(""))
    has_tree = status == PARSED
    tree = _tree_counts(F.col("_types"), F.col("_depth"), F.col("_names"))
    text = lexical_counts(code, ids)
    features: dict[str, Column] = {
        n: F.when(has_tree, c).otherwise(text.get(n, F.lit(0))) for n, c in tree.items()
    }

    # A Python snippet without a tree failed, or was too long for the limit.
    features["parse_error"] = (F.col("_python") & ~has_tree).cast("int")
    features["char_count"] = lexical.char_count(code)
    features["line_count"] = F.when(code == "", 0).otherwise(lexical.newline_line_count(code))
    features["blank_line_ratio"] = lexical.blank_line_ratio(code)
    features["comment_ratio"] = lexical.comment_ratio_by_newlines(code)
    features |= punctuation_counts(code)

    out = staged.select(
        *keep,
        *([F.col("_status").alias("status")] if with_status else []),
        *([F.col("_error").alias("error")] if with_error else []),
        *[features[n].cast("double").alias(n) for n in STRUCTURAL_COLUMNS],
    )
    return out


def write_features(df: DataFrame, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """Write the structural features of ``df`` once, split by outcome; return the good and the failed rows.

    Parsing, counting and both folders are one job. Failed rows are those read as
    Python that the parser could not read: they carry its ``error`` beside the
    counts that stand in, so that nothing is lost and they can be looked into or
    taken up again. ``options`` are those of ``structural_features``.
    """
    made = structural_features(df, with_status=True, with_error=True, **options)
    failed = F.coalesce(F.col("status") == FAILED, F.lit(False))
    split = made.withColumn("outcome", F.when(failed, "failed").otherwise("good"))
    split.write.mode("overwrite").partitionBy("outcome").parquet(path)
    back = df.sparkSession.read.schema(split.schema).parquet(path)
    good = back.where("outcome = 'good'").drop("outcome", "status", "error")
    return good, back.where("outcome = 'failed'").drop("outcome", "status")
