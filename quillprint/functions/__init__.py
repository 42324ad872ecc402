"""Column expressions. All of them run inside the JVM."""

from quillprint.functions.lexical import (
    blank_line_count,
    blank_line_ratio,
    call_count,
    char_count,
    comment_ratio_by_newlines,
    comment_ratio_by_lines,
    count_chars,
    identifier_distinct,
    identifier_mean_length,
    identifiers,
    keyword_count,
    newline_line_count,
    python_route,
)
from quillprint.functions.scores import (
    argmax_label,
    label_text_to_id,
    softmax_probability,
    threshold_label,
)
from quillprint.functions.text import (
    clean_code,
    language_grammar,
    normalize_language,
    normalize_newlines,
    split_line_count,
    split_lines,
    strip_whitespace,
    word_tokens,
)

__all__ = [
    "argmax_label",
    "blank_line_count",
    "blank_line_ratio",
    "call_count",
    "char_count",
    "clean_code",
    "comment_ratio_by_lines",
    "comment_ratio_by_newlines",
    "count_chars",
    "identifier_distinct",
    "identifier_mean_length",
    "identifiers",
    "keyword_count",
    "label_text_to_id",
    "language_grammar",
    "newline_line_count",
    "normalize_language",
    "normalize_newlines",
    "python_route",
    "softmax_probability",
    "split_line_count",
    "split_lines",
    "strip_whitespace",
    "threshold_label",
    "word_tokens",
]
