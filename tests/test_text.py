"""Text expressions against plain Python on random Unicode strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillprint.functions import lexical, text

ALPHABET = (
    list("abif_=(){}#/*;:01 \t\n\n\n\r")
    + ["\r\n", "if", "for", "while", "//", "/*", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\u2028"]
    + ["\u00e9", "\u00b2", "\U0001f600", "\u3000", "\n \n", "\n\n\n", "x = 1\n", "  # c\n"]
)
COMMENT = re.compile(r"^\s*(#|//|/\*|\*)")


def samples():
    rng = random.Random(7)
    out = ["", " ", "\n", "\r\n", "\r", "a", "a\n", "\n\n", "\r\n\r\n", " \n ", "a\r\n \r\nb", "\r \n"]
    for _ in range(3000):
        out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))))
    return out


def py_clean(s):
    return re.sub(r"\n\s*\n+", "\n\n", s.replace("\r\n", "\n").strip())


def mean(xs):
    return sum(xs) / len(xs) if xs else 0.0


IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
CASES = {
    "strip": (text.strip_whitespace, str.strip),
    "clean": (text.clean_code, py_clean),
    "lines": (text.split_lines, str.splitlines),
    "line_total": (text.split_line_count, lambda s: len(s.splitlines())),
    "newlines": (lexical.newline_line_count, lambda s: s.count("\n") + 1),
    "comments": (
        lexical.comment_line_count,
        lambda s: sum(1 for x in s.splitlines() if COMMENT.match(x)),
    ),
    "blank": (
        lexical.blank_line_count,
        lambda s: sum(1 for x in s.splitlines() if not x.strip()),
    ),
    "if": (lambda c: lexical.keyword_count(c, "if"), lambda s: len(re.findall(r"\bif\b", s))),
    "calls": (lexical.call_count, lambda s: len(re.findall(r"\w+\s*\(", s))),
    "braces": (lambda c: text.count_chars(c, "{}"), lambda s: s.count("{") + s.count("}")),
    "words": (text.word_tokens, lambda s: re.findall(r"\b\w\w+\b", s.lower())),
    "ident_mean": (
        lambda c: lexical.identifier_mean_length(lexical.identifiers(c)),
        lambda s: mean([len(x) for x in IDENT.findall(s)]),
    ),
    "ident_distinct": (
        lambda c: lexical.identifier_distinct(lexical.identifiers(c)),
        lambda s: len(set(IDENT.findall(s))),
    ),
    "chars": (lexical.char_count, len),
}


@pytest.fixture(scope="module")
def computed(spark):
    df = spark.createDataFrame(list(enumerate(samples())), "id long, s string")
    cols = [build(F.col("s")).alias(name) for name, (build, _) in CASES.items()]
    return df.select("id", "s", *cols).collect()


@pytest.mark.parametrize("name", CASES)
def test_matches_python(computed, name):
    expected = CASES[name][1]
    wrong = [(r["s"], r[name], expected(r["s"])) for r in computed if r[name] != expected(r["s"])]
    assert not wrong, wrong[:3]


def test_null_text_cleans_to_empty(spark):
    row = spark.sql("select cast(null as string) s").select(text.clean_code(F.col("s"))).first()
    assert row[0] == ""


def test_long_whitespace_runs_stay_linear(spark):
    s = "a" + " " * 200_000 + "b" + "\n" * 200_000 + "c"
    df = spark.createDataFrame([(s,)], "s string")
    row = df.select(text.clean_code(F.col("s")), lexical.blank_line_count(F.col("s"))).first()
    assert row[0] == "a" + " " * 200_000 + "b\n\nc"
    assert row[1] == 199_999


def test_language_names(spark):
    names = [" JS ", "C++", "csharp", "Py", "cobol", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, l string")
    got = [r[1] for r in df.select("i", text.language_grammar(F.col("l"))).orderBy("i").collect()]
    assert got == ["javascript", "cpp", "c_sharp", "python", None, None]
