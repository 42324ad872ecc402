"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and cue words such as ``password``. A deterministic parser looks at
the surroundings of each anchor, finds the span's boundaries and validates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import text_of

# Kinds in the order in which spans are listed, the required ones first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey")
KEY_PREFIX = "AKIA"

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]++:[^\s/@]*+@[A-Za-z0-9.-]++")
VALUE = re.compile(r"[\"']?[ ]?[:=#][ ]?[\"']?([A-Za-z0-9+/_.-]{8,})")
ACCOUNT_VALUE = re.compile(r"[ ]?(?:no\.?|number)?[ ]?[:=#]?[ ]?([A-Za-z0-9][A-Za-z0-9 -]{5,40}[A-Za-z0-9])", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789"):
        found.add_word(word, (word, len(word)))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.add_word(KEY_PREFIX, ("key", len(KEY_PREFIX)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    plain = re.sub("[^A-Z0-9]", "", text.upper())
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Finder:
    """Spans of one text at a time; offsets count code points, ends are exclusive."""

    def __init__(self) -> None:
        self.anchors = anchors()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        past = dict.fromkeys(KINDS, 0)  # where each kind may begin again

        def take(kind: str, start: int, end: int, valid: bool) -> None:
            past[kind] = end
            if valid:
                found[kind].append((start, end))

        for last, (what, size) in self.anchors.iter(text):
            at = last - size + 1
            if what == "@":
                start = at
                while start > past["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    take("email", start, m.end(), True)
            elif what == "+":
                if at >= past["phone"] and (m := PHONE.match(text, at)):
                    take("phone", at, m.end(), 9 <= sum(map(str.isdigit, m.group())) <= 15)
            elif what.isdigit():
                if at and text[at - 1] in "0123456789":
                    continue
                if at >= past["ip"] and (m := QUAD.match(text, at)):
                    parts = [p.lstrip("0") for p in m.group().split(".")]
                    take("ip", at, m.end(), all(len(p) <= 3 and int(p or "0") <= 255 for p in parts))
                if at >= past["card"] and (m := CHAIN.match(text, at)):
                    digits = m.group().replace(" ", "").replace("-", "")
                    take("card", at, m.end(), 13 <= len(digits) <= 19 and passes_luhn(digits))
            elif what == "scheme":
                if last + 1 >= past["login"] and (m := LOGIN.match(text, last + 1)):
                    take("login", at, m.end(), True)
            elif what == "key":
                if at >= past["secret"] and (m := KEY.match(text, at)):
                    take("secret", at, m.end(), True)
            elif what == "secret":
                if last + 1 >= past["secret"] and (m := VALUE.match(text, last + 1)):
                    value = m.group(1)
                    take("secret", m.start(1), m.end(1), any(map(str.isdigit, value)))
            elif last + 1 >= past["account"] and (m := ACCOUNT_VALUE.match(text, last + 1)):
                if i := IBAN.match(text, m.start(1)):
                    take("account", i.start(), i.end(), valid_iban(i.group()))
                elif (value := re.match(r"[0-9]+(?:[ -][0-9]+)*", m.group(1))) and sum(map(str.isdigit, value.group())) >= 6:
                    take("account", m.start(1), m.start(1) + value.end(), True)
        return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def find_spans(text: Column) -> Column:
    @F.pandas_udf(SPAN_TYPE)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder()
        for series in texts:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in finder.spans(t)] for t in series], dtype=object)

    return find(text)


def mask_spans(text: Column, spans: Column) -> Column:
    @F.pandas_udf("string")
    def mask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in parts:
            yield pd.Series([masked(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return mask(text, spans)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first, then the longest, counts."""
    out, past = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= past:
            out += [text[past : s["start"]], f"<{s['kind']}>"]
        past = max(past, s["end"])
    return "".join([*out, text[past:]])


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``pii``, its spans as ``(kind, start, end)``.

    Spans are listed by kind in the order of ``KINDS``, then by start, and those
    of one kind do not overlap. A null text has none. Only the text goes to
    Python, whole; other columns stay where they are and an existing ``pii`` is
    replaced.
    """
    return docs.withColumn("pii", find_spans(text_of(text)))


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by ``<kind>``; null texts stay null."""
    hidden = F.when(F.size("_pii") > 0, mask_spans(text_of(text), F.col("_pii"))).otherwise(F.col(text))
    return docs.withColumn("_pii", find_spans(text_of(text))).withColumn(text, hidden).drop("_pii")


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
