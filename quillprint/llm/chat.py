"""Chat formatting by schema fingerprints.

A record may hold a conversation in any of several layouts. The nested paths of
its fields that are not null are hashed into a fingerprint, and the fingerprint
selects a declarative mapping that turns the layout into canonical turns. The
template marks turns, keeps control strings inside texts apart from its own
marks, and can be read back exactly. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's marks, and control strings of other templates that texts must not carry either.
TURN, END = "<|turn|>", "<|end|>"
MARKS_SAMPLE = "</s>[INST] ok [/INST]"
# A first character, and what makes it the beginning of a control string.
CONTROLS = {"<": (r"\|turn\|>", r"\|end\|>", r"/?s>", "<SYS>>", "</SYS>>"), r"\[": (r"/?INST\]",)}
JOINER = "⁠"
ANSWERING = "assistant"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _controls(joiners: str) -> str:
    return "|".join(f"{first}{joiners}(?={'|'.join(rest)})" for first, rest in CONTROLS.items())


ESCAPED, PLAIN = _controls(JOINER + "+"), _controls(JOINER + "*")


def escape(text: Column) -> Column:
    """One more joiner after the first character of every control string."""
    return F.regexp_replace(text, PLAIN, "$0" + JOINER)


def unescape(text: Column) -> Column:
    tails = "|".join(f"(?<={first}){JOINER}(?={JOINER}*(?:{'|'.join(rest)}))" for first, rest in CONTROLS.items())
    return F.regexp_replace(text, tails, "")


def turn_of(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def renamed(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, role), role)


def fields(*pairs: tuple[str, str]) -> Callable[[Column], Column]:
    """Turns from fields ``(role, field)``; a field that is null gives no turn."""

    def turns(record: Column) -> Column:
        each = [F.when(record[name].isNotNull(), turn_of(F.lit(role), record[name])) for role, name in pairs]
        return F.array_compact(F.array(*each))

    return turns


def listed(name: str, role: str, text: str, read: Callable[[Column], Column] = lambda role: role) -> Callable[[Column], Column]:
    """Turns from a list of messages, the role as ``read`` gives it."""
    return lambda record: F.transform(record[name], lambda m: turn_of(read(m[role]), m[text]))


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it must have, those it may have, and how its turns are read."""

    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: Callable[[Column], Column]

    def path_sets(self) -> list[tuple[str, ...]]:
        some = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [tuple(sorted(self.required + extra)) for extra in some]


MAPPINGS = (
    Mapping(("messages[].content",), ("messages[].role",), listed("messages", "role", "content")),
    Mapping(("conversations[].value",), ("conversations[].from",), listed("conversations", "from", "value", renamed)),
    Mapping(("prompt",), ("system", "response"), fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("instruction", "output"), (), fields(("user", "instruction"), ("assistant", "output"))),
)


def leaves(kind: T.DataType) -> list[tuple[str, Callable[[Column], Column]]]:
    """``(path, test for a value there)`` of every leaf of a type."""
    if isinstance(kind, T.StructType):
        found = []
        for f in kind.fields:
            for path, test in leaves(f.dataType):
                dot = "." if path and not path.startswith("[") else ""
                found.append((f"{f.name}{dot}{path}", lambda c, n=f.name, t=test: t(c[n])))
        return found
    if isinstance(kind, T.ArrayType):
        inner = leaves(kind.elementType)
        joined = [(f"[].{p}" if p and not p.startswith("[") else f"[]{p}", t) for p, t in inner]
        return [(p, lambda c, t=t: F.coalesce(F.exists(c, lambda e: t(e)), F.lit(False))) for p, t in joined]
    return [("", lambda c: c.isNotNull())]


def fingerprint(record: Column, kind: T.StructType) -> Column:
    """A hash of the record's paths that hold a value, in alphabetical order."""
    paths = sorted(leaves(kind), key=lambda leaf: leaf[0])
    present = [F.when(test(record), F.lit(path)) for path, test in paths]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*present)), "\n"))


def format_chats(df: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with ``layout``, ``formatted`` and ``loss_spans``.

    ``column`` is a struct; ``layout`` is the fingerprint of its fields. A layout
    that no mapping knows, an empty message list or a null record leaves
    ``formatted`` and ``loss_spans`` null. Null texts and roles are empty.
    ``loss_spans`` holds ``(start, end)`` of every assistant text in code points
    of the formatted text, end exclusive. A conversation is one row and its
    spans are listed in one pass over its turns. Other columns pass through;
    existing columns of the three names are replaced.
    """
    kind, record = df.schema[column].dataType, F.col(column)
    known = {path for path, _ in leaves(kind)}
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in reversed(mappings):
        if set(m.required) | set(m.optional) <= known:
            prints = [F.xxhash64(F.lit("\n".join(paths))) for paths in m.path_sets()]
            turns = F.when(F.col("layout").isin(*prints), m.turns(record)).otherwise(turns)
    marked = df.withColumn("layout", fingerprint(record, kind)).withColumn("_turns", turns)
    blocks = F.transform(
        "_turns",
        lambda t: F.struct(
            (t["role"] == ANSWERING).alias("answer"),
            F.concat(F.lit(TURN), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    tail = END + "\n"

    def step(done: Column, b: Column) -> Column:
        start = done["at"] + F.length(b["head"])
        end = start + F.length(b["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(b["answer"], F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((end + len(tail)).alias("at"), spans.alias("spans"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    made = marked.withColumn("_blocks", blocks)
    text = F.array_join(F.transform("_blocks", lambda b: F.concat(b["head"], b["body"], F.lit(tail))), "")
    spans = F.aggregate("_blocks", nothing, step)["spans"]
    return made.withColumn("formatted", text).withColumn("loss_spans", spans).drop("_turns", "_blocks")


def read_back(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation."""
    blocks = F.split(formatted, TURN.replace("|", r"\|"))

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        size = F.length(role)
        text = F.substring(block, size + 2, F.length(block) - size - 1 - len(END + "\n"))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), turn)


def under_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def laid_out(turns: DataFrame) -> DataFrame:
    """``(conv_id, record)`` of rows by turn, each conversation in the plainest layout that can hold it.

    A single question with or without an answer becomes fields; longer
    conversations become lists of messages in two spellings. Null texts are
    empty. Rows without a ``conv_id`` form one conversation; rows of one turn
    stand by role, then by text, nulls first. No rows give no conversations.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    grouped = turns.groupBy("conv_id").agg(ordered.alias("t"))
    t = F.col("t")
    text = lambda i: F.get("t", F.lit(i))["text"]
    is_role = lambda *roles: F.col("t.role") == F.array(*map(F.lit, roles))
    # Whole lists are compared: a role may itself hold any separator.
    alone, pair, led = is_role("user"), is_role("user", "assistant"), is_role("system", "user", "assistant")
    odd, plain = F.coalesce(F.col("conv_id") % 2, F.lit(1)) != 0, alone | led
    short = plain | pair
    spelled = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt")])
    first_user = F.when(alone, text(0)).otherwise(text(1))
    # Roles that the second spelling would rename are listed in the first.
    foreign = F.exists(t, lambda m: F.coalesce(m["role"].isin(*ROLE_NAMES), F.lit(False)))
    messages = F.transform(t, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    spoken = F.transform(
        t, lambda m: F.struct(F.coalesce(F.try_element_at(spelled, m["role"]), m["role"]).alias("from"), m["text"].alias("value"))
    )
    record = F.struct(
        F.when(~short & (odd | foreign), messages).alias("messages"),
        F.when(~short & ~(odd | foreign), spoken).alias("conversations"),
        F.when(led, text(0)).alias("system"),
        F.when(plain | (pair & odd), F.when(pair, text(0)).otherwise(first_user)).alias("prompt"),
        F.when(led, text(2)).when(pair & odd, text(1)).alias("response"),
        F.when(pair & ~odd, text(0)).alias("instruction"),
        F.when(pair & ~odd, text(1)).alias("output"),
    )
    return grouped.select("conv_id", record.alias("record"))


def read_back_digest(formatted: DataFrame, key: str) -> DataFrame:
    """What the query returns, derived from the formatted texts alone."""
    back = formatted.select(
        key, "layout", "formatted", read_back(F.col("formatted")).alias("turns"),
        under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
