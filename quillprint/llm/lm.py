"""Language-model scoring with a weighted backoff automaton of three orders.

Every word and every pair of words that the training documents contain is a
state. The arcs of a state are the words seen after it; its failure arc leads to
the state one word shorter, and from a single word to the start. With ``c`` the
counts, a state ``h`` and the weight ``K`` of its order, the arc of a word ``w`` has
weight ``c(hw) / (c(h) + K)`` and the failure arc ``K / (c(h) + K)``; the probability
of ``w`` is its arc plus the failure arc times the probability at the shorter state.
So each state's probabilities add up to one, and counts are all there is to know.

Nothing is pruned, so the automaton grows with the corpus and is never whole in
one place. Documents are dealt into blocks of bounded size. A block sends each
distinct word, pair and triple of its texts once, with its count in the block's
training documents, to the part of the key space it lies in; the part adds up
what all blocks sent and answers every block with the totals, in the order asked.
The block then walks its texts from left to right over the arcs it was given.
Keys travel sorted, as compressed differences, counts and answers compressed.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.llm.jaccard import MIX_B, hashed_words, mix
from quillprint.llm.support import text_of

ADDED = 0.1
#: Weights of the failure arcs of states of one word and of two.
FAILURE = (1000.0, 3.0)
BLOCK_CHARS = 8_000_000
#: Tasks that blocks are dealt to, at most; a task takes its blocks one after the other.
BLOCK_TASKS = 20_000
#: Bits of a key beyond those that number the corpus: a stranger is met once in 2^24 searches.
SPARE_BITS = 24
# Words keep all bits but one, which marks training rows while they are sorted.
WORD_BITS = 63
# Fixed value: the key of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
ONE = np.uint64(1)
REQUEST = "part long, block long, n long, keys binary, counts binary"
ANSWER = "part long, block long, n long, totals binary"


def tokens(text: str) -> np.ndarray:
    """Hashes of the words, then of the end."""
    return np.append(hashed_words(text), END)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * MIX_B + second)


def shortened(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: planes of small numbers are zeros and cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<u8").astype(np.uint64)


def tallied(keys: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (of 63 bits at most), and how many of each are marked."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    both = np.sort((keys << ONE) | marked.astype(np.uint64))
    own = both >> ONE
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[first], np.add.reduceat((both & ONE).astype(np.int64), first)


def part_edges(keys: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts that sorted keys lie in, and where the keys of each part start and end."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(keys) else np.empty(0, np.int64)
    return part[starts].astype(np.int64), starts, np.append(starts[1:], len(keys))[: len(starts)]


class Block:
    """The texts of one block, in any order, as words, pairs and triples by position."""

    def __init__(self, texts: list[str], gram_bits: int):
        found = [tokens(t) for t in texts]
        self.lengths = np.array([len(f) for f in found], np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        words = np.concatenate(found) if found else np.empty(0, np.uint64)
        place = np.arange(len(words)) - np.repeat(self.firsts, self.lengths)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        pairs = np.zeros_like(words)
        pairs[1:] = pair_keys(words[:-1], words[1:])
        triples = pair_keys(pairs[self.third - 1], words[self.third])
        self.words = shortened(words, WORD_BITS)
        self.grams = np.concatenate((shortened(pairs[self.second], gram_bits), shortened(triples, gram_bits)))

    def gram_rows(self, by_token: np.ndarray) -> np.ndarray:
        return np.concatenate((by_token[self.second], by_token[self.third]))


def request_rows(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, parts: int) -> list[tuple]:
    """One row for each part that some key lies in; ``kind`` 0 or 1 keeps words and longer keys in parts of their own."""
    return [
        (2 * int(p) + kind, block, int(e - s), packed(np.diff(keys[s:e], prepend=np.uint64(0))), packed(counts[s:e]))
        for p, s, e in zip(*part_edges(keys, bits, parts), strict=True)
    ]


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = [(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)})


def summed(requests: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys' totals over all requests of one part, the key of every entry by number, and entries a request."""
    n = requests.column("n").to_numpy()
    keys = [np.cumsum(unpacked(b, k), dtype=np.uint64) for b, k in zip(requests.column("keys").to_pylist(), n, strict=True)]
    counts = [unpacked(b, k) for b, k in zip(requests.column("counts").to_pylist(), n, strict=True)]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, number, np.concatenate(counts).astype(np.int64))
    return totals, number, n


def vocabulary(rows: DataFrame, parts: int) -> tuple[int, int]:
    """How many tokens the training rows of ``rows (text, train)`` have, and how many distinct ones."""

    def count(batches):
        for batch in batches:
            found = [tokens(t) for t in batch.column(0).to_pylist()]
            if found:
                keys = shortened(np.concatenate(found), WORD_BITS)
                yield from as_table(request_rows(0, 0, *tallied(keys, np.ones(len(keys), bool)), WORD_BITS, parts), REQUEST).to_batches()

    def add(requests: pa.Table) -> pa.Table:
        totals, _, _ = summed(requests)
        return pa.table({"tokens": [int(totals.sum())], "words": [len(totals)]})

    sums = rows.where("train").select("text").mapInArrow(count, REQUEST).groupBy("part").applyInArrow(add, "tokens long, words long")
    return tuple(sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())


def score_documents(
    docs: DataFrame,
    training: Column,
    key: str = "doc_id",
    text: str = "text",
    failure: tuple[float, float] = FAILURE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score)``, one row for every row of ``docs``.

    ``training`` says which rows are learnt from (null: not). Words are
    lower-cased (A-Z) and compared by 63-bit hashes, longer keys by hashes that are
    ``SPARE_BITS`` longer than the corpus needs; the end of a text is a token, so an
    empty or null text has one. ``base_score`` is the single-word model with
    ``ADDED`` added to every count, one word standing for all unknown ones; it is
    also what the start state of the automaton has. ``score`` is the automaton.
    Without training rows every token is unknown and has probability one. Other
    columns are not looked at. Rows of equal key and text share a block.
    """
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    chars = rows.agg(F.sum(F.length("text").cast("long") + 1)).first()[0] or 1
    n_blocks = max(1, -(-chars // block_chars))
    gram_bits = max(40, min(WORD_BITS, SPARE_BITS + ceil(log2(chars + 1))))
    n_train, n_words = vocabulary(rows, n_blocks)
    spread = n_train + ADDED * (n_words + 1)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).alias("block")
    # Read with all its columns both times, so that Spark shuffles the texts once.
    dealt = rows.select(block, "id", "text", "train").repartition(min(n_blocks, BLOCK_TASKS), "block")

    def ask(texts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return as_table([], REQUEST)
        own, block = Block(texts.column("text").to_pylist(), gram_bits), texts.column("block")[0].as_py()
        train = np.repeat(texts.column("train").to_numpy(zero_copy_only=False), own.lengths)
        out = request_rows(block, 0, *tallied(own.words, train), WORD_BITS, n_blocks)
        out += request_rows(block, 1, *tallied(own.grams, own.gram_rows(train)), gram_bits, n_blocks)
        return as_table(out, REQUEST)

    def answer(requests: pa.Table) -> pa.Table:
        totals, number, n = summed(requests)
        ends = np.cumsum(n)
        blobs = [packed(totals[number[e - k : e]]) for e, k in zip(ends, n, strict=True)]
        return pa.table({**{c: requests.column(c) for c in ("part", "block", "n")}, "totals": pa.array(blobs, pa.binary())})

    def totals_of(keys: np.ndarray, kind: int, answers: pa.Table) -> np.ndarray:
        """The training count of every key. Answers in the order of parts are in the order of the distinct keys."""
        own = answers.filter(pa.array(answers.column("part").to_numpy() % 2 == kind)).sort_by("part")
        totals = [unpacked(b, n) for b, n in zip(own.column("totals").to_pylist(), own.column("n").to_pylist(), strict=True)]
        _, number = np.unique(keys, return_inverse=True)
        return np.concatenate(totals)[number].astype(np.float64) if totals else np.zeros(0)

    def traverse(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(texts.column("text").to_pylist(), gram_bits)
        words, grams = totals_of(own.words, 0, answers), totals_of(own.grams, 1, answers)
        pairs, triples = np.zeros(len(words)), grams[len(own.second) :]
        pairs[own.second] = grams[: len(own.second)]
        single = (words + ADDED) / spread
        p = single.copy()
        # The state before a token is the longest that was counted; an uncounted one passes its failure arc with weight one.
        p[own.second] = followed(pairs[own.second], words[own.second - 1], p[own.second], failure[0])
        p[own.third] = followed(triples, pairs[own.third - 1], p[own.third], failure[1])
        known = (words > 0).astype(np.int64)
        sums = [np.add.reduceat(v, own.firsts) if len(own.firsts) else v for v in (known, np.log10(single), np.log10(p))]
        return pa.Table.from_arrays(
            [texts.column("id"), pa.array(own.lengths), *map(pa.array, sums)], names=["id", "n_tokens", "n_known", "base_score", "score"]
        )

    answers = dealt.groupBy("block").applyInArrow(ask, REQUEST).groupBy("part").applyInArrow(answer, ANSWER)
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(traverse, schema)
    return scored.select(
        F.col("id").alias(key), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"
    )


def followed(arc: np.ndarray, state: np.ndarray, shorter: np.ndarray, weight: float) -> np.ndarray:
    """Probability after states counted ``state`` times, of which ``arc`` times with this word; ``shorter`` at the shorter state."""
    return (arc + weight * shorter) / (state + weight)
