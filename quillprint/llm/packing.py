"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents become pieces of at most one sequence. Each task packs its share of
the pieces online: a fixed number of sequences is open, found by their free
space in a bitset; a piece goes where least space stays free, and when nothing
fits and no more may be opened, the fullest sequence closes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import text_of, written

CAPACITY = 2048
OPEN_SEQUENCES = 512
PIECES_PER_TASK = 250_000
#: Distinct words whose ids a Python worker remembers before it starts afresh.
REMEMBERED = 800_000
# White space as the tokenizer's pattern understands it.
BLANK = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
# One space and a word: such chunks can be told apart again after they were encoded together.
SPACED = re.compile(f" [^{BLANK}]+")
ENCODED_TOGETHER = 1_000
# Texts on which a tokenizer must agree with its own ids of their chunks.
PROBES = ("a b. c, d", "one  two\n\nthree \t four.", " lead, trail ", "x.y,z. ..", "don't stop, 12 + 3,4.", "\u00e9\u0301 \u4e2d\u6587, \U0001f600.")
PIECE_TYPE = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
ID_BYTES = 4


class WordTokenizer:
    """Token ids of whole texts, as little-endian bytes.

    The tokenizer never joins characters across the start of a run of white
    space, so each run with the word after it can be encoded by itself and its
    ids remembered. Where bytes are the alphabet, a token that starts with a
    space shows where a chunk of one space and a word starts, and many chunks
    are encoded as one text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.known = Tokenizer.from_file(path), {}
        names = self.model.get_vocab() if isinstance(self.model.pre_tokenizer, ByteLevel) else {}
        # Fixed value: the letter that stands for a space in such vocabularies.
        self.spaced = np.zeros(max(names.values(), default=0) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        for probe in PROBES:
            if self([probe])[0] != self.encoded([probe])[0]:
                raise ValueError(f"the tokenizer of {path} joins characters across white space")

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the tokenizer itself."""
        return [pack(f"<{len(c.ids)}I", *c.ids) for c in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_together(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that ``SPACED`` matches."""
        groups = [chunks[at : at + ENCODED_TOGETHER] for at in range(0, len(chunks), ENCODED_TOGETHER)]
        out: list[bytes] = []
        for group, ids in zip(groups, self.encoded(["".join(g) for g in groups]), strict=True):
            numbers = np.frombuffer(ids, "<u4")
            starts = (np.flatnonzero(self.spaced[np.minimum(numbers, len(self.spaced) - 1)]) * ID_BYTES).tolist()
            if len(starts) == len(group):
                out.extend(ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True))
            else:
                out.extend(self.encoded(group))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        chunks = [CHUNK.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = set().union(*chunks).difference(known)
        # A stop or comma right after a letter at the end of a chunk is always encoded by itself.
        ended = [c for c in new if c[-1] in ".," and len(c) > 1 and c[-2].isalpha()]
        plain = (new.difference(ended) | {c[:-1] for c in ended} | {".", ","}).difference(known)
        together = [c for c in plain if SPACED.fullmatch(c)] if self.spaced.any() else []
        alone = list(plain.difference(together))
        for part, encode in ((alone, self.encoded), (together, self.encoded_together)):
            for at in range(0, len(part), 10_000):
                some = part[at : at + 10_000]
                known.update(zip(some, encode(some), strict=True))
        for c in ended:
            known[c] = known[c[:-1]] + known[c[-1]]
        return [b"".join(map(known.__getitem__, doc)) for doc in chunks]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker; it encodes in its own thread only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, length, capacity)]]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``(key, piece, start, length, ids_crc32)`` of every document.

    ``path`` is a file of the tokenizers library; ``end_id`` follows each
    document. A null text is empty and becomes a piece of one token. Texts are
    encoded whole, a few at a time.
    """

    @F.pandas_udf(PIECE_TYPE)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, last = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for series in texts:
            rows = []
            for at in range(0, len(series), 256):
                for ids in encode(series.iloc[at : at + 256].tolist()):
                    data = ids + last
                    rows.append(
                        [
                            {"piece": i, "start": s, "length": n, "ids_crc32": zlib.crc32(data[ID_BYTES * s : ID_BYTES * (s + n)])}
                            for i, (s, n) in enumerate(cuts(len(data) // ID_BYTES, capacity))
                        ]
                    )
            yield pd.Series(rows, dtype=object)

    return docs.select(F.col(key), F.inline(cut(text_of(text))))


def token_ids(docs: DataFrame, path: str, text: str = "text", end_id: int = 0) -> DataFrame:
    """``docs`` with ``ids``, the document's tokens and ``end_id``."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = tokenizer(path)
        for series in texts:
            found = [np.append(np.frombuffer(b, "<u4").astype("int32"), end_id) for b in model(series.tolist())]
            yield pd.Series(found, dtype=object)

    return docs.withColumn("ids", encode(text_of(text)))


class OpenSequences:
    """The open sequences of one task, as a bitset over their free space."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.free = 0  # bit f: a sequence with f free places is open
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count, self.next = 0, 0

    def _pop(self, space: int) -> int:
        number = self.at[space].pop()
        if not self.at[space]:
            self.free ^= 1 << space
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence's number and the piece's offset in it."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._pop(space)
        else:
            space, number = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            if self.count >= self.limit:
                fullest = (self.free & -self.free).bit_length() - 1
                if left <= fullest:
                    return number, self.capacity - space  # it is itself the fullest, and closes
                self._pop(fullest)
            self.at[left].append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.capacity - space


def best_fit(
    parts: DataFrame,
    length: str = "length",
    capacity: int = CAPACITY,
    open_sequences: int = OPEN_SEQUENCES,
    per_task: int = PIECES_PER_TASK,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Every row of ``parts`` with ``sequence_id`` and ``offset``.

    ``parts`` should be a written table: it is counted to choose the number of
    tasks, each of about ``per_task`` rows and dealt by a hash of the ``order``
    columns (all columns, if none are named). Rows are packed in that hash's
    order, so that long and short pieces mix. Lengths must lie between 1 and
    ``capacity``; others fail the job. Sequences of different tasks never
    share an id.
    """
    names = list(order) or parts.columns
    tasks = max(1, -(-parts.count() // per_task))
    mixed = parts.withColumn("_mix", F.xxhash64(*names)).repartition(tasks, F.col("_mix"))
    schema = parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenSequences(capacity, open_sequences), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(length)).to_pylist()
            if any(n is None or not 0 < n <= capacity for n in lengths):
                raise ValueError(f"a piece is empty or longer than {capacity}")
            placed = [bins.place(n) for n in lengths]
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_mix"]
            added = [pa.array([first + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *added], names=schema.names)

    return mixed.sortWithinPartitions("_mix", *names).mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written before they are packed."""
    cut = written(pieces(docs, path, key, text, capacity), "pieces")
    return best_fit(cut, "length", capacity, order=(key, "piece", "start", "ids_crc32"))


def sequences(placed: DataFrame, docs_with_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(sequence_id, ids)``: the packed token sequences; keys must be unique."""
    part = F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int"))
    joined = placed.join(docs_with_ids.select(key, "ids"), key).select("sequence_id", "offset", part.alias("part"))
    rows = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.part").alias("ids"))
