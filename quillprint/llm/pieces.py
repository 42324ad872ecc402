"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

White space becomes a mark, and no piece has a mark after another character, so
texts fall into marked words that are segmented one by one. The distinct words
of a few texts are sorted, which walks their trie depth-first: the forward
scores of the prefix that a word shares with the word before it are kept, and
only the rest of the word is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import text_of

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of words and their pieces, about, that a Python worker remembers before it starts afresh.
REMEMBERED_BYTES = 48_000_000
#: What a remembered word takes besides its characters and pieces.
WORD_BYTES = 160
#: Texts that are cut into words at a time, and characters of them.
BATCH_TEXTS, BATCH_CHARS = 256, 2_000_000
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: ids and scores of ordinary pieces, ids of single bytes, and what each id stands for."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_at: list[int]
    texts: list[str]
    unknown: int
    long: dict[str, tuple[int, ...]]  # the last three characters of longer pieces: their lengths, falling
    unknown_score: float


@lru_cache(maxsize=2)
def vocabulary(path: str, by_rank: bool = True) -> Pieces:
    """Pieces of a SentencePiece model file.

    Scores of a merge-trained file only number its merges. ``by_rank`` reads
    them as ranks and takes the logarithm of a Zipf law over them; without it
    the file's scores are log probabilities and used as they are.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
    if any(MARK in texts[i].lstrip(MARK) for i in plain):
        raise ValueError("a piece has a mark after another character")
    if by_rank:
        ranked = sorted(plain, key=lambda i: -model.get_score(i))
        total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
        scores = {texts[i]: -math.log(r) - total for r, i in enumerate(ranked, 1)}
    else:
        scores = {texts[i]: model.get_score(i) for i in plain}
    at = [-1] * 256
    for i in range(size):
        if model.is_byte(i):
            at[int(texts[i][1:-1], 16)] = i
    lowest = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
    lengths: dict[str, set[int]] = {}
    for piece in scores:
        if len(piece) > 3:
            lengths.setdefault(piece[-3:], set()).add(len(piece))
    long = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
    return Pieces({texts[i]: i for i in plain}, scores, at, texts, model.unk_id(), long, lowest)


class Segmenter:
    """The best pieces of words; of equal scores the one with the longer last piece."""

    def __init__(self, known: Pieces) -> None:
        self.known = known
        self.endings: dict[str, tuple[tuple[int, ...], tuple[tuple[int, float], ...]]] = {}

    def ending(self, end: str) -> tuple[tuple[int, ...], tuple[tuple[int, float], ...]]:
        """What may end a word here, by its last three characters: lengths of longer pieces, and short pieces with scores."""
        scores = self.known.scores
        short = tuple((k, scores[end[-k:]]) for k in range(len(end), 0, -1) if end[-k:] in scores)
        found = (self.known.long.get(end, ()), short)
        if len(self.endings) < 200_000:
            self.endings[end] = found
        return found

    def __call__(self, words: list[str]) -> dict[str, bytes]:
        """Ids of every word, as little-endian bytes."""
        scores, endings, unknown, out = self.known.scores, self.endings, self.known.unknown_score, {}
        best, back, previous = [0.0], [0], ""
        for word in sorted(words):
            shared, limit = 0, min(len(word), len(previous))
            while shared < limit and word[shared] == previous[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                key = word[end - 3 : end] if end > 2 else word[:end]
                found = endings.get(key) or self.ending(key)
                top, start = best[-1] + unknown, end - 1
                for k in found[0]:
                    if k <= end:
                        score = scores.get(word[end - k : end])
                        if score is not None and best[end - k] + score > top:
                            top, start = best[end - k] + score, end - k
                for k, score in found[1]:
                    if best[end - k] + score > top:
                        top, start = best[end - k] + score, end - k
                best.append(top)
                back.append(start)
            out[word] = self.ids(word, back)
            previous = word
        return out

    def ids(self, word: str, back: list[int]) -> bytes:
        cuts, end = [], len(word)
        while end:
            cuts.append(word[back[end] : end])
            end = back[end]
        numbers, ids = self.known.ids, []
        for piece in reversed(cuts):
            number = numbers.get(piece)
            if number is not None:
                ids.append(number)
            else:
                raw = [self.known.bytes_at[b] for b in piece.encode("utf-8", "surrogatepass")]
                ids += [self.known.unknown] if -1 in raw else raw
        return pack(f"<{len(ids)}i", *ids)


def segment(words: list[str], known: Pieces) -> dict[str, list[int]]:
    """The best pieces of every word."""
    return {w: np.frombuffer(ids, "<i4").tolist() for w, ids in Segmenter(known)(words).items()}


class Encoder:
    """Ids of whole texts; words that were met before are looked up."""

    def __init__(self, path: str, by_rank: bool) -> None:
        self.known = vocabulary(path, by_rank)
        self.segmenter, self.words, self.held = Segmenter(self.known), {}, 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        docs = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > REMEMBERED_BYTES:
            self.words, self.held = {}, 0
        new = self.segmenter(list(set().union(*docs).difference(self.words)))
        self.held += sum(map(len, new)) * 2 + sum(map(len, new.values())) + WORD_BYTES * len(new)
        self.words.update(new)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, d)), "<i4") for d in docs]

    def batches(self, texts: pd.Series) -> Iterator[np.ndarray]:
        """Ids of all texts, a few texts or a long one at a time."""
        part, chars = [], 0
        for t in texts:
            part.append(t)
            chars += len(t)
            if len(part) == BATCH_TEXTS or chars > BATCH_CHARS:
                yield from self(part)
                part, chars = [], 0
        yield from self(part)


class Decoder:
    """The text of ids: pieces joined, bytes put together, marks made spaces, the first mark taken away."""

    def __init__(self, known: Pieces) -> None:
        self.known = known
        self.of_byte = {i: b for b, i in enumerate(known.bytes_at) if i >= 0}
        self.is_byte = np.zeros(len(known.texts), bool)
        self.is_byte[list(self.of_byte)] = True

    def __call__(self, ids: np.ndarray) -> str:
        if len(ids) and self.is_byte[ids].any():
            return decode_ids(ids.tolist(), self.known, self.of_byte)
        text = "".join(map(self.known.texts.__getitem__, ids.tolist())).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def decode_ids(ids: list[int], known: Pieces, of_byte: dict[int, int]) -> str:
    """Pieces joined, bytes put together, marks made spaces, and the first mark taken away."""
    out, raw = [], bytearray()
    for i in ids:
        if i in of_byte:
            raw.append(of_byte[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(known.texts[i])
    out.append(raw.decode("utf-8", "replace"))
    text = "".join(out).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, path: str, text: str = "text", by_rank: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids``, an array of int; empty for null and empty texts.

    Each row is encoded by itself, whole; other columns stay where they are and
    an existing ``piece_ids`` is replaced. A mark in a text is read as a space,
    and decodes to one.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path, by_rank)
        for series in texts:
            yield pd.Series(list(encoder.batches(series)), dtype=object)

    return docs.withColumn("piece_ids", ids(text_of(text)))


def decode(encoded: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text its ids stand for; null ids decode to an empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(vocabulary(path))
        for series in batches:
            yield pd.Series([decoder(np.asarray(x)) for x in series], dtype=object)

    return encoded.withColumn(into, texts(F.coalesce(ids, F.array().cast("array<int>"))))


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """Numbers of pieces and of bytes, a checksum of the ids, and whether decoding gives the text back.

    Encoding and decoding share one worker, which holds the ids of a few texts at
    a time; only the numbers leave it.
    """

    @F.pandas_udf("n_pieces long, ids_crc32 long, round_trip boolean")
    def checked(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, True)
        decoder = Decoder(encoder.known)
        numbers = [b"%d " % i for i in range(len(encoder.known.texts))]
        for series in texts:
            rows = []
            for ids, text in zip(encoder.batches(series), series, strict=True):
                written = b"".join(map(numbers.__getitem__, ids.tolist()))[:-1]
                rows.append((len(ids), zlib.crc32(written), decoder(ids) == text))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "round_trip"])

    return docs.select("doc_id", checked(text_of("text")).alias("found")).select("doc_id", "found.*")
