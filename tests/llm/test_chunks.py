"""Chunks encoded together have the ids that the tokenizer gives the whole text."""

from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quillprint.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = st.text("ab ZÄ中́Ġ  \n\t'.,12$😀\x00", max_size=40)
SPECIAL = st.sampled_from(["<|endoftext|>", " <|endoftext|>", "word <|endoftext|>x", " don't", "Ġword", " Ġ"])


@settings(deadline=None)
@given(st.lists(st.one_of(LETTERS, SPECIAL), max_size=12).map(" ".join))
def test_ids_are_those_of_the_whole_text(text):
    encoder = packing.tokenizer(PATH)
    encoder.known.clear()
    assert encoder([text, f" {text}"]) == encoder.encoded([text, f" {text}"])


def test_other_splitting_rules_encode_one_by_one(monkeypatch):
    encoder = packing.WordTokenizer(PATH)
    chunks = [" one", " two", " three"]
    want = encoder.encoded(chunks)
    assert encoder.encoded_together(chunks) == want
    encoder.spaced[:] = True  # as if words had more starts than chunks
    assert encoder.encoded_together([" unlikelyword", *chunks]) == encoder.encoded([" unlikelyword", *chunks])
