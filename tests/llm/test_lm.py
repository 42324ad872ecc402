"""The backoff automaton: nothing pruned, blocks of any size, probabilities that add up."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillprint.llm import lm
from quillprint.llm.support import fold_of, table

KEYS = st.lists(st.integers(0, (1 << 63) - 1), max_size=50)


def scores(docs, **options):
    out = lm.score_documents(docs, F.col("train"), "id", **options).collect()
    return sorted((r.id is not None, r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in out)


@given(KEYS)
def test_packed_numbers_come_back(values):
    values = np.array(values, np.uint64)
    assert (lm.unpacked(lm.packed(values), len(values)) == values).all()


@given(KEYS, st.integers(1, 9))
def test_parts_follow_each_other(values, parts):
    keys = np.unique(np.array(values, np.uint64))
    part, starts, ends = lm.part_edges(keys, 63, parts)
    assert [k for s, e in zip(starts, ends, strict=True) for k in keys[s:e]] == list(keys)
    assert all(0 <= p < parts for p in part) and sorted(set(part)) == list(part)


def test_tallied_counts_marked_rows_only():
    keys, n = lm.tallied(np.array([5, 3, 5, 5, 7], np.uint64), np.array([True, False, True, False, True]))
    assert keys.tolist() == [3, 5, 7] and n.tolist() == [0, 2, 1]


def test_blocks_do_not_change_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (fold_of("doc_id", 10) != 0).alias("train"))
    assert scores(docs) == scores(docs, block_chars=40_000)


def test_probabilities_of_a_state_add_up(spark):
    """After ``a b``: every word, the end and the one word for all unknown ones share a weight of one."""
    words = ["a", "b", "c", "d"]
    learnt = [(i, t, True) for i, t in enumerate(["a b c", "a b c d", "b a b d", "c"])]
    asked = [(100 + i, t, False) for i, t in enumerate(["a b", *(f"a b {w}" for w in [*words, "unknown"])])]
    rows = {r[1]: r[-1] for r in scores(spark.createDataFrame(learnt + asked, "id int, text string, train boolean"))}
    count = {w: sum(t.split().count(w) for _, t, _ in learnt) for w in words}
    n, v = sum(count.values()) + len(learnt), len(words) + 1
    start = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in count.items()}
    pairs = {p: sum(f"{t} $".split()[i : i + 2] == list(p) for _, t, _ in learnt for i in range(6)) for p in [("a", "b"), ("b", "$")]}
    prefix = np.log10(start["a"]) + np.log10((pairs["a", "b"] + 1000 * start["b"]) / (count["a"] + 1000))
    # Each of these has one more token, the end, whose probability depends on the last word: divide it out.
    end = (len(learnt) + 0.1) / (n + 0.1 * (v + 1))
    total = 10 ** (rows[100] - prefix)
    for i, w in enumerate([*words, "unknown"]):
        own = f"b {w} $".split()
        follows = sum(f"{t} $".split()[j : j + 2] == own[1:] for _, t, _ in learnt for j in range(6))
        thrice = sum(f"{t} $".split()[j : j + 3] == own for _, t, _ in learnt for j in range(6))
        after = sum(f"{t} $".split()[j : j + 2] == own[:2] for _, t, _ in learnt for j in range(6))
        last = (thrice + 3 * (follows + 1000 * end) / (count.get(w, 0) + 1000)) / (after + 3)
        total += 10 ** (rows[101 + i] - prefix) / last
    assert total == pytest.approx(1)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "x y x y", True), (1, "x y x y", True), (None, None, None), (None, None, None), (3, "", False), (4, "x " * 5000, True)]
    docs = spark.createDataFrame(rows, "id int, text string, train boolean").withColumns({"block": F.lit(1), "part": F.lit(2), "n": F.lit(3)})
    out = scores(docs, block_chars=7)
    assert len(out) == 6 and [r[2] for r in out] == [1, 1, 5, 5, 1, 5001]
    assert {r[4] for r in out} == {5 + 5 + 5001}


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    held = lm.score_documents(docs, fold_of("doc_id", 10) != 0).where(fold_of("doc_id", 10) == 0)
    tokens, base, score = held.agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert score / tokens > base / tokens + 0.9
