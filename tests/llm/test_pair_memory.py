"""What a Python worker of the join holds: few texts at a time, and no sets of pairs."""

import random
from itertools import combinations

import pyarrow as pa

from quillprint.llm import jaccard

RULE = jaccard.Rule(words=3, percent=90)


class Rows:
    """Stands for a DataFrame of one batch."""

    def __init__(self, batch):
        self.batch = batch

    def mapInArrow(self, function, schema):  # noqa: N802
        return list(function(iter([self.batch])))


def test_texts_are_taken_in_slices():
    texts = [f"one two three four {i}" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc", "text"])
    out = jaccard.set_traits(Rows(batch), RULE)
    assert max(b.num_rows for b in out) <= jaccard.SLICE
    assert [d for b in out for d in b.column(0).to_pylist()] == list(range(1000))
    signed = jaccard.signature_rows(Rows(batch), RULE)
    assert {d for b in signed for d in b.column(1).to_pylist()} == set(range(1000))


def test_pairs_are_compared_without_python(spark):
    rng = random.Random(4)
    texts = {d: " ".join(f"w{i}" for i in range(60 + d) if rng.random() > 0.02) for d in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    pairs = spark.createDataFrame(list(combinations(texts, 2)), "a long, b long")
    decided, _ = jaccard.checked_pairs(pairs, docs, RULE)
    assert "Python" not in decided._jdf.queryExecution().toString()
    sets = {d: set(jaccard.shingle_set(t, 3).tolist()) for d, t in texts.items()}
    want = {(a, b): RULE.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(texts, 2)}
    assert {(r.a, r.b): r.linked for r in decided.collect()} == want
    assert len(set(want.values())) == 2
