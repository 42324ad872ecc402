"""Passages that many unlike texts quote: they make few candidates, and no link is lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillprint.llm import jaccard
from quillprint.llm.support import written

RULES = [jaccard.Rule(words=5, percent=80, errors=0, parts=1), jaccard.Rule(words=3, percent=90), jaccard.Rule()]


@pytest.mark.parametrize("rule", RULES)
def test_linked_sets_share_more_than_they_may_leave_out(rule):
    rng = np.random.default_rng(11)
    for size in [1, 2, 5, 9, 13, 24, 60, 61, 150, 400, 401, 1000, 3000] * 6:
        shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        most = size * 100 // rule.percent - size
        own, other = np.split(rng.integers(0, 1 << 63, most, dtype=np.uint64), [rng.integers(0, most + 1)])
        a, b = np.unique(np.concatenate((shared, own))), np.unique(np.concatenate((shared, other)))
        assert rule.linked(len(np.intersect1d(a, b)), len(a), len(b))
        common = np.intersect1d(jaccard.signatures(a, rule), jaccard.signatures(b, rule))
        used = {x.number for x in jaccard.used_bands(len(a), rule)} & {x.number for x in jaccard.used_bands(len(b), rule)}
        spared = [[jaccard.beyond_one(s, rule)[n % 2] for s in (a, b)] for n in used]
        assert any((common & np.uint64(1) == n % 2).sum() > max(s) for n, s in zip(used, spared, strict=True))


def test_quoting_texts_make_few_pairs(spark):
    """200 unlike texts quote one passage; every tenth has a copy with one word changed."""
    rng, rule = random.Random(5), RULES[0]
    passage = [f"q{i}" for i in range(60)]
    texts = {}
    for doc in range(200):
        texts[doc] = [f"w{rng.randrange(10**9)}" for _ in range(120)] + passage + [f"w{rng.randrange(10**9)}" for _ in range(20)]
        if doc % 10 == 0:
            texts[1000 + doc] = [*texts[doc][:50], "changed", *texts[doc][51:]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc long, text string")
    traits = written(jaccard.set_traits(docs, rule), "traits")
    _, pairs = jaccard.first_pairs(jaccard.signature_rows(docs, rule), traits)
    found = {tuple(p) for p in pairs.collect()}
    assert {(d, 1000 + d) for d in range(0, 200, 10)} <= found
    assert len(found) < 100
    out = jaccard.similar_documents(docs, rule, key="doc").where(F.col("doc") != F.col("component_id")).collect()
    assert {(r.component_id, r.doc) for r in out} == {(d, 1000 + d) for d in range(0, 200, 10)}
