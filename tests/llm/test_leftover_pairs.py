"""Changed copies of one text that are too far from each other for a link: they meet few others, and no link is lost."""

import random
from itertools import combinations

import pytest

from quillprint.llm import jaccard

RULES = [jaccard.Rule(words=5, percent=80, errors=0, parts=1), jaccard.Rule(words=3, percent=90)]


def changed(words, rng, times):
    out = list(words)
    for at in rng.sample(range(len(out)), times):
        out[at] = f"c{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("rule", RULES)
def test_far_copies_meet_few_others(spark, rule):
    """60 near copies that are connected and 40 that are linked with none, of one text."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    few, many = {5: (3, 14), 3: (3, 20)}[rule.words]
    texts = {d: changed(base, rng, few if d < 60 else many) for d in range(100)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc long, text string").repartition(4)
    members = spark.createDataFrame([(d, 0 if d < 60 else d) for d in texts], "doc long, component long")
    assert jaccard.prefix_pairs(docs, members, rule).count() < 100


@pytest.mark.parametrize("rule", RULES)
def test_prefixes_lose_no_link(spark, rule):
    """All links between single sets of many sizes; some texts are given twice, some keys have two texts."""
    rng = random.Random(8)
    rows = []
    for group in range(25):
        size = rng.choice([1, 2, 4, 9, 20, 60, 200, 700])
        base = [f"g{group}w{rng.randrange(3 * size)}" for _ in range(size)]
        for i in range(8):
            cut = base[: max(1, size - rng.randrange(1 + size // 12))]
            rows.append((group * 10 + i, " ".join(changed(cut, rng, min(len(cut), rng.randrange(1 + size // 15))))))
    rows += [rows[3], rows[40], (rows[5][0], rows[100][1])]
    sets = [(d, jaccard.shingle_set(t, rule.words)) for d, t in rows]
    want = {
        (min(a, b), max(a, b)) for (a, x), (b, y) in combinations(sets, 2)
        if a != b and rule.linked(len(set(x.tolist()) & set(y.tolist())), len(x), len(y))
    }
    assert len(want) > 50
    members = spark.createDataFrame([(d, d) for d in {d for d, _ in rows}], "doc long, component long")
    found = jaccard.prefix_pairs(spark.createDataFrame(rows, "doc long, text string"), members, rule).collect()
    assert want <= {(min(p), max(p)) for p in found}
