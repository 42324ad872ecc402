"""Orders of epochs and running sums."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillprint.operators.epochs import epoch_batches, epoch_order
from quillprint.operators.prefix import running_sums


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5000).select("id", (F.col("id") % 7).alias("x"))


def order(df, epoch, **options):
    return [r.id for r in sorted(epoch_order(df, epoch, **options).collect(), key=lambda r: r.position)]


def test_every_epoch_is_a_permutation_of_its_own(rows):
    first, second, third = (order(rows, e) for e in (1, 2, 3))
    assert first == list(range(5000))
    for got in (second, third):
        assert sorted(got) == first
    assert len({tuple(o) for o in (first, second, third, order(rows, 2, seed=7))}) == 4
    # Hardly any neighbours stay neighbours.
    assert sum(abs(a - b) == 1 for a, b in zip(second, second[1:])) < 25


def test_order_does_not_depend_on_partitions(spark, rows):
    want = order(rows, 2)
    assert order(rows.repartition(13), 2) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert order(rows.repartition(2, "x"), 2) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_keys(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "id long")
    got = epoch_order(df, 2).collect()
    assert sorted(r.position for r in got) == list(range(5))
    assert sorted(str(r.id) for r in got) == ["1", "1", "2", "None", "None"]
    assert epoch_order(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="from 1"):
        epoch_order(df, 0)


def test_batches_are_even(spark, rows, tmp_path):
    path = str(tmp_path / "epoch")
    assert epoch_batches(rows, 2, 8, path) == 5000
    sizes = {r["step"]: r["count"] for r in spark.read.parquet(path).groupBy("step").count().collect()}
    assert sizes == dict.fromkeys(range(8), 625)


@pytest.mark.parametrize("unique", [False, True])
def test_running_sums(spark, unique):
    """A hot group, a hot key and a null group, over more ranges than groups."""
    dice = random.Random(3)
    data = [(None if dice.random() < 0.6 else dice.randrange(4), i if unique else dice.choice([5, 5, i % 40]), dice.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g int, k int, v int")
    got = running_sums(df, ["g"], ["k"], ["v"], unique=unique).collect()
    assert len(got) == 3000
    for group in {r.g for r in got}:
        mine, total = sorted((r for r in got if r.g == group), key=lambda r: (r.k, r.v_before, r.v)), 0
        for r in mine:
            assert r.v_before == total
            total += r.v
        assert {r.v_all for r in mine} == {total}
    whole = running_sums(df, [], ["k"], ["v"]).agg(F.max(F.col("v_before") + F.col("v")), F.max("v_all")).first()
    assert whole[0] == whole[1] == sum(v for *_, v in data)
