"""Connected components of a link table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.llm.support import written

MAX_ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """``(node, component)``: for every linked node the smallest node it can reach.

    ``links`` has two columns of long; loops and nulls are ignored, order and
    repeats do not matter. Each round hangs every node's larger neighbours
    under its smallest one, then its smaller neighbours likewise; the number of
    links never grows and the rounds grow with the logarithm of the longest
    chain. Rounds are written tables. Minima are taken before rows are
    shuffled, and a node with very many links is split by adaptive execution.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u > v").distinct(), "links")
        lowest = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
    raise RuntimeError("links did not settle")
