"""A Merkle manifest of a dataset, built level by level with lag and lead windows.

Rows are leaves. In each group, runs of neighbouring nodes are hashed into
parents until one node is left, and the groups' last nodes are hashed likewise
into one root. On every level a window over the runs gives each node columns of
its neighbours at fixed offsets before and after it; those that lie outside its run,
by slot and run length, are masked. What is left are its siblings, and the first
child of a run holds all that the parent is hashed from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillprint.llm.support import written
from quillprint.operators.prefix import running_sums

FAN_OUT = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH_TYPE = "array<struct<left:string,right:string>>"
GROUP = ("known", "source")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*map(framed, values))


def neighbours(nodes: DataFrame, groups: Sequence[str], fan_out: int) -> DataFrame:
    """``nodes (groups, at, n, node, ..)`` with ``run``, ``slot``, ``left`` and ``right``.

    ``at`` is a node's place among the ``n`` of its group; ``left`` and ``right``
    are its run's other nodes before and after it, joined.
    """
    run, slot = F.floor(F.col("at") / fan_out), (F.col("at") % fan_out).cast("int")
    placed = nodes.withColumns({"run": run, "slot": slot})
    length = F.least(F.lit(fan_out), F.col("n") - F.col("run") * fan_out)
    over = Window.partitionBy(*groups, "run").orderBy("at")
    before = [F.when(F.col("slot") >= k, F.lag("node", k).over(over)) for k in range(fan_out - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < length, F.lead("node", k).over(over)) for k in range(1, fan_out)]
    return placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def climb(nodes: DataFrame, groups: Sequence[str], fan_out: int) -> list[DataFrame]:
    """All levels, each ``(groups, at, n, node)``, the last with one node a group.

    A group that has come down to one node waits there unchanged. Levels shrink
    by the fan-out and are written tables.
    """
    levels = [nodes]
    columns = [*groups, "at", "n", "node"]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        level = levels[-1].select(*columns)
        beside = neighbours(level.where("n > 1"), groups, fan_out).where("slot = 0")
        n = F.ceil(F.col("n") / fan_out).cast("long")
        parents = beside.select(*groups, F.col("run").alias("at"), n.alias("n"), digest(F.col("node"), F.col("right")).alias("node"))
        levels.append(written(parents.unionByName(level.where("n = 1")), "nodes"))
    return levels


def descend(levels: list[DataFrame], groups: Sequence[str], top: DataFrame, fan_out: int) -> DataFrame:
    """The first level with ``path``, and the columns that ``top`` has besides ``(groups, at, path)``.

    ``path`` lists the siblings before and after the node on each level, from
    the node's own up; ``top`` gives each group's last node the path above it.
    """
    extra = [c for c in top.columns if c not in (*groups, "at", "path")]
    above = top
    for i, level in reversed(list(enumerate(levels[:-1]))):
        beside = neighbours(level, groups, fan_out)
        parent = above.select(*groups, F.col("at").alias("run"), F.col("path").alias("above"), *extra)
        own = F.array(F.struct("left", "right"))
        path = F.when(F.col("n") > 1, F.concat(own, F.col("above"))).otherwise(F.col("above"))
        found = beside.join(parent, [*groups, "run"]).select(*[c for c in level.columns], path.alias("path"), *extra)
        above = written(found, "paths") if i else found
    if len(levels) == 1:
        above = levels[0].join(above.drop("at"), [*groups]).select(*levels[0].columns, "path", *extra)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, beside: digest(beside["left"], node, beside["right"]))


def path_digest(path: Column) -> Column:
    """A hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    columns: Sequence[str] = LEAF_COLUMNS,
    carry: dict[str, Column] | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """``(key, leaf, carry.., subroot, root, path)``, one row for every row of ``docs``.

    A leaf hashes ``columns`` of its row, nulls and empty values apart. The
    leaves of a group stand by key, null keys first, rows with equal keys by
    leaf; groups stand by the bytes of their name, the null group first.
    ``path`` lists the siblings ``(left, right)`` on every level from the leaf to
    the root; a run of one has empty ones, and a lone leaf is its own subroot.
    ``carry`` names expressions over the row that come along. No rows give none.

    Texts are read once and do not move: all that is shuffled are leaves and
    paths, by runs of ``fan_out`` nodes, so a group with most of the rows is
    spread like any other. Only the root comes to the driver.
    """
    if fan_out < 2:
        raise ValueError(f"a parent must have two children at least, not {fan_out}")
    carry, name = carry or {}, F.col(group).cast("string")
    rows = docs.select(
        F.col(key).alias("key"), name.isNotNull().alias("known"), F.coalesce(name, F.lit("")).alias("source"),
        leaf_of([F.col(c) for c in columns]).alias("node"), F.lit(1).alias("row"), *[c.alias(f"_c_{n}") for n, c in carry.items()],
    )
    placed = running_sums(written(rows, "leaves"), GROUP, ["key", "node"], ["row"])
    leaves = written(placed.withColumnsRenamed({"row_before": "at", "row_all": "n"}).drop("row"), "leaves")
    levels = climb(leaves, GROUP, fan_out)

    tops = written(levels[-1].select(*GROUP, F.col("node"), F.lit(1).alias("row"), F.lit(0).alias("all")), "subroots")
    sources = running_sums(tops, ["all"], GROUP, ["row"]).withColumnsRenamed({"row_before": "at", "row_all": "n"}).drop("row")
    upper = climb(written(sources, "subroots"), ["all"], fan_out)
    root = upper[-1].select("node").first()
    start = upper[-1].select("all", F.lit(0).cast("long").alias("at"), F.array().cast(PATH_TYPE).alias("path"))
    above = descend(upper, ["all"], start, fan_out)
    above = above.select(*GROUP, F.lit(0).cast("long").alias("at"), "path", F.col("node").alias("subroot"))
    found = descend(levels, GROUP, written(above, "subroots"), fan_out)
    return found.select(
        F.col("key").alias(key), F.col("node").alias("leaf"), *[F.col(f"_c_{n}").alias(n) for n in carry],
        "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "path",
    )
