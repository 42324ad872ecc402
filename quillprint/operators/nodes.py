"""Profiles of node tables ``(key, node_id, parent_id, depth, node_type, name)``.

Both profiles aggregate: a key that holds a third of all nodes is combined on
the map side before anything moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.operators.structural import DOUBLE_NAMED, PYTHON_NODE_TYPES
from quillprint.session import written

# Fixed values of the generic rules: node types matched whole, and fragments
# matched anywhere in the type.
NODE_FRAGMENTS = {
    "num_functions": "function",
    "num_classes": "class",
    "num_imports": "import",
    "num_calls": "call",
}
NODE_TYPES = {
    "num_if": ("if_statement", "if"),
    "num_for": ("for_statement", "for"),
    "num_while": ("while_statement", "while"),
}
EXTRA_FUNCTION_TYPES = ("method_declaration",)
IDENTIFIER_TYPES = ("identifier", "variable_name", "field_identifier", "name")


def _double(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def python_node_profile(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Counts, depth and name statistics per key under the Python node types."""
    kind, name = F.col("node_type"), F.col("name")
    weight = F.when(name.isNull(), 0).when(kind.isin(*DOUBLE_NAMED), 2).otherwise(1)
    weighted = F.sum(F.length(name) * weight).cast("double")
    return nodes.groupBy(key).agg(
        *[_double(F.count_if(kind.isin(*t))).alias(n) for n, t in PYTHON_NODE_TYPES.items()],
        _double(F.max("depth")).alias("max_ast_depth"),
        _double(F.try_divide(weighted, F.sum(weight))).alias("avg_identifier_len"),
        _double(F.count_distinct(name)).alias("num_unique_identifiers"),
    )


def node_profile(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Counts, depth, name and type statistics per key for any grammar's nodes.

    Types and names are tallied by value first, so that distinct counts and the
    size of the most common type fall out of one more aggregation.
    """
    named = F.col("node_type").isin(*IDENTIFIER_TYPES) & F.col("name").isNotNull()
    tallies = F.array_compact(
        F.array(
            F.struct(F.lit("type").alias("of"), F.col("node_type").alias("value")),
            F.when(named, F.struct(F.lit("name").alias("of"), F.col("name").alias("value"))),
        )
    )
    values = (
        nodes.select(key, "depth", F.inline(tallies))
        .groupBy(key, "of", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    )
    n, value = F.col("n"), F.col("value")
    is_type, is_name = F.col("of") == "type", F.col("of") == "name"

    def total(match: Column) -> Column:
        return _double(F.sum(F.when(is_type & match, n)))

    counts = {c: F.contains(value, F.lit(part)) for c, part in NODE_FRAGMENTS.items()}
    counts["num_functions"] = counts["num_functions"] | value.isin(*EXTRA_FUNCTION_TYPES)
    counts |= {c: value.isin(*types) for c, types in NODE_TYPES.items()}
    mean_length = F.try_divide(
        F.sum(F.when(is_name, F.length(value) * n)).cast("double"), F.sum(F.when(is_name, n))
    )
    return values.groupBy(key).agg(
        *[total(match).alias(c) for c, match in counts.items()],
        _double(F.max("depth")).alias("max_ast_depth"),
        _double(mean_length).alias("avg_identifier_len"),
        _double(F.count_if(is_name)).alias("num_unique_identifiers"),
        _double(F.count_if(is_type)).alias("total_node_types"),
        _double(F.max(F.when(is_type, n))).alias("most_common_node_type_count"),
    )


def node_depths(nodes: DataFrame, key: str = "id") -> DataFrame:
    """``nodes (key, node_id, parent_id, ..)`` with ``depth``, 1 for a root, worked out from the parents alone.

    Every node knows an ancestor and the steps to it; each round it takes over
    that ancestor's ancestor, so the distance doubles and a tree of depth d is
    done after log2(d) joins. A node whose parent is not in the table is a root.
    Nodes on a circle of parents, and those below one, have no depth, and neither
    have rows without key or node id. Of repeated rows of a node the smallest
    parent counts, a null one last; all of them get its depth. An existing
    ``depth`` is replaced. Both sides of every join are node tables, small on
    disk and large in memory: they are merged, never sent whole to the driver.
    """
    rows = nodes.drop("depth")
    known = rows.where(F.col(key).isNotNull() & F.col("node_id").isNotNull())
    single = written(known.groupBy(key, "node_id").agg(F.min("parent_id").alias("up")), "parents")
    there = single.select(F.col(key).alias("_key"), F.col("node_id").alias("_node"))
    parent = (F.col(key) == F.col("_key")) & (F.col("up") == F.col("_node"))
    # A parent that is not there counts like none.
    state = single.join(there.hint("merge"), parent, "left").select(key, "node_id", F.col("_node").alias("up"), F.lit(1).alias("steps"))
    state = written(state, "ancestors")
    most = single.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= most and not state.where("up IS NOT NULL").isEmpty():
        further = state.select(
            F.col(key).alias("_key"), F.col("node_id").alias("_node"), F.col("up").alias("_up"), F.col("steps").alias("_steps")
        )
        met = state.join(further.hint("merge"), parent, "left")
        steps = F.col("steps") + F.coalesce("_steps", F.lit(0))
        state = written(met.select(key, "node_id", F.col("_up").alias("up"), steps.alias("steps")), "ancestors")
        reach *= 2
    # Whoever still has an ancestor after more steps than there are nodes goes round in circles.
    depth = F.when(F.col("up").isNull(), F.col("steps")).cast("int")
    found = state.select(F.col(key).alias("_key"), F.col("node_id").alias("_node"), depth.alias("depth"))
    same = (F.col(key) == F.col("_key")) & (F.col("node_id") == F.col("_node"))
    return rows.join(found.hint("merge"), same, "left").select(*rows.columns, "depth")
