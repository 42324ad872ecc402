"""Golden snippets, routes and edge inputs of the structural row."""

import ast
import random
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillprint.functions import lexical
from quillprint.operators import nodes, structural, syntax
from quillprint.operators.lengths import LENGTH_COLUMNS, length_features
from quillprint.operators.nodes import node_profile, python_node_profile
from quillprint.operators.structural import (
    STRUCTURAL_COLUMNS,
    lexical_features,
    structural_features,
)
from quillprint.operators.syntax import syntax_nodes

GOLDEN = [
    ("g1", "python", "import os\n\ndef f(a):\n    # c\n    if a:\n        return g(a)\n    x = 1\n"),
    (
        "g2",
        "java",
        "// hi\npublic class A {\n  int f(int x) { if (x == 1) { return g(x); } return 0; }\n}\n",
    ),
    (
        "g3",
        "c",
        "/* c */\nfor (i = 0; i < n; i++) { s += a[i]; }\r\n\r\n\r\nwhile (p) p = next(p);\n",
    ),
    ("g4", "", ""),
    ("g5", None, "x = 1\n"),
    ("g6", "python", "def f(:\n  pass\n"),
    ("g7", "javascript", "try { if (a) b(); } catch (e) { }"),
]
LENGTHS = {
    "g1": (69, 8, 8.625, 0.142857),
    "g2": (83, 5, 16.6, 0.25),
    "g3": (75, 6, 12.5, 0.2),
    "g4": (0, 1, 0, 0),
    "g5": (6, 2, 3, 0),
    "g6": (15, 3, 5, 0),
    "g7": (33, 1, 33, 0),
}
STRUCTURE = {
    "g1": dict(
        avg_identifier_len=1.333333, blank_line_ratio=0.125, char_count=69, comment_ratio=0.125,
        line_count=8, max_ast_depth=7, num_assign=1, num_calls=1, num_colons=2, num_functions=1,
        num_if=1, num_imports=1, num_parens=4, num_unique_identifiers=2,
    ),
    "g2": dict(
        parse_error=1, avg_identifier_len=2.785714, char_count=83, comment_ratio=0.2, line_count=5,
        num_assign=2, num_braces=6, num_calls=3, num_if=1, num_parens=6, num_semicolons=2,
        num_unique_identifiers=10,
    ),
    "g3": dict(
        avg_identifier_len=1.642857, blank_line_ratio=0.333333, char_count=75,
        comment_ratio=0.166667, line_count=6, num_assign=3, num_braces=2, num_calls=3, num_for=1,
        num_parens=6, num_semicolons=4, num_unique_identifiers=9, num_while=1,
    ),
    "g4": {},
    "g5": dict(
        avg_identifier_len=1, char_count=6, line_count=2, num_assign=1, num_unique_identifiers=1
    ),
    "g6": dict(
        parse_error=1, avg_identifier_len=2.666667, char_count=15, line_count=3, num_calls=1,
        num_colons=1, num_parens=1, num_unique_identifiers=3,
    ),
    "g7": dict(
        avg_identifier_len=2.166667, char_count=33, line_count=1, num_braces=4, num_calls=3,
        num_if=1, num_parens=6, num_semicolons=1, num_unique_identifiers=6,
    ),
}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(GOLDEN, "id string, language string, code string")


def snippets(spark, rows):
    return spark.createDataFrame(
        [(i, c, lang) for i, (c, lang) in enumerate(rows)], "id long, code string, language string"
    )


def test_length_goldens(golden):
    for row in length_features(golden).collect():
        assert [row[c] for c in LENGTH_COLUMNS] == pytest.approx(LENGTHS[row["id"]], abs=1e-6)


def test_structural_goldens(golden):
    out = structural_features(golden)
    assert out.columns == ["id", *STRUCTURAL_COLUMNS]
    for row in out.collect():
        want = {c: STRUCTURE[row["id"]].get(c, 0.0) for c in STRUCTURAL_COLUMNS}
        assert {c: row[c] for c in STRUCTURAL_COLUMNS} == pytest.approx(want, abs=1e-6), row["id"]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitioning_does_not_matter(golden, partitions):
    base = {tuple(r) for r in structural_features(golden).collect()}
    assert {tuple(r) for r in structural_features(golden.repartition(partitions)).collect()} == base


def test_single_python_pass(golden):
    plan = structural_features(golden)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_edges(spark):
    deep_parens = "(" * 2000 + "1" + ")" * 2000
    deep_tree = "x = 1" + "+1" * 1500
    rows = [
        (None, "python"),
        ("def f(): pass".ljust(4999), None),
        ("def f(): pass".ljust(5000), None),
        ("x = 1\n".ljust(10000), "python"),
        ("x = 1\n".ljust(10001), "python"),
        ("x = 1\x00", "python"),
        (deep_parens, "python"),
        (deep_tree, "python"),
        ("async def f():\n  async for a in b: pass\ntry:\n  pass\nexcept E as e:\n  pass\n", "py"),
        ("x += 1\ny: int = 2\nfrom a import b as c, d\n", " Python "),
    ]
    limited = structural_features(
        snippets(spark, rows), with_status=True, parse_limit=10_000, unhinted_limit=5000
    )
    out = {r["id"]: r for r in limited.collect()}
    assert out[0]["parse_error"] == 0 and out[0]["max_ast_depth"] == 1 and out[0]["line_count"] == 0
    assert out[1]["num_functions"] == 1 and out[1]["status"] == "parsed"
    assert out[2]["num_functions"] == 0 and out[2]["status"] is None and out[2]["parse_error"] == 0
    assert out[3]["parse_error"] == 0 and out[3]["max_ast_depth"] > 0
    assert out[4]["parse_error"] == 1 and out[4]["num_assign"] == 1
    assert out[5]["parse_error"] == 1
    assert out[6]["parse_error"] == 1 and out[6]["num_parens"] == 4000
    assert out[7]["status"] == "parsed" and out[7]["parse_error"] == 0
    assert out[7]["char_count"] == len(deep_tree) and out[7]["max_ast_depth"] > 1500
    assert out[8]["num_functions"] == 1 and out[8]["num_for"] == 1 and out[8]["num_try"] == 1
    assert out[8]["num_unique_identifiers"] == 2
    assert out[9]["num_assign"] == 0 and out[9]["num_imports"] == 1
    assert out[9]["num_unique_identifiers"] == 2


def test_node_table_agrees_with_row_counts(golden):
    nodes = syntax_nodes(golden.where("id = 'g1'"))
    profile = python_node_profile(nodes).first()
    for name, value in STRUCTURE["g1"].items():
        if name in profile.__fields__:
            assert profile[name] == pytest.approx(value, abs=1e-6)
    roots = nodes.where("parent_id is null").collect()
    assert [(r["node_type"], r["depth"]) for r in roots] == [("Module", 1)]


def test_worker_batches_are_bounded(monkeypatch):
    codes = pa.array(["x = 1", None, "def f(:", "y = g(2)"] * 3)
    whole = pa.concat_arrays(list(syntax._parse_batches(iter([codes, codes]))))
    monkeypatch.setattr(syntax, "NODES_PER_BATCH", 10)
    parts = list(syntax._parse_batches(iter([codes, codes])))
    assert len(parts) > 4 and pa.concat_arrays(parts).equals(whole)
    assert whole.field("status").to_pylist()[:4] == ["parsed", None, "failed", "parsed"]


def test_generic_profile(spark):
    rows = [
        (1, 0, None, 1, "program", None),
        (1, 1, 0, 2, "function_declaration", None),
        (1, 2, 1, 3, "identifier", "abc"),
        (1, 3, 1, 3, "identifier", "abc"),
        (1, 4, 1, 3, "name", "x"),
        (1, 5, 1, 3, "method_declaration", None),
        (1, 6, 1, 4, "call_expression", None),
        (1, 7, 1, 4, "if", None),
        (2, 0, None, 1, "program", "ignored"),
    ]
    nodes = spark.createDataFrame(
        rows, "id long, node_id long, parent_id long, depth int, node_type string, name string"
    )
    got = {r["id"]: r.asDict() for r in node_profile(nodes).collect()}
    one = got[1]
    assert one["num_functions"] == 2 and one["num_calls"] == 1 and one["num_if"] == 1
    assert one["avg_identifier_len"] == pytest.approx(7 / 3)
    assert one["num_unique_identifiers"] == 2 and one["max_ast_depth"] == 4
    assert one["total_node_types"] == 7 and one["most_common_node_type_count"] == 2
    assert got[2]["avg_identifier_len"] == 0 and got[2]["total_node_types"] == 1


def test_lexical_row(golden):
    row = lexical_features(golden).where("id = 'g2'").first()
    assert row["comment_ratio"] == 0.25 and row["num_if"] == 1 and row["num_functions"] == 0


def test_expressions_accept_a_stream(spark, golden, tmp_path):
    golden.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(golden.schema).parquet(str(tmp_path / "in"))
    query = (
        structural_features(stream)
        .writeStream.format("memory")
        .queryName("structure")
        .option("checkpointLocation", str(tmp_path / "check"))
        .start()
    )
    query.processAllAvailable()
    query.stop()
    assert spark.table("structure").where(F.col("id") == "g1").first()["max_ast_depth"] == 7


def test_hot_key_profile(spark):
    """A third of all nodes under one key."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        F.col("id").alias("node_id"),
        F.lit(None).cast("long").alias("parent_id"),
        (F.col("id") % 9).cast("int").alias("depth"),
        F.when(F.col("id") % 2 == 0, "identifier").otherwise("call").alias("node_type"),
        F.concat(F.lit("n"), F.col("id") % 50).alias("name"),
    )
    hot = node_profile(rows).where("id = 0").first()
    assert hot["num_calls"] == 5000 and hot["most_common_node_type_count"] == 5000
    assert hot["num_unique_identifiers"] == 25 and hot["max_ast_depth"] == 6
    assert python_node_profile(rows).where("id = 0").first()["num_unique_identifiers"] == 50


def test_long_and_deep_code_is_parsed(spark):
    """Without limits, length and depth change nothing, and text columns need no parser."""
    chain = "x = a" + ".b" * 1500
    rows = [("a = f(1)\n" * 2500, "python"), (chain, "python"), ("x = 1" + "+1" * 1500, "python"), ("def f(): pass".ljust(9000), None)]
    table = snippets(spark, rows)
    out = {r["id"]: r for r in structural_features(table, with_status=True).collect()}
    assert [out[i]["status"] for i in range(4)] == ["parsed"] * 4
    assert out[0]["num_calls"] == 2500 and out[0]["char_count"] == 22_500 and out[0]["parse_error"] == 0
    assert out[1]["char_count"] == len(chain) and out[1]["max_ast_depth"] > 1500
    assert out[3]["num_functions"] == 1
    assert syntax_nodes(table).where("id = 2 AND node_type = 'BinOp'").count() == 1500
    plan = structural_features(table).select("id", "char_count")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_failed_rows_go_to_a_folder_of_their_own(spark, tmp_path):
    """One parser stage, one write: every row is in one of both, with the counts that the plain features have."""
    rows = [(i, "def f(:" if i % 5 == 0 else f"x{i} = f({i})", "python", i % 2) for i in range(40)] + [(40, None, None, 1), (41, "a;b", "c", 0)]
    df = spark.createDataFrame(rows, "id long, code string, language string, label int")
    good, failed = structural.write_features(df, str(tmp_path / "features"))
    assert {r["id"] for r in failed.collect()} == set(range(0, 40, 5))
    assert all(r["error"].startswith("SyntaxError: ") for r in failed.collect())
    both = sorted(map(tuple, good.unionByName(failed.drop("error")).collect()))
    assert both == sorted(map(tuple, structural.structural_features(df).select(*good.columns).collect()))
    none = structural.write_features(df.limit(0), str(tmp_path / "none"))
    assert [x.count() for x in none] == [0, 0]


def test_depths_from_parents(spark):
    """Chains, circles, orphans, repeated rows and rows without keys."""
    rows = [("chain", i, i - 1 if i else None) for i in range(300)]
    rows += [("star", 0, None), *[("star", i, 0) for i in range(1, 50)]]
    rows += [("circle", 1, 2), ("circle", 2, 3), ("circle", 3, 1), ("circle", 4, 1), ("circle", 5, None), ("circle", 6, 6)]
    rows += [("orphan", 1, 99), ("orphan", 2, 1), (None, 1, None), ("odd", None, 1), ("odd", 1, None), ("odd", 1, None), ("odd", 2, 1), ("odd", 2, None)]
    df = spark.createDataFrame(rows, "id string, node_id long, parent_id long").withColumn("depth", F.lit("x"))
    got = nodes.node_depths(df).collect()
    assert len(got) == len(rows)
    depth = {(r.id, r.node_id): r.depth for r in got}
    assert all(depth["chain", i] == i + 1 for i in range(300))
    assert depth["star", 0] == 1 and {depth["star", i] for i in range(1, 50)} == {2}
    assert [depth["circle", i] for i in range(1, 7)] == [None, None, None, None, 1, None]
    assert (depth["orphan", 1], depth["orphan", 2]) == (1, 2)
    assert (depth[None, 1], depth["odd", None], depth["odd", 1], depth["odd", 2]) == (None, None, 1, 2)
    assert nodes.node_depths(df.limit(0)).count() == 0


def _whole(code):
    """Type, name and depth of every node below the root, from one parse of the whole snippet; None if it fails."""
    try:
        level, found, depth = [ast.parse(code)], [], 1
    except Exception:
        return None
    while level:
        level, depth = [n for node in level for n in ast.iter_child_nodes(node)], depth + 1
        found += [(type(n).__name__, depth, getattr(n, "name", None)) for n in level]
    return sorted(found, key=repr)


def test_pieces_make_the_whole_tree():
    odd = [
        "", "\n", "x = 1", "if a:\n  b\nelse:\n  c\n", "if a:\n  b\nelsewhere = 1\n", "@d\n@e\ndef f():\n  pass\ny\n", "@d\n# c\n\nclass K: pass",
        "s = '''a\nb = 1\n'''\nz", "s = '''a\nb = 1\n", "q = (1,\nr,\n)\nt", "x = 1 \\\ny\n", "x = \\\ny\n", "a\r\nb\r\n", "a\rb\n", "try:\n  a\nexcept E as e:\n  b\nfinally:\n  c",
        "match x:\n  case 1: y\nz = 1\n", "else:\n  a\n", "x\n  y\n", "a; b\nc", "x = 1\n\x0cy = 2\n", "x\n\\", "def f(:\nx = 1\n", "x = 1\n\x00\n", "v = f'''\na{b}\nc'''\nw",
    ]
    nodes = pa.concat_arrays(list(syntax._parse_batches(iter([pa.array(odd)] * 2)))).to_pylist()
    for code, row in zip(odd * 2, nodes, strict=True):
        want = _whole(code)
        assert row["status"] == ("failed" if want is None else "parsed"), code
        if want is not None:
            got = zip(row["types"][1:], row["depths"][1:], row["names"][1:])
            assert sorted(got, key=repr) == want, code
            ups = [row["depths"][p] + 1 for p in row["parents"][1:]]
            assert ups == row["depths"][1:] and row["parents"][0] is None and row["depths"][0] == 1


def test_repeated_statements_are_parsed_once(monkeypatch):
    parsed, parse = [], ast.parse

    def counted(code):
        parsed.append(len(code))
        return parse(code)

    codes = pa.array([f"class K{i}:\n    pass\n" + "if a: b = g(1)\nc = 2\n" * 500 for i in range(20)])
    size = sum(len(c) for c in codes.to_pylist())
    monkeypatch.setattr(syntax.ast, "parse", counted)
    outlines = pa.concat_arrays(list(syntax._outline_batches(iter([codes])))).to_pylist()
    assert sum(parsed) < size / 100
    assert all(len(o["types"]) == 1 + 500 * 4 and o["names"] == [f"K{i}"] for i, o in enumerate(outlines))
    parsed.clear()
    trees = pa.concat_arrays(list(syntax._parse_batches(iter([codes])))).to_pylist()
    assert sum(parsed) < size / 100 and all(len(t["types"]) > 500 * 12 for t in trees)


def test_depths_send_no_node_table_to_the_driver(spark, monkeypatch):
    """However small a node table is on disk, no join copies it whole."""
    plans, write = [], nodes.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(nodes, "written", seen)
    rows = [(1, i, i - 1 if i else None) for i in range(9)] + [(2, 5, 5), (3, 1, 7)]
    deep = nodes.node_depths(spark.createDataFrame(rows, "id long, node_id long, parent_id long"))
    plans.append(deep._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
    got = {(r["id"], r["node_id"]): r["depth"] for r in deep.collect()}
    assert [got[1, i] for i in range(9)] == list(range(1, 10)) and got[2, 5] is None and got[3, 1] == 1


def test_pieces_that_differ_in_identifiers_are_parsed_once():
    outlines, seen = syntax._Outlines(), []
    read = outlines.memory.read
    outlines.memory.read = lambda tree: seen.append(tree) or read(tree)
    codes = ["".join(f"if v{i}_{k}: v{i}_{k} = g(1)\n" for k in range(20)) for i in range(50)]
    for code in codes:
        outlines.read(code)
    assert len(seen) == 1
    assert outlines.columns[2] == [read(ast.parse(code))[0] for code in codes]


def test_tallies_are_the_nodes_grouped(spark):
    codes = ["x = 1\nif a: b = c(1)\nif d: e = f(1)\n", "class A:\n    def m(self):\n        pass\n", "def f(:\n", "", None, "x = 1\n" * 40]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    want = syntax_nodes(df).groupBy("id", "node_type", "depth").agg(F.count(F.lit(1)).alias("n"))
    got = syntax.syntax_tallies(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shapes_keep_trees_and_failures():
    tokens = ["a1", "_", "if", "else", "print", "in", "is", "not", "lambda", "None", "await", "type", "match", "case", "def", "import", "as", "except"]
    tokens += ["1", "1.", "1.e5", ".5e3", "0x1f", "1if", "1j", "0or", "b'x'", "f'{a1}'", "'q'", "#c", "é", "=", ":", ":=", "(", ")", "[", "]", "{", "}"]
    tokens += [",", ".", "...", "*", "**", "+", "-", "->", ";", "\\", "\t", "\n    ", "\x0c", "e5", "b", "rb", "x_1", "global", "del", "return"]
    dealt = random.Random(5)
    parsed = 0
    for _ in range(30_000):
        piece = "".join(dealt.choice(tokens) + dealt.choice(["", " "]) for _ in range(dealt.randint(1, 6)))
        found = []
        for code in (piece, syntax._shape(piece)):
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                try:
                    found.append((syntax._preorder(ast.parse(code + "\n")), syntax._Outlines().outline(ast.parse(code + "\n"))))
                except Exception as failure:  # noqa: BLE001
                    found.append(type(failure).__mro__[-3])
        assert found[0] == found[1], piece
        parsed += isinstance(found[0], tuple)
    assert parsed > 1_000


def test_marks_are_searched_only_where_they_are(spark):
    codes = ["", "f (x) g\t(y) (z)", "no marks", "# a\n // b\n x # c", "a\n * b", "é(1)", "(", "word"]
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string").coalesce(1)
    c = F.col("code")
    got = df.orderBy("id").select(lexical.call_count(c), lexical.comment_line_count(c)).collect()
    assert [tuple(r) for r in got] == [(0, 0), (2, 0), (0, 0), (0, 2), (0, 1), (1, 0), (0, 0), (0, 0)]
    for count, mark in ((lexical.call_count, "("), (lexical.comment_line_count, "#")):
        plan = df.select(count(c))._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in plan and "Contains(code" in plan and mark in plan
