"""Fill-in-middle, sharding and the Merkle manifest beside plain Python, on odd tables too."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillprint.llm import infill, merkle, shards
from quillprint.operators.prefix import running_sums

LONG = "".join(f"line {i % 977}\n" for i in range(60_000))
ROWS = [
    (1, "src", "en", "one\ntwo\n\nthree", 1), (1, "src", "en", "one\ntwo\n\nthree", 1), (2, None, None, None, None), (3, "", "en", "", 0),
    (4, "src", "en", "\n", 1), (5, "src", "en", LONG, 7), (6, "src", "fr", LONG, 7), (None, "src", "en", "No id here", 3), (None, None, "en", None, 3),
    (7, "other", "de", "tail <S", 2), (8, "other", "de", "has <M> in it\nX", 2), (9, "zé", "de", "\U0001f600\nÄB\r\n\x00c", 2), (10, "src", "en", "-", None),
]
SCHEMA = "doc_id long, source string, lang string, text string, n_chars int"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, SCHEMA)
    # Names that the operators use themselves.
    return made.withColumns({n: F.lit(1) for n in ("fim", "_f_text", "shard", "size", "at", "n", "row", "node", "path", "_key", "known")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def infilled(doc_id, text, rule):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    key = sha(f"{rule.seed}:{'' if doc_id is None else doc_id}")
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in rule.marks) or h[2] % 100 >= rule.percent:
        return len(units), "plain", None, None, text
    p, s, m = rule.prefix + pre, rule.suffix + suf, rule.middle + mid
    form, out = ("spm", s + p + m) if h[3] % 100 < rule.suffix_first_percent else ("psm", p + s + m)
    return len(units), form, len(pre), len(mid), out


@pytest.mark.parametrize("rule", [infill.Rule(), infill.Rule(percent=50, seed="x"), infill.Rule(prefix="<<", suffix="[s]", middle="$1", suffix_first_percent=0)])
def test_fill_in_middle(docs, empty, rule):
    made = infill.fill_in_middle(docs, rule)
    assert made.columns == [c for c in docs.columns if c != "fim"] + ["fim"]
    rows = made.withColumn("back", infill.restored(F.col("fim.output"), F.col("fim.form"), rule)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert tuple(r.fim) == infilled(r.doc_id, r.text or "", rule)
        assert r.back == (r.text or "")
    assert infill.fill_in_middle(empty, rule).count() == 0
    assert made.where("fim.form = 'plain'").count() == sum(r.fim.form == "plain" for r in rows)


def test_units_must_cover_the_text(spark):
    odd = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not cover"):
        infill.fill_in_middle(odd, infill.Rule(unit="[a-z]")).collect()


def test_words_as_units(spark):
    text = "  the cat\tsat on\nthe mat "
    odd = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = infill.fill_in_middle(odd, infill.Rule(unit=r"\s*+\S++|\s++")).first().fim
    assert got.n == 7


@pytest.mark.parametrize("n_shards", [1, 3, 40])
def test_shards(docs, empty, n_shards):
    rows = shards.shard_documents(docs, n_shards, keep=["text", "lang", "shard"]).collect()
    assert len(rows) == len(ROWS)
    size = lambda t: len((t or "").encode()) + 16
    want = sorted(((d is not None, d or 0, zlib.crc32((t or "").encode()), size(t)) for d, _, _, t, _ in ROWS))
    whole, before, slots, expected = sum(w[3] for w in want), 0, {}, []
    for known, d, crc, n in want:
        s = min((2 * before + n) * n_shards // (2 * whole), n_shards - 1)
        slots[s] = slots.get(s, -1) + 1
        expected.append((d if known else None, n, crc, s, slots[s]))
        before += n
    got = [(r[0], r[1], r[2], r[-2], r[-1]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert shards.shard_documents(empty, n_shards).count() == 0


def test_shards_are_balanced(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shards.shard_documents(docs, 8).collect()
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(abs(s - sum(sums) / 8) for s in sums) <= max(r.size for r in rows)
    ordered = [r.shard for r in sorted(rows, key=lambda r: r.doc_id)]
    assert ordered == sorted(ordered)


def test_no_size_at_all(spark):
    docs = spark.createDataFrame([(i, None) for i in range(5)], "doc_id long, text string")
    got = shards.shard_documents(docs, 4, overhead=0).collect()
    assert {(r.shard, r.slot) for r in got} == {(0, i) for i in range(5)}
    with pytest.raises(ValueError, match="a shard at least"):
        shards.shard_documents(docs, 0)


def test_shards_are_written(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    shards.write_shards(docs.drop("shard"), path, 3)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    for s in range(3):
        slots = sorted(r.slot for r in back.where(f"shard = {s}").collect())
        assert slots == list(range(len(slots)))


def test_running_sums_of_hot_groups(spark):
    """A group and a key with most of the rows lie in several ranges, and their sums go on from range to range."""
    dice = random.Random(3)
    data = [(None if dice.random() < 0.6 else dice.randrange(4), 5 if dice.random() < 0.5 else dice.randrange(40), dice.randrange(9), i) for i in range(3000)]
    rows = spark.createDataFrame(data, "g int, k int, v int, i int")
    got = running_sums(rows.na.fill(-1, ["g"]), ["g"], ["k"], ["v"]).collect()
    for group in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == group), key=lambda r: (r.k, r.v_before, r.v))
        total = 0
        for r in mine:
            assert r.v_before == total
            total += r.v
        assert {r.v_all for r in mine} == {total}
    assert len(got) == 3000


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes, fan_out):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan_out])) for i in range(0, len(levels[-1]), fan_out)])
    return levels


def path_of(levels, at, fan_out):
    out = []
    for level in levels[:-1]:
        run = at // fan_out * fan_out
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fan_out])))
        at //= fan_out
    return out


def check_manifest(rows, got, fan_out):
    groups: dict = {}
    for r in rows:
        leaf = sha("".join(framed(r[c]) for c in LEAF))
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf for *_, leaf in sorted(groups[s])], fan_out) for s in names}
    top = levels_of([trees[s][-1][0] for s in names], fan_out)
    want = []
    for i, s in enumerate(names):
        for at, (known, d, leaf) in enumerate(sorted(groups[s])):
            path = path_of(trees[s], at, fan_out) + path_of(top, i, fan_out)
            want.append((d if known else None, leaf, trees[s][-1][0], top[-1][0], path))
    have = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, leaf, _, root, path in have:
        node = leaf
        for left, right in path:
            node = sha(left + node + right)
        assert node == root


@pytest.mark.parametrize("fan_out", [2, 3, 16])
def test_manifest(docs, empty, fan_out):
    made = merkle.manifest(docs, fan_out=fan_out)
    check_manifest([r.asDict() for r in docs.select(*LEAF).collect()], made.collect(), fan_out)
    assert made.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert merkle.manifest(empty, fan_out=fan_out).count() == 0


def test_manifest_of_many_and_hot_groups(spark):
    """A third of the rows in one source, and more sources than a run has room for."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 45}", "en", i % 7, f"T{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    check_manifest([dict(zip(docs.columns, r, strict=True)) for r in rows], merkle.manifest(docs).collect(), 16)


def test_manifest_of_one_row(spark):
    docs = spark.createDataFrame([(1, None, "en", 2, "ab")], "doc_id long, source string, lang string, n_chars int, text string")
    r = merkle.manifest(docs).first()
    assert (r.leaf, r.path) == (r.root, [])
    assert r.subroot == sha("1:1" + "-" + "2:en" + "1:2" + "2:ab")


def test_change_is_noticed(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars int, text string")
    forged = merkle.leaf_of([*map(F.col, LEAF[:-1]), F.when(F.col("doc_id") == 7, "x").otherwise(F.col("text"))])
    made = merkle.manifest(docs, carry={"shown": forged})
    bad = made.where(merkle.folded(F.col("shown"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [7]
