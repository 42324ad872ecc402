"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles link when their Jaccard similarity reaches a threshold.
Sets are put into bands of size; two linked sets lie in one band or in
neighbouring ones, and within a band the threshold bounds how many shingles
they may differ in. The shingles are hashed into groups and each group into a
few parts, so many that some group of two linked sets differs in fewer parts
than it may lose: one of its subsets of parts has the same contents in both
sets. The hash of each such subset is a signature, so linked sets share one.
There are more groups than needed for that, so linked sets share several: of the
signatures that a set has in a band, it leaves out as many as linked sets share
beyond one, those that most sets have (passages that many unlike texts quote).
All order signatures alike, so the rarest that two linked sets share stays in both.

Copies of one set are compared as one. Candidates are checked exactly if their
sizes and sketches allow a link. Within a signature every set is first compared
with a pivot only, the set that meets most others. Sets that share a signature and are
not yet known to be connected then meet by prefixes: by the shingles that are the
rarest among such sets, of which linked sets share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillprint.llm.components import connected
from quillprint.llm.support import small_or_shuffled, text_of, written

PIVOT_ROUNDS = 2
BROADCAST_IDS = 200_000
#: Texts that a worker holds as Python strings at once.
SLICE = 256
SKETCH = ("s0", "s1", "s2", "s3")
#: Signatures that a set leaves out, in bands of even and of odd numbers.
BEYOND = ("even", "odd")

# Odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TAG_A, TAG_B, TAG_C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity in percent, and the shape of the signatures.

    A group of shingles is cut into ``parts`` parts of which ``errors`` may differ.
    Sets so small that they may differ in ``few_errors`` shingles at most are one
    group of more parts, of which as many may differ.
    """

    words: int = 5
    percent: int = 80
    errors: int = 1
    parts: int = 3
    few_errors: int = 2
    few_parts: int = 8

    def linked(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashed_words(text: str) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased; whole texts at once."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    blank = IS_SPACE[raw]
    edges = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    size = 1 << max(12, int(len(raw)).bit_length())
    inverse = pow(BASE, -1, 1 << 64)
    codes = (LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(raw)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * powers(inverse, size)[starts] + (ends - starts).astype(np.uint64) * TAG_A)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words is empty."""
    hashes = hashed_words(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        total = mix(total * TAG_B + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(total)


@dataclass(frozen=True)
class Band:
    number: int
    last: int
    errors: int
    parts: int
    groups: int
    spare: int  # groups of two linked sets that keep within the errors, at least


@lru_cache(maxsize=8)
def bands(rule: Rule) -> list[Band]:
    out, first, ratio = [], 1, 100 / rule.percent
    stretch = 3 if rule.percent >= 85 else 2
    while first < 1 << 31:
        last = max(first, int(first * ratio**stretch), first * 100 // rule.percent)
        differing = 2 * last * (100 - rule.percent) // (100 + rule.percent)
        small = differing <= rule.few_errors
        errors, parts = (differing, rule.few_parts if differing else 1) if small else (rule.errors, rule.parts)
        least = differing // (errors + 1) + 1
        # Groups that are empty in some set cannot tell sets apart, so there are a few more than needed.
        empty = least * exp(-(parts - errors) / parts * first / ratio / least)
        groups = least + (ceil(empty + 3 * sqrt(empty)) if least > 1 else 0)
        out.append(Band(len(out), last, errors, parts, groups, groups - least + 1))
        first = last + 1
    return out


def used_bands(size: int, rule: Rule) -> list[Band]:
    """The band of a set's size, and the next if linked sets may lie there."""
    all_bands = bands(rule)
    own = next(b for b in all_bands if size <= b.last)
    return [own, all_bands[own.number + 1]] if size * 100 // rule.percent > own.last else [own]


def placed(shingles: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """The part that each shingle lies in, and which parts of each group are filled."""
    place = (shingles % np.uint64(band.groups * band.parts)).astype(np.int64)
    return place, np.bincount(place, minlength=band.groups * band.parts).reshape(band.groups, band.parts) > 0


def beyond_one(shingles: np.ndarray, rule: Rule) -> list[int]:
    """By the parity of the band's number: how many signatures beyond one any linked set shares with this set, at least.

    A group disagrees only if more shingles than its errors differ in it; an agreement on nothing has no signature.
    """
    size, out = len(shingles), [0, 0]
    for band in used_bands(size, rule) if size else []:
        largest = min(band.last, size * 100 // rule.percent)
        differing = (size + largest) * (100 - rule.percent) // (100 + rule.percent)
        _, filled = placed(shingles, band)
        empty = int((filled.sum(axis=1) <= band.errors).sum())
        out[band.number % 2] = max(0, band.groups - differing // (band.errors + 1) - empty - 1)
    return out


def signatures(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """Sorted distinct hashes, whose lowest bit is that of the band's number."""
    if not len(shingles):
        return shingles
    content = mix(shingles + TAG_C)
    out = []
    for band in used_bands(len(shingles), rule):
        place, filled = placed(shingles, band)
        sums = np.zeros(band.groups * band.parts, np.uint64)
        np.add.at(sums, place, content)
        sums = sums.reshape(band.groups, band.parts)
        groups = np.arange(band.groups, dtype=np.uint64)
        found, empty = [], np.zeros(band.groups, bool)
        for n, chosen in enumerate(combinations(range(band.parts), band.parts - band.errors)):
            cols = list(chosen)
            tag = np.uint64((band.number * 1000 + n + 1) * int(TAG_A) & 0xFFFFFFFFFFFFFFFF)
            sig = mix(sums[:, cols].sum(axis=1, dtype=np.uint64) + groups * TAG_B + tag)
            sig = (sig & ~np.uint64(1)) | np.uint64(band.number % 2)
            none = ~filled[:, cols].any(axis=1)
            empty |= none
            found.append((sig, none))
        # Empty subsets only count for sets in which they could be all that agrees.
        keep_empty = empty.sum() >= band.spare
        out += [sig if keep_empty else sig[~none] for sig, none in found]
    return np.unique(np.concatenate(out))


def sketch(shingles: np.ndarray, words: int = 4) -> np.ndarray:
    """The parity of the shingles in each of ``64 * words`` classes; two sets differ in at least as many shingles as in bits."""
    classes = 64 * words
    odd = np.bincount((mix(shingles ^ TAG_C) & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_words(size: int) -> int:
    """Words of a set's fine sketch: about as many bits as shingles, so that unlike sets differ in more bits than linked ones may."""
    return 1 << max(2, min(9, (size >> 6).bit_length()))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``SLICE`` at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def set_traits(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each row of ``docs (doc, text)``: set size, a 128-bit key of the contents, signatures to leave out, a short and a fine sketch."""
    names = ("n_shingles", "high", "low", *BEYOND, *SKETCH)
    schema = "doc long, " + ", ".join(f"{n} long" for n in names) + ", fine array<long>"

    def traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            rows, fine = np.zeros((batch.num_rows, len(names)), np.int64), []
            for row, t in zip(rows, batch.column(1).to_pylist(), strict=True):
                found = shingle_set(t, rule.words)
                row[0] = len(found)
                row[1:3] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                row[3:5] = beyond_one(found, rule)
                row[5:] = sketch(found)
                fine.append(sketch(found, fine_words(len(found))))
            columns = [pa.array(np.ascontiguousarray(c)) for c in rows.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(fine, pa.list_(pa.int64()))], names=["doc", *names, "fine"])

    return docs.mapInArrow(traits, schema)


def signature_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """``(sig, doc)`` of every signature of every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: list, sigs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(ids))], names=["sig", "doc"])

        ids, sigs, held = [], [], 0
        for batch in slices(batches):
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = signatures(shingle_set(t, rule.words), rule)
                ids.append(np.full(len(found), doc, np.int64))
                sigs.append(found.view(np.int64))
                held += len(found)
                if held > 200_000:
                    yield rows(ids, sigs)
                    ids, sigs, held = [], [], 0
        if held:
            yield rows(ids, sigs)

    return docs.mapInArrow(sign, "sig long, doc long")


def checked_pairs(pairs: DataFrame, docs: DataFrame, rule: Rule, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(a, b, linked)`` of ``pairs (a, b)``, and the sets ``(doc, shingles)`` that decided: the exact similarity does.

    Only documents that occur in a pair, and whose sets are not ``held`` from
    earlier pairs, are read into sets again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, rule.words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc", "shingles"])

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    ids = written(ids if held is None else ids.join(held.select("doc"), "doc", "left_anti"), "paired")
    needed = docs.join(small_or_shuffled(ids, BROADCAST_IDS), "doc", "left_semi")
    sets = written(needed.select("doc", "text").mapInArrow(cut, "doc long, shingles array<long>"), "sets")
    sets = sets if held is None else held.unionByName(sets)
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    # Compared by Spark: batches of pairs for Python would hold the sets once more on either side.
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    linked = (100 + rule.percent) * shared >= rule.percent * (F.size("left") + F.size("right")).cast("long")
    return both.select("a", "b", linked.alias("linked")), sets


def may_link(rule: Rule) -> Column:
    """Whether the sizes and sketches of sides ``x`` and ``y`` leave room for the least similarity."""
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    differing = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in SKETCH), F.lit(0))
    fits = (100 * n >= rule.percent * m) & (100 * m >= rule.percent * n)
    return fits & (differing * (100 + rule.percent) <= (n + m) * (100 - rule.percent))


def rarest(rows: DataFrame, traits: DataFrame) -> DataFrame:
    """``rows (sig, doc, n)`` without those of each document's signatures that it may leave out: the most frequent ones, ``n`` sets having them.

    Of a document of several sets, as many are left out as the set with the fewest allows.
    """
    allowed = traits.groupBy("doc").agg(*[F.min(c).alias(c) for c in BEYOND])
    odd = F.pmod("sig", F.lit(2)) == 1
    place = F.row_number().over(Window.partitionBy("doc", "odd").orderBy(F.desc("n"), F.desc("sig")))
    ranked = rows.join(allowed, "doc").select("sig", "doc", "n", odd.alias("odd"), F.when(odd, F.col("odd")).otherwise(F.col("even")).alias("beyond"))
    return ranked.withColumn("place", place).where("place > beyond").select("sig", "doc", "n")


def first_pairs(signed: DataFrame, traits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sig, doc)`` of the signatures that several sets share, and pairs ``(a, b)`` of each such set with a pivot.

    A set's degree is the number of its meetings: the sizes of all its
    signatures' groups, summed. The pivot of a signature is the set of the
    highest degree in it. Where many sets are changed copies of one, that one
    shares more signatures than they share with each other, and one pair each
    connects them.
    """
    # Counted and joined as dealt: signatures, most of which occur once, are shuffled once for both.
    dealt = signed.repartition("sig")
    shared = dealt.groupBy("sig").agg(F.count("doc").alias("n")).where("n > 1")
    rows = written(dealt.join(shared, "sig").select("sig", "doc", "n"), "bucketed")
    rows = written(rarest(rows, traits), "rarest")
    degree = written(rows.groupBy("doc").agg(F.sum("n").alias("degree")), "degrees")
    ranked = rows.select("sig", "doc").join(degree, "doc")
    pivots = written(ranked.groupBy("sig").agg(F.max(F.struct("degree", "doc"))["doc"].alias("pivot")), "pivots")
    met = rows.join(pivots, "sig").where("doc != pivot")
    pairs = met.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
    return rows.select("sig", "doc"), pairs


def likely_pairs(pairs: DataFrame, traits: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs (a, b)`` whose sizes and sketches leave room for a link."""
    x = traits.select(F.col("doc").alias("a"), F.struct("n_shingles", "fine", *SKETCH).alias("x"))
    y = traits.select(F.col("doc").alias("b"), F.struct("n_shingles", "fine", *SKETCH).alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(may_link(rule))
    bits = F.zip_with("x.fine", "y.fine", lambda v, w: F.bit_count(v.bitwiseXOR(w)).cast("long"))
    differing = F.aggregate(bits, F.lit(0).cast("long"), lambda a, n: a + n)
    room = (F.col("x.n_shingles") + F.col("y.n_shingles")) * (100 - rule.percent)
    # Fine sketches of different widths say nothing.
    other = F.size("x.fine") != F.size("y.fine")
    return both.where(other | (differing * (100 + rule.percent) <= room)).select("a", "b").distinct()


def prefix_rows(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``(shingle, doc, component, n_shingles, place)``: the rarest shingles of each set of ``members (doc, component)``.

    Sets order their shingles alike, the rarest among members first; the place counts from one. Beyond
    the places kept too few shingles follow for a link, and shingles of one set only join nothing.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(t, rule.words) for t in batch.column(1).to_pylist()]
            own = pa.array([int(np.bitwise_xor.reduce(mix(f))) >> 1 if len(f) else 0 for f in found], pa.int64())
            sets = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, sets], names=["doc", "own", "shingles"])

    needed = docs.join(small_or_shuffled(members.select("doc"), BROADCAST_IDS), "doc", "left_semi").select("doc", "text")
    sets = needed.mapInArrow(cut, "doc long, own long, shingles array<long>")
    rows = sets.select("doc", "own", F.size("shingles").cast("long").alias("n_shingles"), F.explode("shingles").alias("shingle"))
    dealt = written(rows, "shingles").repartition("shingle")
    counted = dealt.join(dealt.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle")
    # Ranks without gaps: rows that are repeated do not move the others.
    place = F.dense_rank().over(Window.partitionBy("doc", "own").orderBy("n", "shingle")).cast("long")
    first = counted.withColumn("place", place).where(f"n > 1 AND 100 * (n_shingles - place + 1) >= {rule.percent} * n_shingles")
    return first.join(members, "doc").select("shingle", "doc", "component", "n_shingles", "place")


def prefix_pairs(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``(doc, pivot)``: pairs of ``members (doc, component)`` of different components, among them all that are linked.

    Linked sets share so many shingles that the first one shared, in an order from rare to frequent, stands
    early in both. Changed copies of one text whose own changes are too many for a link begin with
    those changes, so they meet no other copy, however many there are.
    """
    each = written(prefix_rows(docs, members, rule), "prefixes")
    # Pairs within the largest component of a shingle need no look: one side is what lies outside it.
    sizes = each.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    main = written(sizes.groupBy("shingle").agg(F.max_by("component", "n").alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1"), "main")
    outside = written(each.join(main, "shingle").where("component != main"), "outside")
    apart = F.expr("x.shingle = y.shingle AND x.component != y.component")
    least = rule.percent * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    early = [(100 + rule.percent) * (F.col(f"{s}.n_shingles") - F.col(f"{s}.place") + 1) >= least for s in ("x", "y")]
    met = outside.alias("x").join(each.alias("y"), apart & early[0] & early[1])
    return met.select("x.doc", F.col("y.doc").alias("pivot"))


def similar_links(docs: DataFrame, signed: DataFrame, traits: DataFrame, rule: Rule) -> DataFrame:
    """``(a, b)``: links that connect exactly the documents which all links of ``docs (doc, text)`` connect.

    ``signed (sig, doc)`` holds their signatures, ``traits`` their sizes and sketches.
    """
    rows, pairs = first_pairs(signed, traits)
    seen = checked = held = None
    for turn in range(1, PIVOT_ROUNDS + 1):
        pairs = written(pairs, "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        decided, held = checked_pairs(written(likely_pairs(pairs, traits, rule), "likely"), docs, rule, held)
        done = written(decided.where("linked"), "checked")
        checked = done if checked is None else checked.unionByName(done)
        links = checked.select("a", "b")
        last = turn == PIVOT_ROUNDS or (turn > 1 and done.isEmpty())
        # What is left: signatures whose sets are not all connected yet.
        reached = connected(links)
        placed = rows.join(reached.withColumnRenamed("node", "doc"), "doc", "left")
        placed = placed.select("sig", "doc", F.coalesce("component", "doc").alias("component"))
        pivots = [F.min_by(F.struct("doc", "component"), F.xxhash64("doc", F.lit(2 * turn + i))).alias(f"p{i}") for i in (0, 1)]
        most = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), *pivots)
        open_sigs = written(most.where("c0 < c1"), "open")
        if open_sigs.isEmpty():
            break
        unsettled = written(placed.join(open_sigs, "sig"), "unsettled")
        if last:
            met = prefix_pairs(docs, written(unsettled.select("doc", "component").distinct(), "unsettled"), rule)
        else:
            ends = F.array(*[F.when(F.col("component") != F.col(f"p{i}.component"), F.col(f"p{i}.doc")) for i in (0, 1)])
            met = unsettled.select("doc", F.explode(F.array_compact(ends)).alias("pivot"))
        pairs = met.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
        pairs = pairs.distinct().join(seen, ["a", "b"], "left_anti")
        if last:
            likely = written(likely_pairs(written(pairs, "pairs"), traits, rule), "likely")
            decided, _ = checked_pairs(likely, docs, rule, held)
            return links.unionByName(written(decided.where("linked").select("a", "b"), "checked"))
    return links


def similar_documents(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id)``, one row for every row of ``docs``.

    The component is the smallest key that links can reach. Keys are of type
    long; rows that share a key are one document, so their texts belong
    together. Rows without a key get a null component and link with nothing;
    rows without words stand alone. Shingles are compared by 64-bit hashes.
    Other columns are not looked at.
    """
    rule = rule or Rule()
    rows = docs.select(F.col(key).cast("long").alias("doc"), text_of(text).alias("text"))
    keyed = written(set_traits(rows, rule), "traits")
    # Copies of one set hang under the smallest of their keys, which alone is compared with other sets.
    worded = keyed.where("n_shingles > 0 AND doc IS NOT NULL")
    keys = worded.select("doc", "high", "low")
    first = written(keys.groupBy("high", "low").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    copies = written(keys.join(first, ["high", "low"]).where("doc != first").select("doc", "high", "low", "first").distinct(), "copies")
    repeated = small_or_shuffled(copies.drop("first"), BROADCAST_IDS)
    alone = worded.join(repeated, ["doc", "high", "low"], "left_anti")
    traits = written(alone.select("doc", "n_shingles", "fine", *BEYOND, *SKETCH).distinct(), "traits")
    # A document that has a set of its own besides is signed.
    dropped = written(copies.select("doc").distinct().join(traits.select("doc"), "doc", "left_anti"), "dropped")
    single = rows.where("doc IS NOT NULL").join(small_or_shuffled(dropped, BROADCAST_IDS), "doc", "left_anti")
    links = similar_links(rows.where("doc IS NOT NULL"), signature_rows(single, rule), traits, rule)
    found = connected(copies.select(F.col("doc").alias("a"), F.col("first").alias("b")).unionByName(links))
    joined = keyed.join(found, F.col("doc") == F.col("node"), "left")
    return joined.select(F.col("doc").alias(key), "n_shingles", F.coalesce("component", "doc").alias("component_id"))
