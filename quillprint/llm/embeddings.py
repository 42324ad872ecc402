"""Near duplicates among embeddings, by an exact metric range join.

Vectors of length one lie at a distance of at most ``sqrt(2 - 2 * cosine)`` if
they link. Pivots partition them into cells; the triangle inequality tells which
other cells may hold a vector's partners, and only there it is copied. Cells
then join independently, large ones in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.llm.components import connected
from quillprint.llm.support import written

COSINE = 0.9
BLOCK_ROWS = 4096
#: Pivots are sent to every task, so their number has a bound; beyond it cells have more blocks.
MAX_PIVOTS = 1024
SLACK = 1e-9
PROBE_ROWS = 2048


def unit_vectors(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """``(vec, unit, high, low)``: vectors of length one as bytes, and a key of their contents.

    ``unit`` is null where the vector or its key is null, or the vector is zero
    or has a component that is null or not finite.
    """

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            units, high, low = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unit = None
                if i is not None and v and None not in v:
                    x = np.array(v, np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        unit = np.trim_zeros(x / np.sqrt(x @ x), "b").tobytes()
                a, b = np.frombuffer(xxhash.xxh3_128_digest(unit or b""), np.int64)
                units.append(unit)
                high.append(int(a))
                low.append(int(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(units, pa.binary()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                names=["vec", "unit", "high", "low"],
            )

    rows = vectors.select(F.col(key).cast("long").alias("vec"), F.col(value).cast("array<double>").alias("value"))
    return rows.mapInArrow(scale, "vec long, unit binary, high long, low long")


def matrix(units: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(units), width))
    for row, u in zip(out, units, strict=True):
        x = np.frombuffer(u)
        row[: len(x)] = x
    return out


class Cells:
    """Pivots and what is known of their cells."""

    def __init__(self, pivots: np.ndarray, reach: float) -> None:
        self.pivots, self.reach = pivots, reach
        self.apart = np.maximum(np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T)), SLACK)
        self.radius, self.blocks = np.zeros(len(pivots)), np.ones(len(pivots), np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosines to all pivots, the own cell, and the distance to its pivot."""
        cos = x @ self.pivots.T
        own = cos.argmax(axis=1)
        return cos, own, np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(x)), own]))

    def visited(self, cos: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which cells, besides its own, may hold partners of a vector; of two cells the later is visited.

        A partner in cell j lies at most the cell's radius from its pivot, so the
        vector lies at most ``radius + reach`` from it. And it is nearer to pivot
        j than to the vector's own one, so the plane half way between them lies
        within reach.
        """
        away = np.sqrt(np.maximum(0, 2 - 2 * cos))
        plane = (cos[np.arange(len(cos)), own][:, None] - cos) / self.apart[own]
        later = np.arange(len(self.pivots))[None, :] > own[:, None]
        return later & (away <= self.radius[None, :] + self.reach + SLACK) & (plane <= self.reach + SLACK)


def dealt(reps: DataFrame, cells: Cells, width: int) -> DataFrame:
    """Each vector once as a member of its own block, and as a visitor of all others where it may have partners."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = np.array(part.column(0).to_pylist(), np.int64)
                cos, own, _ = cells.nearest(matrix(part.column(2).to_pylist(), width))
                mine = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cells.blocks[own]
                rows, cell, block, guest = [], [], [], []
                for i, (c, b, far) in enumerate(zip(own, mine, cells.visited(cos, own), strict=True)):
                    places = [(c, b, 0), *[(c, k, 1) for k in range(b + 1, cells.blocks[c])]]
                    places += [(j, k, 1) for j in np.flatnonzero(far) for k in range(cells.blocks[j])]
                    rows += [i] * len(places)
                    for to, values in zip((cell, block, guest), zip(*places, strict=True), strict=True):
                        to += values
                for start in range(0, len(rows), 20_000):
                    piece = slice(start, start + 20_000)
                    columns = [part.column(k).take(pa.array(rows[piece], pa.int64())) for k in range(3)]
                    added = [pa.array(np.array(x[piece], np.int32)) for x in (cell, block, guest)]
                    yield pa.RecordBatch.from_arrays([*columns, *added], names=["vec", "copies", "unit", "cell", "block", "guest"])

    return reps.select("vec", "copies", "unit").mapInArrow(
        deal, "vec long, copies long, unit binary, cell int, block int, guest int"
    )


class Block:
    """Members of one block; visitors pass by. Links are counted, and told only as far as they connect."""

    def __init__(self, limit: float, width: int) -> None:
        self.limit, self.width = limit, width
        self.ids, self.copies, self.units, self.ready = [], [], [], False
        self.edges: list[tuple[int, int]] = []
        self.counted: dict[int, int] = {}

    def add(self, vec: int, copies: int, unit: bytes) -> None:
        self.ids.append(vec)
        self.copies.append(copies)
        self.units.append(unit)

    def count(self, ids: np.ndarray, links: np.ndarray) -> None:
        for i in np.flatnonzero(links):
            self.counted[int(ids[i])] = self.counted.get(int(ids[i]), 0) + int(links[i])

    def close(self) -> None:
        """All members are there: link them with each other."""
        self.ready, self.x = True, matrix(self.units, self.width)
        self.members, self.weights = np.array(self.ids, np.int64), np.array(self.copies, np.int64)
        self.root, self.links = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
        for at in range(0, len(self.ids), PROBE_ROWS):
            hit = self.x[at : at + PROBE_ROWS] @ self.x.T >= self.limit
            hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
            self.links[at : at + len(hit)] += hit @ self.weights
            for i in np.flatnonzero(hit.any(axis=1)):
                self.join(np.append(np.flatnonzero(hit[i]), at + i))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, members: np.ndarray) -> int:
        roots = {self.find(i) for i in members}
        first = min(roots)
        for r in roots:
            self.root[r] = first
        return first

    def visit(self, ids: list[int], copies: list[int], units: list[bytes]) -> None:
        if not self.ready:
            self.close()
        ids, copies = np.array(ids, np.int64), np.array(copies, np.int64)
        hit = matrix(units, self.width) @ self.x.T >= self.limit
        self.links += copies @ hit
        self.count(ids, hit @ self.weights)
        for i in np.flatnonzero(hit.any(axis=1)):
            self.edges.append((int(ids[i]), int(self.members[self.join(np.flatnonzero(hit[i]))])))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.close()
        self.count(self.members, self.links)
        own = [(int(self.members[i]), int(self.members[self.find(i)])) for i in range(len(self.members)) if self.root[i] != i]
        told = [(v, v, n) for v, n in self.counted.items()] + [(a, b, 0) for a, b in own + self.edges]
        for at in range(0, len(told), 50_000):
            columns = zip(*told[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])


def joined(placed: DataFrame, limit: float, width: int) -> DataFrame:
    """``(a, b, links)``: numbers of links where ``a = b``, else connections. Members come before visitors."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place = None, None
        for batch in batches:
            frame = batch.to_pandas()
            for (cell, number, guest), rows in frame.groupby(["cell", "block", "guest"], sort=True):
                if (cell, number) != place:
                    if block:
                        yield from block.rows()
                    block, place = Block(limit, width), (cell, number)
                for at in range(0, len(rows), PROBE_ROWS):
                    part = [rows[c].iloc[at : at + PROBE_ROWS].tolist() for c in ("vec", "copies", "unit")]
                    if guest:
                        block.visit(*part)
                    else:
                        for values in zip(*part, strict=True):
                            block.add(*values)
        if block:
            yield from block.rows()

    # Every visitor comes to a block that has members; blocks that have none give no rows.
    ordered = placed.repartition("cell", "block").sortWithinPartitions("cell", "block", "guest")
    return ordered.mapInArrow(join, "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", value: str = "embedding", cosine: float = COSINE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row for every row of ``vectors``.

    All pairs of rows with at least this cosine, in double precision, are
    links; copies are counted like others but compared once. Null or zero
    vectors and vectors with null or non-finite components link with nothing
    and are kept. Rows with a null key link with nothing and get a null
    component. Vectors of different lengths are compared as if the shorter
    ended in zeros. Other columns are not looked at.
    """
    rows = written(unit_vectors(vectors, key, value), "units")
    valid = rows.where("unit IS NOT NULL")
    reps = valid.groupBy("high", "low").agg(
        F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")
    )
    reps = written(reps, "distinct-units")
    n, size = reps.agg(F.count(F.lit(1)), F.max(F.length("unit"))).first()
    width = (size or 8) // 8
    wanted = min(MAX_PIVOTS, -(-n // block_rows)) or 1
    chosen = reps.orderBy(F.xxhash64("high", "low"), "vec").limit(wanted).select("unit").collect()
    pivots = matrix([bytes(r["unit"]) for r in chosen], width) if chosen else np.zeros((1, width))
    cells = Cells(pivots, float(np.sqrt(2 - 2 * cosine)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                _, own, away = cells.nearest(matrix(batch.column(0).slice(at, 4096).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(away)], names=["cell", "away"])

    measured = reps.select("unit").mapInArrow(measure, "cell int, away double")
    for r in measured.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        cells.radius[r["cell"]], cells.blocks[r["cell"]] = r["radius"], -(-r["n"] // block_rows)
    found = written(joined(dealt(reps, cells, width), cosine, width), "joined")
    counts = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    groups = written(
        reps.select("high", "low", "vec", "copies").join(counts, F.col("vec") == F.col("a"), "left").select(
            "high", "low", F.col("vec").alias("first"), "copies", F.coalesce("links", F.lit(0)).alias("links")
        ),
        "groups",
    )
    member = valid.select("vec", "high", "low").join(groups, ["high", "low"])
    reached = connected(found.where("a != b").select("a", "b"))
    placed = member.join(reached, F.col("first") == F.col("node"), "left").select(
        "vec", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    alone = rows.where("unit IS NULL").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    both = placed.unionByName(alone)
    kept = F.col("vec").eqNullSafe(F.col("component_id"))
    return both.select(F.col("vec").alias(key), "n_links", "component_id", kept.alias("kept"))
