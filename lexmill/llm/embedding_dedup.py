"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of
about ``block_size`` dimensions. Two vectors of cosine at least c are within a
squared distance of 2 - 2c, so in one block at least they are within that
block's proportional share of it. Each block is joined on its share: its points
go to the cell of their nearest pivot, and visit every cell that a point within
the range of theirs can be in (the one on the far side of whose bisecting plane
the range reaches). Cells are cut into chunks, so a task holds a bounded number
of points, however crowded a cell is. The union of all blocks' pairs is then
verified with the whole vectors in double precision.

Equal vectors are one class and enter the join once. Vectors that are null, of
no dimension, zero, or hold null or non-finite components link with nothing, nor
do vectors of different dimension, nor rows without an id. Rows that share an id
are separate vectors with one name.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.texts import stored

#: Points of one side that a task compares at once, and the most pivots that are sent to tasks.
CHUNK, MAX_CELLS = 4_096, 256
SLACK = 1e-5


class Space(NamedTuple):
    """The blocks of one dimension: rotation, block bounds, and per block the pivots and the squared range."""

    rotation: np.ndarray
    bounds: list[int]
    pivots: list[np.ndarray]
    budgets: list[float]


def rotation(dimension: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(7 + dimension).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    rows = np.array([np.frombuffer(v, np.float64) for v in vectors])
    # Scaled first, so that the squares of large or small components stay finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def vector_classes(df: DataFrame) -> DataFrame:
    """``id, digest, vector, dimension`` of each row; the last three are null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, vector, dimension = [], [], []
            for cell in batch.column("source"):
                values = cell.values
                row = None
                if values is not None and len(values) and not values.null_count:
                    row = np.asarray(values, np.float64)
                    if not np.isfinite(row).all() or not row.any():
                        row = None
                raw = None if row is None else row.tobytes()
                vector.append(raw)
                digest.append(raw and hashlib.blake2b(raw, digest_size=16).hexdigest())
                dimension.append(None if row is None else len(row))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digest, pa.string()), pa.array(vector, pa.binary()), pa.array(dimension, pa.int32())], ["id", "digest", "vector", "dimension"])

    return df.mapInArrow(run, "id long, digest string, vector binary, dimension int")


def places(space: Space, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its number, the points in it, their cells, and which cells each of them visits."""
    turned = rows @ space.rotation
    for b, (u, v) in enumerate(zip(space.bounds[:-1], space.bounds[1:], strict=True)):
        points, pivots = turned[:, u:v], space.pivots[b]
        square = np.maximum((points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * points @ pivots.T, 0)
        home = np.argmin(square, axis=1)
        gap = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 0))[home]
        beyond = square - square[np.arange(len(points)), home][:, None]
        reach = 2 * gap * np.sqrt(space.budgets[b])
        yield b, points, home, beyond <= reach + SLACK


def joined(nodes: DataFrame, dimension: int, cosine: float, block_size: int) -> DataFrame:
    """Pairs ``a < b`` of nodes of this dimension that are within the share of one block at least."""
    spark = nodes.sparkSession
    own = nodes.where(F.col("dimension") == dimension).select("node", "vector")
    n = own.count()
    blocks = max(1, round(dimension / block_size))
    bounds = [round(i * dimension / blocks) for i in range(blocks + 1)]
    turn = rotation(dimension)
    some = own.orderBy(F.xxhash64("node"), "node").limit(max(1, min(MAX_CELLS, n // 2048))).collect()
    pivots = unit_rows([bytes(r["vector"]) for r in some]) @ turn
    within = 2 - 2 * cosine
    space = Space(turn, bounds, [pivots[:, u:v] for u, v in zip(bounds[:-1], bounds[1:], strict=True)], [within * (v - u) / dimension + 1e-9 for u, v in zip(bounds[:-1], bounds[1:], strict=True)])
    cells = len(some)
    shared = spark.sparkContext.broadcast(space)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, guests = np.zeros((2, blocks * cells), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                for b, _, home, visits in places(shared.value, unit_rows(part.column("vector").to_pylist())):
                    homes[b * cells : (b + 1) * cells] += np.bincount(home, minlength=cells)
                    guests[b * cells : (b + 1) * cells] += visits.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks * cells), pa.int32()), pa.array(homes), pa.array(guests)], ["place", "homes", "guests"])

    counts = own.mapInArrow(count, "place int, homes long, guests long").groupBy("place").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests")).collect()
    chunks = np.ones((2, blocks * cells), np.int64)
    for r in counts:
        chunks[:, r["place"]] = [max(1, -(-r["homes"] // CHUNK)), max(1, -(-r["guests"] // CHUNK))]
    dealt = spark.sparkContext.broadcast(chunks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = dealt.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node = part.column("node").to_numpy()
                spread = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                for b, points, home, visits in places(shared.value, unit_rows(part.column("vector").to_pylist())):
                    raw = np.array([p.tobytes() for p in points.astype(np.float32)], object)
                    for side, (row, cell) in enumerate(((np.arange(len(node)), home), np.nonzero(visits))):
                        place = b * cells + cell
                        own_chunk = (spread[row] % chunks[side, place].astype(np.uint64)).astype(np.int64)
                        copies = chunks[1 - side, place]
                        again = np.repeat(np.arange(len(row)), copies)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
                        first, second = (own_chunk[again], other) if side == 0 else (other, own_chunk[again])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(place[again], pa.int32()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(np.full(len(again), side), pa.int32()), pa.array(node[row][again]), pa.array(raw[row][again], pa.binary())],
                            ["place", "home_chunk", "guest_chunk", "side", "node", "point"],
                        )

    def compare(group: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        budget = shared.value.budgets[group.column("place")[0].as_py() // cells] + SLACK
        side = group.column("side").to_numpy()
        node = group.column("node").to_numpy()
        point = np.frombuffer(b"".join(group.column("point").to_pylist()), np.float32).reshape(len(node), -1)
        home, home_node, guest, guest_node = point[side == 0], node[side == 0], point[side == 1], node[side == 1]
        square = (home * home).sum(axis=1)
        found = []
        for at in range(0, len(guest), 1024):
            some = guest[at : at + 1024]
            distance = (some * some).sum(axis=1)[:, None] + square[None, :] - 2 * some @ home.T
            i, j = np.nonzero(distance <= budget)
            a, b = guest_node[at + i], home_node[j]
            found.append(np.stack([a[a < b], b[a < b]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = own.mapInArrow(deal, "place int, home_chunk int, guest_chunk int, side int, node long, point binary")
    return rows.groupBy("place", "home_chunk", "guest_chunk").applyInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose whole vectors have the cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x, y = (part.column(c).to_pylist() for c in ("x", "y"))
                good, sizes = np.zeros(len(x), bool), np.array([len(v) for v in x])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    good[own] = np.einsum("ij,ij->i", unit_rows([x[i] for i in own]), unit_rows([y[i] for i in own])) >= cosine
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good))

    left = nodes.select(F.col("node").alias("a"), F.col("vector").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("vector").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def linked(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *, cosine: float = 0.9, block_size: int = 16) -> DataFrame:
    """Per row the key, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("source"))
    own = stored(vector_classes(rows), "vectors")
    known = own.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    # Equal vectors have equal digests; any of their rows has the vector.
    sized = known.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    nodes = known.join(sized, ["digest", "id"]).dropDuplicates(["digest"]).select(F.xxhash64("digest").alias("node"), "digest", "id", "size", "vector", "dimension")
    nodes = stored(nodes, "nodes")
    # Few dimensions occur: a table of embeddings has one.
    dimensions = sorted(r["dimension"] for r in nodes.select("dimension").distinct().collect())
    pairs = None
    for dimension in dimensions:
        more = joined(nodes, dimension, cosine, block_size)
        pairs = more if pairs is None else pairs.union(more)
    if pairs is None:
        pairs = df.sparkSession.createDataFrame([], "a long, b long")
    links = stored(verified(pairs, nodes, cosine), "links")
    info = nodes.select("node", "id", "size")
    one = info.select(F.col("node").alias("a"), F.col("id").alias("id_a"), F.col("size").alias("size_a"))
    two = info.select(F.col("node").alias("b"), F.col("id").alias("id_b"), F.col("size").alias("size_b"))
    named = stored(links.join(one, "a").join(two, "b"), "named")
    more = named.select(F.col("a").alias("node"), F.col("size_b").alias("n")).union(named.select("b", "size_a")).groupBy("node").agg(F.sum("n").alias("more"))
    counted = nodes.select("digest", "node", "size", F.col("id").alias("first")).join(more, "node", "left").select("digest", "first", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    result = own.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(counted, "digest", "left")
    result = stored(result.select("id", "first", F.coalesce("links", F.lit(0)).alias("n_links")), "counted")
    same = result.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    reached = components(named.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).union(same))
    final = result.join(reached.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return final.select(F.col("id").alias(key), "n_links", component.alias("component_id"), (F.col("id") == component).alias("kept"))
