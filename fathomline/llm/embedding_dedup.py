"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within epsilon = sqrt(2 - 2c) of each other. Vectors are
rotated onto their principal dimensions and sorted by the grid cells (of side epsilon) of the
leading ones. The sorted sequence is cut into blocks; two blocks meet only if their cells touch
and their boxes lie within epsilon. A pair of blocks is joined by halving both sequences, leaving
out halves whose boxes are too far apart, down to leaves that are compared in double precision.

A block meets itself where it was written; only pairs of different blocks are shuffled. What that
costs is pairs of near blocks times the bytes of a block: where vectors have no clusters, all blocks
are near each other and both the pairs and the comparisons grow with the square of the vectors.

Equal vectors form one class before the join, and a pair of blocks gives counts and a spanning
forest instead of pairs: what is written grows with the vectors, however dense the links are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark import TaskContext

from .components import connected_components
from .shared import attach, cut

COSINE = 0.95
LEADING = 8
#: Vectors and bytes that a block holds at most; a task holds two blocks as doubles.
BLOCK = 8192
BLOCK_BYTES = 4 << 20
LEAF = 256
#: Columns of the random sketch that the principal dimensions are read from, beyond those that are kept.
OVERSAMPLE = 16
#: Distances are rounded; a block is only skipped when it is farther away than epsilon and this.
SLACK = 1e-6


def _vectors(rows: DataFrame) -> tuple[DataFrame, np.dtype]:
    """(vec_id, digest, vector) of every row, and the type of a vector's numbers: floats stay floats, others are doubles.

    Digest and vector are null where the row links with nothing.
    """
    own_type = dict(rows.dtypes)["embedding"]
    kind = "float" if own_type == "array<float>" else "double"
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)

    def run(batches):
        for batch in batches:
            digest, packed = [], []
            for item in batch.column(1):
                values = item.values if item.is_valid else None
                own = None
                if values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(dtype)
                    if np.isfinite(x).all() and x.any():
                        own = (x + dtype.type(0)).tobytes()
                digest.append(own and xxhash.xxh3_128_digest(own))
                packed.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "vector"]
            )

    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return plain.mapInArrow(run, "vec_id long, digest binary, vector binary"), dtype


def _unit(packed: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    """``n`` vectors as rows of length one, in double precision."""
    x = np.frombuffer(packed, dtype).reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # large components do not overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return _unit(b"".join(column.to_pylist()), len(column), dtype)


def _principal(sketch: np.ndarray, probe: np.ndarray, leading: int) -> np.ndarray:
    """Leading eigenvectors of a moment matrix M from ``sketch`` = M ``probe``; always an orthonormal basis."""
    basis, upper = np.linalg.qr(sketch)
    inner = upper @ np.linalg.pinv(probe.T @ sketch) @ upper.T
    turned = np.linalg.eigh((inner + inner.T) / 2)[1]
    return (basis @ turned)[:, ::-1][:, :leading].copy()


def _rotation(classes: DataFrame, dims: int, leading: int, dtype: np.dtype) -> np.ndarray:
    """dims x leading matrix of the principal dimensions, from sums over all vectors.

    The sums are the moments times a few random columns: what tasks and driver hold grows with dims, not dims^2.
    """
    probe = np.random.default_rng(0).normal(size=(dims, min(dims, leading + OVERSAMPLE)))

    def run(batches):
        total = np.zeros(probe.shape)
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(0), dtype)
                total += x.T @ (x @ probe)
        if total.any():
            i, j = np.indices(total.shape)
            columns = [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    found = classes.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    sketch = np.zeros(probe.shape)
    for r in found:
        sketch[r["i"], r["j"]] = r["v"]
    return _principal(sketch, probe, leading)


def _blocks(classes: DataFrame, rotation: np.ndarray, epsilon: float, size: int, n: int, dtype: np.dtype) -> DataFrame:
    """Contiguous intervals of the grid order: (block, low, high, nodes, copies, vectors)."""
    lead = rotation.shape[1]

    def cells(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.floor((_units(batch.column(2), dtype) @ rotation) / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(at[:, k]) for k in range(lead))], names=["node", "copies", "vector", *(f"c{k}" for k in range(lead))]
            )

    order = [f"c{k}" for k in range(lead)] + ["node"]
    grid = classes.select("node", "copies", "vector").mapInArrow(cells, "node long, copies long, vector binary, " + ", ".join(f"c{k} long" for k in range(lead)))
    sequence = grid.repartitionByRange(max(1, -(-n // size)), *order).sortWithinPartitions(*order).select("node", "copies", "vector")

    def one(part: int, k: int, held: list) -> pa.RecordBatch:
        nodes, copies, vectors = (sum((list(b.column(c)) for b in held), []) for c in range(3))
        packed = b"".join(v.as_py() for v in vectors)
        at = _unit(packed, len(vectors), dtype) @ rotation
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 24) + k], pa.int64()),
                pa.array([at.min(axis=0)], pa.list_(pa.float64())), pa.array([at.max(axis=0)], pa.list_(pa.float64())),
                pa.array([np.array([v.as_py() for v in nodes], np.int64).tobytes()], pa.binary()),
                pa.array([np.array([v.as_py() for v in copies], np.int64).tobytes()], pa.binary()),
                pa.array([packed], pa.binary()),
            ],
            names=["block", "low", "high", "nodes", "copies", "vectors"],
        )

    def cut_up(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - rows)
                held.append(piece)
                rows, at = rows + piece.num_rows, at + piece.num_rows
                if rows == size:
                    yield one(part, k, held)
                    held, rows, k = [], 0, k + 1
        if rows:
            yield one(part, k, held)

    return sequence.mapInArrow(cut_up, "block long, low array<double>, high array<double>, nodes binary, copies binary, vectors binary")


def _block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(i, j), i < j: blocks whose boxes lie within epsilon, found by an equi-join on the leading cells."""
    boxes = blocks.select("block", "low", "high")
    cell = lambda name, k, by: (F.floor(F.element_at(name, k) / epsilon) + by).cast("int")
    reach = lambda k, by: F.explode(F.sequence(cell("low", k, -by), cell("high", k, by))).alias(f"g{k}")
    lead = blocks.select(F.size("low")).first()
    keys = [1, 2] if lead and lead[0] > 1 else [1]
    home, near = boxes, boxes
    for k in keys:
        home, near = home.select("*", reach(k, 0)), near.select("*", reach(k, 1))
    on = [f"g{k}" for k in keys]
    met = home.select(F.col("block").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"), *on).join(
        near.select(F.col("block").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"), *on), on
    )
    gap = F.zip_with(F.arrays_zip("li", "hi"), F.arrays_zip("lj", "hj"), lambda x, y: F.greatest(F.lit(0.0), x["li"] - y["hj"], y["lj"] - x["hi"]))
    far = F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)
    # either block may be the one at home, so order each pair before copies go
    close = met.where(far <= (epsilon + SLACK) ** 2)
    return close.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


class _Forest:
    """Union-find over the nodes of one pair of blocks."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def join_blocks(x: np.ndarray, y: np.ndarray | None, px: np.ndarray, py: np.ndarray | None, wx, wy, cosine: float, epsilon: float):
    """Counts of linked vectors by row of x and of y, and each row's root; y None joins x with itself."""
    own = y is None
    if own:
        y, py, wy = x, px, wx
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = _Forest(len(x) + (0 if own else len(y)))
    shift = 0 if own else len(x)
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if own and b1 <= a0:
            continue  # met from the other side
        gap = np.maximum(0, np.maximum(px[a0:a1].min(0) - py[b0:b1].max(0), py[b0:b1].min(0) - px[a0:a1].max(0)))
        if (gap * gap).sum() > (epsilon + SLACK) ** 2:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = ((a0 + a1) // 2 if a1 - a0 > LEAF else a1), ((b0 + b1) // 2 if b1 - b0 > LEAF else b1)
            for p, q in ((a0, am), (am, a1)):
                for r, s in ((b0, bm), (bm, b1)):
                    if p < q and r < s:
                        stack.append((p, q, r, s))
            continue
        near = x[a0:a1] @ y[b0:b1].T >= cosine
        if own:
            near &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None]
        if near.any():
            count_x[a0:a1] += near @ wy[b0:b1]
            count_y[b0:b1] += wx[a0:a1] @ near
            i, j = np.nonzero(near)
            forest.join(a0 + i, shift + b0 + j)
    return count_x, count_y, forest.root


def _joined(pairs: DataFrame, blocks: DataFrame, rotation: np.ndarray, cosine: float, epsilon: float, dtype: np.dtype) -> DataFrame:
    """(node, links, root): linked vectors of each class within a block or a pair of them, and its root there."""
    schema = "node long, links long, root long"

    def sides(batch):
        for row in range(batch.num_rows):
            raw = [batch.column(c)[row].as_py() for c in range(batch.num_columns)]
            for k in range(0, len(raw), 3):
                raw[k : k + 2] = (np.frombuffer(r, np.int64) for r in raw[k : k + 2])
                raw[k + 2] = _unit(raw[k + 2], len(raw[k]), dtype)
            yield raw

    def linked(node, count, root):
        hit = count > 0
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(count[hit]), pa.array(node[root][hit])], names=["node", "links", "root"])

    def within(batches):
        for batch in batches:
            for node, copies, x in sides(batch):
                count_x, count_y, root = join_blocks(x, None, x @ rotation, None, copies, None, cosine, epsilon)
                yield linked(node, count_x + count_y, root)

    def across(batches):
        for batch in batches:
            for node_x, copies_x, x, node_y, copies_y, y in sides(batch):
                *counts, root = join_blocks(x, y, x @ rotation, y @ rotation, copies_x, copies_y, cosine, epsilon)
                yield linked(np.concatenate([node_x, node_y]), np.concatenate(counts), root)

    side = lambda k: blocks.select(F.col("block").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("nodes", "copies", "vectors")))
    met = pairs.join(side("i"), "i").join(side("j"), "j")
    apart = met.select("nodes_i", "copies_i", "vectors_i", "nodes_j", "copies_j", "vectors_j").mapInArrow(across, schema)
    return blocks.select("nodes", "copies", "vectors").mapInArrow(within, schema).union(apart)


def near_duplicates(rows: DataFrame, cosine: float = COSINE, leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding).

    Links pairs with a cosine of ``cosine`` (> 0) or more in double precision. Null and zero vectors,
    those with null or non-finite components and rows without an id link with nothing (n_links 0,
    component the own id, kept). Vectors of different lengths are not linked. Repeated rows count
    as other vectors each. Other columns are not read; an empty table gives an empty table.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    packed, dtype = _vectors(rows)
    own = cut(packed)
    usable = own.where("digest is not null and vec_id is not null")
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    vectors = (
        usable.join(classes.select("digest", F.col("rep").alias("vec_id")), ["digest", "vec_id"], "left_semi")
        .groupBy("digest").agg(F.min("vector").alias("vector"))
    )
    known = cut(classes.join(vectors, "digest").withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.length("vector")))
    found = None
    for width, n in known.groupBy("width").count().orderBy("width").collect():  # one row per vector length
        alike, dims = known.where(F.col("width") == width), width // dtype.itemsize
        rotation = _rotation(alike, dims, min(leading, dims), dtype)
        size = max(1, min(block, BLOCK_BYTES // width))
        blocks = cut(_blocks(alike, rotation, epsilon, size, n, dtype))
        part = _joined(cut(_block_pairs(blocks, epsilon)), blocks, rotation, cosine, epsilon, dtype)
        found = part if found is None else found.union(part)
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = cut(connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    member = known.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = cut(member.join(roots, "component").select("digest", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id"))
    out = attach(own.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")), facts, "digest", "copies")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
