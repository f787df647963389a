"""Embedding near-duplicates: an epsilon grid order join over leading principal dimensions.

1. Equal vectors are one class with a weight; one vector of each class goes on.
2. Classes are sorted by length, then by grid cell on the leading principal dimensions, and cut into blocks of bounded size.
3. Intervals of the sequence have boxes.  From one pair of the whole sequence with itself, pairs of intervals are split
   into pairs of their parts, level by level and as DataFrames; pairs whose boxes are provably too far apart go.
4. The block pairs left are joined by tile (a few neighbouring blocks against a few others), so that a block travels once
   for several partners.  There a bound from the first dimensions leaves out most pairs; the others are checked exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import NO_ID, components, cut, documents, local_forest, numbered
from skuweave.operators.store import identified

MIN_COSINE = 0.9
#: Vectors that the principal axes are fitted on, about; the axes steer the order only, never the result.
SAMPLE = 20_000
#: Leading dimensions: of the grid, of boxes, of the first part of a dot product.
GRID, BOX, FIRST = 8, 16, 32
#: Vectors in a block, at most, and its bytes, about; vectors in an interval at the recursion's end.
BLOCK, BLOCK_BYTES, LEAF = 2048, 4 << 20, 256
#: Parts of an interval; blocks on each side of a tile.
FAN, TILE = 16, 4
#: The column that tells rows apart, which tables aren't expected to have.
ROW = "__sw_vector_row"


def _by_length(lists: pa.ListArray):
    """For each length among the lists: it, the rows' places, and the rows as a matrix of doubles."""
    offsets = lists.offsets.to_numpy()
    sizes, flat = np.diff(offsets), np.asarray(lists.flatten()).astype(np.float64)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[np.repeat(sizes == d, sizes)].reshape(len(rows), d)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(batches):
    """Sums of u * u' over the unit vectors u of each length, as bytes."""
    sums: dict = {}
    for b in batches:
        for d, _, x in _by_length(b.column(0)):
            u = _unit(x)
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, m in sums.items():
        yield pa.record_batch([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["dims", "spread"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("spread"))
    return pa.table([pa.array([table.column("dims")[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["dims", "spread"])


def axes(vectors: DataFrame) -> dict:
    """By length: orthonormal axes as columns, the widest spread first.  The sums are made on the executors."""
    sums = vectors.select("vec").mapInArrow(_spread, "dims int, spread binary").groupBy("dims").applyInArrow(_added, "dims int, spread binary").collect()
    return {r.dims: np.linalg.eigh(np.frombuffer(r.spread).reshape(r.dims, r.dims))[1][:, ::-1] for r in sums}


def _placed(sent, width: float):
    """Arrow batches (h1, h2, weight, dims, vec) with each vector's grid cell and leading coordinates."""

    def run(batches):
        for b in batches:
            lists = b.column(4)
            sizes = np.minimum(BOX, np.diff(lists.offsets.to_numpy()))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cell, lead = np.zeros(len(sizes), np.int64), np.zeros(ends[-1])
            for d, rows, x in _by_length(lists):
                y = _unit(x) @ sent.value.get(d, np.eye(d))[:, :BOX]
                for k in range(min(GRID, d)):
                    cell[rows] = cell[rows] * 16 + np.clip(np.floor(y[:, k] / width), -8, 7).astype(np.int64) + 8
                lead[ends[rows][:, None] + np.arange(y.shape[1])] = y
            yield pa.record_batch([*b.columns, pa.array(cell), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lead))], names=[*b.schema.names, "cell", "lead"])

    return run


def gaps(lo_a, hi_a, lo_b, hi_b) -> float:
    """Squared distance between two boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


def interval_pairs(boxes: DataFrame, blocks: int, reach: float) -> DataFrame:
    """Pairs (dims, a <= b) of boxes (dims, k, lo, hi), k under ``blocks``, that aren't provably over ``reach`` apart (squared).

    Intervals of FAN, FAN * FAN ... boxes have the boxes around them; pairs are split from the whole sequence downwards.
    """
    levels = [boxes]
    while FAN ** (len(levels) - 1) < blocks:
        around = lambda f, c: F.array(*[f(F.get(c, i)) for i in range(BOX)]).alias(c)
        levels.append(levels[-1].groupBy("dims", F.expr(f"k div {FAN}").alias("k")).agg(around(F.min, "lo"), around(F.max, "hi")))
    pairs = levels[-1].select("dims", F.col("k").alias("a"), F.col("k").alias("b"))
    part = lambda c: F.greatest(F.lit(0.0), F.get("lo_a", c) - F.get("hi_b", c), F.get("lo_b", c) - F.get("hi_a", c))
    apart = sum((part(i) * part(i) for i in range(1, BOX)), part(0) * part(0))
    for level in reversed(levels[:-1]):
        side = lambda s: level.select(F.col("dims"), F.expr(f"k div {FAN}").alias(s), F.col("k").alias(f"k_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))  # noqa: B023, E731
        pairs = pairs.join(side("a"), ["dims", "a"]).join(side("b"), ["dims", "b"]).where((F.col("k_a") <= F.col("k_b")) & (apart <= reach))
        pairs = cut(pairs.select("dims", F.col("k_a").alias("a"), F.col("k_b").alias("b")))
    return pairs


class _Block:
    """A block's vectors, unit and turned to the principal axes."""

    def __init__(self, k: int, blob: bytes, pos: bytes, weight: bytes, kind: str, turns: dict):
        self.k = k
        self.pos, self.weight = np.frombuffer(pos, np.int64), np.frombuffer(weight, np.int64)
        self.raw = np.frombuffer(blob, kind).reshape(len(self.pos), -1).astype(np.float64)
        self.norm = np.linalg.norm(self.raw, axis=1)
        dims = self.raw.shape[1]
        turned = self.raw / self.norm[:, None] @ turns.get(dims, np.eye(dims))
        self.first = turned[:, :FIRST].astype(np.float32)
        self.rest = np.sqrt(np.maximum(0, (turned[:, FIRST:] ** 2).sum(axis=1))).astype(np.float32)
        self.boxes = [(turned[a : a + LEAF, :BOX].min(axis=0), turned[a : a + LEAF, :BOX].max(axis=0)) for a in range(0, len(self.pos), LEAF)]
        self.links = np.zeros(len(self.pos), np.int64)


def join_blocks(a: _Block, b: _Block, least: float) -> list:
    """Forests of the links between a and b, by position, and their weights added to a's and b's; a is b: within the block."""
    forests = []
    reach = 2 - 2 * least + 1e-9
    for i, (la, ha) in enumerate(a.boxes):
        for j, (lb, hb) in enumerate(b.boxes):
            if a is b and j < i or gaps(la, ha, lb, hb) > reach:
                continue
            x, y = slice(i * LEAF, i * LEAF + LEAF), slice(j * LEAF, j * LEAF + LEAF)
            bound = a.first[x] @ b.first[y].T
            bound += a.rest[x][:, None] * b.rest[y][None]
            p, q = np.nonzero(bound >= least - 1e-4)
            if a is b and i == j:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            p, q = p + i * LEAF, q + j * LEAF
            near = np.einsum("ij,ij->i", a.raw[p], b.raw[q]) / (a.norm[p] * b.norm[q]) >= least
            p, q = p[near], q[near]
            if len(p):
                np.add.at(a.links, p, b.weight[q])
                np.add.at(b.links, q, a.weight[p])
                forests.append(local_forest(np.column_stack([a.pos[p], b.pos[q]])))
    return forests


def _join(kind: str, turns, least: float):
    """A tile's rows (ta, tb, k, raw, pos, weight) to (v, u, n): links counted (u < 0) and forests of links (n = 0)."""

    def run(table: pa.Table) -> pa.Table:
        ta, tb = table.column("ta")[0].as_py(), table.column("tb")[0].as_py()
        blocks = {}
        for k, *cells in zip(table.column("k").to_pylist(), *(table.column(c) for c in ("raw", "pos", "weight")), strict=True):
            blocks[k] = _Block(k, *(c.as_py() for c in cells), kind, turns.value)
        forests = [np.empty((0, 2), np.int64)]
        for a in sorted(k for k in blocks if k // TILE == ta):
            for b in sorted(k for k in blocks if k // TILE == tb and k >= a):
                found = join_blocks(blocks[a], blocks[b], least)
                forests += [local_forest(np.concatenate(found))] if found else []
        forest = local_forest(np.concatenate(forests))
        hit = [(x.pos[x.links > 0], x.links[x.links > 0]) for x in blocks.values()]
        v, n = np.concatenate([p for p, _ in hit]), np.concatenate([c for _, c in hit])
        return pa.table(
            [pa.array(np.concatenate([v, forest[:, 0]])), pa.array(np.concatenate([np.full(len(v), -1, np.int64), forest[:, 1]])), pa.array(np.concatenate([n, np.zeros(len(forest), np.int64)]))],
            names=["v", "u", "n"],
        )

    return run


def _gather(table: pa.Table) -> pa.Table:
    """A block's rows, in order of position, to one row with its vectors, positions, weights and box."""
    table = table.sort_by("pos")
    flat = np.asarray(table.column("vec").combine_chunks().flatten())
    lead = np.asarray(table.column("lead").combine_chunks().flatten()).reshape(table.num_rows, -1)
    one = lambda x, t: pa.array([x], t)
    return pa.table(
        [
            one(table.column("dims")[0].as_py(), pa.int32()),
            one(table.column("k")[0].as_py(), pa.int64()),
            one(flat.tobytes(), pa.binary()),
            one(np.asarray(table.column("pos")).astype(np.int64).tobytes(), pa.binary()),
            one(np.asarray(table.column("weight")).astype(np.int64).tobytes(), pa.binary()),
            one(lead.min(axis=0).tolist(), pa.list_(pa.float64())),
            one(lead.max(axis=0).tolist(), pa.list_(pa.float64())),
        ],
        names=["dims", "k", "raw", "pos", "weight", "lo", "hi"],
    )


def near_vectors(df: DataFrame, *, ident: str = "vec_id", vector: str = "embedding", least: float = MIN_COSINE) -> DataFrame:
    """Per row of df: id, n_links (other rows with cosine >= least), component (the smallest id in reach).

    Vectors are compared with those of the same length, all lengths at once.  Tasks return counts and forests, never all
    pairs.  Vectors that are null, empty or zero, or that hold null or non-finite parts, link with nothing.  A null id
    counts as the largest; its component is null if no other id is in reach.  Repeated rows are linked copies.  An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    kind = "<f4" if "float" in dict(df.dtypes)[vector] else "<f8"
    rows = identified(df, ROW).select(F.coalesce(F.col(ident).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector).alias("vec"), F.col(ROW).alias("row"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    ok = F.coalesce(F.when(F.size("vec") > 0, finite), F.lit(False))
    # -0.0 and 0.0 are one: adding 0.0 makes them equal bits.
    rows = rows.withColumn("ok", ok).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast("float" if kind == "<f4" else "double")))
    slim = cut(rows.select("row", "id", "ok", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), F.when(F.col("ok"), F.size("vec")).alias("dims")))
    classes = cut(slim.where("ok").groupBy("dims", "h1", "h2").agg(F.count("*").alias("weight"), F.min("id").alias("first"), F.min("row").alias("row")))
    n = classes.count()
    distinct = cut(rows.select("row", "vec").join(classes.select("row", "weight", "dims", "h1", "h2"), "row").select("h1", "h2", "weight", "dims", "vec"))
    turns = df.sparkSession.sparkContext.broadcast(axes(distinct.where(F.pmod("h1", F.lit(max(1, n // SAMPLE))) == 0)))
    width = math.sqrt(2 - 2 * least) or 1.0
    schema = f"h1 long, h2 long, weight long, dims int, vec array<{'float' if kind == '<f4' else 'double'}>, cell long, lead array<double>"
    placed = cut(distinct.mapInArrow(_placed(turns, width), schema))
    placed = numbered(placed, [F.col("dims"), F.col("cell"), F.get("lead", 0), F.col("h1"), F.col("h2")], "pos")
    per = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("dims") * int(kind[2])))))
    placed = placed.withColumn("k", F.floor(F.col("pos") / per))
    blocks = placed.select("dims", "k", "pos", "weight", "vec", "lead").groupBy("dims", "k").applyInArrow(_gather, "dims int, k long, raw binary, pos binary, weight binary, lo array<double>, hi array<double>")
    blocks = cut(blocks)
    boxes = cut(blocks.select("dims", "k", "lo", "hi"))
    pairs = interval_pairs(boxes, (boxes.agg(F.max("k")).first()[0] or 0) + 1, 2 - 2 * least + 1e-9)
    tile = lambda c: F.expr(f"{c} div {TILE}")
    asked = pairs.select("dims", tile("a").alias("ta"), tile("b").alias("tb"), F.explode(F.array("a", "b")).alias("k")).distinct()
    loaded = asked.join(blocks.select("dims", "k", "raw", "pos", "weight"), ["dims", "k"])
    found = cut(loaded.groupBy("dims", "ta", "tb").applyInArrow(_join(kind, turns, least), "v long, u long, n long"))
    counts = found.where("u < 0").groupBy("v").agg(F.sum("n").alias("n"))
    roots = components(found.where("u >= 0").select("v", "u"))
    known = cut(placed.select("pos", "h1", "h2")).join(counts, F.col("pos") == F.col("v"), "left").drop("v").join(roots, F.col("pos") == F.col("v"), "left")
    known = known.select("h1", "h2", F.coalesce("root", "pos").alias("root"), F.coalesce("n", F.lit(0)).alias("n")).join(classes.drop("row", "dims"), ["h1", "h2"])
    known = cut(known)
    least_id = cut(known.groupBy("root").agg(F.min("first").alias("component")))
    known = cut(known.join(least_id, "root").select("h1", "h2", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component"))
    out = slim.join(known, ["h1", "h2"], "left")
    null = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        null(F.col("id")).alias("id"),
        F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        null(F.when(F.col("ok"), F.col("component")).otherwise(F.col("id"))).alias("component"),
    )


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    """near_vectors() of all embeddings; null, zero and odd vectors, repeated rows and empty tables as there."""
    out = near_vectors(documents(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
