"""A stored vector index: cells fitted on a bounded sample, every row written to its cell, exact search by bounds.

By the triangle inequality a row at distance d from its cell's centre is at least |D - d| away from a query at distance D
from that centre.  A query first looks into its nearest cells; what it finds there bounds how far any better row can be,
and that leaves out whole cells (partitions that aren't read) and, in the others, all rows whose d is too far from D.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.operators.store import stored

#: Rows that centres are fitted on, about, and cells at most.  Both steer how much is read, never what is found.
SAMPLE, CELLS = 20_000, 1024
#: Folders of rows for each length.
PARTS = 32
ROWS = "id long, vec array<double>, cell long, dist double, square double, dims int, part int"
#: What rounded cosines and sums of doubles may be off by, as a squared distance.
SLACK = 4e-6


def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of k-means (Lloyd's rounds from distinct rows of x); fewer than ``cells`` where x has fewer distinct rows."""
    x = np.unique(np.asarray(x, dtype=np.float64), axis=0)
    if len(x) <= cells:
        return x
    centers = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own, _ = nearest_cells(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=cells)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None]
    return np.sqrt(np.maximum(square, 0))


def nearest_cells(x: np.ndarray, centers: np.ndarray, step: int = 4096) -> tuple:
    """Each row's nearest centre and its distance from that."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), step):
        d = distances(x[a : a + step], centers)
        own[a : a + step] = d.argmin(axis=1)
        far[a : a + step] = np.linalg.norm(x[a : a + step] - centers[own[a : a + step]], axis=1)
    return own, far


def matrices(lists: pa.ListArray):
    """For each length among the lists: it, the rows' places, and the rows as a matrix of doubles."""
    offsets = lists.offsets.to_numpy()
    sizes, flat = np.diff(offsets), np.asarray(lists.flatten()).astype(np.float64)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[np.repeat(sizes == d, sizes)].reshape(len(rows), d)


def usable(vector: Column | str) -> Column:
    """True for vectors with a direction: not null or empty, no null or non-finite part, not zero."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.when(F.size(vector) > 0, finite), F.lit(False))


def sampled(rows: DataFrame, key: Column, limit: int) -> list:
    """About ``limit`` rows, chosen by a hash of their key."""
    n = rows.count()
    return rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // limit))) == 0).collect()


def _assign(sent):
    """Arrow batches (id, vec) with dims, cell and dist."""

    def run(batches):
        for b in batches:
            dims, cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for d, rows, x in matrices(b.column(1)):
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                dims[rows] = d
                if d in sent.value:
                    cell[rows], dist[rows] = nearest_cells(x, sent.value[d])
                else:  # a length that the sample doesn't have: one cell around its first axis
                    dist[rows] = np.linalg.norm(x - np.eye(1, d), axis=1)
            yield pa.record_batch([*b.columns, pa.array(dims), pa.array(cell), pa.array(dist)], names=[*b.schema.names, "dims", "cell", "dist"])

    return run


def _slim(df: DataFrame, ident: str, vector: str) -> DataFrame:
    rows = df.where(F.col(ident).isNotNull() & usable(vector))
    return rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def write_index(df: DataFrame, path: str, *, ident: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> None:
    """Writes df's vectors to a folder: rows by length and cell, and the cells' centres.

    cells: for each length; by default one for about 16 rows, at most CELLS.  Vectors without a direction
    and rows without an id have no place in it.
    """
    spark, rows = df.sparkSession, _slim(df, ident, vector)
    by_length: dict = {}
    for r in sampled(rows, F.col("id"), SAMPLE):
        by_length.setdefault(len(r.vec), []).append(r.vec)
    n = rows.count()
    wanted = cells or max(1, min(CELLS, n // 16))
    centers = {}
    for d, x in by_length.items():
        x = np.array(x)
        centers[d] = fit_cells(x / np.linalg.norm(x, axis=1, keepdims=True), wanted)
    flat = [(d, k, c.tolist()) for d, own in centers.items() for k, c in enumerate(own)]
    spark.createDataFrame(flat, "dims int, cell long, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    _write(rows, centers, path, "overwrite")


def _part(cell: str) -> Column:
    """The folder that a cell's rows are in: neighbours in number aren't neighbours in space, so any even deal will do."""
    return (F.col(cell) % PARTS).cast("int")


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _cosine() -> Column:
    """The cosine of asked and vec by one root of the product of their squares, and rounded as a double to six digits: as SQL has
    it, also where it lies between two, as with vectors of whole numbers."""
    return F.round(_dot("asked", "vec") / F.sqrt(F.col("asked_square") * F.col("square")) * 1e6) / 1e6


def _write(rows: DataFrame, centers: dict, path: str, mode: str) -> None:
    sent = rows.sparkSession.sparkContext.broadcast(centers)  # at most CELLS centres for each length
    placed = rows.mapInArrow(_assign(sent), "id long, vec array<double>, dims int, cell long, dist double").withColumn("square", _dot("vec", "vec"))
    placed = placed.withColumn("part", _part("cell")).repartition("dims", "part").sortWithinPartitions("dims", "part", "cell", "dist")
    placed.write.mode(mode).partitionBy("dims", "part").parquet(f"{path}/rows")


def _centers(spark: SparkSession, path: str) -> dict:
    out: dict = {}
    for r in spark.read.parquet(f"{path}/centers").orderBy("dims", "cell").collect():
        out.setdefault(r.dims, []).append(r.center)
    return {d: np.array(c) for d, c in out.items()}


def add_to_index(df: DataFrame, path: str, *, ident: str = "vec_id", vector: str = "embedding") -> None:
    """Adds df's vectors to their cells; the centres stay, and so does exactness."""
    _write(_slim(df, ident, vector), _centers(df.sparkSession, path), path, "append")


@dataclass
class Found:
    """A search's rows (query_id, vec_id, cosine, rank), and over all queries: cells, those looked into, pairs, those compared."""

    rows: DataFrame
    cells: int
    looked: int
    pairs: int
    compared: int


def _first_look(sent, k: int):
    """Arrow batches (id, vec) to (id, vec, cell, far): the nearest cells that hold k + 1 rows together."""

    def run(batches):
        for b in batches:
            who, cells, far = [], [], []
            for d, rows, x in matrices(b.column(1)):
                centers, info = sent.value.get(d, (np.eye(1, d), {}))
                held = np.array([info[c][0] if c in info else 0 for c in range(len(centers))])
                apart = distances(x / np.linalg.norm(x, axis=1, keepdims=True), centers)
                for row, near in zip(rows.tolist(), apart, strict=True):
                    order = np.argsort(near, kind="stable")
                    order = order[held[order] > 0]
                    order = order[: int(np.searchsorted(np.cumsum(held[order]), k + 1)) + 1]
                    who += [row] * len(order)
                    cells += order.tolist()
                    far += near[order].tolist()
            who = pa.array(who, pa.int64())
            yield pa.record_batch([b.column(0).take(who), b.column(1).take(who), pa.array(cells, pa.int64()), pa.array(far, pa.float64())], names=["id", "vec", "cell", "far"])

    return run


def _second_look(sent):
    """Arrow batches (id, vec, reach, seen) to (id, vec, reach, cell, far): the other cells that may hold a row in reach."""

    def run(batches):
        for b in batches:
            who, cells, far = [], [], []
            reach, seen = b.column(2).to_pylist(), b.column(3).to_pylist()
            for d, rows, x in matrices(b.column(1)):
                centers, info = sent.value.get(d, (np.eye(1, d), {}))
                apart = distances(x / np.linalg.norm(x, axis=1, keepdims=True), centers)
                for row, near in zip(rows.tolist(), apart.tolist(), strict=True):
                    for c, (_, low, high) in info.items():
                        if c not in seen[row] and max(near[c] - high, low - near[c]) <= reach[row]:
                            who.append(row)
                            cells.append(c)
                            far.append(near[c])
            who = pa.array(who, pa.int64())
            yield pa.record_batch([b.column(0).take(who), b.column(1).take(who), b.column(2).take(who), pa.array(cells, pa.int64()), pa.array(far, pa.float64())], names=["id", "vec", "reach", "cell", "far"])

    return run


def search_index(path: str, queries: DataFrame, k: int, *, ident: str = "vec_id", vector: str = "embedding") -> Found:
    """The k rows of the index with the largest cosine for each query, its own id left out: exactly those of a full scan.

    Cosines are rounded to six digits, ties go to the smaller id.  Queries without an id or a direction have no rows;
    rows of other lengths don't appear.
    """
    spark = queries.sparkSession
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    centers, info = _centers(spark, path), {}
    held = rows.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()  # a row for each cell
    for r in held:
        info.setdefault(r.dims, {})[r.cell] = (r.n, r.low, r.high)
    known = {d: (centers.get(d, np.eye(1, d)), cells) for d, cells in info.items()}
    sent = spark.sparkContext.broadcast(known)
    asked = stored(_slim(queries, ident, vector).dropDuplicates(["id"]))
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")

    def compared(looks: DataFrame, near: Column) -> tuple:
        looks = stored(looks.withColumn("dims", F.size("vec")).withColumnsRenamed({"id": "query_id", "vec": "asked"}))
        looks = looks.withColumn("part", _part("cell")).withColumn("asked_square", _dot("asked", "asked"))
        # Only the folders of cells that are looked into are read.
        folders = sorted(r.part for r in looks.select("part").distinct().collect())
        pairs = looks.join(rows.where(F.col("part").isin(folders)), ["dims", "part", "cell"]).where(near & (F.col("id") != F.col("query_id")))
        return pairs.select("query_id", F.col("id").alias("vec_id"), _cosine().alias("cosine")), looks.count()

    first = stored(asked.mapInArrow(_first_look(sent, k), "id long, vec array<double>, cell long, far double"))
    found, looked = compared(first.drop("far"), F.lit(True))
    found = stored(found)
    kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine") + SLACK)).alias("reach"))
    seen = first.groupBy("id").agg(F.collect_set("cell").alias("seen"))
    again = asked.join(kth, "id", "left").join(seen, "id", "left").select("id", "vec", F.coalesce("reach", F.lit(9.0)).alias("reach"), F.coalesce("seen", F.array().cast("array<long>")).alias("seen"))
    second = again.mapInArrow(_second_look(sent), "id long, vec array<double>, reach double, cell long, far double")
    more, again_ = compared(second, F.abs(F.col("far") - F.col("dist")) <= F.col("reach"))
    both = stored(found.unionByName(more))
    ranked = both.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    asked_of = {r.d: r["count"] for r in asked.groupBy(F.size("vec").alias("d")).count().collect()}  # a row for each length
    whole = {d: sum(n for n, _, _ in cells.values()) for d, cells in info.items()}
    return Found(
        ranked,
        sum(n * len(info.get(d, ())) for d, n in asked_of.items()),
        looked + again_,
        sum(n * whole.get(d, 0) for d, n in asked_of.items()),
        both.count(),
    )
