"""Approximate nearest neighbours by inner product: inverted lists and an adaptive scan of dimensions.

1. Equal vectors are one class, which carries its k + 1 smallest ids; nothing else of a class can be among k nearest.
2. A further dimension makes the largest inner product the smallest distance: classes lie on the unit sphere, scaled by the
   longest vector.  A seeded random rotation spreads every distance evenly over the dimensions.
3. Lists are k-means cells fitted on a bounded sample; every class goes to its list, in blocks of bounded size that hold
   the rotated vectors column block by column block, and the original ones.
4. How many lists a query probes is measured: sampled queries are compared with all rows, and the least number that finds
   the recall asked for is taken.
5. A query first scans its nearest list, which bounds the distance that counts; then the others.  After each column block a
   test drops every candidate whose partial distance is larger than that of a candidate in reach would be but for a chance
   of ALPHA: under a random rotation the share of a distance in the first s of d dimensions is Beta(s / 2, (d - s) / 2).
   Survivors are scored exactly, on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.llm.common import NO_ID, bounded, cut, documents, give_back
from skuweave.operators.vectors import distances, fit_cells, matrices, nearest_cells, sampled, usable

K = 20
#: Rows that lists are fitted on, about; lists at most; queries compared with all rows, about, and the recall asked of them.
SAMPLE, LISTS, TRIED, RECALL = 20_000, 1024, 256, 0.97
#: Dimensions of a column block; the chance of a wrong drop in one test; draws that its limits are read from.
COLUMNS, ALPHA, DRAWS = 16, 0.005, 200_000
#: Classes of a block and queries that meet it at once, at most about; queries scanned together; classes that give a first bound.
BLOCK, BATCH, STEP, LEAD = 4096, 1024, 128, 128
#: Lists or blocks named in a broadcast at most.
NAMED = 200_000


class Model:
    """What places vectors of one length: the longest norm, rotation, rotated centres, and limits of partial distances."""

    def __init__(self, top: float, sample: np.ndarray, lists: int, seed: int):
        d = sample.shape[1] + 1
        rng = np.random.default_rng(seed)
        self.top = top
        self.turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.edges = [*range(0, d, COLUMNS), d]
        share = [np.quantile(rng.beta(s / 2, (d - s) / 2, DRAWS), 1 - ALPHA) for s in self.edges[1:-1]]
        self.limits = np.array([*share, 1.0])
        self.centers = fit_cells(self.placed(sample), lists, seed=seed)

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Rows on the unit sphere, with the further dimension, turned."""
        x = x / self.top
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]) @ self.turn

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries as unit vectors without a further dimension, turned."""
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return q @ self.turn[:-1]

    def columns(self, y: np.ndarray) -> list:
        return [np.ascontiguousarray(y[:, a:z], dtype=np.float32) for a, z in zip(self.edges, self.edges[1:], strict=False)]


def _listed(sent):
    """Arrow batches (h1, h2, first, vec) with dims and list."""

    def run(batches):
        for b in batches:
            dims, own = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for d, rows, x in matrices(b.column(3)):
                dims[rows] = d
                own[rows] = nearest_cells(sent.value[d].placed(x), sent.value[d].centers)[0]
            yield pa.record_batch([*b.columns, pa.array(dims), pa.array(own)], names=[*b.schema.names, "dims", "list"])

    return run


_BLOCK = "dims int, list int, block int, n int, keys binary, raw binary, cols binary"


def _packed(sent):
    """A block's rows (dims, list, block, h1, h2, first, vec) to one row: keys, original vectors, column blocks."""

    def run(table: pa.Table) -> pa.Table:
        d, own, block = (table.column(c)[0].as_py() for c in ("dims", "list", "block"))
        raw = np.asarray(table.column("vec").combine_chunks().flatten()).astype(np.float64).reshape(-1, d)
        keys = np.column_stack([table.column(c).to_numpy() for c in ("h1", "h2", "first")]).astype(np.int64)
        cols = b"".join(c.tobytes() for c in sent.value[d].columns(sent.value[d].placed(raw)))
        kind = table.schema.field("vec").type.value_type
        data = raw.astype(np.float32).tobytes() if pa.types.is_float32(kind) else raw.tobytes()
        types = [pa.int32()] * 4 + [pa.binary()] * 3
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        return pa.table([pa.array([v], t) for v, t in zip((d, own, block, len(keys), keys.tobytes(), data, cols), types, strict=True)], names=names)

    return run


class Block:
    """A block read back: keys (h1, h2, first), original vectors in double precision, column blocks."""

    def __init__(self, dims: int, n: int, keys: bytes, raw: bytes, cols: bytes, model: Model):
        self.keys = np.frombuffer(keys, np.int64).reshape(n, 3)
        self.raw = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dims else np.float64).astype(np.float64).reshape(n, dims)
        flat, self.cols = np.frombuffer(cols, np.float32), []
        for a, z in zip(model.edges, model.edges[1:], strict=False):
            self.cols.append(flat[a * n : z * n].reshape(n, z - a))


def _square(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * (q @ x.T)


def survivors(q: list, x: list, reach: np.ndarray, limits: np.ndarray) -> tuple:
    """(query, candidate) pairs that no test drops: q, x in column blocks; reach: squared distance that counts, by query.

    While most pairs are left a column block's distances are a matrix product; then they are taken pair by pair.
    """
    edge = reach[:, None] * limits[0] * (1 + 1e-5) + 1e-5
    partial = _square(q[0], x[0])
    a, b = np.nonzero(partial <= edge)
    partial = partial[a, b]
    for s in range(1, len(q)):
        if not len(a):
            break
        if 4 * len(a) > len(q[0]) * len(x[0]):
            partial = partial + _square(q[s], x[s])[a, b]
        else:
            gap = q[s][a] - x[s][b]
            partial = partial + np.einsum("ij,ij->i", gap, gap)
        keep = partial <= reach[a] * limits[s] * (1 + 1e-5) + 1e-5
        a, b, partial = a[keep], b[keep], partial[keep]
    return a, b


def scan(block: Block, model: Model, asked: np.ndarray, bound: np.ndarray, k: int) -> tuple:
    """(query, candidate, score) of each query's k best in the block by exact scores, among what the tests leave.

    asked: original queries; bound: their score that counts (-inf if not known yet).
    """
    out = []
    for at in range(0, len(asked), STEP):
        own, known = asked[at : at + STEP], bound[at : at + STEP]
        norm = np.linalg.norm(own, axis=1)
        q = model.columns(model.asked(own))
        reach = np.where(np.isfinite(known), 2 - 2 * known / (norm * model.top), np.inf)
        lead = 0
        if not np.isfinite(reach).all():
            # The first rows are scored as they are; the k-th of them bounds the rest.
            lead = min(LEAD, len(block.raw))
            first = own @ block.raw[:lead].T
            if lead >= k:
                kth = np.partition(first, lead - k, axis=1)[:, lead - k]
                reach = np.minimum(reach, 2 - 2 * kth / (norm * model.top))
        a, b = survivors(q, [c[lead:] for c in block.cols], reach.astype(np.float32), model.limits.astype(np.float32))
        a, b = np.concatenate([np.repeat(np.arange(len(own)), lead), a]), np.concatenate([np.tile(np.arange(lead), len(own)), b + lead])
        score = np.concatenate([np.einsum("ij,ij->i", own[a[s : s + 100_000]], block.raw[b[s : s + 100_000]]) for s in range(0, max(1, len(a)), 100_000)])
        order = np.lexsort((block.keys[b, 2], -score, a))
        a, b, score = a[order], b[order], score[order]
        start = np.searchsorted(a, np.arange(len(own)))
        best = np.arange(len(a)) - start[a] < k
        out.append((a[best] + at, b[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FOUND = "q1 long, q2 long, c1 long, c2 long, first long, score double"


def _scanned(sent, k: int):
    """A block (one row) and the queries that probe it (q1, q2, vec, bound) to their best there."""

    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if not block.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5 + [pa.array([], pa.float64())], names=names)
        d = block.column("dims")[0].as_py()
        model = sent.value[d]
        held = Block(d, *(block.column(c)[0].as_py() for c in ("n", "keys", "raw", "cols")), model)
        asked = np.asarray(queries.column("vec").combine_chunks().flatten()).astype(np.float64).reshape(-1, d)
        bound = queries.column("bound").to_pandas().fillna(-np.inf).to_numpy()
        a, b, score = scan(held, model, asked, bound, k)
        keys = [queries.column(c).to_numpy()[a] for c in ("q1", "q2")] + [held.keys[b, j] for j in range(3)]
        give_back()
        return pa.table([*(pa.array(x, pa.int64()) for x in keys), pa.array(score)], names=names)

    return run


def _exact(sent, tried: dict, k: int):
    """Blocks (dims, list, n, keys, raw, cols) to the k best of a task for each query tried: (q, list, first, score)."""

    def run(batches):
        best: dict = {}
        for b in batches:
            for d, own, *cells in zip(*(b.column(c).to_pylist() for c in ("dims", "list", "n", "keys", "raw", "cols")), strict=True):
                if d not in tried.value:
                    continue
                block, (numbers, keys, x) = Block(d, *cells, sent.value[d]), tried.value[d]
                score = x @ block.raw.T
                for i, q in enumerate(numbers):
                    other = np.flatnonzero((block.keys[:, 0] != keys[i][0]) | (block.keys[:, 1] != keys[i][1]))
                    top = other[np.argsort(-score[i, other], kind="stable")[:k]]
                    rows = best.get(q, []) + [(-s, f, own) for s, f in zip(score[i, top].tolist(), block.keys[top, 2].tolist(), strict=True)]
                    best[q] = sorted(rows)[:k]
        flat = [(q, o, f, -s) for q, rows in best.items() for s, f, o in rows]
        cells = zip(*flat, strict=True) if flat else ((), (), (), ())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["q", "list", "first", "score"])

    return run


def probes_needed(order: dict, found: list, recall: float) -> int:
    """The least number of lists in each query's order (q: its lists) that holds ``recall`` of the rows (q, list) found."""
    if not found:
        return 1
    place = {q: {c: i for i, c in enumerate(lists)} for q, lists in order.items()}
    at = sorted(place[q][c] for q, c in found)
    return at[min(len(at), int(np.ceil(recall * len(at)))) - 1] + 1


def _probes(sent, held: dict, probes: dict, k: int):
    """Arrow batches (q1, q2, vec) to (q1, q2, vec, dims, list, place): the lists that each query probes, nearest first.

    More lists than ``probes`` only where those hold fewer than k classes.
    """

    def run(batches):
        for b in batches:
            who, lists, place = [], [], []
            dims = np.zeros(b.num_rows, np.int32)
            for d, rows, x in matrices(b.column(2)):
                if d not in sent.value:
                    continue
                dims[rows] = d
                order = np.argsort(distances(sent.value[d].asked(x), sent.value[d].centers), axis=1, kind="stable")
                sizes = np.array([held.value.get((d, c), 0) for c in range(order.shape[1])])
                enough = (np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1
                for row, lists_, most in zip(rows.tolist(), order, np.maximum(enough, probes[d]), strict=True):
                    lists_ = lists_[:most]
                    who += [row] * len(lists_)
                    lists += lists_.tolist()
                    place += range(len(lists_))
            at = pa.array(who, pa.int64())
            yield pa.record_batch([*(c.take(at) for c in b.columns), pa.array(dims).take(at), pa.array(lists, pa.int32()), pa.array(place, pa.int32())], names=[*b.schema.names, "dims", "list", "place"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first")
    return found.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k)


def nearest(
    df: DataFrame, asked: Column, *, ident: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL, lists: int | None = None, probes: int | None = None, seed: int = 11
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df that ``asked`` holds for, its k nearest other rows as found.

    Nearest: the largest inner product, in double precision, of vectors of the same length; ties go to the smaller id, a
    null id counting as the largest.  Every row but the query's own is a candidate, a repeated row for each time it
    comes; repeated queries are answered once.  Fewer rows if there are fewer candidates.  Vectors that are null, empty
    or zero, or that hold null or non-finite parts, take no part.  lists, probes: numbers for each length, else about
    the square root of the classes (at most LISTS), and what reaches ``recall`` for sampled queries.  An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    spark, more = df.sparkSession, k + 1
    kind = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    # -0.0 and 0.0 are one: adding 0.0 makes them equal bits.
    rows = df.where(usable(vector)).select(
        F.coalesce(F.col(ident).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.transform(vector, lambda x: (x + F.lit(0.0)).cast(kind)).alias("vec")
    )
    rows = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    by = Window.partitionBy("h1", "h2")
    kept = rows.drop("asked").withColumn("at", F.row_number().over(by.orderBy("id"))).where(F.col("at") <= more)
    kept = kept.withColumn("copy", F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("at")))
    kept = cut(kept.withColumn("vec", F.when(F.col("at") == 1, F.col("vec"))))
    classes = kept.where("at = 1").select("h1", "h2", F.col("id").alias("first"), "vec")
    asking = rows.where("asked")

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    shapes = classes.groupBy(F.size("vec").alias("d")).agg(F.max(norm).alias("top"), F.count("*").alias("n")).collect()  # a row for each length
    taken: dict = {}
    for r in sampled(classes.select("h1", "vec"), F.col("h1"), SAMPLE):
        taken.setdefault(len(r.vec), []).append(r.vec)
    models = {}
    for s in shapes:
        sample = np.array(taken.get(s.d) or classes.where(F.size("vec") == s.d).limit(1).first().vec, dtype=np.float64).reshape(-1, s.d)
        models[s.d] = Model(s.top, sample, lists or max(1, min(LISTS, int(s.n**0.5))), seed)
    sent = spark.sparkContext.broadcast(models)

    listed = cut(classes.mapInArrow(_listed(sent), f"h1 long, h2 long, first long, vec array<{kind}>, dims int, list int"))
    sizes = listed.groupBy("dims", "list").agg(F.count("*").alias("size"))
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    n_lists = sizes.count()
    placed = listed.join(bounded(sizes, n_lists, NAMED), ["dims", "list"]).withColumn("block", F.pmod("h1", "blocks").cast("int")).drop("size", "blocks")
    blocks = cut(placed.groupBy("dims", "list", "block").applyInArrow(_packed(sent), _BLOCK))

    wanted = cut(asking.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "vec").dropDuplicates(["q1", "q2"]))
    held = {(r.dims, r.list): r.size for r in sizes.collect()}  # at most LISTS for each length
    if probes is None:
        tried: dict = {}
        for i, r in enumerate(sampled(wanted, F.col("q1"), TRIED)):
            tried.setdefault(len(r.vec), []).append((i, (r.q1, r.q2), r.vec))
        tried = {d: ([i for i, _, _ in t], [c for _, c, _ in t], np.array([v for _, _, v in t], dtype=np.float64)) for d, t in tried.items()}
        seen = blocks.mapInArrow(_exact(sent, spark.sparkContext.broadcast(tried), k), "q int, list int, first long, score double")
        top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))
        seen = seen.withColumn("at", top).where(F.col("at") <= k).select("q", "list").collect()  # k rows for each query tried
        needed = {}
        for d, (numbers, _, x) in tried.items():
            order = np.argsort(distances(models[d].asked(x), models[d].centers), axis=1, kind="stable")
            needed[d] = probes_needed(dict(zip(numbers, order.tolist(), strict=True)), [(r.q, r.list) for r in seen if r.q in set(numbers)], recall)
    else:
        needed = {}
    needed = {d: needed.get(d, probes or len(m.centers)) for d, m in models.items()}
    probed = wanted.mapInArrow(_probes(sent, spark.sparkContext.broadcast(held), needed, more), f"q1 long, q2 long, vec array<{kind}>, dims int, list int, place int")

    def scanned(some: DataFrame) -> DataFrame:
        """Queries (q1, q2, vec, bound, dims, list) against the blocks of their lists, a batch of them and a block at a time."""
        loads = some.groupBy("dims", "list").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches"))
        loads = cut(loads.join(bounded(sizes.select("dims", "list", "blocks"), n_lists, NAMED), ["dims", "list"]))
        near = bounded(loads, n_lists, NAMED)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = blocks.join(near.drop("blocks"), ["dims", "list"]).withColumn("batch", each("batches")).drop("batches")
        right = some.join(near, ["dims", "list"]).withColumn("batch", F.pmod("q2", "batches").cast("int")).withColumn("block", each("blocks")).drop("batches", "blocks")
        right = right.select(F.col("dims").alias("d"), F.col("list").alias("l"), F.col("block").alias("b"), F.col("batch").alias("t"), "q1", "q2", "vec", "bound")
        return left.groupBy("dims", "list", "block", "batch").cogroup(right.groupBy("d", "l", "b", "t")).applyInArrow(_scanned(sent, more), _FOUND)

    first = scanned(cut(probed.where("place = 0").select("q1", "q2", "vec", F.lit(None).cast("double").alias("bound"), "dims", "list")))
    first = cut(_best(first, more))
    bounds = first.where(F.col("at") == more).select("q1", "q2", F.col("score").alias("bound"))
    rest = probed.where("place > 0").join(bounds, ["q1", "q2"], "left").select("q1", "q2", "vec", "bound", "dims", "list")
    found = cut(_best(first.drop("at").unionByName(scanned(cut(rest))), more).drop("at", "first"))

    # From classes to rows: each class's ids, the best of them, then the query's own row out.
    ids = kept.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("id").alias("first"), "copy")
    found = _best(found.join(ids, ["c1", "c2"]), more).drop("at")
    queries = asking.select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    own = (F.col("c1") == F.col("q1")) & (F.col("c2") == F.col("q2")) & (F.col("first") == F.col("query_id")) & (F.col("copy") == 1)
    out = queries.join(found, ["q1", "q2"]).where(~own)
    rank = F.row_number().over(Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "first", "copy"))
    null = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(null("query_id").alias("query_id"), "rank", null("first").alias("vec_id"), "score")


def op11_nearest(spark, sf_dir: str) -> DataFrame:
    """nearest() for all embeddings whose id is divisible by 20; null, zero and odd vectors, ties and empty tables as there."""
    return nearest(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
