"""Helpers the corpus operators share: lineage cuts, row numbers, links to components, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuweave.operators.store import free_name, shared_dir, stored

#: The white space that separates words, as the characters of ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
#: Rows whose id is null act as one document whose id is above all others.
NO_ID = 2**63 - 1


#: Rows that go to Python at once, where the session has Spark's own setting: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch from Spark's default, which is meant for narrow rows; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; a lost executor can't take it along."""
    small_batches(df.sparkSession)
    return stored(df)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """small, marked for broadcast if it has at most ``limit`` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(small) if rows <= limit else small


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df in the given order with gapless row numbers from 0, without a single-task window.

    One range shuffle; the partitions' row counts (a row each) are summed on the driver and sent back.
    Rows that tie in ``order`` are told apart by their place in the input, so no tie fills one range.
    """
    spark = df.sparkSession
    tie, pos, held, start = (free_name(df, f"__sw_{n}") for n in ("tie", "pos", "part", "start"))
    placed = df.withColumn(tie, F.monotonically_increasing_id())
    kept = cut(placed.repartitionByRange(parts(spark), *order, F.col(tie)).sortWithinPartitions(*order, F.col(tie)).drop(tie))
    kept = kept.withColumn(pos, F.monotonically_increasing_id())
    part, low = F.shiftright(pos, 33), F.col(pos).bitwiseAND((1 << 33) - 1)
    counts = sorted(kept.groupBy(part.alias("p")).count().collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts or [(0, 0)], f"{held} long, {start} long")
    return kept.withColumn(held, part).join(F.broadcast(offsets), held).withColumn(name, F.col(start) + low).drop(pos, held, start)


def _ends(group: str, weight: str):
    """One row for a sorted partition: its first and last group and the last one's sum."""

    def run(batches):
        from pyspark import TaskContext

        first = last = None
        total = 0
        for b in batches:
            if b.num_rows:
                g, w = b.column(group).to_numpy(), b.column(weight).to_numpy()
                tail = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
                total = (total if tail == 0 and g[-1] == last else 0) + int(w[tail:].sum())
                first, last = g[0] if first is None else first, g[-1]
        if first is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), *(pa.array([int(x)], pa.int64()) for x in (first, last, total))], names=["part", "first", "last", "total"])

    return run


def _prefix_sums(group: str, weight: str, carried: dict):
    def run(batches):
        from pyspark import TaskContext

        last, total = carried.get(TaskContext.get().partitionId(), (None, 0))
        for b in batches:
            if b.num_rows:
                g, w = b.column(group).to_numpy(), b.column(weight).to_numpy()
                ahead = np.cumsum(w) - w
                start = np.concatenate([[True], g[1:] != g[:-1]])
                base = ahead[start][np.cumsum(start) - 1]
                out = ahead - base
                if g[0] == last:
                    out[: len(g) if not start[1:].any() else int(np.flatnonzero(start[1:])[0]) + 1] += total
                last, total = g[-1], int(out[-1] + w[-1])
                yield pa.record_batch([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "__sw_ahead"])

    return run


def running(df: DataFrame, group: str, order: list, weight: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``weight`` (a long) over the rows before this one in its ``group`` (a long), in order.

    No window, so a group may hold any part of all rows: one range shuffle, then each sorted partition is summed where it
    lies; a row for each partition goes to the driver, which carries sums over to the partitions that a group runs into.
    Rows that tie in ``order`` follow in the order of their place in the input.
    """
    tie = free_name(df, "__sw_tie")
    keys = [F.col(group), *order, F.col(tie)]
    placed = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    kept = cut(placed.drop(tie))
    carried, before = {}, (None, 0)
    for r in sorted(kept.select(group, weight).mapInArrow(_ends(group, weight), "part long, first long, last long, total long").collect()):
        carried[r.part] = before
        before = (r.last, r.total + (before[1] if r.first == r.last == before[0] else 0))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), "__sw_ahead long"])
    return kept.mapInArrow(_prefix_sums(group, weight, carried), schema).withColumnRenamed("__sw_ahead", name)


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def local_forest(pairs: np.ndarray) -> np.ndarray:
    """A (child, root) row for every vertex of the n x 2 links that isn't its component's smallest."""
    ids, flat = np.unique(pairs.ravel(), return_inverse=True)
    parent = np.arange(len(ids))
    a, b = flat.reshape(-1, 2).T
    while True:
        pa_, pb = parent[a], parent[b]
        low = np.minimum(pa_, pb)
        before = parent.copy()
        np.minimum.at(parent, pa_, low)
        np.minimum.at(parent, pb, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        if np.array_equal(before, parent):
            break
    kids = np.flatnonzero(parent != np.arange(len(ids)))
    return np.column_stack([ids[kids], ids[parent[kids]]])


def _forest_batches(batches):
    held, rows = [], 0
    for b in batches:
        held.append(np.column_stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]))
        rows += len(held[-1])
        if rows >= 1_000_000:
            held = [local_forest(np.concatenate(held))]
            rows = len(held[0])
    if rows:
        f = local_forest(np.concatenate(held))
        yield pa.record_batch([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["v", "u"])


#: Links that are finished in one task (16 bytes each, so 8 MB at most): a round over all executors costs more than that.
#: A parameter of the speed alone; both ways give the same components.
LOCAL_LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (v, u), two longs; root is the component's smallest vertex.

    Each partition first shrinks its links to a forest.  Up to LOCAL_LINKS links are left to one task; for more,
    large-star and small-star rounds (Kiveris et al. 2014) over DataFrames run until nothing changes, each kept in the
    shared folder.  No links reach the driver.
    """
    edges = links.select("v", "u").where("v != u").mapInArrow(_forest_batches, "v long, u long").distinct()
    edges = cut(edges)
    if edges.count() <= LOCAL_LINKS:
        return cut(edges.coalesce(1).mapInArrow(_forest_batches, "v long, u long").withColumnRenamed("u", "root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Minima are kept before the join, so that both of its sides come straight from a shuffle and Spark can split
        # a vertex with very many neighbours.
        least = cut(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")))
        # Large star: every larger neighbour of v is linked to the smallest of v and its neighbours.
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        large = cut(large)
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")))
        # Small star: v and its smaller neighbours are linked to the smallest of them.
        small = large.join(least, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select("v", F.col("u").alias("root"))
        before = now
