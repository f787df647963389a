"""N-gram Jaccard join: every pair of texts whose word-shingle sets are similar, by signature trees.

1. Equal texts fall into one class by two 64-bit hashes; one row of each class goes on.
2. Shingle hashes are dealt by hash range.  A range's task sees all texts' hashes there, so it knows each one's exact
   number of texts; hashes of one text alone can't be shared and are dropped, the others go back to their text.
3. A text's prefix is the rarest (1 - t) * n + 1 of its n hashes, in the order (number of texts, hash).  Two texts with
   similarity t or more share a prefix hash.  Texts that share one are tied into clusters; most texts have none.
4. Within a cluster, signature trees: a node has the OR of its texts' bitmaps and the range of their set sizes.  A dual
   traversal leaves out node pairs whose largest possible overlap is too small, and pairs that are connected already;
   what is left is checked exactly.  A cluster of up to BLOCK texts is one tree in one task.
5. A larger cluster is sorted by size and cut into blocks, the leaves of a tree over the whole cluster.  Each block is
   joined with itself; then one text of each component found stands for it, and these are joined likewise, round after
   round, which ties a large group of near copies together without any two of its blocks meeting.  Last, the tree is
   traversed as DataFrames, level by level: pairs of nodes that are one component already, or that can't overlap enough
   by bitmaps and sizes, go before any text is copied; the block pairs left are joined, one group for each.
6. The links found connect all that is connected; components come from large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import NO_ID, bounded, components, cut, documents, give_back, local_forest, numbered, parts
from skuweave.operators.store import identified

WORDS = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 3, 4
#: Words remembered with their hash by each Python worker.
MEMO = 200_000
#: Hashes and texts that a task gathers before it deals them out.
FLUSH_HASHES, FLUSH_TEXTS = 500_000, 60_000
#: Texts in a block of a cluster and in a leaf of a task's tree; children of a task's and of a cluster's nodes.
BLOCK, LEAF, FAN, WIDE = 128, 8, 4, 16
#: Longs in the bitmap of a cluster's node; rows of small clusters that go to a task at once, about; copies listed for a broadcast.
BITMAP, TOGETHER, COPIES = 64, 512, 4_000_000
#: From so many texts of a part on, a hash goes on as one row with its count.
HOT = 16
#: The column that tells rows apart, which tables aren't expected to have.
ROW = "__sw_text_row"


class _Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh3_64_digest(word)
        return h


def shingles(text: str | None, memo: dict, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word windows; texts with fewer words have the whole as one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w = np.frombuffer(b"".join([memo[x] for x in words]), dtype=np.uint64)
    n = len(w) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


LOW = np.uint64((1 << 48) - 1)


def _packed(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes, in 6 bytes each."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _runs(x: np.ndarray):
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return ()
    at = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1)]
    return zip(at, [*at[1:], len(x)], strict=True)


def _dealt(buckets: int, size: int):
    """Arrow batches (node, text) to rows (bucket, part, kind, data).

    kind 0: hashes by range, with their text's number in the part.  kind 1, to the part itself: its texts.  A hash of
    HOT texts of the part or more goes to its range once, with their number (kind 2), and with its texts to the part
    (kind 3), so that a passage that all texts share is a row for each part at its range.
    """

    def flush(part, nodes, sets):
        sizes = np.array([len(s) for s in sets], dtype=np.uint32)
        home = -1 - (part + (part >> 24)) % buckets
        rows = [(home, part, 1, np.array(nodes, dtype=np.int64).tobytes() + sizes.tobytes())]
        h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        who = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        bucket = ((h >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
        h = h & LOW
        # Hashes are counted exactly where their last 20 bits occur often enough at all.
        low = (h & np.uint64(0xFFFFF)).astype(np.int64)
        often = np.flatnonzero((np.bincount(low, minlength=1) >= HOT)[low])
        if len(often):
            full = h[often] | bucket[often].astype(np.uint64) << np.uint64(48)
            value, which, count = np.unique(full, return_inverse=True, return_counts=True)
            value_bucket = (value >> np.uint64(48)).astype(np.int64)
            hot = count >= HOT
            for a, z in _runs(value_bucket[hot]):
                v, c = value[hot][a:z], count[hot][a:z]
                rows.append((int(v[0] >> np.uint64(48)), part, 2, _packed(v & LOW) + c.astype(np.uint32).tobytes()))
            mine = hot[which]
            if mine.any():
                rows.append((home, part, 3, full[mine].tobytes() + who[often[mine]].tobytes()))
                cold = np.ones(len(h), dtype=bool)
                cold[often[mine]] = False
                h, who, bucket = h[cold], who[cold], bucket[cold]
        order = np.argsort(bucket, kind="stable")
        h, who, bucket = h[order], who[order], bucket[order]
        rows += [(int(bucket[a]), part, 0, _packed(h[a:z]) + who[a:z].tobytes()) for a, z in _runs(bucket)]
        b, p, k, d = zip(*rows, strict=True)
        return pa.record_batch([pa.array(b, pa.int32()), pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "part", "kind", "data"])

    def run(batches):
        from pyspark import TaskContext

        part, memo, nodes, sets, held = TaskContext.get().partitionId() << 24, _Hashes(), [], [], 0
        for b in batches:
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                nodes.append(node)
                sets.append(shingles(text.as_py(), memo, size))
                held += len(sets[-1])
                if held >= FLUSH_HASHES or len(sets) >= FLUSH_TEXTS:
                    yield flush(part, nodes, sets)
                    part, nodes, sets, held = part + 1, [], [], 0
            if len(memo) > MEMO:
                memo.clear()
        if nodes:
            yield flush(part, nodes, sets)
        del memo, nodes, sets
        give_back()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """One range's rows to (part, kind, data): per part the hashes of two texts or more, with their number of texts."""
    bucket, parts_, kinds, blobs = (table.column(c).to_pylist() for c in ("bucket", "part", "kind", "data"))
    if bucket[0] < 0:
        return table.select(["part", "kind", "data"])
    low, who, own, times = [], [], [], []
    for k, (kind, d) in enumerate(zip(kinds, blobs, strict=True)):
        n = len(d) // (8 if kind == 0 else 10)
        low.append(_unpacked(d, n))
        own.append(np.full(n, k, dtype=np.int32))
        who.append(np.frombuffer(d, np.uint16, n, 6 * n) if kind == 0 else np.zeros(n, np.uint16))
        times.append(np.ones(n, np.uint32) if kind == 0 else np.frombuffer(d, np.uint32, n, 6 * n))
    h, who, own, times = np.concatenate(low), np.concatenate(who), np.concatenate(own), np.concatenate(times)
    order = np.argsort(h)
    s = h[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.repeat(np.add.reduceat(times[order].astype(np.int64), at), np.diff(np.concatenate([at, [len(s)]])))
    keep = many >= 2
    order, many = order[keep], many[keep].astype(np.uint32)
    back = np.lexsort((order, own[order]))
    order, many = order[back], many[back]
    full = h[order] | np.uint64(bucket[0]) << np.uint64(48)
    rows = []
    for a, z in _runs(own[order]):
        k = own[order[a]]
        rows.append((parts_[k], kinds[k], full[a:z].tobytes() + many[a:z].tobytes() + (who[order[a:z]].tobytes() if kinds[k] == 0 else b"")))
    p, k, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["part", "kind", "data"])


def _prefixes(table: pa.Table) -> pa.Table:
    """One part's rows to (node, n, prefix, shared): prefix and shared hashes are null for texts without candidates."""
    head, h, many, who, hot, hot_many, own = None, [], [], [], [], [], None
    for kind, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == 1:
            head = d
        elif kind == 3:
            own = d
        else:
            n = len(d) // (14 if kind == 0 else 12)
            (h if kind == 0 else hot).append(np.frombuffer(d, np.uint64, n))
            (many if kind == 0 else hot_many).append(np.frombuffer(d, np.uint32, n, 8 * n))
            if kind == 0:
                who.append(np.frombuffer(d, np.uint16, n, 12 * n))
    if own is not None:  # the part's hot hashes, whose numbers come once for all its texts
        value, count = np.concatenate(hot), np.concatenate(hot_many)
        order = np.argsort(value)
        n = len(own) // 10
        h.append(np.frombuffer(own, np.uint64, n))
        who.append(np.frombuffer(own, np.uint16, n, 8 * n))
        many.append(count[order][np.searchsorted(value[order], h[-1])])
    k = len(head) // 12
    nodes, sizes = np.frombuffer(head, np.int64, k), np.frombuffer(head, np.uint32, k, 8 * k).astype(np.int64)
    h, many, who = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((h, np.uint64), (many, np.uint32), (who, np.uint16)))
    order = np.lexsort((h, many, who))
    h, who = h[order], who[order]
    ends = np.searchsorted(who, np.arange(k + 1, dtype=np.int64))
    prefix, shared = [None] * k, [None] * k
    length = sizes - -(-sizes * NUM // DEN) + 1
    take = length - (sizes - np.diff(ends))  # what is left of the prefix after the text's own hashes
    for i in np.flatnonzero((take > 0) & (np.diff(ends) > 0)):
        own = h[ends[i] : ends[i + 1]]
        prefix[i] = own[: take[i]].view(np.int64)
        shared[i] = np.sort(own).tobytes()
    return pa.table([pa.array(nodes), pa.array(sizes), pa.array(prefix, pa.list_(pa.int64())), pa.array(shared, pa.binary())], names=["node", "n", "prefix", "shared"])


def _tree(bits: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list:
    """Levels from the leaves up: (first, last + 1, bitmap, least size, most in common, most hashes beyond the bits)."""
    beyond = counts - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    level = [(a, min(a + LEAF, len(bits))) for a in range(0, len(bits), LEAF)]
    level = [(a, z, np.bitwise_or.reduce(bits[a:z]), sizes[a:z].min(), counts[a:z].max(), beyond[a:z].max(), ()) for a, z in level]
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FAN):
            x = level[i : i + FAN]
            up.append((x[0][0], x[-1][1], np.bitwise_or.reduce([c[2] for c in x]), min(c[3] for c in x), max(c[4] for c in x), max(c[5] for c in x), tuple(x)))
        level = up
    return level[0]


def tree_links(left: list, right: list | None, known: dict | None = None) -> list:
    """Links (a, b) that connect all texts connected by links within left, or between left and right.

    left, right: (node, n, hashes) lists; hashes are sorted and hold all that a text may share.  known: nodes' components
    so far; texts of one component aren't compared.  A link says that the overlap is at least NUM / DEN of the union.
    """
    texts = sorted(left, key=lambda t: (t[2][0], t[1]))
    other = texts if right is None else sorted(right, key=lambda t: (t[2][0], t[1]))
    most = max(len(t[2]) for t in (*texts, *other))
    width = min(1 << 16, max(512, 1 << (4 * most - 1).bit_length()))

    def signatures(ts):
        bits = np.zeros((len(ts), width // 8), dtype=np.uint8)
        for row, (_, _, h) in zip(bits, ts, strict=True):
            flags = np.zeros(width, dtype=np.uint8)
            flags[h & np.uint64(width - 1)] = 1
            row[:] = np.packbits(flags)
        words = bits.view(np.uint64)
        return words, np.array([t[1] for t in ts]), np.array([len(t[2]) for t in ts])

    a_bits, a_n, a_k = signatures(texts)
    b_bits, b_n, b_k = (a_bits, a_n, a_k) if right is None else signatures(other)
    a_over = a_k - np.bitwise_count(a_bits).sum(axis=1).astype(np.int64)
    b_over = b_k - np.bitwise_count(b_bits).sum(axis=1).astype(np.int64)
    parent = {t[0]: t[0] for t in (*texts, *other)}
    if known:
        parent |= {c: c for c in known.values()} | known

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    need, gain = NUM, NUM + DEN  # (NUM + DEN) * overlap >= NUM * (n_a + n_b)
    links = []
    root_a = _tree(a_bits, a_n, a_k)
    stack = [(root_a, root_a if right is None else _tree(b_bits, b_n, b_k))]
    while stack:
        x, y = stack.pop()
        common = int(np.bitwise_count(x[2] & y[2]).sum())
        if gain * min(x[4], y[4], common + x[5], common + y[5]) < need * (x[3] + y[3]):
            continue
        if x[6] or y[6]:
            xs, ys = x[6] or (x,), y[6] or (y,)
            if x is y:
                stack += [(p, q) for i, p in enumerate(xs) for q in xs[i:]]
            else:
                stack += [(p, q) for p in xs for q in ys]
            continue
        ia, ib = np.arange(x[0], x[1]), np.arange(y[0], y[1])
        common = np.bitwise_count(a_bits[ia][:, None] & b_bits[ib][None]).sum(axis=2).astype(np.int64)
        bound = np.minimum(np.minimum(a_k[ia][:, None], b_k[ib][None]), common + np.minimum(a_over[ia][:, None], b_over[ib][None]))
        for i, j in np.argwhere(gain * bound >= need * (a_n[ia][:, None] + b_n[ib][None])):
            p, q = texts[ia[i]], other[ib[j]]
            if right is None and ia[i] >= ib[j] or (u := find(p[0])) == (v := find(q[0])):
                continue
            overlap = len(np.intersect1d(p[2], q[2], assume_unique=True))
            if gain * overlap >= need * (p[1] + q[1]):
                parent[max(u, v)] = min(u, v)
                links.append((p[0], q[0]))
    return links


_LINKS = "v long, u long"


def _links(found: list) -> pa.Table:
    v, u = zip(*found, strict=True) if found else ((), ())
    return pa.table([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["v", "u"])


def _by_root(table: pa.Table) -> dict:
    texts: dict = {}
    for root, node, n, shared in zip(*(table.column(c).to_pylist() for c in ("root", "node", "n", "shared")), strict=True):
        texts.setdefault(root, []).append((node, n, np.frombuffer(shared, np.uint64)))
    return texts


def _small(table: pa.Table) -> pa.Table:
    """Whole clusters (root, node, n, shared) to their links."""
    return _links([x for texts in _by_root(table).values() for x in tree_links(texts, None)])


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    flags = np.zeros(64 * BITMAP, dtype=np.uint8)
    flags[hashes & np.uint64(64 * BITMAP - 1)] = 1
    return np.packbits(flags).view(np.uint64)


_BLOCK = "kind int, v long, u long, root long, block long, n long, top long, k long, beyond long, shared binary, bits array<long>"


def _block(table: pa.Table) -> pa.Table:
    """A block (block, root, node, n, shared) to its links (kind 0), a text of each component (1), and its signature (2).

    The signature is that of each cluster in the block: OR of bitmaps, least and largest size, most hashes, and most
    hashes of a text beyond the bits of its own bitmap.
    """
    rows, block = [], table.column("block")[0].as_py()
    for root, texts in _by_root(table).items():
        found = tree_links(texts, None)
        part = {t[0]: t[0] for t in texts}
        for child, top in local_forest(np.array(found, dtype=np.int64).reshape(-1, 2)).tolist():
            part[child] = top
        rows += [(0, v, u) + (None,) * 8 for v, u in found]
        rows += [(1, t[0], None, root, None, t[1], None, None, None, t[2].tobytes(), None) for t in texts if part[t[0]] == t[0]]
        bits = [_bitmap(t[2]) for t in texts]
        beyond = max(len(t[2]) - int(np.bitwise_count(b).sum()) for t, b in zip(texts, bits, strict=True))
        sizes = [t[1] for t in texts]
        rows.append((2, None, None, root, block, min(sizes), max(sizes), max(len(t[2]) for t in texts), beyond, None, np.bitwise_or.reduce(bits).view(np.int64).tolist()))
    types = [pa.int32(), *[pa.int64()] * 8, pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _pair(table: pa.Table) -> pa.Table:
    """Two blocks of a cluster (side, node, n, shared, part) to the links between them that join components."""
    sides, known = ([], []), {}
    for side, node, n, shared, part in zip(*(table.column(c).to_pylist() for c in ("side", "node", "n", "shared", "part")), strict=True):
        sides[side].append((node, n, np.frombuffer(shared, np.uint64)))
        known[node] = part
    return _links(tree_links(*sides, known))


def _blocked(texts: DataFrame) -> DataFrame:
    """texts (root, node, n, shared) with block: up to BLOCK neighbours each by cluster, size and least hash."""
    order = [F.col("root"), F.col("n"), F.substring("shared", 1, 8), F.col("node")]
    return numbered(texts, order, "at").withColumn("block", F.floor(F.col("at") / BLOCK)).drop("at")


def block_pairs(leaves: DataFrame) -> DataFrame:
    """(root, a < b): pairs of blocks of a cluster between which links may join components.

    leaves: (root, k, n, top, k_most, beyond, low, high, bits), k from 0 in each cluster; low, high: least and largest
    component.  The tree over them is built and traversed level by level.
    """
    levels, most = [leaves], leaves.agg(F.max("k")).first()[0] or 0
    while WIDE ** (len(levels) - 1) <= most:
        f = {"n": F.min, "top": F.max, "k_most": F.max, "beyond": F.max, "low": F.min, "high": F.max}
        any_ = F.array(*[F.bit_or(F.get("bits", i)) for i in range(BITMAP)]).alias("bits")
        levels.append(levels[-1].groupBy("root", F.expr(f"k div {WIDE}").alias("k")).agg(*[g(c).alias(c) for c, g in f.items()], any_))
    pairs = levels[-1].where("low != high").select("root", F.col("k").alias("a"), F.col("k").alias("b"))
    x, y = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    common = F.aggregate(F.zip_with(x("bits"), y("bits"), lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda s, n: s + n)
    bound = F.least(x("k_most"), y("k_most"), common + x("beyond"), common + y("beyond"))
    enough = (NUM + DEN) * bound >= NUM * (x("n") + y("n"))
    alike = (DEN * x("top") >= NUM * y("n")) & (DEN * y("top") >= NUM * x("n"))
    apart = F.least(x("low"), y("low")) != F.greatest(x("high"), y("high"))
    for depth, level in reversed(list(enumerate(levels[:-1]))):
        side = lambda s: level.select("root", F.expr(f"k div {WIDE}").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in level.columns if c != "root"])  # noqa: B023, E731
        order = x("k") <= y("k") if depth else x("k") < y("k")
        pairs = pairs.join(side("a"), ["root", "a"]).join(side("b"), ["root", "b"]).where(order & apart & alike & enough)
        pairs = cut(pairs.select("root", x("k").alias("a"), y("k").alias("b")))
    return pairs


def large_links(texts: DataFrame) -> DataFrame:
    """Links among the texts (root, node, n, shared) of clusters that take more than one block."""
    members = cut(_blocked(texts))
    found, left, first = None, members, None
    while True:
        joined = cut(left.groupBy("block").applyInArrow(_block, _BLOCK))
        first = joined if first is None else first
        links = joined.where("kind = 0").select("v", "u")
        found = links if found is None else found.unionByName(links)
        standing = joined.where("kind = 1")
        # Rounds go on while they tie blocks together and a cluster has more than a block of components.
        had, have = left.count(), standing.count()
        if 2 * have > had or standing.groupBy("root").count().where(F.col("count") > 1).limit(1).count() == 0:
            break
        left = cut(_blocked(standing.select("root", F.col("v").alias("node"), "n", "shared")))
    found = cut(found)
    parts_ = components(found).withColumnRenamed("root", "part")
    members = members.join(parts_, F.col("node") == F.col("v"), "left").withColumn("part", F.coalesce("part", "node")).drop("v")
    start = members.groupBy("root").agg(F.min("block").alias("start"))
    members = cut(members.join(start, "root").withColumn("k", F.col("block") - F.col("start")).drop("start"))
    within = members.groupBy("root", "block", "k").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    leaves = first.where("kind = 2").select("root", "block", "n", "top", F.col("k").alias("k_most"), "beyond", "bits").join(within, ["root", "block"]).drop("block")
    pairs = block_pairs(cut(leaves))
    texts = members.select("root", "k", "node", "n", "shared", "part")
    meet = lambda c, side: texts.join(pairs.withColumn("k", F.col(c)), ["root", "k"]).withColumn("side", F.lit(side))
    both = meet("a", 0).unionByName(meet("b", 1)).drop("k")
    return found.unionByName(both.groupBy("root", "a", "b").applyInArrow(_pair, _LINKS))


def class_links(texts: DataFrame) -> DataFrame:
    """Links (v, u) among texts (node, n, prefix, shared)."""
    open_ = texts.where("prefix is not null").dropDuplicates(["node"])
    tokens = open_.select("node", F.explode("prefix").alias("token"))
    least = cut(tokens.groupBy("token").agg(F.min("node").alias("u")))
    found = components(tokens.join(least, "token").select(F.col("node").alias("v"), "u"))
    roots = found.unionByName(found.select(F.col("root").alias("v"), "root")).distinct()
    members = cut(open_.select("node", "n", "shared").join(roots, F.col("node") == F.col("v")).select("root", "node", "n", "shared"))
    sizes = cut(members.groupBy("root").agg(F.count("*").alias("size")))
    total, largest = sizes.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return found.select("v", F.col("root").alias("u"))  # no clusters, no links
    sized = members.join(sizes, "root")
    group = F.pmod(F.xxhash64("root"), F.lit(-(-total // TOGETHER))).alias("g")
    small = sized.where(F.col("size") <= BLOCK).groupBy(group).applyInArrow(_small, _LINKS)
    return small if largest <= BLOCK else small.unionByName(large_links(sized.where(F.col("size") > BLOCK).drop("size")))


def near_duplicates(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", size: int = WORDS, row: str | None = None) -> DataFrame:
    """Per row of docs: id, row, n_shingles, component, first.

    row: what identified() gives, or the column of docs that the parameter names and that tells its rows apart in the same way.

    component: the smallest id reachable by links (similarity at least NUM / DEN).  Null, empty and blank texts have no
    shingles and link with nothing, copies included: their component is their own id.  A null id counts as the largest;
    its component is null if no other id is in reach.  Repeated rows are copies of each other.  first: the row of
    the component's representative, the row with the smallest id and of those the first; it tells null-id components apart.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs, row = (docs, row) if row else (identified(docs, ROW), ROW)
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(row).alias("row"))
    keyed = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row", "text", F.xxhash64("text").alias("node"), F.xxhash64(F.lit(1), "text").alias("check"))
    slim = cut(keyed.drop("text"))
    # One row of each class goes on: the least by (id, row).  The other rows, if few, are broadcast to drop them.
    firsts = cut(slim.groupBy("node", "check").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("copies")))
    rest = slim.join(firsts.where("copies > 1"), ["node", "check"]).where("row != first.row").select("row")
    rest = cut(rest)
    texts = keyed.join(bounded(rest, rest.count(), COPIES), "row", "left_anti").select("node", "text")
    spark = docs.sparkSession
    buckets = min(1 << 16, 4 * parts(spark))
    dealt = texts.mapInArrow(_dealt(buckets, size), "bucket int, part long, kind int, data binary")
    dealt = dealt.groupBy("bucket").applyInArrow(_shared, "part long, kind int, data binary")
    sets = cut(dealt.groupBy("part").applyInArrow(_prefixes, "node long, n long, prefix array<long>, shared binary"))
    found = components(class_links(sets))
    classes = firsts.groupBy("node").agg(F.min("first").alias("first")).join(sets.groupBy("node").agg(F.max("n").alias("n")), "node")
    classes = classes.join(found, F.col("node") == F.col("v"), "left").select("node", "n", "first", F.coalesce("root", "node").alias("root"))
    classes = cut(classes)
    least = cut(classes.groupBy("root").agg(F.min("first").alias("least")))
    classes = cut(classes.join(least, "root").select("node", "n", "least"))
    out = slim.join(classes, "node")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least.id"))
    null = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(null(F.col("id")).alias("id"), "row", F.col("n").alias("n_shingles"), null(component).alias("component"), F.when(F.col("n") == 0, F.col("row")).otherwise(F.col("least.row")).alias("first"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() among all documents; nulls, short texts, repeated rows and empty tables as there."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
