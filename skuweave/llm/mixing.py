"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

A document's membership pattern is the set of the sources that hold it: those given for it, or those of all rows with the
same text.  All patterns of several sources, and the sources in them, go through the flow: a small network is solved on the
driver, a larger one by rounds over DataFrames, and both flows are the cheapest that there are.  A source that shares
nothing has a flow of one arc, which is an expression.  Documents are then laid out by pattern in an order that the seed
fixes, and each source takes its stretch of that order, so that sources that share texts take different ones first.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import bounded, cut, documents, new_path, numbered, running
from skuweave.operators.store import remove

#: Words that separate nothing: a word is a run of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
#: Arcs (pairs of a pattern and a source of it) that the driver solves; more go by rounds.  A parameter of the speed alone:
#: both ways meet the same share of the quotas at the same cost.
LOCAL_ARCS = 200_000
#: Repetitions that have a cost each; beyond them costs go by powers of two.
SINGLY = 8
#: Fixed point of the places at which stretches start, where they are summed over DataFrames.
PLACES = 1 << 40
#: Rows of a plan that are broadcast; a larger plan is joined by a shuffle.
PLAN_ROWS = 100_000


def step(used: int, words: int) -> tuple[int, int]:
    """Unit cost of the next repetition of a pattern's words, and the use up to which it holds: the k-th time costs k * k."""
    k = used // words + 1
    k = k if k <= SINGLY else 1 << (k - 1).bit_length()
    return k * k, k * words


def _ahead(group: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row the sum of ``weight`` over the rows of its group before it."""
    order = np.argsort(group, kind="stable")
    g, w = group[order], weight[order]
    before = np.cumsum(w) - w
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    out = np.empty_like(w)
    out[order] = before - np.repeat(before[start], np.diff(np.append(start, len(g))))
    return out


def min_cost_flow(capacity: dict, quota: dict, epochs: int, arcs: dict | None = None) -> dict:
    """Words that each pattern (a tuple of sources) gives each of its sources, as {(pattern, source): words}.

    A pattern's words cost k * k each the k-th time (see step()).  Without arcs a pattern gives them ``epochs`` times in
    all; with arcs, {(pattern, source): words}, each source gets at most so many.  The flow meets as much of the quotas as
    it can and is the cheapest that does.

    What a pattern gives costs more from one use of its words to the next, the same for all patterns, so the flow is made
    largest for one use, then from there for the next, and is the cheapest after each.  Within one use words are pulled:
    a source that lacks words asks the patterns on its shortest way to spare words; those that have none to spare take
    them back from another source, nearer to spare words, which then lacks them itself.  What a pattern gives never falls.
    Distances are found anew in every round, so each round pulls along shortest ways only (push-relabel with exact
    labels), and a use is done when no source that lacks words has a way to any.
    """
    patterns = [p for p in capacity if capacity[p] > 0]
    keys = [(p, s) for p in patterns for s in p]
    names = sorted({s for _, s in keys})
    at = {s: i for i, s in enumerate(names)}
    words = np.array([capacity[p] for p in patterns], np.int64)
    pat = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    src = np.array([at[s] for _, s in keys], np.int64)
    cap = np.array([epochs * capacity[p] if arcs is None else arcs.get((p, s), 0) for p, s in keys], np.int64)
    most, left = epochs * words, np.array([quota.get(s, 0) for s in names], np.int64)
    if arcs is not None:
        most = np.zeros(len(patterns), np.int64)
        np.add.at(most, pat, cap)
    flow, used = np.zeros(len(keys), np.int64), np.zeros(len(patterns), np.int64)

    def total(group: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, group, of)
        return out

    use, last, turn = 1, int((-(-most // words)).max(initial=0)), 0
    while (left > 0).any():
        offer, held, seen = np.maximum(np.minimum(use * words, most) - used, 0), None, np.zeros(len(names), bool)
        while True:
            room = np.where(seen[src], 0, np.minimum(cap - flow, offer[pat]))
            reach = total(src, room, len(names))
            if not reach.any() or (reach[left > 0] > 0).any():
                break
            seen |= reach > 0
            held = np.minimum(flow, reach[src])
            offer = total(pat, held, len(patterns))
        if not reach.any():
            if use >= last:
                break
            use = use + 1 if use < SINGLY else 2 * use
            continue
        turn += 1
        order = np.random.default_rng(turn).permutation(len(keys))
        p, s = pat[order], src[order]
        ask = np.maximum(np.minimum(room[order], left[s]), 0)
        grant = np.clip(offer[p] - _ahead(p, ask), 0, ask)
        take = np.clip(np.maximum(left[s], 0) - _ahead(s, grant), 0, grant)
        due = total(p, take, len(patterns))
        change = take
        if held is None:
            used += due
        else:
            change = take - np.clip(due[p] - _ahead(p, held[order]), 0, held[order])
        flow[order] += change
        left -= total(s, change, len(names))
    return {k: int(v) for k, v in zip(keys, flow) if v > 0}


def flow_by_rounds(arcs: DataFrame, quota: DataFrame) -> DataFrame:
    """arcs with ``flow``, a flow as min_cost_flow() finds it, for networks of any size.

    arcs: (gid, pid, sid, arc, words, most), longs: a pattern's source gets at most ``arc`` words, all of them together
    ``most``; quota: (sid, quota).  The rounds are those of min_cost_flow().  Patterns grant and sources accept in an order
    of hashes, by prefix sums, so that neither is a group in one task.
    """
    spark, written = arcs.sparkSession, None
    arcs = cut(arcs.withColumn("flow", F.lit(0).cast("long")))
    n_sources = quota.count()
    last = arcs.where("words > 0").agg(F.max(F.ceil(F.col("most") / F.col("words")))).first()[0] or 0
    use, turn = 1, 0
    while True:
        met = arcs.groupBy("sid").agg(F.sum("flow").alias("met"))
        lacking = cut(quota.join(met, "sid").select("sid", (F.col("quota") - F.col("met")).alias("lack")).where("lack > 0"))
        if lacking.isEmpty():
            return arcs
        spare = F.least(F.first("words") * use, F.first("most")) - F.sum("flow")
        offers, givers, seen = arcs.groupBy("pid").agg(spare.alias("offer")).where("offer > 0"), None, None
        while True:
            open_ = arcs.where("arc > flow").join(offers, "pid")
            if seen is not None:
                open_ = open_.join(bounded(seen, n_sources, PLAN_ROWS), "sid", "left_anti")
            near = open_.groupBy("sid").agg(F.sum(F.least(F.col("arc") - F.col("flow"), F.col("offer"))).alias("reach"))
            near = cut(near.join(bounded(lacking, n_sources, PLAN_ROWS), "sid", "left"))
            found = near.agg(F.count("*").alias("near"), F.count("lack").alias("asking")).first()
            if not found.near or found.asking:
                break
            seen = near.select("sid") if seen is None else seen.unionByName(near.select("sid"))
            givers = arcs.where("flow > 0").join(bounded(near, n_sources, PLAN_ROWS), "sid").select("gid", "pid", F.least("flow", "reach").alias("held"))
            offers = givers.groupBy("pid").agg(F.sum("held").alias("offer"))
        if not found.near:
            if use >= last:
                return arcs
            use = use + 1 if use < SINGLY else 2 * use
            continue
        turn += 1
        order = [F.xxhash64("gid", F.lit(turn)), F.col("gid")]
        asking = near.where("lack is not null").select("sid", "lack")
        asks = open_.join(bounded(asking, n_sources, PLAN_ROWS), "sid").select("gid", "pid", "sid", "offer", "lack", F.least(F.col("arc") - F.col("flow"), "offer", "lack").alias("ask"))
        grants = running(asks, "pid", order, "ask", "ahead").withColumn("grant", F.least(F.col("ask"), F.col("offer") - F.col("ahead"))).where("grant > 0").drop("ahead")
        takes = running(grants, "sid", order, "grant", "ahead").select("gid", "pid", F.least(F.col("grant"), F.col("lack") - F.col("ahead")).alias("change")).where("change > 0")
        moved = takes
        if givers is not None:
            takes = cut(takes)
            due = givers.join(takes.groupBy("pid").agg(F.sum("change").alias("due")), "pid")
            back = running(due, "pid", order, "held", "ahead").select("gid", "pid", F.least(F.col("held"), F.col("due") - F.col("ahead")).alias("back")).where("back > 0")
            moved = takes.unionByName(back.select("gid", "pid", (-F.col("back")).alias("change")))
        # Written and read again: a file's size is known, while a checkpoint keeps an estimate that multiplies from round to round.
        written, before = new_path(spark, "flow"), written
        arcs.join(moved.drop("pid"), "gid", "left").withColumn("flow", F.col("flow") + F.coalesce("change", F.lit(0))).drop("change").write.parquet(written)
        arcs = spark.read.schema(arcs.schema).parquet(written)
        if before:
            remove(spark, before)


def targets(own: DataFrame, total: int, share: float, most: float, cycle: tuple) -> DataFrame:
    """own (source, words) with target: ``share`` of ``total`` by weight, none above ``most`` times its words.

    Sources in code point order, null last, weigh ``cycle``, repeating.  The excess of full sources is shared again by
    weight until none is above: a sum over the table for each time.
    """
    ranked = numbered(own, [F.col("source").isNull(), "source"], "rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod("rank", F.lit(len(cycle))).cast("int"))
    ranked = cut(ranked.select("source", "words", weight.alias("weight")))
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else level * F.col("weight") > most * F.col("words")
        row = ranked.agg(F.count_if(full).alias("n"), F.sum(F.when(full, most * F.col("words"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if row.n == n_full or not row.weights:
            break
        n_full, level = row.n, (share * total - (row.taken or 0)) / row.weights
    capped = F.col("words") * F.lit(float(most))
    return ranked.select("source", "words", (capped if level is None or not row.weights else F.least(level * F.col("weight"), capped)).alias("target"))


def _tag(source: Column) -> Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _quotas(entries: DataFrame, whole: DataFrame, total: int, share: float, epochs: int, cycle: tuple, apart: bool) -> DataFrame:
    """(gid, target, source_words, first, part): for each pattern and source the stretch of the pattern's order it takes.

    entries: (gid, pid, many, source, size), a row for each document and source, many if the pattern has several sources;
    whole: (pid, words), each text once.  apart: rows of a text are copies that may be taken ``epochs`` times each, not
    one document held by several.
    """
    spark = entries.sparkSession
    arcs = cut(entries.groupBy("gid", "pid", "many", "source").agg(F.sum("size").alias("arc")).withColumn("tag", _tag(F.col("source"))))
    wanted = cut(targets(arcs.groupBy("source").agg(F.sum("arc").alias("words")), total, share, float(epochs), cycle))
    near = cut(arcs.where("many").select("tag").distinct())
    n_near = near.count()
    quota = cut(wanted.withColumn("tag", _tag(F.col("source"))).join(bounded(near, n_near, PLAN_ROWS), "tag").select("tag", F.bround("target").cast("long").alias("quota")))
    most = F.col("arc") * epochs if apart else F.col("words") * epochs
    linked = cut(arcs.join(bounded(near, n_near, PLAN_ROWS), "tag").join(whole, "pid").select("gid", "pid", "tag", "arc", "words", most.alias("most")))
    n_linked = linked.count()
    if n_linked <= LOCAL_ARCS:
        held = defaultdict(list)
        for r in linked.orderBy("pid", "tag").collect():
            held[r.pid].append(r)
        held = {tuple(r.tag for r in p): p for p in held.values()}
        caps = {(key, r.tag): r.most for key, p in held.items() for r in p}
        flow = min_cost_flow({key: p[0].words for key, p in sorted(held.items())}, {r.tag: r.quota for r in quota.collect()}, epochs, caps if apart else None)
        rows = []
        for key, p in held.items():
            ahead = 0.0
            for r in p:
                part = flow.get((key, r.tag), 0) / r.arc if r.arc else 0.0
                rows.append((r.gid, ahead, part))
                ahead += part
        routed = spark.createDataFrame(rows, "gid long, first double, part double")
    else:
        sid = F.xxhash64("tag")
        together = linked.groupBy("pid").agg(F.sum("most").alias("together")) if apart else whole.select("pid", (F.col("words") * epochs).alias("together"))
        network = linked.join(together, "pid").select("gid", "pid", sid.alias("sid"), F.col("most").alias("arc"), "words", F.col("together").alias("most"))
        flow = flow_by_rounds(network, cut(quota.select(sid.alias("sid"), "quota"))).select("gid", "flow")
        part = F.coalesce(F.col("flow") / F.nullif(F.col("arc"), F.lit(0)), F.lit(0.0))
        laid = linked.join(flow, "gid").select("gid", "pid", "tag", part.alias("part"), F.floor(part * PLACES).alias("place"))
        routed = running(laid, "pid", [F.col("tag")], "place", "first").select("gid", (F.col("first") / PLACES).alias("first"), "part")
    alone = F.when(F.col("arc") > 0, F.least(F.col("target"), F.col("arc") * float(epochs)) / F.col("arc"))
    plan = arcs.join(wanted.withColumnRenamed("words", "source_words"), arcs["source"].eqNullSafe(wanted["source"])).join(bounded(routed, n_linked, PLAN_ROWS), "gid", "left")
    return plan.select("gid", "target", "source_words", "arc", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("part", alone, F.lit(0.0)).alias("part"))


def _placed(entries: DataFrame, whole: DataFrame, total: int, share: float, epochs: int, cycle: tuple, apart: bool) -> DataFrame:
    """entries with target, source_words and times, how often its source takes the document."""
    plan = cut(_quotas(entries, whole, total, share, epochs, cycle, apart))
    rows = running(entries.drop("pid", "many"), "gid", [F.col("u"), F.col("row")], "size", "ahead")
    rows = rows.join(bounded(plan, plan.count(), PLAN_ROWS), "gid")
    # The k-th pass over the pattern's order is from k to k + 1; a document is taken if its middle is in the stretch.
    middle = (F.col("ahead") + F.col("size") / 2) / F.nullif(F.col("arc"), F.lit(0))
    times = F.ceil(F.col("first") + F.col("part") - middle) - F.ceil(F.col("first") - middle)
    return rows.withColumn("times", F.coalesce(F.least(times, F.lit(epochs)), F.lit(0)).cast("int"))


def mix_copies(docs: DataFrame, *, ident: str, size: Column, source: Column, text: Column, share: float = 1.5, epochs: int = 2, seed: int = 17, cycle: tuple = (5, 2, 1)) -> DataFrame:
    """Per row of docs: id, size, source, source_size, target, taken, times (how often it is taken, at most ``epochs``).

    Rows with the same text are copies of one document, whose membership pattern is the set of their sources.  Every row
    counts for its own source.  A source's quota goes first to texts that are used least, all sources considered; whole
    documents only, so a source misses its quota by half a document at most at either end of a stretch.  Rows without
    words (null and empty texts too) aren't taken.  A null source is a source, the last in order.  Repeated rows are
    copies.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    row = F.monotonically_increasing_id()
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), source.cast("string").alias("source"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(seed), text).alias("h2"), row.alias("row"))
    rows = cut(rows)
    tag = _tag(F.col("source"))
    # A pattern goes by a hash of its sources' number and hashes, in no order: no row holds a list of them.
    held = rows.where("size > 0").select("h1", "h2", tag.alias("tag")).distinct()
    texts = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tag")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "tag")).alias("b"))
    several = cut(texts.where("n > 1").select("h1", "h2", F.xxhash64("n", "a", "b").alias("pid")))
    alone = F.xxhash64(F.lit(1).cast("long"), F.xxhash64(tag), F.xxhash64(F.lit(1), tag))
    entries = rows.join(bounded(several, several.count(), PLAN_ROWS), ["h1", "h2"], "left").withColumn("many", F.col("pid").isNotNull() & (F.col("size") > 0)).withColumn("pid", F.coalesce("pid", alone))
    entries = cut(entries.withColumn("gid", F.xxhash64("pid", tag)).withColumnRenamed("h2", "u"))
    whole = entries.groupBy("h1", "u", "pid").agg(F.max("size").alias("size")).groupBy("pid").agg(F.sum("size").alias("words"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    out = _placed(entries.drop("h1"), cut(whole), total, share, epochs, cycle, True)
    return out.select("id", "size", "source", F.col("source_words").alias("source_size"), "target", (F.col("times") * F.col("size")).cast("long").alias("taken"), "times")


def mix(docs: DataFrame, *, ident: str, size: Column, members: Column, share: float = 1.5, epochs: int = 2, seed: int = 17, cycle: tuple = (5, 2, 1)) -> DataFrame:
    """Per row of docs: id, size, sources (its membership pattern), taken, routes.

    members: the sources that hold the document (null or empty: the null source); any of them may take it, ``epochs``
    times in all.  routes: (source, words) for each source that takes it; the order of preference is that of
    mix_copies(), and rows without words, repeated rows and empty tables are as there.  Targets are ``share`` of all
    documents' words by weight.
    """
    members = F.when(F.coalesce(F.size(members), F.lit(0)) > 0, F.array_distinct(members)).otherwise(F.array(F.lit(None).cast("string")))
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), members.alias("own"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.withColumn("pid", F.xxhash64(F.array_sort(F.transform("own", _tag)))))
    entries = rows.select("id", "size", F.explode("own").alias("source"), "pid", (F.size("own") > 1).alias("many"), "row", F.xxhash64(F.lit(seed), "row").alias("u"))
    entries = cut(entries.withColumn("gid", F.xxhash64("pid", _tag(F.col("source")))))
    whole = cut(rows.groupBy("pid").agg(F.sum("size").alias("words")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    placed = _placed(entries, whole, total, share, epochs, cycle, False).where("times > 0 and size > 0")
    routes = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("source", (F.col("times") * F.col("size")).cast("long").alias("words")))).alias("routes"))
    out = rows.join(routes, "row", "left")
    taken = F.aggregate("routes", F.lit(0).cast("long"), lambda s, r: s + r.words)
    return out.select("id", "size", F.col("own").alias("sources"), F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), F.coalesce("routes", F.array().cast("array<struct<source:string,words:bigint>>")).alias("routes"))


def words(text: Column) -> Column:
    """Number of words of a text column (null: 0), as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """mix_copies() of all documents; nulls, texts without words, copies and empty tables as there."""
    text = F.col("text")
    out = mix_copies(documents(spark, sf_dir), ident="doc_id", size=words(text), source=F.col("source"), text=text)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
