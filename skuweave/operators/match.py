"""Matching products to listings: lossless blocking, scoring, dedup, caps and top-k."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.functions.text import bind
from skuweave.operators.score import INPUTS, THRESHOLD, flags, letters, once, overlap, ratio_bound, scores, sequence_ratio
from skuweave.operators.store import stored

SIGNALS = ["brand_norm", "kind", "screen_size_inch", "eans", "asins", "strong_models", "family_models", "name_norm", "tokens"]
KEEP_ALWAYS = ["direct_ref", "gtin", "asin", "model"]


#: What the text score gives for the same brand, kind and size, for all words in common, and for the same name.
EVIDENCE, WORDS, RATIO = {"b": 0.22, "k": 0.18, "z": 0.18}, 0.28, 0.24
#: The least threshold that blocks are lossless for: words and name alone can't reach it.
LEAST = WORDS + RATIO


def evidence_blocks(threshold: float) -> list:
    """(evidence, least likeness of words): combinations of the same brand, kind and size of which a pair shares one.

    A pair without an identifier in common scores at most its evidence, RATIO for the name, and WORDS times the Jaccard
    likeness of its words; so each combination asks for a likeness of its own.  Combinations that can't reach the
    threshold are left out, and those that hold a smaller one which asks for no likeness.
    """
    sets = [s for n in (1, 2, 3) for s in combinations("bkz", n)]
    least = {s: round((threshold - sum(EVIDENCE[x] for x in s) - RATIO) / WORDS, 6) for s in sets}
    free = [s for s in sets if least[s] <= 0]
    return [(s, max(0.0, least[s])) for s in sets if least[s] <= 1 and not any(set(f) < set(s) for f in free)]


def _first_tokens(likeness: float) -> Column:
    """Of the tokens, as many as two sets of such Jaccard likeness must share one of; those with digits, being rare, first."""
    order = F.array_sort(F.transform("tokens", lambda t: F.struct((~t.rlike("[0-9]")).alias("plain"), F.xxhash64(t).alias("h"), t.alias("t"))))
    n = F.size("tokens")
    return F.transform(F.slice(order, 1, n - F.ceil(n * likeness - 1e-9).cast("int") + 1), lambda x: x.t)


def _crossed(keys: Column, values: Column) -> Column:
    """Each key with each value, as keys."""
    return bind(values, lambda vs: F.flatten(F.transform(keys, lambda k: F.transform(vs, lambda v: F.xxhash64(k, v)))))


def _models() -> Column:
    return F.array_union("strong_models", "family_models")


def _bound() -> Column:
    """Whether a side has a brand and models: two such sides are vetoed unless they have both in common."""
    return F.col("brand_norm").isNotNull() & (F.size(_models()) > 0)


def _unless(keys: Column, has: Column, spread: bool) -> Column:
    """Keys that meet if the source or the target (with spread) isn't as ``has`` says: not both."""
    tag = lambda t: F.transform(keys, lambda k: F.xxhash64(k, F.lit(t)))
    return F.when(has, tag("any")).otherwise(F.concat(tag("any"), tag("has"))) if spread else F.when(has, tag("has")).otherwise(tag("any"))


def _of_a_kind(keys: Column, spread: bool) -> Column:
    """Keys that meet if the kinds are the same or one is missing."""
    tag = lambda t: F.transform(keys, lambda k: F.xxhash64(k, t))
    known, none, any_ = tag(F.col("kind")), tag(F.lit("none")), tag(F.lit("any"))
    return F.when(F.col("kind").isNull(), F.concat(none, any_) if spread else any_).otherwise(F.concat(known, any_) if spread else F.concat(known, none))


def block_keys(references: Column, spread: bool, threshold: float = THRESHOLD) -> Column:
    """64-bit keys of which a pair that can reach the threshold and isn't vetoed shares one; so do pairs of the same reference.

    Such a pair has a barcode, ASIN or model in common, or one of evidence_blocks() with, where it asks for a likeness of
    words, one of the first tokens.  Sizes are alike within an inch: with spread, they give the keys of the neighbouring
    whole inches too.  What has a brand and models on both sides meets by brand, model and kind alone.
    """
    near = lambda d: F.floor(F.col("screen_size_inch") + d).cast("string")
    sizes = F.filter(F.array(*[near(d) for d in ((-1, 0, 1) if spread else (0,))]), lambda z: z.isNotNull())
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    values = {"b": one("brand_norm"), "k": one("kind"), "z": sizes}
    key = lambda tag: lambda v: F.xxhash64(F.lit(tag), v)
    none = F.array().cast("array<bigint>")
    own = F.when(_bound(), F.transform(_models(), lambda m: F.xxhash64(F.lit("bm"), "brand_norm", m))).otherwise(none)
    every = [F.transform(c, key(t)) for t, c in (("e", F.col("eans")), ("a", F.col("asins")))] + [_of_a_kind(F.transform(_models(), key("m")), spread)]
    for evidence, likeness in evidence_blocks(threshold):
        parts = [values[e] for e in evidence] + ([_first_tokens(likeness)] if likeness else [])
        joined = F.transform(parts[0], key("".join(evidence)))
        for p in parts[1:]:
            joined = _crossed(joined, p)
        every.append(joined)
    return F.array_distinct(F.concat(F.transform(references, key("r")), _of_a_kind(own, spread), _unless(F.concat(*every), _bound(), spread)))


def _signals(side: str, extra: tuple) -> list:
    """A side's columns of a pair: signals, all its models in one array, its name's letters, and what else is asked for."""
    models, bag = _models().alias(f"{side}_models"), letters(F.col("name_norm")).alias(f"{side}_letters")
    return [*[F.col(c).alias(f"{side}_{c}") for c in [*SIGNALS, *extra]], models, bag]


#: Products of a class that go together, at most; those of larger classes are several rows.
MEMBERS = 256


def _references(df: DataFrame) -> Column:
    """The references of a row's products: of a class, or its own."""
    return F.col("references") if "references" in df.columns else F.array_compact(F.array("reference"))


def grouped(df: DataFrame, keys: list, member: Column) -> DataFrame:
    """Rows with equal keys as one: class (a number), keys, members (an array of at most MEMBERS; more make further rows)."""
    rows = df.select(F.xxhash64(*keys).alias("__h"), *keys, member.alias("__member"))
    place = F.row_number().over(Window.partitionBy("__h", *keys).orderBy(F.xxhash64("__member")))
    rows = rows.withColumn("__chunk", F.floor((place - 1) / MEMBERS))
    out = rows.groupBy("__h", *keys, "__chunk").agg(F.collect_list("__member").alias("members"))
    return stored(out.drop("__h", "__chunk").withColumn("class", F.monotonically_increasing_id()))


def expanded(pairs: DataFrame, *columns) -> DataFrame:
    """Pairs of classes (s_members, t_members) as pairs of members s and t with the columns; dealt anew, since few classes have many."""
    dealt = pairs.select("s_members", "t_members", *columns).repartition(F.xxhash64("s_members", "t_members"))
    names = dealt.columns[2:]
    return dealt.select(*names, F.explode("s_members").alias("s"), "t_members").select(*names, "s", F.explode("t_members").alias("t"))


def classes(products: DataFrame, ident: str, extra: tuple, by: tuple = ()) -> DataFrame:
    """Products with equal signals (and columns named in by) as one row: class, signals, members (id and extra), references.

    What pairs score is the same for all of a class, so it's found once and goes to the members in the end.
    """
    out = grouped(products, [*SIGNALS, *by], F.struct(F.col(ident).alias("id"), *[F.col(c).alias(c) for c in extra]))
    references = F.array_distinct(F.array_compact(F.col("members.reference"))) if "reference" in extra else F.array().cast("array<string>")
    return out.withColumn("references", references)


def _source_side(sources: DataFrame, source_id: str, threshold: float, extra: tuple = ("reference",)) -> DataFrame:
    refs = _references(sources)
    s = sources.select(F.col(source_id).alias("s_id"), *_signals("s", tuple(c for c in extra if c in sources.columns)), refs.alias("s_references"), block_keys(refs, False, threshold).alias("s_keys"))
    return s.withColumn("key", F.explode("s_keys"))


def _target_side(targets: DataFrame, target_id: str, extra: tuple, threshold: float) -> DataFrame:
    refs = _references(targets)
    t = targets.select(F.col(target_id).alias("t_id"), *_signals("t", extra), refs.alias("t_references"), block_keys(refs, True, threshold).alias("t_keys"))
    return t.withColumn("key", F.explode("t_keys"))


def _meet(s: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs that share a key, at the least of those that they share."""
    return s.join(t, "key").where(F.col("key") == F.array_min(F.array_intersect("s_keys", "t_keys"))).drop("key", "s_keys", "t_keys")


def candidates(sources: DataFrame, targets: DataFrame, source_id: str = "reference", target_id: str = "listing_id", extra: tuple = (), threshold: float = THRESHOLD) -> DataFrame:
    """Each pair that shares a block key once, with both sides' signals as s_* and t_*.

    One equi-join on exploded keys, whose large keys Spark splits; a pair that shares several is kept at the least of
    them, so that nothing is shuffled again to make pairs distinct or to fetch their columns.
    """
    return _meet(_source_side(sources, source_id, threshold), _target_side(targets, target_id, extra, threshold))


def write_matchable(targets: DataFrame, table: str, path: str, *, target_id: str = "listing_id", extra: tuple = ("reference", "retailer", "name"), by: tuple = (), threshold: float = THRESHOLD, buckets: int = 64) -> None:
    """Writes targets (with_signals() rows), a row for each class and block key, as a table that is matched against again and again.

    The table is bucketed and sorted by key, so that joins with it shuffle the sources alone, and cut by the columns
    named in by (such as visible and category), so that filters on those leave folders unread.
    """
    rows = _target_side(classes(targets, target_id, extra, by), "class", ("members", *by), threshold).withColumnsRenamed({f"t_{c}": c for c in by})
    out = rows.repartition(buckets, "key").write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "key").sortBy("key")
    (out.partitionBy(*by) if by else out).saveAsTable(table)


def match_stored(sources: DataFrame, stored_targets: DataFrame, *, threshold: float = THRESHOLD, source_id: str = "reference", extra: tuple = ("reference", "retailer", "name"), by: tuple = ()) -> DataFrame:
    """match() against a table of write_matchable() or rows of it, for the threshold that it was written for."""
    _checked(threshold)
    targets = stored_targets.withColumnsRenamed({c: f"t_{c}" for c in by})
    return _matched(_meet(_source_classes(sources, source_id, threshold, extra), targets), threshold, extra)


def _source_classes(sources: DataFrame, source_id: str, threshold: float, extra: tuple) -> DataFrame:
    return _source_side(classes(sources, source_id, ("reference",) if "reference" in extra else ()), "class", threshold, ("members",))


def pair_up(pairs: DataFrame, sources: DataFrame, targets: DataFrame, source_id: str = "reference", target_id: str = "listing_id", extra: tuple = ()) -> DataFrame:
    """Given pairs (s_id, t_id) with both sides' signals."""
    s = sources.select(F.col(source_id).alias("s_id"), *_signals("s", ("reference",)))
    t = targets.select(F.col(target_id).alias("t_id"), *_signals("t", extra))
    return pairs.join(s, "s_id").join(t, "t_id")


def match(sources: DataFrame, targets: DataFrame, *, threshold: float = THRESHOLD, source_id: str = "reference", target_id: str = "listing_id", extra: tuple = ("reference", "retailer", "name"), ratio: bool = True) -> DataFrame:
    """Matched pairs with score, method and reasons; all signals come from with_signals() and are computed once.

    Products with equal signals are matched once, as a class, and matches go to their members in the end.  Vetoed pairs
    go where they meet, before the ratio; so do pairs whose score at the highest ratio that their names'
    letters allow stays below the threshold, which loses nothing for thresholds up to 0.89.  Only what is left, and of
    its columns only those that go on, is dealt anew and reaches the Arrow function, once.
    Thresholds of LEAST or less need blocks that this join doesn't have and are refused.  The same reference on both
    sides scores 1 as direct_ref.  Without ``ratio`` names count as unlike, and built-in functions do it all.
    """
    _checked(threshold)
    t = _target_side(classes(targets, target_id, extra), "class", ("members",), threshold)
    return _matched(_meet(_source_classes(sources, source_id, threshold, extra), t), threshold, extra, ratio)


def _checked(threshold: float) -> None:
    if not LEAST < threshold:
        raise ValueError(f"blocking is lossless for thresholds over {LEAST} only")


def _matched(pairs: DataFrame, threshold: float, extra: tuple, ratio: bool = True) -> DataFrame:
    """Of pairs of classes the matched pairs of their members."""
    named = "reference" in extra
    pairs = once(flags(pairs), {"direct": overlap(F.col("s_references"), F.col("t_references")) if named else F.lit(False)})
    pairs = pairs.where(F.col("veto").isNull() | F.col("direct"))
    if threshold <= 0.89 or not ratio:
        bounded = scores(pairs, ratio_bound(F.col("s_letters"), F.col("t_letters")) if ratio else F.lit(0.0), threshold)
        pairs = bounded.where(F.col("matched") | F.col("direct")).select(*pairs.columns)
    # Dealt anew: what is left of the pairs may lie in a few tasks, and the ratio is what costs most.
    pairs = pairs.select("s_id", "t_id", "s_name_norm", "t_name_norm", *INPUTS, "s_members", "t_members", "direct").repartition(F.col("s_id"), F.col("t_id"))
    out = scores(pairs, sequence_ratio("s_name_norm", "t_name_norm") if ratio else F.lit(0.0), threshold).where(F.col("matched") | F.col("direct"))
    out = out.select("score", "method", "reasons", "matched", "direct", F.explode("s_members").alias("s"), "t_members")
    out = out.select("score", "method", "reasons", "matched", "direct", "s", F.explode("t_members").alias("t"))
    if named:
        direct = F.col("direct") & F.coalesce(F.col("s.reference") == F.col("t.reference"), F.lit(False))
        out = out.withColumn("direct", direct).where(F.col("matched") | F.col("direct"))
    direct = F.col("direct")
    return out.select(
        F.col("s.id").alias("s_id"),
        F.col("t.id").alias("t_id"),
        *[F.col(f"t.{c}").alias(f"t_{c}") for c in extra],
        F.when(direct, 1.0).otherwise(F.col("score")).alias("score"),
        F.when(direct, "direct_ref").otherwise(F.col("method")).alias("method"),
        F.when(direct, F.array(F.lit("direct_ref"))).otherwise(F.col("reasons")).alias("reasons"),
    )


def by_shop() -> list:
    """The order of a source's matches: the best score first, then retailer and name, nulls as empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.desc("score"), blank("t_retailer"), blank("t_name")]


def first_by(df: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def cap_per_retailer(df: DataFrame, *order, cap: int = 5, source: str = "s_id", retailer: str = "t_retailer") -> DataFrame:
    """Identifier matches all stay; of the others the first ``cap`` for each source and retailer."""
    always = F.col("method").isin(KEEP_ALWAYS)
    rank = F.row_number().over(Window.partitionBy(source, retailer, always).orderBy(*order))
    return df.withColumn("__rn", rank).where(always | (F.col("__rn") <= cap)).drop("__rn")


def top_k(df: DataFrame, k: int, keys: list, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def candidate_filter(targets: DataFrame, *, category=None, kinds=(), retailers=(), min_price=None, max_price=None, limit=None, order: str = "listing_id") -> DataFrame:
    """Hidden listings pass any category; a null kind or price passes; empty lists filter nothing; limit in id order."""
    df = targets
    if category is not None:
        df = df.where(~F.col("visible") | (F.col("category") == category))
    if kinds:
        df = df.where(F.col("kind").isNull() | F.col("kind").isin(list(kinds)))
    if retailers:
        df = df.where(F.col("retailer").isin(list(retailers)))
    if min_price is not None:
        df = df.where(F.col("price_eur").isNull() | (F.col("price_eur") >= min_price))
    if max_price is not None:
        df = df.where(F.col("price_eur").isNull() | (F.col("price_eur") <= max_price))
    return df.orderBy(order).limit(limit) if limit else df


def weighted_exact(sources: DataFrame, targets: DataFrame, weights: dict, threshold: float, source_id: str, target_id: str) -> DataFrame:
    """Pairs whose equal non-null fields weigh at least threshold.

    Rows with equal fields are one class, which is compared once.  Classes are blocked on the smallest sets of fields that
    reach the threshold together, so that a pair meets only if it passes; the other fields are added where it does.  A
    pair that shares several sets is kept at the least of its keys.
    """
    fields = list(weights)
    enough = [set(c) for n in range(1, len(fields) + 1) for c in combinations(fields, n) if sum(weights[f] for f in c) >= threshold - 1e-9]
    least = [c for c in enough if not any(d < c for d in enough)]
    text = lambda f: F.col(f).cast("string")

    def side(df, ident, name):
        names = {f: f"{name}_{f}" for f in fields}
        df = grouped(df.select(F.col(ident).alias("__id"), *[text(f).alias(names[f]) for f in fields]), list(names.values()), F.col("__id"))
        keys = [F.when(F.concat(*[names[f] for f in sorted(c)]).isNotNull(), F.xxhash64(F.lit("|".join(sorted(c))), *[names[f] for f in sorted(c)])) for c in least]
        df = df.select(F.col("members").alias(f"{name}_members"), *names.values(), F.array_compact(F.array(*keys)).alias(f"{name}_keys"))
        return df.withColumn("key", F.explode(f"{name}_keys"))

    if not least:
        raise ValueError("no fields together weigh as much as the threshold")
    pairs = side(sources, source_id, "s").join(side(targets, target_id, "t"), "key")
    pairs = pairs.where(F.col("key") == F.array_min(F.array_intersect("s_keys", "t_keys")))
    score = sum((F.when(F.col(f"s_{f}") == F.col(f"t_{f}"), float(w)).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    pairs = expanded(pairs.withColumn("score", score).where(F.col("score") >= threshold), "score")
    return pairs.select(F.col("s").alias("s_id"), F.col("t").alias("t_id"), "score")


def known_tokens(df: DataFrame, other: DataFrame, ident: str, tokens: str = "tokens") -> DataFrame:
    """df (a row for each ident) with ``known``, those of its tokens that rows of other have too, sorted."""
    there = other.select(F.explode(tokens).alias("__t")).distinct()
    known = df.select(ident, F.explode(tokens).alias("__t")).join(there, "__t", "left_semi").groupBy(ident).agg(F.array_sort(F.collect_list("__t")).alias("known"))
    return df.join(known, ident, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def jaccard_join(sources: DataFrame, targets: DataFrame, on: list, least: float, source_id: str, target_id: str, tokens: str = "tokens") -> DataFrame:
    """(s_id, t_id, jac): pairs with equal columns ``on`` whose tokens (distinct, not null) have a Jaccard likeness of ``least`` (over 0).

    A source's tokens that no target has only count; rows that are equal but for those are one class, compared once.
    """
    t = grouped(targets, [*on, tokens], F.col(target_id))
    s = stored(sources.select(F.col(source_id).alias("__id"), *on, tokens).withColumn("__row", F.monotonically_increasing_id()))
    s = grouped(known_tokens(s, t, "__row", tokens).withColumn("n", F.size(tokens)), [*on, "known", "n"], F.col("__id"))
    pairs = s.select(*on, "known", "n", F.col("members").alias("s_members")).join(t.select(*on, tokens, F.col("members").alias("t_members")), on)
    common = F.size(F.array_intersect("known", tokens))
    pairs = once(pairs, {"common": common}).withColumn("jac", F.when(F.col("common") > 0, F.col("common") / (F.col("n") + F.size(tokens) - F.col("common"))).otherwise(0.0))
    return expanded(pairs.where(F.col("jac") >= least), "jac").select(F.col("s").alias("s_id"), F.col("t").alias("t_id"), "jac")
