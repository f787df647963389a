"""The whole query: from a question to competitors, counts and an answer in words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.functions import vocabulary as V
from skuweave.functions.signals import listing_key
from skuweave.functions.text import normalize, tokens
from skuweave.operators import match as M
from skuweave.operators.score import sequence_ratio
from skuweave.operators.store import stored
from skuweave.operators.submission import exclude_shown, result_key
from skuweave.plans import questions as Q

#: Words that ask for every source, by substring; relevance that counts, and that rules a catalogue out.
ALL_WORDS = ["all", "every", "gesamte", "alle", "catalog", "katalog"]
RELEVANT, HOPELESS = 0.16, 0.05
#: Competitors kept in a follow-up before what was shown is left out.
MORE = 24


@dataclass
class Question:
    """What was said: text, earlier questions, and what was shown as rows (s_id, key) with the sources in order."""

    text: str
    history: list = field(default_factory=list)
    shown: DataFrame | None = None
    shown_sources: list = field(default_factory=list)


def _read(spark: SparkSession, texts: list) -> list:
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    return [r.asDict() for r in Q.read_questions(df, "q").orderBy("i").collect()]


def understand(spark: SparkSession, question: Question) -> dict:
    """The signals of the effective question, with effective (its text) and more (a follow-up for other results)."""
    said = [h.strip() for h in question.history if isinstance(h, str) and h.strip()]
    *earlier, now = _read(spark, [*said, (question.text or "").strip()])
    priced = lambda r: r["q_min"] is not None or r["q_max"] is not None
    hard = bool(now["q_refs"] or now["q_categories"] or now["q_kinds"] or now["q_retailers"] or priced(now))
    more = bool(question.shown_sources) and not hard and now["q_more"]
    text = now["q"]
    if more:
        full = [r for r in earlier if r["q_refs"] or r["q_categories"] or r["q_kinds"] or r["q_retailers"] or priced(r) or r["q_anchors"]]
        text = full[-1]["q"] if full else text
    elif text and not now["q_anchored"] and (now["q_retailers"] or priced(now) or len(now["q_tokens"]) <= 4):
        anchored = [r["q"] for r in earlier if r["q_anchored"]]
        text = f"{anchored[-1]} {text}" if anchored else text
    return _read(spark, [text])[0] | {"effective": text, "more": more}


def _words(values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _soft(df: DataFrame, test) -> DataFrame:
    """Rows that pass; all rows if none does."""
    some = df.where(test).limit(1).count() > 0
    return df.where(test) if some else df


def relevance(signals: dict):
    """0.62 of the question's words found in the source plus 0.38 of the likeness of its name."""
    text = F.concat_ws(" ", F.lower("reference"), F.col("name_norm"), normalize(F.col("brand")), normalize(F.col("category")))
    asked = _words(signals["q_tokens"])
    own = F.filter(F.array_distinct(tokens(text)), lambda t: ~t.isin(V.QUERY_STOPWORDS))
    overlap = F.size(F.array_intersect(own, asked)) / max(1, len(signals["q_tokens"]))
    named = F.when((F.col("reference") != "") & F.lit(signals["q_norm"]).contains(F.lower("reference")), 0.8).otherwise(0.0)
    return 0.62 * overlap + 0.38 * sequence_ratio(F.lit(signals["q_norm"]), F.col("name_norm")) + named


def select_sources(sources: DataFrame, signals: dict, max_sources: int) -> DataFrame:
    """Sources of with_signals() with their place: by reference, else by category, kind, words and relevance.

    References that survive the kind and the words are taken as they are.  The category and the words only filter if
    something is left; the kind filters in any case.  Words that ask for everything lift the limit.
    """
    fields = [normalize(F.col(c)) for c in ("reference", "name", "brand", "category")]
    anchors = signals["q_anchors"]
    anchored = F.lit(True)
    if anchors:
        hit = [f.contains(a) for f in fields for a in anchors]
        anchored = hit[0]
        for h in hit[1:]:
            anchored = anchored | h
    anchored = F.coalesce(anchored, F.lit(False))
    kind = F.col("kind").isin(signals["q_kinds"]) if signals["q_kinds"] else F.lit(True)
    kind = F.coalesce(kind, F.lit(False))
    ordered = lambda df, *by: df.withColumn("place", F.row_number().over(Window.orderBy(*by)))
    if signals["q_refs"]:
        named = sources.where(F.upper("reference").isin(signals["q_refs"]) & kind & anchored)
        if named.limit(1).count():
            return ordered(named, "reference")
    df = sources
    if signals["q_categories"]:
        df = _soft(df, normalize(F.col("category")).isin([_plain(c) for c in signals["q_categories"]]))
    df = _soft(df.where(kind), anchored)
    if any(w in signals["q_norm"] for w in ALL_WORDS):
        return df.withColumn("place", F.lit(0))  # as many as there are: no single-task numbering
    if not signals["q_norm"]:
        return ordered(df.orderBy("reference").limit(max_sources), "reference")
    scored = stored(df.withColumn("relevance", relevance(signals)))
    best = scored.orderBy(F.desc("relevance"), "reference").limit(max_sources)
    good = best.where(F.col("relevance") >= RELEVANT)
    if good.limit(1).count():
        best = good
    else:
        best = best.join(F.broadcast(scored.agg(F.max("relevance").alias("top"))), F.col("top") >= HOPELESS).drop("top")
    return ordered(best, F.desc("relevance"), "reference").drop("relevance")


def _plain(category: str) -> str:
    return " ".join("".join(c if c.isalnum() else " and " if c == "&" else " " for c in category.lower()).split())


def search(spark: SparkSession, question: Question, sources: DataFrame, targets: DataFrame, *, max_sources: int = 5, max_competitors: int = 12) -> tuple[DataFrame, dict]:
    """(competitors, counts): rows (source_reference, rank, reference, retailer, name, url, price_eur, visible, score, method).

    sources, targets: with_signals() rows; targets with listing_id, retailer, url, price_eur, category, visible.  Visible
    listings must share the source's category where both have one; duplicates go by reference (visible) or listing key.
    """
    signals = understand(spark, question)
    more = signals["more"]
    if more:
        wanted = spark.createDataFrame(list(enumerate(question.shown_sources)), "place int, reference string")
        last = wanted.groupBy("reference").agg(F.max("place").alias("place"))  # of repeats the last place counts
        chosen = sources.join(F.broadcast(last), "reference")
    else:
        chosen = select_sources(sources, signals, max_sources)
    # Counts are gathered while the rows that they are about are stored, not by jobs of their own.
    seen = {name: Observation() for name in ("chosen", "found", "top", "rest")}
    rows = F.count(F.lit(1)).alias("rows")
    chosen = stored(chosen.observe(seen["chosen"], rows))
    first = chosen.orderBy("place", "reference").select("category").first()
    found = M.candidate_filter(
        targets, category=first.category if first else None, kinds=signals["q_kinds"], retailers=signals["q_retailers"], min_price=signals["q_min"], max_price=signals["q_max"]
    )
    key = F.when(F.col("visible") & (F.col("reference") != ""), F.col("reference")).otherwise(listing_key(F.col("retailer"), F.col("url")))
    found = stored(found.withColumn("__key", key).observe(seen["found"], rows))
    if signals["q_kinds"]:
        words = [normalize_word(w) for k in signals["q_kinds"] for w in V.KIND_KEYWORDS.get(k, [])]
        named = lambda c: c.rlike("|".join(words))
        found = found.where(F.coalesce(F.col("kind").isin(signals["q_kinds"]), F.lit(False)) | named(F.col("name_norm")))
        fit = chosen.where(F.col("kind").isin(signals["q_kinds"]) | (F.col("kind").isNull() & named(F.col("name_norm"))))
    else:
        fit = chosen
    matched = M.match(fit, found, extra=("reference", "retailer", "name", "url", "price_eur", "visible", "category", "__key"))
    matched = matched.join(chosen.select(F.col("reference").alias("s_id"), F.col("category").alias("s_category")), "s_id")
    alike = normalize(F.col("s_category")) == normalize(F.col("t_category"))
    blank = (normalize(F.col("s_category")) == "") | (normalize(F.col("t_category")) == "")
    matched = matched.where(~F.col("t_visible") | blank | alike)
    one = M.first_by(matched, ["s_id", "t___key"], F.desc("score"), "t_id")
    top = M.top_k(one, max(max_competitors, MORE) if more else max_competitors, ["s_id"], F.desc("score"), "t_id")
    top = stored(top.withColumn("key", result_key(F.col("t_visible"), F.col("t_reference"), F.col("t_url"), F.col("t_id"))).observe(seen["top"], rows))
    rest = exclude_shown(top, question.shown) if question.shown is not None else top
    # The first link that is left to a source stands for it.
    own = F.row_number().over(Window.partitionBy("s_id").orderBy("rank", "t_id"))
    links = [F.count_if(F.col("__own") == 1).alias("matched"), F.count_if("t_visible").alias("visible"), F.count_if(~F.col("t_visible")).alias("hidden")]
    rest = stored(rest.withColumn("__own", own).observe(seen["rest"], *links))
    chosen_n, found_n, top_n = (seen[x].get["rows"] for x in ("chosen", "found", "top"))
    n = seen["rest"].get
    counts = {
        "query": question.text,
        "effective_query": signals["effective"],
        "selected_sources": chosen_n,
        "matched_sources": n["matched"],
        "total_links": n["visible"] + n["hidden"],
        "visible_links": n["visible"],
        "hidden_links": n["hidden"],
        "retailer_filter": signals["q_retailers"],
        "kind_filter": signals["q_kinds"],
        "anchor_tokens": signals["q_anchors"],
        "price_filter": {"min": signals["q_min"], "max": signals["q_max"]},
        "candidates_fetched": found_n,
        "follow_up_expand": more,
        "excluded_previous_links": top_n - n["visible"] - n["hidden"],
    }
    out = rest.select(
        F.col("s_id").alias("source_reference"), "rank", *[F.col(f"t_{c}").alias(c) for c in ("reference", "retailer", "name", "url", "price_eur", "visible")], "score", "method"
    )
    return out, counts


def normalize_word(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def answer(competitors: DataFrame, counts: dict, shown: int = 3, names: DataFrame | None = None) -> str:
    """A short text: what was found, and for each source its shops and the best competitors with shop and price.

    names: (reference, name) of the sources; where it has none, the reference stands.  Shops come in the order of rank.
    """
    if not counts["total_links"]:
        return "No further results." if counts["follow_up_expand"] else "No matching products were found."
    lines = [f"Found {counts['total_links']} listings for {counts['matched_sources']} of {counts['selected_sources']} products."]
    if counts["retailer_filter"]:
        lines.append("Retailers: " + ", ".join(counts["retailer_filter"]) + ".")
    low, high = counts["price_filter"]["min"], counts["price_filter"]["max"]
    if low is not None or high is not None:
        lines.append("Price: " + " ".join(x for x in (f"from {low:g}" if low is not None else "", f"up to {high:g}" if high is not None else "") if x) + ".")
    best = competitors.withColumn("__n", F.row_number().over(Window.partitionBy("source_reference").orderBy("rank")))
    shops = F.transform(F.array_sort(F.collect_list(F.struct("rank", "retailer"))), lambda x: x.retailer)
    per_source = best.groupBy("source_reference").agg(F.array_distinct(shops).alias("shops"))
    best = best.where(F.col("__n") <= shown).join(per_source, "source_reference").withColumn("source_name", F.col("source_reference"))
    if names is not None:
        own = names.select(F.col("reference").alias("source_reference"), F.col("name").alias("__name"))
        best = best.join(own, "source_reference", "left").withColumn("source_name", F.coalesce(F.when(F.col("__name") != "", F.col("__name")), F.col("source_reference")))
    last = None
    for r in best.orderBy("source_reference", "rank").limit(60).collect():
        if r.source_reference != last:
            lines.append(f"{r.source_name} ({', '.join(x for x in r.shops if x)}):")
            last = r.source_reference
        price = f" for {r.price_eur:.2f} EUR" if r.price_eur is not None else ""
        lines.append(f"- {r.name} at {r.retailer}{price}")
    return "\n".join(lines)
