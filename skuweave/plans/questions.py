"""Rule-based reading of shopping questions, as columns, and conversational follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.functions import vocabulary as V
from skuweave.functions.signals import words
from skuweave.functions.text import normalize, strip, tokens

NUMBER = r"^[0-9]+(?:[.,][0-9]+)?$"


def query_tokens(normalized: Column) -> Column:
    kept = F.filter(tokens(normalized), lambda t: (F.length(t) > 1) & ~t.isin(V.QUERY_STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def source_refs(text: Column) -> Column:
    """References P_ and eight letters or digits, upper case, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(\bP_[A-Z0-9]{8}\b)"), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))


def _labels(tests: list) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests]))))


def retailers(normalized: Column) -> Column:
    """By substring, so that a name inside another word counts."""
    return _labels([(label, normalized.contains(key)) for key, label in V.RETAILER_KEYWORDS.items()])


def price_bounds(normalized: Column) -> tuple[Column, Column]:
    """(min, max): after words for below and above; between sets both."""
    amount = r"([0-9]+(?:[.,][0-9]{1,2})?)"
    number = lambda pattern, k: F.replace(F.regexp_extract(normalized, pattern, k), F.lit(","), F.lit(".")).try_cast("double")
    below = number(rf"(?:under|below|unter|max|bis|<=)\s*{amount}", 1)
    above = number(rf"(?:over|above|mehr als|ab|>=)\s*{amount}", 1)
    between = rf"(?:between|zwischen)\s*{amount}\s*(?:and|und|-)\s*{amount}"
    return F.coalesce(number(between, 1), above), F.coalesce(number(between, 2), below)


def categories(tokens_: Column) -> Column:
    return _labels([(c, F.arrays_overlap(tokens_, words(keys))) for c, keys in V.CATEGORY_KEYWORDS.items()])


def kinds(normalized: Column) -> Column:
    """One word: as a token; several: as a substring."""
    tests = []
    for k, keys in V.KIND_KEYWORDS.items():
        single, several = [x for x in keys if " " not in x], [x for x in keys if " " in x]
        test = F.arrays_overlap(tokens(normalized), words(single))
        for x in several:
            test = test | normalized.contains(x)
        tests.append((k, test))
    return _labels(tests)


def anchors(tokens_: Column, kinds_: Column) -> Column:
    """Tokens that say what is looked for: no filler, retailer, number, or word of a kind that was recognised."""
    shops = sorted({w for key in V.RETAILER_KEYWORDS for w in key.split()})
    named = F.create_map(*[x for k, keys in V.KIND_KEYWORDS.items() for x in (F.lit(k), words(sorted({w for key in keys for w in key.split()})))])
    own = F.flatten(F.transform(kinds_, lambda k: F.element_at(named, k)))
    kept = F.filter(tokens_, lambda t: (F.length(t) >= 3) & ~t.isin([*V.NON_ANCHOR_TOKENS, *shops]) & ~t.rlike(NUMBER))
    return F.array_sort(F.array_except(kept, own))


def wants_more(normalized: Column) -> Column:
    """A follow-up that asks for other results."""
    phrase = F.lit(False)
    for p in V.EXPAND_PHRASES:
        phrase = phrase | normalized.contains(p)
    return phrase | F.arrays_overlap(tokens(normalized), words(V.EXPAND_TOKENS))


def read_questions(df: DataFrame, text: str) -> DataFrame:
    """df with q_norm, q_tokens, q_refs, q_retailers, q_min, q_max, q_categories, q_kinds, q_anchors, q_more, q_anchored.

    q_anchored: the question names a reference, category or kind, or any word that isn't about filtering.
    """
    df = df.withColumn("q_norm", normalize(F.col(text))).withColumn("q_tokens", query_tokens(F.col("q_norm")))
    low, high = price_bounds(F.col("q_norm"))
    df = df.withColumns(
        {
            "q_refs": source_refs(F.col(text)),
            "q_retailers": retailers(F.col("q_norm")),
            "q_min": low,
            "q_max": high,
            "q_categories": categories(F.col("q_tokens")),
            "q_kinds": kinds(F.col("q_norm")),
            "q_more": wants_more(F.col("q_norm")),
        }
    )
    df = df.withColumn("q_anchors", anchors(F.col("q_tokens"), F.col("q_kinds")))
    other = F.exists("q_tokens", lambda t: ~t.isin([*V.QUERY_STOPWORDS, *V.FILTER_TOKENS]) & ~t.rlike(NUMBER))
    named = (F.size("q_refs") > 0) | (F.size("q_categories") > 0) | (F.size("q_kinds") > 0)
    return df.withColumn("q_anchored", (strip(F.coalesce(F.col(text), F.lit(""))) != "") & (named | other))


def effective_questions(df: DataFrame, text: str, conversation: str, turn: str) -> DataFrame:
    """read_questions(df) with q_effective: a question that only filters is put after the last one that is anchored."""
    df = read_questions(df, text)
    current = strip(F.coalesce(F.col(text), F.lit("")))
    earlier = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("q_anchored"), current), ignorenulls=True).over(earlier)
    filters = (F.size("q_retailers") > 0) | F.col("q_min").isNotNull() | F.col("q_max").isNotNull() | (F.size("q_tokens") <= 4)
    follow = (current != "") & ~F.col("q_anchored") & filters & last.isNotNull()
    return df.withColumn("q_effective", F.when(follow, F.concat_ws(" ", last, current)).otherwise(current))


def query_text(kinds_: Column, brands: Column, categories_: Column, retailers_: Column, low: Column, high: Column, refs: Column, free: Column) -> Column:
    """Filters as a question, the reverse of reading one."""
    spaced = lambda a: F.array_join(F.transform(a, lambda k: F.replace(k, F.lit("_"), F.lit(" "))), " ")
    parts = [spaced(kinds_), F.array_join(brands, " "), F.array_join(categories_, " "), F.array_join(retailers_, " ")]
    parts += [F.when(high.isNotNull(), F.concat(F.lit("under "), high.cast("string"))), F.when(low.isNotNull(), F.concat(F.lit("over "), low.cast("string")))]
    parts += [F.array_join(refs, " "), free]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")
