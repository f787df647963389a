"""Identifiers and attributes of products, as columns over (name, brand, ean, asin, specifications)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuweave.functions import vocabulary as V
from skuweave.functions.text import bind, normalize, strip, strip_accents, tokens



def empty() -> Column:
    return F.array().cast("array<string>")


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_specs(specs: Column) -> Column:
    """Without empty values and internal keys."""
    inner = lambda k: F.lower(k).startswith("_") | F.lower(k).startswith("source_")
    kept = F.map_filter(specs, lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}") & ~inner(k))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def spec_values(specs: Column, keys: list) -> list:
    return [F.try_element_at(specs, F.lit(k)) for k in keys]


def first_of(values: list, f) -> Column:
    """The first result of f over the values that isn't null; f is planned once for all of them."""
    return F.get(F.array_compact(F.transform(F.array(*values), f)), 0)


def brand_value(c: Column) -> Column:
    """First word but company forms, upper case; null for retailers."""
    first = F.get(F.filter(tokens(normalize(c)), lambda t: ~t.isin(V.COMPANY_FORMS)), 0)
    return bind(first, lambda w: F.when(~w.isin(V.RETAILER_TOKENS), F.upper(w)))


def brand(name_norm: Column, own: Column, specs: Column) -> Column:
    known = bind(F.get(tokens(name_norm), 0), lambda w: F.when(w.isin(V.KNOWN_BRANDS), F.upper(w)))
    return F.coalesce(first_of([own, *spec_values(specs, V.BRAND_KEYS)], brand_value), known)


def numeric_id(c: Column, least: int = 8, most: int = 14) -> Column:
    return bind(F.regexp_replace(c, r"\D", ""), lambda d: F.when(F.length(d).between(least, most), d))


def distinct_sorted(values: list, f) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.array(*values), f))))


def eans(ean: Column, specs: Column) -> Column:
    return distinct_sorted([ean, *spec_values(specs, V.EAN_KEYS)], lambda v: numeric_id(v))


def asins(own: Column, specs: Column) -> Column:
    fit = lambda v: bind(F.upper(strip(v)), lambda u: F.when(u.rlike("^B[0-9A-Z]{9}$"), u))
    return distinct_sorted([own, *spec_values(specs, V.ASIN_KEYS)], fit)


def canonical_model(c: Column) -> Column:
    """Upper case letters and digits of a model number; null if it is short, blocked, a size, or lacks either."""
    text = F.regexp_replace(F.upper(strip_accents(c)), r"[\s/]+", "")
    text = F.replace(F.regexp_replace(text, "[^A-Z0-9.+-]", ""), F.lit("+"), F.lit("PLUS"))
    return bind(F.regexp_replace(text, "[^A-Z0-9]", ""), _proper_model)


def _proper_model(text: Column) -> Column:
    bad = text.rlike(r"^(?:\d+|\d{2,4}X\d{2,4}(?:X\d{1,4})?|\d+(?:ML|W|V|HZ))$") | ~text.rlike("[A-Z]") | ~text.rlike("[0-9]")
    return F.when((F.length(text) >= V.MODEL_MIN_LEN) & ~text.isin(V.MODEL_BLOCKLIST) & ~bad, text)


def is_generic_model(c: Column) -> Column:
    return c.isin(V.MODEL_BLOCKLIST) | c.startswith("DVB") | c.rlike("|".join(V.GENERIC_MODELS))


def family_variants(c: Column) -> Column:
    """The model, without a last letter, its short stem, and every letter with three or four digits; 5 characters at least."""
    cut = F.when((F.length(c) > V.MODEL_MIN_LEN) & c.rlike("[A-Z]$"), F.regexp_replace(c, "[A-Z]$", ""))
    stem = F.when(c.rlike(r"^[A-Z]{1,3}\d{3,4}[A-Z]?$"), F.regexp_replace(c, "[A-Z]$", ""))
    parts = F.regexp_extract_all(c, F.lit(r"([A-Z]\d{3,4})"), F.lit(1))
    every = F.concat(F.array_compact(F.array(c, cut, stem)), parts)
    return F.array_distinct(F.filter(every, lambda v: F.length(v) >= V.MODEL_MIN_LEN))


def _joined_windows(name: Column) -> Column:
    """Models split over two to five neighbouring words of the name.

    Words are looked at once each; windows then read what was found, since a pattern inside them would be matched again
    for every window that a word is in.
    """
    stop = [*V.MODEL_BLOCKLIST, *V.MODEL_JOIN_STOPWORDS, *[t.upper() for t in V.RETAILER_TOKENS]]
    found = F.transform(
        F.regexp_extract_all(name, F.lit("([A-Z0-9]+)"), F.lit(1)),
        lambda t: F.struct(t.alias("t"), t.rlike("^[A-Z]+$").alias("alpha"), t.rlike("^[0-9]+$").alias("number"), t.rlike("[0-9]").alias("digit"), t.rlike("[A-Z][0-9]|[0-9][A-Z]").alias("mixed"), t.isin(stop).alias("stop")),
    )

    def count(w, what):
        return F.size(F.filter(w, lambda x: x[what]))

    def fits(w):
        last = F.element_at(w, -1)["t"]
        long_alpha = F.exists(w, lambda x: x["alpha"] & (F.length(x["t"]) > 3) & ((x["t"] != last) | (F.length(x["t"]) > 6)))
        some = F.exists(w, lambda x: x["number"]) & F.exists(w, lambda x: x["alpha"])
        enough = F.exists(w, lambda x: x["mixed"]) | (count(w, "digit") >= 2) | (count(w, "alpha") >= 2)
        return (F.size(w) >= 2) & some & ~F.exists(w, lambda x: x["stop"]) & ~long_alpha & enough

    def windows(words_):
        at = lambda i: F.transform(F.array(*[F.lit(k) for k in range(2, 6)]), lambda k: F.slice(words_, i, k))
        every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words_)), at))
        return F.transform(F.filter(every, fits), lambda w: canonical_model(F.array_join(F.transform(w, lambda x: x["t"]), "")))

    # A window needs a word of digits alone; most names have none.
    some_number = name.rlike("(?<![A-Z0-9])[0-9]+(?![A-Z0-9])")
    return F.when(some_number, bind(found, lambda x: F.when(F.size(x) >= 2, windows(x)))).otherwise(empty())


def certain_models(upper: Column, specs: Column) -> Column:
    """Candidates from spec fields and the name's words."""
    raw = F.regexp_extract_all(upper, F.lit(r"(\b[A-Z0-9]{2,}(?:[.\-/][A-Z0-9]{1,})*\b)"), F.lit(1))
    every = F.concat(F.array(*spec_values(specs, V.MODEL_KEYS)), raw)
    return F.array_distinct(F.array_compact(F.transform(every, canonical_model)))


def joined_models(upper: Column) -> Column:
    """Candidates from neighbouring words of the name."""
    return F.array_distinct(F.array_compact(F.coalesce(_joined_windows(upper), empty())))


def name_tokens(normalized: Column) -> Column:
    useless = lambda t: (F.length(t) < 2) | t.isin([*V.NAME_STOPWORDS, *V.RETAILER_TOKENS]) | t.rlike("^[0-9]{1,3}$")
    return F.array_sort(F.array_distinct(F.filter(tokens(normalized), lambda t: ~useless(t))))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def _inch(c: Column) -> Column:
    return _number(F.regexp_extract(c, r'(?i)(\d{2,3}(?:[.,]\d+)?)\s*(?:"|zoll|inch)', 1))


def screen_inches(plain_name: Column, specs: Column) -> Column:
    """From the name, then the size fields; centimetres count if the field or text is about screens."""
    fields = [F.struct(F.lit("bildschirm" in k.lower()).alias("screen"), v.alias("text")) for k, v in zip(V.SIZE_KEYS, spec_values(specs, V.SIZE_KEYS), strict=True)]

    def one(x):
        cm = lambda t: _number(F.regexp_extract(t, r"(?i)(\d{2,3}(?:[.,]\d+)?)\s*cm", 1))
        return bind(strip_accents(x.text), lambda t: F.coalesce(_inch(t), F.when(x.screen | F.lower(t).contains("zoll"), F.round(cm(t) / 2.54, 1))))

    return F.coalesce(_inch(plain_name), first_of(fields, one))


def kind(text: Column) -> Column:
    """The first kind one of whose patterns the normalised text contains."""
    out = None
    for k, patterns in V.KIND_PATTERNS.items():
        test = text.rlike("|".join(patterns))
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out


def with_signals(products: DataFrame) -> DataFrame:
    """products with brand_norm, eans, asins, strong_models, family_models, name_norm, tokens, kind, screen_size_inch.

    Missing columns count as null.  All expressions are built in; steps are separate columns so that each is computed once.
    """
    have = set(products.columns)
    col = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    df = products.withColumn("__specs", clean_specs(col("specifications", "map<string,string>"))).withColumn("__plain", F.coalesce(strip_accents(col("name")), F.lit("")))
    df = df.withColumn("__upper", F.upper("__plain")).withColumn("name_norm", normalize(F.col("__plain")))
    df = df.withColumn("__certain", certain_models(F.col("__upper"), F.col("__specs"))).withColumn("__joined", joined_models(F.col("__upper")))
    df = df.withColumn("__all", F.concat("__certain", "__joined"))
    plain = lambda a: F.filter(a, lambda m: ~is_generic_model(m))
    family = F.array_union(F.flatten(F.transform(plain(F.col("__all")), family_variants)), F.filter("__all", is_generic_model))
    df = df.withColumn("strong_models", F.array_sort(plain(F.col("__certain")))).withColumn("__family", family)
    text = F.when(F.size("__specs") == 0, F.col("name_norm")).otherwise(normalize(F.concat_ws(" ", col("name"), F.map_values("__specs"))))
    return (
        df.withColumn("family_models", F.array_sort(F.array_except("__family", "strong_models")))
        .withColumn("brand_norm", brand(F.col("name_norm"), col("brand"), F.col("__specs")))
        .withColumn("eans", eans(col("ean"), F.col("__specs")))
        .withColumn("asins", asins(col("asin"), F.col("__specs")))
        .withColumn("tokens", name_tokens(F.col("name_norm")))
        .withColumn("kind", bind(text, kind))
        .withColumn("screen_size_inch", screen_inches(F.col("__plain"), F.col("__specs")))
        .drop("__specs", "__plain", "__upper", "__certain", "__joined", "__all", "__family")
    )


def listing_key(retailer: Column, url: Column) -> Column:
    """Over with_signals() rows: retailer and the best of URL, ASIN, EAN, model, name."""
    from skuweave.functions.text import canonical_url

    shop = F.when(normalize(retailer) == "", F.lit("unknown")).otherwise(normalize(retailer))
    first = lambda c: F.get(c, 0)
    best = F.coalesce(
        F.concat(F.lit("|url|"), canonical_url(url)),
        F.concat(F.lit("|asin|"), first("asins")),
        F.concat(F.lit("|ean|"), first("eans")),
        F.concat(F.lit("|model|"), first("strong_models")),
        F.concat(F.lit("|name|"), F.col("name_norm")),
    )
    return F.concat(shop, best)


def search_terms(max_terms: int = 6, proposed: Column | None = None) -> Column:
    """Over with_signals() rows: barcodes, ASINs, models and names to search for, without repeats whatever the case.

    proposed: an array of further terms, such as a model's lines, which come after these, without bullets before them.
    """
    b = F.initcap(F.lower(F.coalesce("brand_norm", F.lit(""))))
    name = strip(F.coalesce("name", F.lit("")))
    both = lambda x: F.concat(b, F.lit(" "), x)
    by_model = F.flatten(F.transform("strong_models", lambda m: F.when(b != "", F.array(both(m), m)).otherwise(F.array(m))))
    words_ = F.slice(F.filter(F.split(name, r"\s+"), lambda t: F.length(t) > 2), 1, 6)
    tail = F.array_compact(
        F.array(F.when((b != "") & (name != ""), both(name)), F.when(name != "", name), F.when((b != "") & (F.size(words_) > 0), both(F.array_join(F.slice(words_, 1, 4), " "))))
    )
    further = F.array().cast("array<string>") if proposed is None else F.coalesce(F.transform(proposed, lambda t: strip(F.ltrim(strip(t), F.lit("-•*→")))), F.array().cast("array<string>"))
    own = F.slice(_distinct_terms(F.concat("eans", "asins", by_model, tail)), 1, max_terms)
    return F.slice(_distinct_terms(F.concat(own, further)), 1, max_terms)


def _distinct_terms(terms: Column) -> Column:
    """Terms with single spaces, blank ones and repeats whatever the case left out."""
    every = F.filter(F.transform(terms, lambda t: strip(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    seen = F.transform(every, F.lower)
    return F.filter(every, lambda t, i: F.array_position(seen, F.lower(t)) == i + 1)
