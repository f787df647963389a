"""Attributes for retrieval and search: sizes with units, resolution, product type, chunk text, site queries; replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuweave.functions import vocabulary as V
from skuweave.functions.signals import first_of, spec_values
from skuweave.functions.text import bind, clean_name, strip

# Product types of kinds (others: other), and fields and patterns in the order they are looked at.
PRODUCT_TYPES = {
    "air_fryer": "air_fryer",
    "coffee_machine": "coffee_machine",
    "descaler": "coffee_accessory",
    "freezer": "refrigerator",
    "fridge": "refrigerator",
    "grill": "kitchen_appliance",
    "hair_styler": "hair_care",
    "headphone": "headphone",
    "hob": "kitchen_appliance",
    "kettle": "kitchen_appliance",
    "microwave": "kitchen_appliance",
    "mixer": "kitchen_appliance",
    "toaster": "kitchen_appliance",
    "tv": "tv",
    "vacuum": "vacuum",
}
MODEL_FIELDS = ["Hersteller Artikelnummer", "Hersteller Modellnummer", "Herstellernummer", "Modellnummer", "Artikelnummer"]
BRAND_FIELDS = ["Marke", "Hersteller", "Brand"]
SIZE_FIELDS = ["Bildschirmdiagonale in cm, Zoll", "Bildschirmdiagonale (cm/Zoll)", "Größe", "Kabellänge", "Länge"]
SITE_MODEL_FIELDS = ["Hersteller Modellnummer", "Hersteller Artikelnummer", "Modellnummer"]
SITE_EAN_FIELDS = ["GTIN", "EAN-Code", "EAN", "GTIN/EAN"]
RESOLUTIONS = {"8K": r"\b8K\b", "4K": r"\b4K\b|\bUHD\b", "FHD": r"\bFull[\s\-]?HD\b|\bFHD\b|\b1080[pi]\b", "HD": r"\bHD[\s\-]?Ready\b|\b720[pi]\b"}
UNITS = {"Zoll": 'Zoll|"', "cm": r"cm\b", "mm": r"mm\b", "m": r"m\b", "L": r"(?:l|liter|litre)\b", "ml": r"ml\b", "kg": r"kg\b", "g": r"g\b", "W": r"w\b"}


def size_with_unit(text: Column) -> Column:
    """struct(size, unit) of the first unit, in the order of UNITS, that a number stands before; null if none."""

    def one(t):
        found = []
        for unit, pattern in UNITS.items():
            number = F.regexp_extract(t, rf"(?iu)(\d+(?:[.,]\d+)?)\s*(?:{pattern})", 1)
            found.append(F.when(number != "", F.struct(F.replace(number, F.lit(","), F.lit(".")).try_cast("double").alias("size"), F.lit(unit).alias("unit"))))
        return F.coalesce(*found)

    return bind(text, one)


def resolution(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike("(?i)" + p), F.lit(label)) for label, p in RESOLUTIONS.items()])


def product_type(kind: Column) -> Column:
    """The type of a kind; none or another kind: other."""
    types = F.create_map(*[F.lit(x) for pair in PRODUCT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(types, kind), F.lit("other"))


def filled(c: Column) -> Column:
    return F.when(strip(c) != "", strip(c))


def own_brand(products: DataFrame, specs: Column) -> Column:
    """The brand that retrieval goes by, upper case: a field of the specification or, under the same name in small letters,
    of the product; else the name's first word, if it is a known brand."""
    column = {c: F.col(c).cast("string") for c in products.columns}
    fields = [x for k in BRAND_FIELDS for x in (spec_values(specs, [k])[0], column.get(k.lower())) if x is not None]
    first = bind(F.rtrim(F.lower(F.get(F.split(strip(F.col("name")), r"\s+"), 0)), F.lit("®™")), lambda w: F.when(w.isin(V.ENRICHMENT_BRANDS), w))
    return F.upper(F.coalesce(first_of(fields, filled), first))


def enrich(products: DataFrame) -> DataFrame:
    """with_signals() rows with product_type, size, size_unit, model_number, resolution, own_brand and chunk, a text for retrieval."""
    specs = F.coalesce("specifications", F.create_map().cast("map<string,string>"))
    df = products.withColumn("__size", F.coalesce(size_with_unit(F.col("name")), first_of(spec_values(specs, SIZE_FIELDS), size_with_unit)))
    df = df.withColumns(
        {
            "product_type": product_type(F.col("kind")),
            "size": F.col("__size.size"),
            "size_unit": F.col("__size.unit"),
            "model_number": first_of(spec_values(specs, MODEL_FIELDS), filled),
            "own_brand": own_brand(products, specs),
            "resolution": resolution(F.concat_ws(" ", F.col("name"), F.map_values(specs))),
        }
    ).drop("__size")
    # The labels of a chunk's lines, in their order.
    label = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    tags = [
        label("Product type", "product_type"),
        label("Brand", "brand_norm"),
        F.concat(F.lit("Size: "), F.col("size").cast("string"), F.lit(" "), F.col("size_unit")),
        label("Resolution", "resolution"),
        label("Model number", "model_number"),
        F.array_join(F.transform(F.slice("strong_models", 1, 2), lambda m: F.concat(F.lit("Normalized model: "), m)), "\n"),
        label("Product kind", "kind"),
        label("Screen size inch", "screen_size_inch"),
    ]
    have = set(df.columns)
    meta = [F.when(F.col(c).cast("string") != "", label(name, c)) for c, name in (("category", "Category"), ("brand", "Brand"), ("ean", "EAN"), ("price_eur", "Price EUR"), ("retailer", "Retailer")) if c in have]
    lines = F.transform(F.filter(F.map_entries(specs), lambda e: e.value != ""), lambda e: F.concat(e.key, F.lit(": "), e.value))
    fields = F.when(F.size(lines) > 0, F.concat(F.lit("Specifications:\n"), F.array_join(lines, "\n")))
    first = F.when(F.col("name") != "", F.concat(F.lit("Product name: "), F.col("name"), F.lit(".")))
    every = F.filter(F.array(first, *tags, *meta, fields), lambda x: x.isNotNull() & (x != ""))
    return df.withColumn("chunk", F.array_join(every, "\n"))


def site_model(name: Column, specs: Column) -> Column:
    """The model to search for: a field that looks like one, else the longest such word of the name (ties: the first)."""
    blocked = r"(?i)^(?:\d+|\d+-?ML|\d+(?:W|V|HZ))$"
    valid = lambda t: F.when((F.length(t) >= 5) & ~t.rlike(blocked) & ~t.rlike(r"\s") & t.rlike("[A-Za-z]") & t.rlike("[0-9]"), t)
    words = F.array_compact(F.transform(F.regexp_extract_all(F.upper(clean_name(name)), F.lit(r"(\b[A-Z0-9]{2,}(?:[-.][A-Z0-9]{2,})*\b)"), F.lit(1)), valid))
    longest = F.array_max(F.transform(words, lambda t: F.length(t)))
    return F.coalesce(first_of(spec_values(specs, SITE_MODEL_FIELDS), lambda v: valid(strip(v))), F.get(F.filter(words, lambda t: F.length(t) == longest), 0))


def site_queries(site: str, name: Column, brand: Column, ean: Column, specs: Column) -> Column:
    """Searches on one site: by barcode, brand and model, model, name, each once whatever the case."""
    own = F.coalesce(filled(brand), F.get(F.split(strip(name), r"\s+"), 0))
    code = first_of([ean, *spec_values(specs, SITE_EAN_FIELDS)], filled)
    model = site_model(name, specs)
    meaningful = F.slice(F.filter(F.split(clean_name(name), r"\s+"), lambda w, i: (i > 0) & ~w.rlike(r"""(?i)^[\d"'%]+$|^(?:cm|zoll|inch|watt|hz|kg|liter|ltr|l)$""")), 1, 4)
    best = F.coalesce(code, F.when(model.isNotNull(), F.concat_ws(" ", own, model)), F.concat_ws(" ", own, F.array_join(meaningful, " ")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    terms = F.array_compact(F.array(code, F.when(model.isNotNull(), F.concat_ws(" ", own, model)), quoted(model), quoted(filled(clean_name(name))), best))
    every = F.transform(terms, lambda t: strip(F.regexp_replace(F.concat(F.lit(f"site:{site} "), t), r"\s+", " ")))
    seen = F.transform(every, F.lower)
    return F.filter(every, lambda t, i: F.array_position(seen, F.lower(t)) == i + 1)


def point_id(key: Column) -> Column:
    """md5 modulo 2**63 as a long: the last 16 hex digits with the top bit cleared, in two halves."""
    h = F.substring(F.md5(key), 17, 16)
    high, low = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high.bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(low)


def web_competitors(hits: DataFrame, retailer: str = "Web") -> DataFrame:
    """Search hits (title, url, price) as competitors, with references P_WS_ and eight digits of the address's md5."""
    return hits.select(
        F.concat(F.lit("P_WS_"), F.upper(F.substring(F.md5("url"), 1, 8))).alias("reference"),
        F.lit(retailer).alias("competitor_retailer"),
        F.col("title").alias("competitor_product_name"),
        F.col("url").alias("competitor_url"),
        F.col("price").alias("competitor_price"),
    )


REPLY = "thinking string, response string, filters map<string,string>, needs_search boolean"


def agent_reply(text: Column) -> Column:
    """A model's JSON reply without fences; an apology without a search where it can't be read."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?", ""), r"```$", ""))
    read = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), F.from_json(bare, REPLY))
    sorry = F.from_json(F.lit('{"thinking": "Failed to parse response", "response": "Please rephrase the question.", "filters": {}, "needs_search": false}'), REPLY)
    return F.coalesce(read, sorry)


def decisions(replies: DataFrame, text: str, known: str) -> DataFrame:
    """References that replies call a MATCH; lines must read REFERENCE: MATCH or NO_MATCH and name a known one."""
    line = F.explode(F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != ""))
    df = replies.select(F.col(known).alias("known"), line.alias("line"))
    ref = strip(F.regexp_replace(F.substring_index("line", ": ", 1), r"^\[|\]$", ""))
    word = F.regexp_replace(F.upper(strip(F.expr("substring(line, instr(line, ': ') + 2)"))), r"\.+$", "")
    good = F.col("line").contains(": ") & F.array_contains("known", ref) & word.isin("MATCH", "NO_MATCH")
    checked = F.when(good, word).otherwise(F.raise_error(F.concat(F.lit("unexpected line: "), F.col("line"))))
    return df.select(ref.alias("reference"), checked.alias("decision")).where("decision = 'MATCH'").select("reference")

