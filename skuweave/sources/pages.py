"""Raw product pages: embedded JSON as a table of its nodes, and records that columns read from those nodes.

One Arrow function lists the nodes of a page's JSON texts; which of them is the product, what its fields, properties and
breadcrumbs are, and what comes before what, are columns over that list.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from skuweave.functions.text import bind, blank_to_null, clean_title, coerce_price, first_brand, html_title, make_ref, page_category, page_name, price_from_text, strip, url_host

LD_JSON = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
NEXT_DATA = r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
#: Variables that pages assign their data to; what follows the JSON in its script is left aside.
HYDRATION = r"(?is)window\.(?:__NUXT__|__INITIAL_STATE__|__APP_STATE__|__PRELOADED_STATE__|__STORE__|__DATA__)\s*=\s*(?=([\[{].*?)</script>)"

# Keys that fields are looked for under, in a product and anywhere in a page's data.
OFFER_PRICES = ["price", "lowPrice", "highPrice"]
PRODUCT_EANS = ["gtin13", "gtin12", "gtin8", "gtin", "ean", "isbn", "mpn"]
ANYWHERE = {
    "name": ["name", "title", "productName", "product_name", "displayName", "produktName", "bezeichnung"],
    "brand": ["brand", "brandName", "manufacturer", "marke", "hersteller", "vendorName", "maker"],
    "price": ["price", "salePrice", "currentPrice", "regularPrice", "finalPrice", "offerPrice", "preis", "verkaufspreis", "listPrice", "netPrice", "grossPrice"],
    "ean": ["ean", "gtin", "gtin13", "gtin12", "barcode", "ean13", "EAN", "EAN-Code", "GTIN", "gtin/ean", "europeanArticleNumber", "internationalArticleNumber"],
    "image": ["image", "imageUrl", "image_url", "thumbnail", "primaryImage", "mainImage", "coverImage", "defaultImage", "productImage", "imgUrl"],
    "category": ["category", "categoryName", "productCategory", "categoryPath", "breadcrumb", "kategorien"],
}
NOT_SPECIFICATIONS = ["@type", "@context", "@id", "image", "offers", "brand", "name", "description", "url", "@graph"]
CONTAINERS = ["attributes", "specs", "specifications", "technicalDetails", "properties", "productDetails", "technicalSpecs", "featuresList", "details"]
LOOSE_FIELDS = ["ean", "gtin", "brand", "model", "sku", "mpn", "weight", "color", "colour", "dimensions"]
IMAGE_KEYS = ["url", "src", "contentUrl", "originalSrc"]
LISTED_IMAGE_KEYS = ["url", "contentUrl", "src"]
LABELS, VALUES = ["name", "label", "key", "attribute"], ["value", "val", "data"]
DESCRIPTION_CHARS = 800


def _filled(v) -> bool:
    return v not in (None, "", [], {})


def _nodes(data):
    """Every value that search looks at, in its order: an object's own values first, then what is below, left to right.

    Kept on a stack of its own, so no depth of nesting is too deep; yields (key, value), key null for objects.
    """
    stack = [data]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield from x.items()
            stack += reversed(x.values())
        elif isinstance(x, list):
            stack += reversed(x)


def _deep(data, keys):
    """The first filled value of any of the keys (lower case), whatever their case; among an object's own in its order."""
    return next((v for k, v in _nodes(data) if k.lower() in keys and _filled(v)), None)


def _below(data, keys) -> list:
    """All filled values of the keys: an object's entry, then what is inside it, before the next entry."""
    out, stack = [], [(None, data)]
    while stack:
        key, x = stack.pop()
        if key is not None and key.lower() in keys and _filled(x):
            out.append(x)
        if isinstance(x, dict):
            stack += reversed(x.items())
        elif isinstance(x, list):
            stack += [(None, y) for y in reversed(x)]
    return out


def _as_text(v) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def deep_get(*keys: str):
    """An Arrow function: the first value of any of the keys anywhere in a JSON text, as text; null if there is none."""
    keys = {k.lower() for k in keys}

    @F.pandas_udf(StringType())
    def get(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _as_text(_deep(_loaded(t), keys)))

    return get


def deep_collect(*keys: str):
    """An Arrow function: all values of any of the keys in a JSON text, as texts."""
    keys = {k.lower() for k in keys}

    @F.pandas_udf(ArrayType(StringType()))
    def collect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_as_text(v) for v in _below(_loaded(t), keys)])

    return collect


def field(column: str, path: str) -> Column:
    """A dotted path in a JSON text column: each step a key, as far as objects go; null beyond."""
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path.split("."))
    return F.get_json_object(F.col(column), "$" + steps)


def _loaded(text, whole: bool = True):
    """The JSON value of a text, or, unless it has to be the whole text, the one it starts with; None if there is none."""
    try:
        if not text:
            return None
        return json.loads(text) if whole else json.JSONDecoder().raw_decode(text.lstrip())[0]
    except (ValueError, RecursionError):
        return None


#: A value in a page's JSON.  at: its number, in the order in which search comes by (an object's own values before what is
#: below them); of, via: the object that holds it and the key of it that leads here (of: -1 for what no object holds);
#: deep: lists in between; kind: o, l, s, n, b or null; text: its text, of objects and lists only where a value may be one.
NODE = ArrayType(
    StructType(
        [StructField("blob", IntegerType()), StructField("ld", BooleanType()), StructField("at", IntegerType()), StructField("of", IntegerType()), StructField("via", StringType())]
        + [StructField("key", StringType()), StructField("deep", IntegerType()), StructField("kind", StringType()), StructField("filled", BooleanType()), StructField("text", StringType())]
    )
)
_KINDS = {dict: "o", list: "l", str: "s", int: "n", float: "n", bool: "b", type(None): None}
_WHOLE = {k.lower() for k in [*LOOSE_FIELDS, *LABELS, *VALUES]}


def _listed(blob: int, ld: bool, data, out: list) -> None:
    def add(v, of, via, key, deep):
        kind = _KINDS[type(v)]
        text = _as_text(v) if kind not in ("o", "l") or key is not None and key.lower() in _WHOLE else None
        out.append((blob, ld, len(out), of, via, key, deep, kind, _filled(v), text))
        return len(out) - 1

    stack = [(data, None, -1, None, 0)]  # value, its number (null: not listed yet), and where it is
    while stack:
        v, at, of, via, deep = stack.pop()
        at = add(v, of, via, None, deep) if at is None else at
        if isinstance(v, dict):
            stack += reversed([(x, add(x, at, k, k, 0), at, k, 0) for k, x in v.items()])
        elif isinstance(v, list):
            stack += [(x, None, of, via, deep + 1) for x in reversed(v)]


@F.pandas_udf(NODE)
def page_nodes(ld: pd.Series, data: pd.Series) -> pd.Series:
    """All nodes of a page's schema.org texts (each JSON as a whole), then of its data texts (JSON at their start)."""
    rows = []
    for texts in zip(ld, data, strict=True):
        out, blob = [], 0
        for k, part in enumerate(texts):
            for value in (_loaded(t, whole=k == 0) for t in (part if part is not None else [])):
                if _filled(value):
                    _listed(blob, k == 0, value, out)
                    blob += 1
        rows.append(out)
    return pd.Series(rows)


def _lower(keys) -> list:
    return sorted({k.lower() for k in keys})


def _first(c: Column) -> Column:
    """The first element of an array that isn't null."""
    return F.get(F.array_compact(c), 0)


def _line(n: Column) -> Column:
    """A text node's text without white space around it, if any is left."""
    return F.when(n.kind == "s", blank_to_null(strip(n.text)))


def _held(nodes: Column, of: Column, key: str | Column) -> Column:
    """An object's own value under a key; null if it has none."""
    return F.get(F.filter(nodes, lambda x: (x.of == of) & (x.key == key)), 0)


def _held_any(nodes: Column, of: Column, keys: list) -> Column:
    """An object's own values under the keys, in the order of the keys."""
    return F.transform(F.lit(keys), lambda k: _held(nodes, of, k))


def _items(nodes: Column, of: Column, via: str) -> Column:
    """The elements of the list that an object has under a key."""
    return F.filter(nodes, lambda x: (x.of == of) & (x.via == via) & (x.deep == 1) & x.key.isNull())


def _truthy(n: Column) -> Column:
    return n.filled & ~F.coalesce((n.kind == "b") & (n.text == "false"), F.lit(False)) & ~F.coalesce((n.kind == "n") & (n.text.try_cast("double") == 0), F.lit(False))


def _scalar(n: Column) -> Column:
    return F.coalesce(n.kind.isin("s", "n", "b"), F.lit(False))


def _digits(c: Column) -> Column:
    return bind(strip(c), lambda t: F.when(t.rlike(r"^\d{8,}$"), t))


def _address(c: Column) -> Column:
    return F.when(c.startswith("http"), c)


def _image(nodes: Column, n: Column, keys: list) -> Column:
    """The address that an image is: a text, an object's under one of the keys, or that of a list's first element."""
    text = lambda x: F.when(x.kind == "s", _address(x.text))
    first = F.get(_items(nodes, n.of, n.via), 0)
    inside = lambda x, ks: _first(F.transform(_held_any(nodes, x["at"], ks), text))
    return F.when(n.kind == "s", text(n)).when(n.kind == "o", inside(n, keys)).when(n.kind == "l", bind(first, lambda x: F.coalesce(text(x), inside(x, LISTED_IMAGE_KEYS))))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), value.cast("string").alias("value"))


_PAIRS = "array<struct<key:string,value:string>>"


def _with_nodes(df: DataFrame, nodes: Column) -> DataFrame:
    """df with the page's nodes and what several fields go by: the product, its own nodes, breadcrumbs, nodes by field."""
    n, none = F.col("__n"), F.array().cast(NODE)
    df = df.withColumn("__n", nodes)
    fields = _lower([k for keys in ANYWHERE.values() for k in keys])
    held = _lower([*CONTAINERS, *LOOSE_FIELDS])
    df = df.select(
        "*",
        F.filter(n, lambda x: x.ld & (x.of == -1) & (x.kind == "o")).alias("__blocks"),
        F.filter(n, lambda x: x.filled & F.lower(x.key).isin(fields)).alias("__hits"),
        F.filter(n, lambda x: ~x.ld & x.filled & F.lower(x.key).isin(held)).alias("__data"),
        F.filter(n, lambda x: (x.via == "@type") & (x.deep <= 1) & (x.kind == "s")).alias("__types"),
    )
    # A block comes before what is in its graph, and that before the next block.
    graph = lambda b: F.concat(F.array(b), F.filter(n, lambda x: (x.of == b["at"]) & (x.via == "@graph") & (x.deep == 1) & (x.kind == "o")))
    typed = lambda x, fits: F.exists("__types", lambda t: (t.of == x["at"]) & fits(t))
    is_product = lambda x: typed(x, lambda t: F.lower(t.text).contains("product"))
    df = df.withColumn("__product", F.get(F.filter(F.flatten(F.transform("__blocks", graph)), is_product), 0))
    crumbs = F.filter("__blocks", lambda b: typed(b, lambda t: (t.deep == 0) & (t.text == "BreadcrumbList")))

    def trail(b: Column, linked: bool) -> Column:
        name = lambda of: bind(_held(n, of, "name"), lambda x: F.when(_truthy(x) & _scalar(x), strip(x.text)))
        named = lambda x: F.coalesce(name(x["at"]), name(_held(n, x["at"], "item")["at"])) if linked else name(x["at"])
        return F.array_join(F.array_compact(F.transform(F.filter(_items(n, b["at"], "itemListElement"), lambda x: x.kind == "o"), named)), " > ")

    trails = lambda linked: F.filter(F.transform(crumbs, lambda b: trail(b, linked)), lambda t: t != "")
    own = F.filter(n, lambda x: x.of == F.col("__product")["at"])
    return df.withColumn("__own", F.coalesce(own, none)).withColumn("__crumbs", trails(False)).withColumn("__linked", trails(True)).drop("__blocks", "__types")


def _found(field: str, fits) -> Column:
    """The first value under a field's keys in each text of the page, made fit; the first that fits."""
    keys = _lower(ANYWHERE[field])
    hits = F.filter("__hits", lambda x: F.lower(x.key).isin(keys))
    firsts = bind(hits, lambda h: F.filter(h, lambda x, i: (i == 0) | (F.get(h, i - 1).blob != x.blob)))
    return F.transform(firsts, fits)


def _fields() -> dict:
    """Name, brand, ean, image and category of a page with its nodes, as columns, and its prices, in order, as an array."""
    n, product = F.col("__n"), F.col("__product")
    own = lambda key: F.get(F.filter("__own", lambda x: x.key == key), 0)
    named = lambda x: F.when(x.kind == "o", bind(_held(n, x["at"], "name"), _line)).otherwise(_line(x))
    longer = lambda x: bind(_line(x), lambda t: F.when(F.length(t) > 1, t))
    last = lambda x: F.try_element_at(_items(n, x.of, x.via), F.lit(-1))

    def category(x: Column) -> Column:
        held = lambda e: bind(F.get(F.filter(_held_any(n, e["at"], ["name", "item", "title"]), _truthy), 0), _line)
        return F.when(x.kind == "l", bind(last(x), lambda e: F.when(e.kind == "o", held(e)).otherwise(_line(e)))).otherwise(_line(x))

    own_category = bind(own("category"), lambda x: F.when(x.kind == "l", bind(last(x), lambda e: F.when(_scalar(e), blank_to_null(strip(e.text))))).otherwise(_line(x)))
    listed = F.get(_items(n, product["at"], "offers"), 0)
    offer = bind(own("offers"), lambda x: F.when(x.kind == "o", x["at"]).when(x.kind == "l", F.when(listed.kind == "o", listed["at"])))
    scalar = lambda x: F.when(_scalar(x), x.text)
    return {
        "name": F.coalesce(_line(own("name")), _first(_found("name", longer))),
        "brand": F.coalesce(bind(own("brand"), named), _first(_found("brand", named))),
        "ean": F.coalesce(_first(F.transform(F.lit(PRODUCT_EANS), lambda k: bind(own(k), lambda x: F.when(x.kind == "s", _digits(x.text))))), _first(_found("ean", lambda x: F.when(_scalar(x), _digits(x.text))))),
        "image": F.coalesce(bind(own("image"), lambda x: F.when(x.kind != "o", _image(n, x, IMAGE_KEYS))), _first(_found("image", lambda x: _image(n, x, IMAGE_KEYS)))),
        "category": F.coalesce(own_category, F.get("__linked", 0), _first(_found("category", category))),
        "prices": F.array_compact(F.concat(bind(offer, lambda o: F.transform(_held_any(n, o, OFFER_PRICES), scalar)), _found("price", scalar))),
    }


def _specifications() -> Column:
    """Attributes of a page with its nodes, as a map: where a key comes twice, the first of these counts.

    Breadcrumbs (the last), the description, the product's properties (the last of a name), its plain values and named
    objects; then from each data text its containers, in their order, and loose fields.  Null if there are none.
    """
    n = F.col("__n")
    plain = F.filter("__own", lambda x: x.key.isNotNull() & ~x.key.isin(NOT_SPECIFICATIONS))
    plain = F.transform(plain, lambda x: _pair(x.key, F.when(_scalar(x), x.text).when(x.kind == "o", _held(n, x["at"], "name").text)))
    text_of = lambda x, keys: _first(F.transform(F.filter(_held_any(n, x["at"], keys), _truthy), lambda y: y.text))
    items = F.filter("__own", lambda x: (x.via == "additionalProperty") & (x.deep == 1) & (x.kind == "o"))
    extra = F.transform(items, lambda x: _pair(text_of(x, ["name", "propertyID"]), F.coalesce(_held(n, x["at"], "value").text, _held(n, x["at"], "unitText").text)))
    about = bind(F.get(F.filter("__own", lambda x: x.key == "description"), 0), lambda x: F.when((x.kind == "s") & x.filled, F.substring(x.text, 1, DESCRIPTION_CHARS)))
    first = F.concat(F.array(_pair(F.lit("breadcrumb"), F.try_element_at("__crumbs", F.lit(-1))), _pair(F.lit("description"), about)), F.reverse(extra), plain)

    def of_blob(blob: Column) -> Column:
        first_under = lambda key: F.get(F.filter("__data", lambda x: (x.blob == blob) & (F.lower(x.key) == F.lower(key))), 0)
        entries = lambda c: F.transform(F.filter(n, lambda x: (x.of == c["at"]) & _scalar(x) & (x.key != "")), lambda x: _pair(x.key, x.text))
        # Of several names for a value the first that says something, else the last, whatever it says.
        value = lambda x: F.coalesce(text_of(x, VALUES), _held(n, x["at"], VALUES[-1]).text)
        rows = lambda c: F.transform(F.filter(_items(n, c.of, c.via), lambda x: x.kind == "o"), lambda x: _pair(text_of(x, LABELS), value(x)))
        pairs = lambda c: F.coalesce(F.when(c.kind == "o", entries(c)).when(c.kind == "l", rows(c)), F.array().cast(_PAIRS))
        held = F.flatten(F.transform(F.lit(CONTAINERS), lambda k: bind(first_under(k), pairs)))
        return F.concat(held, F.transform(F.lit(LOOSE_FIELDS), lambda k: _pair(k, first_under(k).text)))

    blobs = F.array_distinct(F.transform("__data", lambda x: x.blob))
    every = F.concat(first, F.flatten(F.transform(blobs, of_blob)))
    every = F.filter(every, lambda e: e.key.isNotNull() & e.value.isNotNull())
    once = bind(every, lambda es: bind(F.transform(es, lambda e: e.key), lambda ks: F.filter(es, lambda e, i: F.array_position(ks, e.key) == i + 1)))
    return F.when(F.size(every) > 0, F.map_from_entries(once))


#: What a scrape knew before it read a page; all of it may be missing.
PROVENANCE = {"error": "string", "retailer": "string", "reference": "string", "source_name": "string", "source_brand": "string", "search_result": "struct<title:string,description:string,extra_snippets:array<string>,thumbnail:string,image:string,image_url:string>"}


def parse_pages(pages: DataFrame, *, url: str = "url", html: str = "html", ld: str | None = None, data: str | None = None) -> DataFrame:
    """A record per page with what is known of it; useful: any field beside category and address was found.

    The schema.org product comes first, then the page's data, its title, what the search said of it (search_result), the
    source's brand (source_brand, source_name) and the address.  ld, data: columns with arrays of JSON texts, for pages
    that were taken apart before; else both are found in the html.  Columns that pages lacks count as null; JSON that
    can't be read counts as none.  Null html and addresses give rows without fields.
    """
    have = {f.name for f in pages.schema}
    known = lambda c: F.col(c) if c in have else F.lit(None).cast(PROVENANCE[c])
    texts = lambda *patterns: F.concat(*[F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(p), F.lit(1)) for p in patterns])
    nodes = page_nodes(F.col(ld) if ld else texts(LD_JSON), F.col(data) if data else texts(NEXT_DATA, HYDRATION))
    search = known("search_result")
    title = clean_title(html_title(F.col(html))) if html in have else F.lit(None).cast("string")
    df = _with_nodes(pages, nodes)
    df = df.select("*", F.struct(*[c.alias(f) for f, c in _fields().items()], _specifications().alias("specifications")).alias("p"))
    df = df.drop("__n", "__own", "__hits", "__data", "__product", "__crumbs", "__linked").withColumn("title", title).withColumn("__found", clean_title(search["title"]))
    df = df.withColumn("__name", page_name(F.col(url)))
    snippets = F.concat(F.array(search["description"], search["title"]), F.coalesce(search["extra_snippets"], F.array().cast("array<string>")))
    price = F.coalesce(_first(F.transform("p.prices", coerce_price)), _first(F.transform(snippets, price_from_text)))
    own = F.coalesce(F.when(F.trim(known("source_brand")) != "", F.trim(known("source_brand"))), first_brand(known("source_name")))
    thumb = _first(F.transform(F.array(search["thumbnail"], search["image"], search["image_url"]), lambda u: F.when(u.startswith("http"), u)))
    out = df.select(
        *[c for c in pages.columns if c not in (html, ld, data, "name", "brand", "category", "reference", "retailer", "error", "search_result", "source_name", "source_brand")],
        F.coalesce(F.when(known("reference") != "", known("reference")), make_ref(F.coalesce(F.col(url), F.lit("")))).alias("reference"),
        known("retailer").alias("retailer"),
        F.coalesce("p.name", "title", "__found", "__name").alias("name"),
        F.coalesce(F.col("p.brand"), own, first_brand(F.col("__found")), first_brand(F.col("__name"))).alias("brand"),
        F.col("p.ean").alias("ean"),
        price.alias("price_eur"),
        F.coalesce("p.image", thumb).alias("image_url"),
        F.coalesce(F.col("p.category"), page_category(F.col(url))).alias("category"),
        F.col("p.specifications").alias("specifications"),
        url_host(F.col(url)).alias("host"),
        (F.coalesce(known("error"), F.lit("")) != "").alias("failed"),
    )
    any_ = F.coalesce("ean", "name", "brand", "image_url").isNotNull() | F.col("specifications").isNotNull() | F.col("price_eur").isNotNull()
    return out.withColumn("useful", any_)


def kept_pages(records: DataFrame) -> DataFrame:
    """Records to go on with: pages that were read and said anything."""
    return records.where("not failed and useful").drop("failed", "useful")


def page_counts(records: DataFrame) -> DataFrame:
    """One row: kept, dropped_errors (the page wasn't read), dropped_empty (it said nothing)."""
    return records.agg(
        F.count_if(~F.col("failed") & F.col("useful")).alias("kept"), F.count_if("failed").alias("dropped_errors"), F.count_if(~F.col("failed") & ~F.col("useful")).alias("dropped_empty")
    )


SCRAPED = (
    "url STRING, reference STRING, retailer STRING, error STRING, page_title STRING, source_name STRING, source_brand STRING, search_result "
    + PROVENANCE["search_result"]
    + ", ld_json ARRAY<STRING>, next_data STRING, hydration_data ARRAY<STRUCT<data:STRING>>"
)


def read_scraped(spark: SparkSession, paths: list) -> DataFrame:
    """Entries of scraped JSON files, those that exist, as pages with ld and data texts for parse_pages()."""
    out = None
    for path in paths:
        try:
            df = spark.read.schema(SCRAPED).option("multiLine", True).json(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = df if out is None else out.unionByName(df)
    out = spark.createDataFrame([], SCRAPED) if out is None else out
    data = F.array_compact(F.concat(F.array("next_data"), F.coalesce(F.transform("hydration_data", lambda h: h["data"]), F.array().cast("array<string>"))))
    html = F.concat(F.lit("<title>"), F.coalesce("page_title", F.lit("")), F.lit("</title>"))
    return out.withColumn("ld", F.coalesce("ld_json", F.array().cast("array<string>"))).withColumn("data", data).withColumn("html", html).drop("ld_json", "next_data", "hydration_data", "page_title")
