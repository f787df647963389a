"""Product sources and sinks: JSON files, validation, keyed upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.functions.signals import listing_key, with_signals
from skuweave.functions.text import canonical_url
from skuweave.operators.store import stored

PRODUCT = "reference STRING, name STRING, brand STRING, ean STRING, category STRING, image_url STRING, price_eur DOUBLE, specifications MAP<STRING,STRING>"
TARGET = PRODUCT + ", retailer STRING, url STRING"


def read_products(spark: SparkSession, path: str, schema: str = PRODUCT) -> DataFrame:
    """Rows of JSON array files, with _file; a missing path: no rows."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).json(path)
        return df.withColumn("_file", F.col("_metadata.file_name"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", _file STRING")


def product_rows(df: DataFrame) -> DataFrame:
    """Rows with a reference and a name that aren't a submission's (these have competitors or a source's reference)."""
    for c in ("competitors", "source_reference"):
        if c in df.columns:
            df = df.where(F.col(c).isNull())
    return df.where((F.coalesce("reference", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))


def validate_upload(df: DataFrame) -> DataFrame:
    """One row: rows, missing (without reference or name), valid (some rows, none missing)."""
    bad = (F.coalesce("reference", F.lit("")) == "") | (F.coalesce("name", F.lit("")) == "")
    out = df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("missing"))
    return out.withColumn("valid", (F.col("rows") > 0) & (F.col("missing") == 0))


def first_wins(df: DataFrame, keys: list, *order) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert(current: DataFrame, new: DataFrame, keys: list) -> DataFrame:
    """current with new's rows in place of those of the same key; new must have a row per key (first_wins() before)."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_stamped(current: DataFrame, new: DataFrame, keys: list, now) -> DataFrame:
    """upsert() with updated_at: ``now`` for rows that were there before and are replaced, null for new ones, else as it was."""
    before = current if "updated_at" in current.columns else current.withColumn("updated_at", F.lit(None).cast("timestamp"))
    known = current.select(*keys, F.lit(True).alias("__known"))
    stamp = F.when(F.col("__known"), F.lit(now).cast("timestamp"))
    return upsert(before, new.drop("updated_at").join(known, keys, "left").withColumn("updated_at", stamp).drop("__known"), keys)


def upsert_targets(current: DataFrame, products: DataFrame, visible: bool, now, also: tuple = ()) -> DataFrame:
    """current, prepared targets, with the products' rows in place of those of the same reference and retailer (and columns named in also)."""
    return upsert_stamped(current, prepare_targets(products, visible, also), ["reference", "retailer", *also], now)


def read_seed(spark: SparkSession, pattern: str, data_dir: str, output_dir: str, schema: str = PRODUCT) -> DataFrame:
    """Rows of all files of a name pattern in both folders, with _file and category (from the file's name where a row has none).

    A file of output_dir stands in for one of the same name in data_dir.
    """
    new, old = (product_rows(read_products(spark, f"{d.rstrip('/')}/{pattern}", schema)) for d in (output_dir, data_dir))
    both = new.unionByName(old.join(new.select("_file").distinct(), "_file", "left_anti"))
    named = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise(category_from_file(F.col("_file")))
    return both.withColumn("category", named)


def prepare_targets(df: DataFrame, visible: bool, also: tuple = ()) -> DataFrame:
    """Target rows with signals, canonical_url, visible and listing_key, one per reference and retailer.

    also: columns that tell rows apart beside these, where references are short hashes that several listings may share.
    """
    df = with_signals(product_rows(df)).withColumn("canonical_url", canonical_url(F.col("url"))).withColumn("visible", F.lit(visible))
    df = df.withColumn("listing_key", listing_key(F.col("retailer"), F.col("url")))
    return first_wins(df, ["reference", "retailer", *also], "name", "url")


def category_from_file(name):
    """tv_&_audio from source_products_tv_&_audio.json, words for underscores."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.json$", ""), r"^(?:source_products|target_pool|matched|raw)_", "")
    return F.trim(F.replace(stem, F.lit("_"), F.lit(" ")))


def seed_targets(visible: DataFrame, hidden: DataFrame) -> DataFrame:
    """Both pools as prepared targets, one row per reference and retailer; of a listing in both the visible one stays."""
    both = prepare_targets(visible, True).unionByName(prepare_targets(hidden, False), allowMissingColumns=True)
    return first_wins(both, ["reference", "retailer"], F.desc("visible"), "name", "url")


def not_visited(df: DataFrame, visited: DataFrame, keys: list) -> DataFrame:
    """Rows still to be done: those whose keys weren't seen before."""
    return df.join(visited.select(*keys).distinct(), keys, "left_anti")


#: Bits of a Bloom filter (2 MB) and of them those that a key sets.
BLOOM_BITS, BLOOM_HASHES = 1 << 24, 4


def _places(keys: list, bits: int, hashes: int):
    """The bits that a key sets: steps of one half of its hash from the other."""
    h = F.xxhash64(*keys)
    return F.array(*[F.pmod(h.bitwiseAND(0xFFFFFFFF) + i * F.shiftrightunsigned(h, 32), F.lit(bits)) for i in range(hashes)])


def bloom_filter(rows: DataFrame, keys: list, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """One row with ``bloom``, the filter's bits as longs; the keys are ORed together where they lie and by word."""
    at = rows.select(F.explode(_places(keys, bits, hashes)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("set"))
    every = rows.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    return every.agg(F.transform(ordered, lambda x: x.set).alias("bloom"))


def may_hold(df: DataFrame, bloom: DataFrame, keys: list, name: str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """df with ``name``: false for keys that the filter can't hold.  The filter is a single row of ``bits``, so it is broadcast."""
    bit = lambda p: F.call_function("shiftright", F.get("bloom", F.call_function("div", p, F.lit(64)).cast("int")), (p % 64).cast("int")).bitwiseAND(1)
    return df.crossJoin(F.broadcast(bloom)).withColumn(name, F.forall(_places(keys, bits, hashes), lambda p: bit(p) == 1)).drop("bloom")


def unvisited(df: DataFrame, visited: DataFrame, keys: list, bits: int = BLOOM_BITS) -> DataFrame:
    """not_visited() for large sets: rows that a Bloom filter of what was visited can't hold pass at once, the others meet
    the visited keys in the exact anti join; of df only those are shuffled.  Null keys were never visited."""
    told = may_hold(df, stored(bloom_filter(visited, keys, bits)), keys, "__seen", bits)
    sure, open_ = told.where("not __seen").drop("__seen"), told.where("__seen").drop("__seen")
    return sure.unionByName(not_visited(open_, visited, keys))


def pool_records(scraped: DataFrame) -> DataFrame:
    """Scraped hits (source_reference, scraped: array of structs) as listings named after their address, one per shop and URL."""
    from skuweave.functions.text import make_ref, url_category, url_slug_name
    from skuweave.operators.submission import is_product_url

    hits = scraped.select("source_reference", F.explode_outer("scraped").alias("h")).where("h.url is not null").select("source_reference", "h.*")
    hits = hits.where(is_product_url(F.col("url"), F.col("retailer")))
    rows = hits.select(make_ref(F.col("url")).alias("reference"), url_slug_name(F.col("url")).alias("name"), "retailer", "url", url_category(F.col("url")).alias("category"), "source_reference")
    return first_wins(rows.where(F.length("name") >= 3), ["retailer", "url"], "source_reference").orderBy("retailer", "name", "url")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


CANDIDATES = """
CREATE OR REPLACE TEMPORARY FUNCTION target_candidates(p_category STRING DEFAULT NULL, p_kinds ARRAY<STRING> DEFAULT NULL, p_retailers ARRAY<STRING> DEFAULT NULL, p_min DOUBLE DEFAULT NULL, p_max DOUBLE DEFAULT NULL)
RETURNS TABLE RETURN SELECT * FROM {table} WHERE (NOT visible OR p_category IS NULL OR category = p_category) AND (p_kinds IS NULL OR kind IS NULL OR array_contains(p_kinds, kind))
AND (p_retailers IS NULL OR array_contains(p_retailers, retailer)) AND (p_min IS NULL OR price_eur IS NULL OR price_eur >= p_min) AND (p_max IS NULL OR price_eur IS NULL OR price_eur <= p_max)
"""


def register_candidates(spark: SparkSession, table: str) -> None:
    """The candidate filter as a SQL table function, target_candidates(...), over a table or view of prepared targets."""
    spark.sql(CANDIDATES.format(table=table))
