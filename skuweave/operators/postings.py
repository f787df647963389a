"""A stored inverted index for BM25: postings by term and range of documents, with the largest weight of each.

A range holds about RANGE documents of like length.  What a query can score in a range is at most the sum of its terms'
largest weights there, which only the heads of postings tell.  A query is first scored in its most promising ranges; the
k-th score found bounds what counts, and postings of ranges that can't reach it are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuweave.functions.text import normalize, tokens
from skuweave.operators.retrieval import B, K1, MAX_TERMS, terms
from skuweave.operators.store import remove, stored

#: Documents of a range, about; folders that terms are dealt to; ranges that a query is scored in first.
RANGE, PARTS, FIRST = 128, 64, 8
#: What rounding of scores may hide.
SLACK = 2e-6


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's weight in a document, without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def write_postings(docs: DataFrame, path: str, *, ident: str, text: str, keep: tuple = (), size: int = RANGE) -> None:
    """Writes an index of docs to a folder: postings, terms, documents with the columns named in keep, and totals.

    Ids are unique and not null (rows without one are left out); a null text has no terms, its document counts all the same.
    """
    spark, norm = docs.sparkSession, f"{path}/norm"
    slim = docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), *keep, normalize(F.col(text)).alias("norm"))
    # Texts are read three times and normalised once; as files they take less than the texts, as arrays of words several times as much.
    slim = slim.withColumn("dl", F.size(tokens(F.col("norm")))).withColumn("band", F.floor(2 * F.log2(F.col("dl") + 1)).cast("long"))
    slim.write.mode("overwrite").parquet(norm)
    slim = spark.read.schema(slim.schema).parquet(norm)
    bands = stored(slim.groupBy("band").agg(F.ceil(F.count("*") / size).alias("ranges"), F.count("*").alias("docs"), F.sum("dl").alias("words_")))
    total = bands.agg(F.sum("docs").alias("n"), (F.sum("words_") / F.sum("docs")).alias("avgdl"))
    total.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    # At most two bands for each doubling of length.
    slim = slim.join(F.broadcast(bands.select("band", "ranges")), "band").withColumn("range", F.col("band") * (1 << 32) + F.pmod(F.xxhash64("id"), "ranges"))
    slim.select("id", "range", "dl", *keep).write.mode("overwrite").parquet(f"{path}/documents")
    avgdl = docs.sparkSession.read.parquet(f"{path}/totals").select("avgdl")
    counts = slim.select("id", "range", "dl", F.explode(tokens(F.col("norm"))).alias("term")).groupBy("term", "range", "id", "dl").agg(F.count("*").alias("tf"))
    posting = F.struct("id", "tf", "dl")
    # Dealt as they are written, and grouped there.
    counts = counts.withColumn("part", _part(F.col("term"))).withColumn("deal", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(4))).repartition("part", "deal")
    heads = counts.crossJoin(F.broadcast(avgdl)).groupBy("part", "deal", "term", "range").agg(  # a single row
        F.count("*").alias("n"), F.max(_impact(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("most"), F.array_sort(F.collect_list(posting)).alias("postings")
    )
    heads = heads.drop("deal").sortWithinPartitions("part", "term", "range")
    heads.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    remove(spark, norm)
    index = _read_postings(docs.sparkSession, path)
    index.groupBy("part", "term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings by their schema, since an index of nothing has no files; the id's type is that of the documents."""
    kind = dict(spark.read.parquet(f"{path}/documents").dtypes)["id"]
    return spark.read.schema(f"term string, range long, n long, most double, postings array<struct<id:{kind},tf:long,dl:int>>, part int").parquet(f"{path}/postings")


@dataclass
class Hits:
    """A search's rows (query_id, doc_id, score, rank), the postings of its terms, and how many of them were scored."""

    rows: DataFrame
    postings: int
    scored: int


def search_postings(path: str, queries: DataFrame, k: int, *, query_id: str, query_text: str, only: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0) -> Hits:
    """The k best documents for each query, as a scan of all would rank them: by score (six places), ties by id.

    only: a filter of the index's documents by the columns kept beside them, such as payload_filter; it leaves counts and
    lengths as they are.  Scores have to be over ``least``.
    """
    spark = queries.sparkSession
    postings, documents, total = _read_postings(spark, path), *(spark.read.parquet(f"{path}/{t}") for t in ("documents", "totals"))
    wanted = terms(queries, query_id, query_text).select(F.col("id").alias("query_id"), "term").distinct().withColumn("part", _part(F.col("term")))
    known = spark.read.parquet(f"{path}/terms").join(wanted.select("part", "term").distinct(), ["part", "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = stored(wanted.join(known.crossJoin(F.broadcast(total)).select("term", idf.alias("idf"), "avgdl"), "term"))  # a single row of totals
    told, few = wanted.select("part", "term").distinct(), wanted.count() <= MAX_TERMS
    allowed = None if only is None else stored(only(documents).select("id", "range"))
    heads = postings.select("part", "term", "range", "n", "most").join(wanted, ["part", "term"])
    if allowed is not None:
        heads = heads.join(allowed.select("range").distinct(), "range", "left_semi")
    bounds = heads.groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    bounds = stored(bounds.where(F.col("bound") > least - SLACK).withColumn("place", order))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")

    def scored(some: DataFrame) -> DataFrame:
        # Postings are dealt by range and meet the terms of the range's queries there: a range has all of a document's postings,
        # so scores are summed where they lie, and no posting is shuffled for each of the queries that ask for it.
        asked = some.groupBy("range").agg(F.collect_set("query_id").alias("asked"))
        held = postings.join(F.broadcast(told), ["part", "term"], "left_semi") if few else postings.join(told, ["part", "term"], "left_semi")
        held = held.select("term", "range", "postings").repartition("range").join(asked.repartition("range"), "range")
        each = held.join(F.broadcast(wanted) if few else wanted, "term").where(F.array_contains("asked", F.col("query_id")))
        each = each.select("range", "query_id", "idf", "avgdl", F.inline("postings"))
        sums = each.groupBy("range", "query_id", "id").agg(F.round(F.sum(F.col("idf") * _impact(F.col("tf"), F.col("dl"), F.col("avgdl"))), 6).alias("score"))
        sums = sums.where(F.col("score") > least)
        return (sums if allowed is None else sums.join(allowed.select("id"), "id", "left_semi")).select("query_id", F.col("id").alias("doc_id"), "score")

    first = stored(scored(bounds.where(F.col("place") <= FIRST)))
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("reach"))
    rest = bounds.where(F.col("place") > FIRST).join(kth, "query_id", "left").where(F.col("reach").isNull() | (F.col("bound") >= F.col("reach") - SLACK))
    rest = stored(rest.select("query_id", "range", "n"))
    rows = first.unionByName(scored(rest)).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    counts = bounds.agg(F.sum("n"), F.sum(F.when(F.col("place") <= FIRST, F.col("n")))).first()
    return Hits(rows, counts[0] or 0, (counts[1] or 0) + (rest.agg(F.sum("n")).first()[0] or 0))
