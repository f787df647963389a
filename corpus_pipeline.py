"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() applies them to documents.
All stages but the last return the columns of documents.  A null id is a document of its own kind, above all others, and
repeated rows are copies; see the operators for nulls, empty texts and ties.  Rows go by file and place in the file, so that
no decision depends on which executors there are; docs that aren't rows of files are stored first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuweave.llm.common import bounded, cut, documents, new_path, small_batches
from skuweave.llm.lines import dedup_lines_in
from skuweave.llm.mixing import mix_copies, words
from skuweave.llm.nearjoin import COPIES, near_duplicates
from skuweave.llm.packing import pack_documents
from skuweave.llm.quality import quality
from skuweave.operators.store import free_name, identified, remove

#: The stages' own column names; where a table has such a column, an underscore more.
ROW, TIMES, COPY = "__sw_row", "__sw_times", "__sw_copy"
LINES = ("__sw_kept", "__sw_lines", "__sw_dropped")


def _keep(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """rows without those that gone names: a broadcast if they are few, else a shuffle of both."""
    gone = cut(gone.select(row))
    return rows.join(bounded(gone, gone.count(), COPIES), row, "left_anti").drop(row)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rules and the certified cutoffs; the texts of the others are left as they are.

    A null or empty text has under 10 words and goes; repeated rows are judged each by itself; an empty table stays one.
    """
    row = free_name(docs, ROW)
    rows = identified(docs, row)
    judged = quality(rows, documents(spark, sf_dir, "labels"), carry=[row])
    return _keep(rows, row, judged.where("not kept")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; every document stays, if need be with an empty text.  n_chars is counted again.

    A null text becomes an empty one; of documents that share a line the smallest id keeps it, of rows without an id the
    first in its file; rows with the same id are one document; an empty table stays one.
    """
    small_batches(spark)
    names = tuple(free_name(docs, n) for n in LINES)
    out = dedup_lines_in(docs, names=names).withColumn("text", F.col(names[0]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the row with the smallest id, of those the first.

    Texts without words (null ones too) link with nothing and stay; rows without an id are above all ids; repeated rows
    are copies; an empty table stays one.
    """
    row = free_name(docs, ROW)
    rows = identified(docs, row)
    found = near_duplicates(rows, row=row)
    return _keep(rows, row, found.where("row != first").select(F.col("row").alias(row))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words (null texts too) aren't taken; a null source is a source; repeated rows are copies; an empty
    table stays one.
    """
    row, times, copy = (free_name(docs, n) for n in (ROW, TIMES, COPY))
    rows = identified(docs, row)
    mixed = mix_copies(rows, ident=row, size=words(F.col("text")), source=F.col("source"), text=F.col("text"))
    taken = mixed.where("taken > 0").select(F.col("id").alias(row), F.col("times").alias(times))
    again = rows.join(taken, row)
    return again.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a training sequence.

    A null or empty text is the end id alone; repeated rows are packed each by itself, a null id stays null; pieces of
    equal length go by id, piece and checksum; an empty table gives no rows.
    """
    import public_tokenizers as P

    return pack_documents(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Near-duplicate components, the seeded mix and the packing plan have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet to the shared folder and read by the next.

    A stage's rows are deleted once the next one's are written; those that the last stage reads stay.
    """
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
