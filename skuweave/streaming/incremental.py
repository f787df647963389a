"""Incremental forms: first listings and keyed upserts over file streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuweave.operators.store import shared_dir
from skuweave.sources.ingest import first_wins


def new_listings(stream: DataFrame, event_time: str, keys: list, delay: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, *keys) -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


def upsert_into(table: str, keys: list, order: list):
    """A foreachBatch function that adds each batch's first row of a key, in order, to a Parquet table under its number.

    A batch writes only its own folder, ``batch=N``, and writes it anew when it is replayed, so that whatever is lost on
    the way, each batch counts once.  An empty batch writes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = first_wins(batch, keys, *order)
        if not batch.isEmpty():
            rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return run


def upsert_stream(stream: DataFrame, into, state: str) -> None:
    """Runs a stream to the end of what is there, batch by batch; from the same state folder it goes on where it ended."""
    stream.writeStream.foreachBatch(into).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def read_upserted(spark: SparkSession, table: str, keys: list, newest: list) -> DataFrame:
    """The table's rows, one for each key: the largest by the columns named in newest, of equal ones the latest batch's."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = F.max_by(F.struct(*rest), F.struct(*newest, "batch"))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def compacted(spark: SparkSession, table: str, keys: list, newest: list, to: str) -> None:
    """Writes the table's rows, one for each key, to another folder, as what came before any batch."""
    read_upserted(spark, table, keys, newest).write.mode("overwrite").parquet(f"{to}/batch=-1")


def run_to_end(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there now, into Parquet in the folder that spark.checkpoint.dir names, and reads it."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
