"""Sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import documents, numbered
from skuweave.operators.store import free_name

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (murmur3's) of x and a round key."""
    x = x ^ np.uint64(key & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Places of row numbers 0..n-1 under the seed's permutation (back: the row numbers of places).

    A balanced Feistel network over the least 4**k >= n; values that fall outside are sent through it again until
    they fall inside, which on average takes under four passes.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    with np.errstate(over="ignore"):
        out = _network(np.asarray(rows, dtype=np.uint64), half, seed, back)
        while (outside := np.flatnonzero(out >= np.uint64(n))).size:
            out[outside] = _network(out[outside], half, seed, back)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row number, without any table."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard(df: DataFrame, order: list, shards: int, seed: int = 29) -> DataFrame:
    """df with row_number, shard and slot.

    Rows are numbered in the given order (ties: by their place in the input), permuted, and dealt to shards in turn, so
    shard sizes differ by one at most and slots run gapless from 0.  Null order keys come first; empty df: no rows.
    Columns of df named row_number, shard or slot are replaced.
    """
    rows = numbered(df.drop("row_number", "shard", "slot"), order, "row_number")
    n = rows.count()

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    at = free_name(rows, "__sw_place")
    rows = rows.withColumn(at, place("row_number"))
    return rows.withColumn("shard", (F.col(at) % shards).cast("int")).withColumn("slot", F.expr(f"`{at}` div {shards}")).drop(at)


def op3_shards(spark, sf_dir: str) -> DataFrame:
    """shard() of all documents into 16 by id, size and checksum; a null text is empty, a null id comes first, repeated rows
    take a slot each, an empty table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(slim, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
