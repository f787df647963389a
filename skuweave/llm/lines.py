"""Line dedup: normalised lines, hashed and counted by document; repeated lines stay in one document only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import SPACE_BYTES, cut, documents, give_back
from skuweave.operators.store import free_name, identified

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line, stripped and A-Z lower-cased; None if it has under ``min_chars`` code points."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_keys(min_chars: int):
    """Arrow batches (id, file, at, text) to a row (id, file, at, h1, h2) for each document and each of its distinct keys."""

    def run(batches):
        for b in batches:
            at, keys = [], []
            for k, text in enumerate(b.column(3).cast(pa.binary()).to_pylist()):
                own = {line_key(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
                at += [k] * len(own)
                keys += own
            both = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2)
            at = pa.array(at, pa.int64())
            yield pa.record_batch([*(b.column(k).take(at) for k in range(3)), *(pa.array(both[:, k].astype(np.int64)) for k in range(2))], names=["id", "file", "at", "h1", "h2"])
        give_back()

    return run


def line_filter(min_chars: int, names: tuple):
    """Arrow batches (..., text, drop) to (..., kept, n_lines, n_dropped) under these names; drop: hashes whose lines go."""

    def run(batches):
        for b in batches:
            kept, lines, dropped = [], [], []
            *rest, texts, drops = b.columns
            for text, drop in zip(texts.cast(pa.binary()).to_pylist(), drops.to_pylist(), strict=True):
                all_ = (text or b"").split(b"\n")
                if drop:
                    gone = set(drop)
                    stay = [x for x in all_ if (k := line_key(x, min_chars)) is None or k not in gone]
                else:
                    stay = all_
                kept.append(b"\n".join(stay))
                lines.append(len(all_))
                dropped.append(len(all_) - len(stay))
            yield pa.record_batch(
                [*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*b.schema.names[:-2], *names],
            )
        give_back()

    return run


def _named(ident: str, row: str) -> list:
    """A document's name: its id, or, where that is null, its row (else null), as (file, at)."""
    ident = F.col(ident).cast("long")
    return [ident.alias("id"), *[F.when(ident.isNull(), F.col(row)[c]).alias(c) for c in ("file", "at")]]


def repeated_lines(docs: DataFrame, ident: str, text: str, row: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, file, at, drop): per document the keys (16 bytes each) whose lines it loses; row names rows without an id.

    A key's count of documents and its first one come from a pre-aggregated group-by; only keys over the threshold meet
    the (document, key) rows again, in a sort-merge join whose large keys Spark splits.
    """
    slim = docs.select(*_named(ident, row), F.col(text).alias("text"))
    pairs = cut(slim.mapInArrow(line_keys(min_chars), "id long, file long, at long, h1 long, h2 long"))
    place = F.when(F.col("id").isNull(), F.struct("file", "at"))
    least = [F.min("id").alias("first_id"), F.min(place).alias("first_row")]
    if min_docs == 2:
        # Two documents or more: two ids, two rows without an id, or one of each.
        many = "last_id > first_id or last_row > first_row or (first_id is not null and first_row is not null)"
        counts = pairs.groupBy("h1", "h2").agg(*least, F.max("id").alias("last_id"), F.max(place).alias("last_row")).where(many).drop("last_id", "last_row")
    else:
        counts = pairs.distinct().groupBy("h1", "h2").agg(*least, F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    counts = cut(counts)
    other = "id != first_id or (id is null and (first_id is not null or file != first_row.file or at != first_row.at))"
    lost = pairs.join(counts, ["h1", "h2"]).where(other)
    return lost.groupBy("id", "file", "at").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def dedup_lines(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of docs as (id, kept, n_lines, n_dropped).

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.  Keys of at least ``min_chars`` code points
    in at least ``min_docs`` documents lose all their lines except in the smallest id that holds them.  Null or empty
    text: one empty line.  Each row with a null id is a document of its own, above all ids and in the order of its place
    in its file (of several files, in a fixed order); rows that share an id are one document and are each returned.  An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    return dedup_lines_in(slim, ident="id", min_chars=min_chars, min_docs=min_docs).select("id", "kept", "n_lines", "n_dropped")


def dedup_lines_in(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, names: tuple = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """docs, all its columns but the text as they are, with dedup_lines()'s results under ``names``.

    A column of docs that has one of these names is replaced.
    """
    row, body, drop, *key = (free_name(docs, f"__sw_{n}") for n in ("line_row", "text", "drop", "id", "file", "at"))
    rest, types = [c for c in docs.columns if c not in (text, *names)], dict(docs.dtypes)
    docs = identified(docs, row)
    name = lambda *parts: [F.coalesce(p, F.lit(none)).alias(k) for p, none, k in zip(parts, (0, 0, -1), key, strict=True)]
    drops = repeated_lines(docs, ident, text, row, min_chars, min_docs).select(
        *name(*map(F.col, ("id", "file", "at"))), F.transform("drop", lambda d: F.concat(F.unhex(F.lpad(F.hex(d.h1), 16, "0")), F.unhex(F.lpad(F.hex(d.h2), 16, "0")))).alias(drop)
    )
    # Null ids have a name of their own each, so they don't meet under one join key.
    slim = docs.select(*rest, F.col(text).alias(body), *name(*_named(ident, row))).join(drops, key, "left")
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), f"`{names[0]}` string, `{names[1]}` long, `{names[2]}` long"])
    return slim.select(*rest, body, drop).mapInArrow(line_filter(min_chars, names), schema)


def op4_lines(spark, sf_dir: str) -> DataFrame:
    """dedup_lines() over all documents; nulls, empty texts, repeated rows and empty tables as there."""
    out = dedup_lines(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, lower_ascii AS k FROM (
    SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
  )
),
keys AS (SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.i, l.line, (keys.k IS NOT NULL AND l.doc_id <> keys.first_doc) AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
