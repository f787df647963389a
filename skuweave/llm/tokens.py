"""Token ids of documents and their ORC files: integer run lengths, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuweave.llm.common import NO_ID, documents, new_path, parts
from skuweave.llm.packing import special_strings

#: Words remembered with their ids by each Python worker.
MEMO = 1_000_000
#: Characters whose lower case, composition and white space are alike in Python and in the tokenizer.
_PLAIN = re.compile("[\t-\r\x20-~À-įı-ňŊ-ž]*")
# Byte-level models name each byte by a character; bytes that aren't printable follow from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class _Words(dict):
    """Ids, as little-endian bytes, by lower-case word; unknown words are encoded when asked for.

    A word with a full stop or comma after its letters is its letters and the mark, so it isn't kept itself.
    """

    def __init__(self, model, whole):
        self.model, self.whole = model, whole

    def __missing__(self, word):
        if word.isalpha():
            # Lower-case letters need neither normalizer nor split, only the model.
            named = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
            ids = [t.id for t in self.model.tokenize(named)]
        elif word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        self[word] = out = array("I", ids).tobytes()
        return out


class Encoder:
    """Ids of texts by a ``tokenizers`` file, with add_special_tokens=False, as little-endian unsigned 32-bit bytes.

    Files that lower-case and split at white space are fed word by word, each distinct word once; a text with characters
    on which Python and the tokenizer might differ, or with the string of an added token, goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        kind = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        self.by_word = '"Lowercase"' in kind and '"Removed"' in kind and '"ByteLevel"' in kind
        self.words = _Words(self.whole.model, self.whole) if self.by_word else None
        self.special = special_strings(path)

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_word or not _PLAIN.fullmatch(text) or self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.words
        if len(words) > MEMO:
            words.clear()
        return b"".join([words[w] for w in text.lower().split()])


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker, so that tasks share the words it remembers."""
    return Encoder(path)


def encoded(path: str, end: int):
    """Arrow batches (doc_id, text), a range partition in order, to (doc_id, part, start_in_part, n_tokens, ids)."""

    def run(batches):
        from pyspark import TaskContext

        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], dtype="<u4").tobytes()
        for b in batches:
            ids = [encode(t) + tail for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            flat = np.frombuffer(b"".join(ids), dtype="<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.record_batch(
                [b.column(0), pa.array(np.full(len(ids), part), pa.int32()), pa.array(at + ends - sizes), pa.array(sizes), lists],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            at += int(ends[-1]) if len(ends) else 0

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, ident: str = "doc_id", text: str = "text", end: int = 2, stripe_mb: int = 64) -> None:
    """Writes docs' ids to ORC files in ascending id order (null ids last, repeated ids in input order).

    Columns: doc_id, part (file), start_in_part, n_tokens, ids.  Null or empty text: the end id alone.  The text is
    range-shuffled once and encoded where it lands; integers are run-length encoded (RLE v2), each stripe has row
    indexes and a Bloom filter on doc_id, so readers split files by stripe and skip stripes by metadata.  An empty table
    gives files without rows; other columns of docs are ignored, whatever their names.
    """
    tie = "__sw_tie"
    slim = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn(tie, F.monotonically_increasing_id())
    order = [F.coalesce("doc_id", F.lit(NO_ID)), F.col(tie)]
    placed = slim.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    out = placed.mapInArrow(encoded(tokenizer, end), "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd",
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.create.index": "true",
        "orc.row.index.stride": "1000",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id reach the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, part int, start_in_part long, n_tokens long, ids array<int>").orc(path)


def _digest(batches):
    for b in batches:
        lists = b.column(3)
        flat, ends = np.asarray(lists.flatten()).astype("<u4"), lists.offsets.to_numpy()
        ends = ends - ends[0]
        crc = [zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts all ids before the document's.

    The files' totals, a row each, are summed on the driver.
    """
    rows = read_tokens(spark, path)
    totals = sorted(rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n")).collect())
    before, starts = 0, []
    for p, n in totals:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "part int, before long")
    read = rows.select("doc_id", "part", "start_in_part", "ids").mapInArrow(_digest, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents written as ORC and read back; nulls, empty texts and repeated rows as in write_tokens()."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_index(spark, path)
