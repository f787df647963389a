"""Best-fit packing of token sequences after Martello-Toth dominance reduction."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import cut, documents, give_back, numbered

CAPACITY = 2048


class _Items:
    """Counts by length, with the lengths present as bits of an integer."""

    def __init__(self, counts: dict):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.bits = sum(1 << k for k in self.n)

    def take(self, length: int, many: int) -> None:
        self.n[length] -= many
        if not self.n[length]:
            del self.n[length]
            self.bits ^= 1 << length

    def most(self, limit: int) -> int:
        """The largest length present up to limit; 0 if none."""
        return max(0, (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1) if limit > 0 else 0

    def least(self, many: int) -> list:
        """The smallest items, up to ``many``."""
        out, bits = [], self.bits
        while bits and len(out) < many:
            k = (bits & -bits).bit_length() - 1
            out += [k] * min(self.n[k], many - len(out))
            bits &= bits - 1
        return out

    def best_pair(self, limit: int) -> int:
        """The largest sum of two items up to limit; 0 if none fits."""
        keys, best = sorted(self.n), 0
        i, j = 0, len(keys) - 1
        while i <= j:
            total = keys[i] + keys[j]
            if total > limit or i == j and self.n[keys[i]] < 2:
                j -= 1
            else:
                best = max(best, total)
                i += 1
        return best


def reduce(items: _Items, capacity: int) -> list:
    """Fixes bins that dominate every other bin with the same largest item, as [(lengths, how many)].

    A bin dominates another if the other's items can be grouped so that each group fits in the place of one of its own.
    Sets of up to three items are tried (Martello and Toth 1990): the item alone if nothing fits beside it; with an
    exact partner; with its largest partner if only one fits, or if every two that fit beside it fit in the partner's
    place; with its two largest if no three fit and no pair's smaller item is over the second.
    """
    fixed = []
    for w in sorted(items.n, reverse=True):
        while items.n.get(w):
            items.take(w, 1)  # what follows looks at the others
            rest, left = capacity - w, items.n.get(w, 0) + 1
            a = items.most(rest)
            small = items.least(3)
            chosen = None
            if not a:
                chosen, many = (w,), left
            else:
                pair = (w, a)
                fits = lambda k: len(small) >= k and sum(small[:k]) <= rest
                b = 0
                if a == rest or not fits(2):
                    chosen = pair
                elif not fits(3):
                    if items.best_pair(rest) <= a:
                        chosen = pair
                    else:
                        items.take(a, 1)
                        b = items.most(rest - a)
                        half = items.most(rest // 2)
                        items.n[a] = items.n.get(a, 0) + 1
                        items.bits |= 1 << a
                        if b and b >= half:
                            chosen = (w, a, b)
                if chosen:
                    have = {k: items.n.get(k, 0) + (k == w) for k in set(chosen)}
                    many = min(have[k] // chosen.count(k) for k in have)
            items.n[w] = left
            items.bits |= 1 << w
            if not chosen:
                break
            for k in set(chosen):
                items.take(k, many * chosen.count(k))
            fixed.append((tuple(sorted(chosen, reverse=True)), many))
    return fixed


def best_fit(items: _Items, capacity: int) -> list:
    """Best-fit decreasing over counts: equal bins are filled together, as [(lengths, how many)]."""
    by_room: dict = defaultdict(list)
    rooms = 0
    for w in sorted(items.n, reverse=True):
        left = items.n[w]
        while left:
            open_ = rooms >> w
            if open_:
                room = w + (open_ & -open_).bit_length() - 1
                bin_, have = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, bin_, have = capacity, (), left
            each = min(room // w, left)
            many = min(have, left // each)
            if open_ and have > many:
                by_room[room].append((bin_, have - many))
                rooms |= 1 << room
            by_room[room - each * w].append((bin_ + (w,) * each, many))
            rooms |= 1 << (room - each * w)
            left -= each * many
    return [b for bins in by_room.values() for b in bins]


def plan(counts: dict, capacity: int) -> list:
    """Bins for items given as counts by length, as [(lengths from the largest, how many such bins)]."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be 1 to the capacity")
    items = _Items(dict(counts))
    return reduce(items, capacity) + best_fit(items, capacity)


def pack(pieces: DataFrame, order: list, *, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; lengths are 1 to capacity (else an error), order tells equal lengths apart.

    Pieces are numbered by length in one range shuffle; the driver plans over the counts of each length (at most
    ``capacity`` of them, whatever the number of pieces) and sends back runs of ranks: a piece's rank among those of
    its length gives its bin and place.  The runs number a few thousand at most.  Empty pieces: no rows.
    """
    rows = numbered(pieces.drop("sequence_id", "offset"), [F.col(length), *order], "__sw_row")
    counts = dict(rows.groupBy(F.col(length).cast("int")).count().collect())
    first, at = {}, 0
    for k in sorted(counts):
        first[k], at = at, at + counts[k]
    runs, sequence = [], 0
    for bin_, many in plan(counts, capacity):
        offset = 0
        for k in sorted(set(bin_), reverse=True):
            each = bin_.count(k)
            runs.append((first[k], each, sequence, offset, k))
            first[k] += each * many
            offset += each * k
        sequence += many
    table = np.array(sorted(runs) or [(0, 1, 0, 0, 1)], dtype=np.int64).T

    @F.pandas_udf("sequence_id long, offset long")
    def place(row: pd.Series) -> pd.DataFrame:
        lo, each, base, offset, k = table
        r = row.to_numpy()
        i = np.searchsorted(lo, r, side="right") - 1
        rank = r - lo[i]
        return pd.DataFrame({"sequence_id": base[i] + rank // each[i], "offset": offset[i] + rank % each[i] * k[i]})

    return rows.withColumn("__sw_at", place("__sw_row")).select("*", "__sw_at.sequence_id", "__sw_at.offset").drop("__sw_row", "__sw_at")


def special_strings(tokenizer: str) -> re.Pattern:
    """A pattern for the strings of a ``tokenizers`` file's added tokens, whatever their case."""
    with open(tokenizer) as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    return re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)


def byte_encoder(tokenizer: str, ranks: str | None = None, pattern: str | None = None):
    """A function from a text to its ids by a ``tokenizers`` file, with add_special_tokens=False.

    ranks and pattern: the same vocabulary for ``tiktoken``, whose ids are the same for texts without the string of an
    added token and which is three times as fast; such texts go through it, all others through ``tokenizers``.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    exact = lambda text: whole.encode(text, add_special_tokens=False).ids
    if not ranks:
        return exact
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    special = special_strings(tokenizer)
    return lambda text: exact(text) if special.search(text) else fast(text)


def pieces_of(encoder: tuple, end: int, capacity: int, with_ids: bool = False):
    """Arrow batches (doc_id, text) to a row for each piece: documents longer than capacity are cut, the first is short."""

    def run(batches):
        encode = byte_encoder(*encoder)
        for b in batches:
            ids, piece, start, length, crc, own = [], [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                flat = np.array([*encode(text or ""), end], dtype="<u4")
                at = [0, *range((len(flat) - 1) % capacity + 1, len(flat) + 1, capacity)]
                for p, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    ids.append(i)
                    piece.append(p)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(flat[x:y]))
                    if with_ids:
                        own.append(flat[x:y].astype(np.int32))
            cols = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            yield pa.record_batch(cols + [pa.array(own, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        del encode
        give_back()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, *, ident: str = "doc_id", text: str = "text", end: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for), sequence_id, offset.

    tokenizer: a ``tokenizers`` file; ranks and pattern: see byte_encoder().  Null or empty text: the end id alone.
    Strings of added tokens in a text are those tokens, as ``tokenizers`` reads them.  Repeated rows are packed each by
    itself; a null id stays null; equal lengths are told apart by id, piece and checksum.  An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = cut(slim.mapInArrow(pieces_of((tokenizer, ranks, pattern), end, capacity, with_ids), schema))
    return pack(found, [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], capacity=capacity)


def op5_pack(spark, sf_dir: str) -> DataFrame:
    """pack_documents() over all documents with the 50k byte-level vocabulary; nulls, empty texts and ties as there."""
    import public_tokenizers as P

    return pack_documents(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
