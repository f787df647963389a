"""Phrase collocations by hierarchical pair naming.

1. Texts become chunks: sequences of chunk-local word numbers (0 between pieces), the chunk's words, and their counts.  A
   chunk ends with a few words of the next one, which it names but doesn't count.
2. The counts go to ranges of keys (96-bit hashes of words), packed.  A range sums them over all chunks, gives each frequent
   word a global id, and answers the chunks that hold it.
3. A chunk replaces its words by the ids it was told and lists each pair of adjacent ones; pairs are counted and named in
   ranges in turn, and so on: two adjacent pairs are a phrase of three words.  Keys of pairs are exact, two ids in one number.
4. A phrase's two ids are its parents: the phrase without its last and without its first word.  Counts of all first and
   last parts come down along them, and so does what a longer phrase says of the two that lie in it.

Occurrences are never rows: a chunk's sequence is one value, its keys for a range are one, and only frequent ones come back.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import bounded, cut, documents, give_back, new_path, numbered, parts
from skuweave.operators.store import remove

#: Words of a phrase at most, its least count, per cent of a phrase's count from which a longer one stands for it, rows per stratum.
WORDS, LEAST, WITHIN, TOP = 3, 10, 50, 2000
#: Words of a chunk; words a task remembers before it starts a new dictionary; bytes of a text taken at once; ranges at most.
CHUNK, VOCABULARY, SLICE, RANGES = 1 << 20, 300_000, 1 << 20, 1 << 16

#: Strata named in a broadcast at most.
STRATA = 100_000

BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")


def packed(x: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _table(names: str, rows: list) -> pa.Table:
    """Rows as dicts to a table with the columns of a schema string; what a row leaves out is null."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    columns = [c.split() for c in names.split(", ")]
    return pa.table([pa.array([r.get(c) for r in rows], types[t]) for c, t in columns], names=[c for c, _ in columns])


class _Numbers(dict):
    """Words of a stratum to their numbers in the task; new ones are listed."""

    def __init__(self, stratum: str, of: int, words: list, digests: list, strata: list):
        super().__init__({BREAK: 0})
        self.seed, self.of, self.words, self.digests, self.strata = stratum.encode() + b"\n", of, words, digests, strata

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.digests.append(xxhash.xxh3_128_digest(self.seed + word)[:12])
        self.strata.append(self.of)
        self[word] = n = len(self.words)
        return n


def _slices(text: bytes):
    """The text, folded, in pieces of about SLICE bytes that end between words."""
    text = text.lower().translate(_FOLD).replace(BREAK, b" " + BREAK + b" ")
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


_RANGE = "chunk long, range int, start int, keys binary, more binary, counts binary"
_FIRST = f"{_RANGE}, own int, ids binary, words binary, strata string, of binary, stratum string, n long"


def _ranges(chunk: int, where: np.ndarray, keys: np.ndarray, more: np.ndarray | None, counts: np.ndarray) -> list:
    """A row for each range; all are sorted by range, then key."""
    if not len(where):
        return []
    at = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1)]
    return [
        {"chunk": chunk, "range": int(where[a]), "start": int(a), "keys": packed(_steps(keys[a:z])), "more": None if more is None else more[a:z].tobytes(), "counts": packed(counts[a:z].astype(np.uint32))}
        for a, z in zip(at, [*at[1:], len(where)], strict=True)
    ]


def _chunk_rows(part: np.ndarray, own: int, chunk: int, words: list, digests: list, strata: list, names: list, ranges: int) -> pa.Table:
    """A chunk's rows: its sequence and words, its counts for each range, its words counted by stratum."""
    local, seq = np.unique(part, return_inverse=True)
    known = local[local > 0] - 1
    cells = np.frombuffer(b"".join([digests[k] for k in known.tolist()]), np.uint32).reshape(-1, 3)
    high, low = cells[:, 0].astype(np.uint64) << np.uint64(32) | cells[:, 1], cells[:, 2]
    where = (low % np.uint32(ranges)).astype(np.int64)
    order = np.lexsort((low, high, where))
    rank = np.empty(len(local), np.uint32)
    rank[len(local) - len(known) :][order] = np.arange(1, len(known) + 1)
    rank[: len(local) - len(known)] = 0
    seq = rank[seq]
    counts = np.bincount(seq[:own], minlength=len(known) + 1)[1:]
    of = np.array([strata[k] for k in known.tolist()], dtype=np.uint32)[order]
    rows = _ranges(chunk, where[order], high[order], low[order], counts)
    text = b"\n".join([words[known[k]] for k in order.tolist()])
    rows.append({"chunk": chunk, "own": own, "ids": packed(seq), "words": zstandard.compress(text, 1), "strata": json.dumps(names), "of": packed(of)})
    totals = np.bincount(of, weights=counts, minlength=len(names))
    rows += [{"stratum": s, "n": int(n)} for s, n in zip(names, totals, strict=True) if n]
    return _table(_FIRST, rows)


def _chunks(size: int, ahead: int, ranges: int):
    """Arrow batches (stratum, text) to chunks of ``size`` words, each with ``ahead`` words of the next one."""

    def run(batches):
        from pyspark import TaskContext

        chunk, held, have = TaskContext.get().partitionId() << 24, [], 0
        words, digests, of, names, strata = [], [], [], [], {}

        def ready(all_: bool):
            nonlocal chunk, held, have
            seq = np.concatenate(held) if held else np.empty(0, np.int32)
            while len(seq) >= size + ahead or all_ and len(seq):
                own = min(size, len(seq))
                yield from _chunk_rows(seq[: own + ahead], own, chunk, words, digests, of, names, ranges).to_batches()
                chunk, seq = chunk + 1, seq[own:]
            held, have = [seq], len(seq)

        for b in batches:
            for stratum, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                numbers = strata.get(stratum)
                if numbers is None:
                    numbers = strata[stratum] = _Numbers(stratum, len(names), words, digests, of)
                    names.append(stratum)
                for s in _slices(text.as_py()):
                    held.append(np.array([numbers[w] for w in s.split()], dtype=np.int32))
                    have += len(held[-1])
                    if have >= size + ahead:
                        yield from ready(False)
                held.append(np.zeros(1, np.int32))
                have += 1
                if len(words) > VOCABULARY:
                    yield from ready(True)
                    words, digests, of, names, strata = [], [], [], [], {}
        yield from ready(True)
        del words, digests, of, strata, held
        give_back()

    return run


_ANSWER = "chunk long, local binary, told binary, first binary, id long, n long, left long, right long"


def _counted(ranges: int, least: int, base: int):
    """A range's rows to answers: for each chunk its frequent keys (place, id, whether it is the first chunk to hold it), and
    for each of them (id, n), of pairs with the ids of its parents."""

    def run(table: pa.Table) -> pa.Table:
        here = table.column("range")[0].as_py()
        table = table.sort_by("chunk")
        high, low, count, whose, place = [], [], [], [], []
        for k, (keys, more, counts, start) in enumerate(zip(*(table.column(c).to_pylist() for c in ("keys", "more", "counts", "start")), strict=True)):
            high.append(np.cumsum(unpacked(keys, np.uint64), dtype=np.uint64))
            n = len(high[-1])
            low.append(np.zeros(n, np.uint32) if more is None else np.frombuffer(more, np.uint32))
            count.append(unpacked(counts, np.uint32).astype(np.int64))
            whose.append(np.full(n, k, np.int32))
            place.append(np.arange(start, start + n, dtype=np.uint32))
        high, low, count, whose, place = (np.concatenate(x) for x in (high, low, count, whose, place))
        order = np.lexsort((whose, low, high))
        h, w = high[order], low[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        sums = np.add.reduceat(count[order], at)
        often = sums >= least
        ids = np.where(often, (np.cumsum(often) - 1) * ranges + here + 1, 0)
        size = np.diff(np.concatenate([at, [len(h)]]))
        told, first = np.repeat(ids, size), np.zeros(len(h), np.uint8)
        first[at] = 1
        keep = told > 0
        told, first, whose, place = told[keep], first[keep], whose[order][keep], place[order][keep]
        back = np.argsort(whose, kind="stable")
        told, first, whose, place = told[back], first[back], whose[back], place[back]
        chunks, rows = table.column("chunk").to_pylist(), []
        edge = np.searchsorted(whose, np.arange(len(chunks) + 1))
        for k, (a, z) in enumerate(zip(edge, edge[1:], strict=False)):
            if z > a:
                rows.append({"chunk": chunks[k], "local": packed(place[a:z]), "told": packed(told[a:z]), "first": packed(first[a:z])})
        key = h[at][often]
        named = pa.table(
            [
                *(pa.nulls(len(key), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())),
                *(pa.array(x.astype(np.int64)) for x in (ids[often], sums[often])),
                *(pa.array(x.astype(np.int64), mask=None if base else np.ones(len(key), bool)) for x in (key // np.uint64(max(1, base)), key % np.uint64(max(1, base)))),
            ],
            names=[c.split()[0] for c in _ANSWER.split(", ")],
        )
        return pa.concat_tables([_table(_ANSWER, rows), named])

    return run


def pairs_of(seq: np.ndarray, ids: np.ndarray, base: int, ranges: int) -> tuple:
    """Adjacent known members of a sequence: (places, number of the pair at each, its range, its key).

    ids: by local number; a pair's key is left * base + right.  Pairs are numbered by range, then key.
    """
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    both, which = np.unique(seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1], return_inverse=True)
    keys = ids[both >> np.uint64(32)] * np.uint64(base) + ids[both & np.uint64(0xFFFFFFFF)]
    mixed = (keys ^ keys >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    where = ((mixed >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((keys, where))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return at, rank[which], where[order], keys[order]


_NEXT = f"{_RANGE}, own int, ids binary, gids binary, id long, stratum string, word string"


def _answers(told: pa.Table) -> tuple:
    blobs = [told.column(c).to_pylist() for c in ("local", "told", "first")]
    return tuple(np.concatenate([unpacked(x, t) for x in col]) for col, t in zip(blobs, (np.uint32, np.int64, np.uint8), strict=True))


def _renumbered(seq: np.ndarray, size: int, local: np.ndarray, told: np.ndarray) -> tuple:
    """The sequence over the frequent members alone, numbered anew from 1, and their ids by number."""
    number = np.zeros(size, np.uint32)
    number[local] = np.arange(1, len(local) + 1)
    return number[seq], np.concatenate([[0], told]).astype(np.uint64)


def _paired(ranges: int, base: int, before: int | None, last: bool):
    """A chunk and its answers to its pairs' counts for each range and (but the last time) its sequence of ids.

    before: the base of the pairs that the answers are about; None if they are about words, which the chunk then names
    where it is the first to hold them.
    """

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows or not told.num_rows:
            return _table(_NEXT, [])
        key, own = chunk.column("chunk")[0].as_py(), chunk.column("own")[0].as_py()
        seq = unpacked(chunk.column("ids")[0].as_py(), np.uint32)
        local, ids, first = _answers(told)
        rows = []
        if before is None:
            words = zstandard.decompress(chunk.column("words")[0].as_py()).split(b"\n")
            strata, of = json.loads(chunk.column("strata")[0].as_py()), unpacked(chunk.column("of")[0].as_py(), np.uint32)
            new = first > 0
            rows += [{"id": i, "stratum": strata[of[k]], "word": words[k].decode()} for i, k in zip(ids[new].tolist(), local[new].tolist(), strict=True)]
            seq, gids = _renumbered(seq, len(words) + 1, local + 1, ids)
        else:
            at, which, where, _ = pairs_of(seq, unpacked(chunk.column("gids")[0].as_py(), np.uint64), before, ranges)
            number = np.zeros(len(seq) - 1, np.int64)
            number[at] = which + 1
            seq, gids = _renumbered(number, len(where) + 1, local + 1, ids)
        at, which, where, keys = pairs_of(seq, gids, base, ranges)
        rows += _ranges(key, where, keys, None, np.bincount(which[at < own], minlength=len(keys)))
        if not last and len(keys):
            rows.append({"chunk": key, "own": own, "ids": packed(seq), "gids": packed(gids)})
        give_back()
        return _table(_NEXT, rows)

    return run


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exactly, as long.  Counts up to 10 ** 16, over which it is an error, not a wrong number."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def collocations(
    docs: DataFrame, *, text: str = "text", stratum: str = "lang", missing: str = "und", words: int = WORDS, least: int = LEAST, within: int = WITHIN, top: int = TOP
) -> DataFrame:
    """(stratum, rank, phrase, a, l, r, n, score, first_words): each stratum's best phrases of 2 to ``words`` words.

    A-Z is lower-cased; ``.,;:!?`` and line ends cut a text into pieces, spaces and tabs those into words.  a: the phrase's
    count, at least ``least``; l, r: the counts of its first ``first_words`` words and of the rest, at the cut with the lowest
    score (ties: the earliest); n: all words of the stratum.  A phrase goes if one of a word more that holds it is at least
    ``within`` per cent as frequent (a still longer one is then never the only one that is).  Ties go by a, then by the
    phrase's bytes.  Null strata are ``missing``; null and empty texts have no words; every row counts, repeated ones
    too.  An empty table gives no rows; other columns are ignored, whatever their names.  More than 3 * 10 ** 9 frequent
    words, or frequent phrases of a length but the longest, are an error.
    """
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "phrases")
    ranges = min(RANGES, 4 * parts(spark))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    slim = docs.select(F.coalesce(F.col(stratum).cast("string"), F.lit(missing)).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = kept(slim.mapInArrow(_chunks(CHUNK, words - 1, ranges), _FIRST), "chunks-1")
    totals = cut(chunks.where("stratum is not null").groupBy("stratum").agg(F.sum("n").alias("total")))
    none = F.array().cast("array<long>")
    levels, before, base = [], None, 0
    for size in range(1, words + 1):
        dealt = chunks.where("range is not null").select("chunk", "range", "start", "keys", "more", "counts")
        answers = kept(dealt.groupBy("range").applyInArrow(_counted(ranges, least, base), _ANSWER), f"answers-{size}")
        named = answers.where("id is not null").select("id", "n", "left", "right")
        if size > 1:
            side = lambda s: levels[-1].select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("stratum", "words", "n", "firsts", "lasts")])  # noqa: B023, E731
            both = named.join(side("left"), "left").join(side("right"), "right").select(
                *("id", "left", "right", "n", F.col("left_stratum").alias("stratum")),
                F.concat("left_words", F.slice("right_words", -1, 1)).alias("words"),
                F.concat("left_firsts", F.array("left_n")).alias("firsts"),
                F.concat(F.array("right_n"), "right_lasts").alias("lasts"),
            )
            levels.append(kept(both, f"phrases-{size}"))
        if size == words:
            break
        before, base = base or None, (named.agg(F.max("id")).first()[0] or 0) + 1
        if base * base >= 1 << 63:
            raise ValueError(f"{base} ids of frequent phrases of {size} words")
        held = ["chunk", "own", "ids", *(["words", "strata", "of"] if size == 1 else ["gids"])]
        sequences = chunks.where("ids is not null").select(*held)
        told = answers.where("chunk is not null").select(F.col("chunk").alias("for"), "local", "told", "first")
        paired = sequences.groupBy("chunk").cogroup(told.groupBy("for")).applyInArrow(_paired(ranges, base, before, size + 1 == words), _NEXT)
        chunks = kept(paired, f"chunks-{size + 1}")
        remove(spark, f"{folder}/chunks-{size}")
        if size == 1:
            first = chunks.where("word is not null").select("id", "stratum", "word").join(named.select("id", "n"), "id")
            levels.append(kept(first.select("id", "stratum", F.array("word").alias("words"), "n", none.alias("firsts"), none.alias("lasts")), "phrases-1"))
    found = []
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            most = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            level = level.join(most, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("n")))
        found.append(level.select("stratum", "words", "n", "firsts", "lasts"))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    cuts = F.zip_with("firsts", "lasts", lambda f, s: F.struct(score(F.col("n"), f, s).alias("score"), f.alias("l"), s.alias("r")))
    worst = F.array_min(F.transform(cuts, lambda c, k: F.struct(c.score.alias("score"), (k + 1).alias("first_words"), c.l.alias("l"), c.r.alias("r"))))
    scored = every.select("stratum", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), worst.alias("cut")).select("stratum", "phrase", "a", "cut.*")
    # One range sort of all strata: no stratum gathers in one task.
    placed = cut(numbered(scored, [F.col("stratum"), F.desc("score"), F.desc("a"), F.col("phrase")], "place"))
    strata = cut(placed.groupBy("stratum").agg(F.min("place").alias("start")).join(totals, "stratum"))
    ranked = placed.join(bounded(strata, strata.count(), STRATA), "stratum").withColumn("rank", F.col("place") - F.col("start") + 1)
    out = ranked.where(F.col("rank") <= top).select("stratum", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", F.col("first_words").cast("int").alias("first_words"))
    out = cut(out)  # at most ``top`` rows of each stratum
    remove(spark, folder)
    return out


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """collocations() of all documents by language; nulls, empty texts, ties, repeated rows and empty tables as there."""
    out = collocations(documents(spark, sf_dir))
    return out.select(F.col("stratum").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
),
grams AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM pieces, unnest(generate_series(1, len(ws))) AS g(i)),
ones AS (SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL),
twos AS (SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
threes AS (SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
held AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM threes UNION ALL SELECT lang, w2, w3, f FROM threes) GROUP BY ALL
),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM twos t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w2
  LEFT JOIN held h ON h.lang = t.lang AND h.w1 = t.w1 AND h.w2 = t.w2
  WHERE h.most IS NULL OR 100 * h.most < 50 * t.f
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), 1, t.f, x.f, y.f
  FROM threes t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN twos y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), 2, t.f, x.f, y.f
  FROM threes t JOIN twos x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w3
),
scored AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS s FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY s, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, CAST(s AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
