"""Language ID: mixtures of languages inferred by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import documents

#: Labelled documents that the n-gram models are counted on, at most about; chosen by a hash of the id.
TRAIN = 30_000
#: n-gram length in bytes and table size (a power of two).
GRAM, TABLE = 3, 1 << 16
STEPS, SMOOTH = 12, 0.1
#: Rounding that a bound on a log likelihood is given.
SLACK = 1e-3
#: Languages beyond this are refused: each has a table of its own.
MAX_LANGS = 512


def grams(text: str) -> np.ndarray:
    """Table places of the text's byte n-grams: lower case, white space as one space, a space at both ends."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.empty(0, dtype=np.int64)
    h = b[: len(b) - GRAM + 1].copy()
    for k in range(1, GRAM):
        h = h * np.uint32(257) + b[k : len(b) - GRAM + 1 + k]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - TABLE.bit_length() + 1)).astype(np.int64)


def _count(batches):
    sums: dict = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in sums:
                sums[lang] = np.zeros(TABLE, dtype=np.int64)
            sums[lang] += np.bincount(grams(text), minlength=TABLE)
    for lang, n in sums.items():
        yield pa.record_batch([pa.array([lang]), pa.array([n.tobytes()], pa.binary())], names=["lang", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    """A language's tables from all tasks to their sum."""
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts"))
    return pa.table([table.column("lang")[:1], pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])


def train(docs: DataFrame, text: str, lang: str, ident: str, limit: int = TRAIN) -> tuple[list, np.ndarray]:
    """Languages in code point order and the log probability of each table place in each.

    Counted on a sample of about ``limit`` rows with a language (all rows, if there are no more): the share that a hash
    of the id picks.  16 tasks make a table for each language that they meet; these are summed by language before the
    driver gets them, TABLE numbers for each of at most MAX_LANGS languages (more: ValueError).  No rows: no languages.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = known.count()
    part = min(1.0, limit / max(rows, 1))
    picked = known.where(F.pmod(F.xxhash64(F.lit(5), ident), F.lit(1_000_000)) < int(part * 1_000_000)) if part < 1 else known
    tables = picked.select(F.col(lang).alias("lang"), F.col(text).alias("text")).repartition(16).mapInArrow(_count, "lang string, counts binary")
    sums = {r.lang: np.frombuffer(r.counts, dtype=np.int64) for r in tables.groupBy("lang").applyInArrow(_summed, "lang string, counts binary").limit(MAX_LANGS + 1).collect()}
    if len(sums) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sums)
    counts = np.array([sums[x] for x in langs], dtype=float).reshape(-1, TABLE) + SMOOTH
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixture(places: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, float]:
    """Languages' shares of a text and the probability of the leading one, from its n-grams' places.

    Starts from the single best language and adds the one of all others that raises the likelihood most, shares fitted by
    EM, for as long as twice the log likelihood gained exceeds log(n) per language (BIC); n-grams of a text depend on one
    another, so their number counts for a third.  At the end languages that the others make needless go.  A language isn't
    fitted where the likelihood's slope at the current shares, which bounds its gain (the likelihood is concave), stays
    below the penalty or the best gain so far.
    """
    uniq, n = np.unique(places, return_counts=True)
    lp = logp[:, uniq]
    weight = n / GRAM
    single = lp @ weight
    order = np.argsort(-single, kind="stable")
    chosen, best = [int(order[0])], float(single[order[0]])
    lead = np.exp(np.minimum(0, single - best))
    shares = np.zeros(len(logp))
    shares[chosen[0]] = 1
    p = np.exp(lp - lp.max(axis=0))
    base = float(weight @ lp.max(axis=0))

    def fit(ids, pi):
        q = p[ids]
        pi = pi / pi.sum()
        for _ in range(STEPS):
            r = pi[:, None] * q
            pi = (r / r.sum(axis=0)) @ weight
            pi /= pi.sum()
        return pi, base + float(weight @ np.log(pi @ q))

    n_words = float(weight.sum())
    penalty = float(np.log(max(2.0, n_words))) / 2
    while len(chosen) < len(logp):
        # The most that each language can add, by the slope towards it or towards one that is in already.
        slope = p @ (weight / (shares[chosen] @ p[chosen]))
        bound = np.maximum(slope, slope[chosen].max()) - n_words
        bound[chosen] = -np.inf
        gain, fitted = penalty, None
        for k in order[np.argsort(-bound[order], kind="stable")]:
            if bound[k] + SLACK <= gain:
                break
            ids = [*chosen, int(k)]
            pi, total = fit(ids, np.append(shares[chosen] * (1 - 1 / len(ids)), 1 / len(ids)))
            if total - best > gain:
                gain, fitted = total - best, (ids, pi, total)
        if fitted is None:
            break
        chosen, pi, best = fitted
        shares[:] = 0
        shares[chosen] = pi
    # What the languages added later make needless goes again, such as a first one between two others.
    while len(chosen) > 2:
        parts = [(k, *fit(ids, shares[ids] + 1e-6)) for k in chosen for ids in [[c for c in chosen if c != k]]]
        k, pi, total = max(parts, key=lambda x: x[2])
        if best - total > penalty:
            break
        chosen, best = [c for c in chosen if c != k], total
        shares[:] = 0
        shares[chosen] = pi
    top = int(np.argmax(shares))
    sure = float(shares[top] / shares.sum()) * (float(lead[top] / lead.sum()) if len(chosen) == 1 else 1.0)
    return shares, min(1.0, max(0.0, sure))


def _predict(sent):
    def run(batches):
        langs, logp = sent.value
        for b in batches:
            pred, score, shares = [], [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                if not text or not langs or not any(map(str.isalpha, text[:64])) and not any(map(str.isalpha, text)):
                    pred.append("und")
                    score.append(0.0)
                    shares.append([])
                    continue
                s, sure = mixture(grams(text), logp)
                pred.append(langs[int(np.argmax(s))])
                score.append(sure)
                shares.append([(langs[k], float(s[k])) for k in np.flatnonzero(s > 0)])
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(pred), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=[*b.schema.names[:-1], "lang_pred", "score", "shares"],
            )

    return run


def identify(docs: DataFrame, model: tuple, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares) for each row, from the whole text alone.

    lang_pred: the language with the largest share; ``und`` (score 0) for null texts and texts without a letter, or if no
    language was learned.  shares: the languages selected, with their proportions.  Repeated rows and null ids are judged
    each by itself; languages of equal share: the first in code point order.  An empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(_predict(sent), "id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def held_out(ident: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4 (a null id: not)."""
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 4 == 2, F.lit(False))


def op2_language(spark, sf_dir: str) -> DataFrame:
    """identify() all documents by models of those not held out; nulls, texts without letters and empty tables as there."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()), "text", "lang", "doc_id")
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "shares")
