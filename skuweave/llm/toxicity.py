"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import cut, documents
from skuweave.llm.langid import held_out

#: Labelled documents that the lexicon is learned on, at most about; chosen by a hash of the id.
TRAIN = 30_000
#: A term is learned if it is in so many toxic documents, so large a part of those that hold it are toxic, and its
#: evidence passes at this level over all candidates (Bonferroni).
MIN_TOXIC, PURITY, LEVEL = 3, 0.9, 0.05
#: Lengths of word beginnings that are terms of their own.
STEMS = (3, 4, 5, 6, 7, 8)
#: Words for each match over which its evidence halves.
FADE = 4000

# Characters that look like Latin letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕһԁѵԝмткнвɡαορντικυβı", "aeopcyxijshdvwmtkhbgaopvtikubi")
# Digits and signs that stand for letters inside a word; some stand for one of two.
DIGITS = [str.maketrans("0134578@$!|", "oieastbasil"), str.maketrans("0134578@$!|", "oleastbasll")]

_MIXED = re.compile(r"(?=\S*[^\W\d_])(?=\S*[0-9@$!|])\S+")
_EITHER = re.compile("[1!]")
_ALIKE = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "]")
_WORD = re.compile(r"[\w@$!|]+")
_LATIN = re.compile("[a-zà-öø-ÿœß]")


def _class(test) -> str:
    """The characters for which test holds, as the inside of a regular expression's class."""
    out, start = [], None
    for c in range(0x110001):
        ok = c < 0x110000 and test(c)
        if ok and start is None:
            start = c
        elif not ok and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: All but letters of any script and the marks that are part of words in some (not the accents for any letter).
_OTHER = re.compile("[^ " + _class(lambda c: unicodedata.category(chr(c))[0] in "LM" and not 0x300 <= c < 0x370) + "]+")
_OTHER_ASCII = re.compile("[^a-z ]+")
#: Runs of letters of scripts that put no spaces between words; pieces of such lengths are terms wherever they stand.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2,}")
PIECES = (2, 3, 4)
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def folds(text: str) -> list:
    """The text with a space before and after each word: homoglyphs and digit substitutions undone, marks dropped.

    Letters of all scripts stay.  Homoglyphs are undone in words that hold Latin letters too; words of look-alikes alone
    are left as they are, and undone in readings of their own.  One to four readings, of the same length, for these and
    for signs that stand for one of two letters; the first is the text's own.
    """
    texts, other = [text.lower()], _OTHER_ASCII
    if not text.isascii():
        text, other = _HIDDEN.sub("", unicodedata.normalize("NFKC", text).lower()), _OTHER
        texts = [text]
        if _ALIKE.search(text):
            texts = [_WORD.sub(lambda m: m[0].translate(HOMOGLYPHS) if _LATIN.search(m[0]) else m[0], text)]
            if _ALIKE.search(texts[0]):
                texts.append(text.translate(HOMOGLYPHS))

    def reading(text, table):
        def digits(m):
            word = m[0]
            core = word.strip(".,;:!?()[]\"'")
            return word.replace(core, core.translate(table), 1) if core else word

        return " " + " ".join(other.sub(" ", _MIXED.sub(digits, text)).split()) + " "

    tables = DIGITS if _EITHER.search(text) else DIGITS[:1]
    return list(dict.fromkeys(reading(t, table) for t in texts for table in tables))


def fold(text: str) -> str:
    return folds(text)[0]


def terms_of(folded: str) -> set:
    """Terms of a folded text: whole words as `` word ``, their beginnings as `` begin``, pieces of unspaced runs."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for k in STEMS:
        out.update(" " + w[:k] for w in words if len(w) > k)
    if not folded.isascii():
        for run in set(_UNSPACED.findall(folded)):
            out.update(run[i : i + k] for k in PIECES for i in range(len(run) - k + 1))
    return out


def _toxic_terms(batches):
    found = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            found.update(terms_of(fold(text or "")))
    yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "toxic"])


def _clean_terms(sent):
    def run(batches):
        found, candidates = Counter(), sent.value
        for b in batches:
            for text in b.column(0).to_pylist():
                found.update(terms_of(fold(text or "")) & candidates)
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "clean"])

    return run


def _phrases(sent):
    """Counts, by label, of two-word phrases around matches: what stands before and after each."""

    def run(batches):
        scorer = Scorer(sent.value)
        found: dict = {True: Counter(), False: Counter()}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded = fold(text or "")
                around = set()
                for start in scorer.matches(folded):
                    end = folded.index(" ", start + 1)
                    before = folded.rfind(" ", 0, start) if start else -1
                    after = folded.find(" ", end + 1)
                    if before >= 0:
                        around.add(folded[before : end + 1])
                    if after >= 0:
                        around.add(folded[start : after + 1])
                found[bool(label)].update(around)
        keys = list(found[True] | found[False])
        yield pa.record_batch([pa.array(keys, pa.string()), *(pa.array([found[x][k] for k in keys], pa.int64()) for x in (True, False))], names=["phrase", "toxic", "clean"])

    return run


def evidence(toxic: int, clean: int, base: float) -> float:
    """Log likelihood ratio of so many toxic among the documents that hold a term, against the base rate."""
    part = toxic / max(1, toxic + clean)
    if part < PURITY or not 0 < base < part:
        return 0.0
    return toxic * math.log(part / base) + (clean * math.log((1 - part) / (1 - base)) if clean else 0.0)


def choose(counts: list, holders: dict, n_toxic: int, n_clean: int, sure: float) -> dict:
    """Terms and weights (log odds) from (term, toxic, clean) counts and the toxic documents that hold each term.

    Terms are taken by evidence, the strongest first, and none whose beginning or continuation is taken already.  A term
    must pass by the toxic documents that aren't explained yet, by two terms taken before: what merely comes along with
    the terms of toxic documents has no evidence left by then.
    """
    base = n_toxic / max(1, n_toxic + n_clean)
    lexicon: dict = {}
    taken: set = set()
    explained: Counter = Counter()
    for _, _, term, toxic, clean in sorted((-evidence(k, c, base), len(t), t, k, c) for t, k, c in counts):
        word = term.rstrip()
        starts = {word[:k] for k in range(2, len(word) + 1)}
        own = holders.get(term, [])
        if word in taken or any(s in lexicon for s in starts) or evidence(sum(explained[d] < 2 for d in own), clean, base) < sure:
            continue
        lexicon[term] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        taken |= starts
        explained.update(own)
    return lexicon


def _holders(sent):
    def run(batches):
        for b in batches:
            ids, terms = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = terms_of(fold(text or "")) & sent.value
                ids += [i] * len(own)
                terms += own
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], names=["row", "term"])

    return run


def learn(labelled: DataFrame, text: str, label: str, ident: str, limit: int = TRAIN) -> dict:
    """A lexicon {term: weight}, exception phrases and the prior log odds, from labelled rows.

    Counted on a sample of about ``limit`` rows with a label (all rows, if there are no more), which a hash of the id
    picks.  Candidates are words and beginnings of words in MIN_TOXIC toxic documents of the sample or more; a second pass
    counts the clean documents that hold them.  A phrase of a match and its neighbour that is found in clean documents (3 or more, nine in ten of
    all) is an exception.
    """
    known = labelled.where(F.col(label).isin(0, 1)).select(F.col(ident).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    rows = known.count()
    part = min(1.0, limit / max(rows, 1))
    if part < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000)) < int(part * 1_000_000))
    known = cut(known.repartition(16))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    spark = labelled.sparkSession
    toxic = known.where("label = 1").select("text").mapInArrow(_toxic_terms, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("toxic"))
    top = toxic.where(F.col("toxic") >= MIN_TOXIC).orderBy(F.desc("toxic"), "term").collect()  # of the bounded sample
    candidates = spark.sparkContext.broadcast({r.term for r in top})
    clean = known.where("label = 0").select("text").mapInArrow(_clean_terms(candidates), "term string, clean long").groupBy("term").agg(F.sum("clean").alias("clean"))
    held = {r.term: r.clean for r in clean.collect()}
    sure, base = math.log(max(1, len(top)) / LEVEL), n_toxic / max(1, n_toxic + n_clean)
    passed = [(r.term, r.toxic, held.get(r.term, 0)) for r in top if evidence(r.toxic, held.get(r.term, 0), base) >= sure]
    wanted = spark.sparkContext.broadcast({t for t, _, _ in passed})
    holders: dict = {}
    rows = known.where("label = 1").select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_holders(wanted), "row long, term string")
    for r in rows.collect():  # toxic documents of the bounded sample only
        holders.setdefault(r.term, []).append(r.row)
    model = {"lexicon": choose(passed, holders, n_toxic, n_clean, sure), "prior": math.log((n_toxic + 1) / (n_clean + 10)), "exceptions": {}}
    sent = spark.sparkContext.broadcast(model)
    around = known.select("label", "text").mapInArrow(_phrases(sent), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    free = around.where((F.col("clean") >= 3) & (F.col("clean") >= 9 * F.col("toxic"))).orderBy(F.desc("clean"), "phrase").collect()
    return model | {"exceptions": {r.phrase: r.clean for r in free}}


class Scorer:
    """Scores texts by a lexicon, through one automaton over terms and exception phrases."""

    def __init__(self, model: dict):
        self.prior = model["prior"]
        self.automaton = ahocorasick.Automaton()
        for term, weight in model["lexicon"].items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in model["exceptions"]:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> dict:
        """Where terms begin outside exception phrases, with their weights (of several terms the largest)."""
        hits, free = {}, []
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    free.append((start, end))
                else:
                    hits[start] = max(hits.get(start, 0.0), weight)
        if free:
            hits = {s: w for s, w in hits.items() if not any(a <= s < z for a, z in free)}
        return hits

    def __call__(self, text: str | None) -> tuple[float, int]:
        """Probability that the label is 1, and the number of matches outside exceptions."""
        folded, *other = folds(text or "")
        hits = self.matches(folded)
        for reading in other:
            hits = self.matches(reading) | hits
        n_words = folded.count(" ") - 1
        # Normalised by length: evidence counts by words for each match.
        total = sum(hits.values()) / (1 + max(0, n_words) / (FADE * max(1, len(hits))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + total)))), len(hits)


def _score(sent):
    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            found = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["id", "score", "n_matches"])

    return run


def toxicity(docs: DataFrame, model: dict, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, n_matches) for each row, from the whole text alone.

    Null and empty texts get the prior.  Null ids and repeated rows are scored each by itself; of terms that begin at one
    place the heaviest counts.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(_score(sent), "id long, score double, n_matches long")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """toxicity() of all documents by a lexicon of those not held out; a document with both labels counts as toxic."""
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    labelled = docs.select("doc_id", "text").join(known, "doc_id")
    out = toxicity(docs, learn(labelled, "text", "toxic", "doc_id"))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")
