"""Nearest neighbours, phrases and fill-in-middle against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skuweave.llm import ann, infill, phrases, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Nearest neighbours


def brute_nearest(rows, every=20, k=20):
    """(query, rank, id, score) over rows (id, vector), a null id last in ties; repeated queries once."""
    ok = [(i, tuple(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in set(ok):
        if q is None or q % every:
            continue
        others = list(ok)
        others.remove((q, v))
        scored = sorted((-float(np.dot(v, w)), i is None, i or 0) for i, w in others if len(w) == len(v))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return out


def same(got, want):
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], r[1], r[2]) for r in want)
    assert sorted(r[3] for r in got) == pytest.approx(sorted(r[3] for r in want), abs=1e-12)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")


def test_nearest_small_tables_exactly(spark):
    """Ties, copies, repeated rows, one id with two vectors, null ids, odd vectors, several lengths: no more rows than are scored exactly."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 6).tolist()) for i in range(60)] + [(i, [1, 1, 1, 0, 0, 0]) for i in range(60, 90)]
    rows += [(40, [1, 2, 1, 0, 0, 0])] * 3 + [(40, [5, 5, 5, 5, 5, 5]), (None, [1, 1, 1, 0, 0, 0]), (None, [9, 9, 9, 0, 0, 0]), (100, None), (120, []), (140, [0, 0, 0, 0, 0, 0])]
    rows += [(160, [1, None, 1, 1, 1, 1]), (180, [float("nan"), 1, 1, 1, 1, 1]), (200, [float("inf"), 1, 1, 1, 1, 1]), (220, [1, 2]), (221, [2, 1]), (240, [3, 3, 3])]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, lists=2).collect()
    same(got, brute_nearest(rows))
    assert not [r for r in got if r.query_id == 240] and [r.vec_id for r in got if r.query_id == 220] == [221]


def test_nearest_hot_vector(spark):
    """A third of all rows are one vector, and many queries are: each query leaves out itself alone, ties go by id."""
    rng = np.random.default_rng(2)
    hot = [0.5] * 8
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(1200)]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, recall=1.0, lists=4, probes=4).collect()
    want = brute_nearest(rows)
    found, true = {(r.query_id, r.vec_id) for r in got}, {(q, i) for q, _, i, _ in want}
    assert len(found & true) >= 0.97 * len(true) and len(got) == len(want)
    exact = {q for q, _, _, _ in want if q % 3 == 0}
    ties = {(q, i) for q, _, i, s in want if q in exact and abs(s - 2.0) < 1e-9}
    assert ties <= found


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_recall(spark, monkeypatch, kind):
    """Clustered vectors of several norms in 40 dimensions, blocks and batches of a few rows: recall and exact scores."""
    monkeypatch.setattr(ann, "BLOCK", 150)
    monkeypatch.setattr(ann, "BATCH", 20)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 40))
    x = (centers[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 40)) * 0.6) * rng.uniform(0.2, 3, size=(4000, 1))
    x = x.astype(np.float32).astype(np.float64)
    got = ann.nearest(frame(spark, list(enumerate(x.tolist())), kind), F.col("vec_id") % 20 == 0).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    true = {(q, int(i)) for q in range(0, 4000, 20) for i in np.argsort(-score[q])[:20]}
    assert len({(r.query_id, r.vec_id) for r in got} & true) >= 0.93 * len(true)
    assert len(got) == len(true) and all(abs(score[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got)
    by = sorted(got, key=lambda r: (r.query_id, r.rank))
    assert all(a.query_id != b.query_id or (a.rank + 1 == b.rank and a.score >= b.score) for a, b in zip(by, by[1:], strict=False))


def test_tests_drop_most_candidates_and_few_in_reach():
    """The scan itself: far candidates go before the last column block, nearly all candidates in reach survive."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 128))
    x[:60] = x[0] + rng.normal(size=(60, 128)) * 0.3
    model = ann.Model(float(np.linalg.norm(x, axis=1).max()), x[:500], 1, 5)
    cols, q = model.columns(model.placed(x)), model.columns(model.asked(x[:1]))
    full = sum(((a - b) ** 2).sum(axis=1) for a, b in zip(cols, q, strict=True))
    reach = np.array([np.partition(full, 50)[50]])
    kept = set(ann.survivors(q, cols, reach, model.limits)[1].tolist())
    inside = set(np.flatnonzero(full <= reach[0]).tolist())
    assert kept <= {i for i in range(3000) if full[i] <= reach[0] * 1.001} and len(kept) >= 0.9 * len(inside)
    half = ann.survivors(q[: len(q) // 2], [c[:, :] for c in cols[: len(q) // 2]], reach, model.limits)[1]
    assert len(half) < 0.2 * 3000


def test_probes_needed():
    order = {0: [3, 1, 2], 1: [2, 3, 1]}
    assert ann.probes_needed(order, [], 0.9) == 1
    assert ann.probes_needed(order, [(0, 3), (0, 3), (1, 2), (1, 1)], 0.75) == 1
    assert ann.probes_needed(order, [(0, 3), (0, 3), (1, 2), (1, 1)], 0.8) == 3


def test_op11(spark, edge_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_nearest"](spark, edge_dir)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    same(got.collect(), brute_nearest(rows))


# Phrases


def brute_phrases(rows, words=3, least=10, within=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = tuple(re.findall("[^\x20\x09]+", piece))
            totals[lang] += len(ws)
            for m in range(1, words + 1):
                for i in range(len(ws) - m + 1):
                    counts.setdefault(lang, Counter())[ws[i : i + m]] += 1
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= within * a for q, b in found.items()):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, n, totals[lang], -s) for r, (s, a, p, l, n) in enumerate(sorted(kept)[:top])]
    return out


def test_op12(spark, edge_dir, rows):
    got = queries.QUERIES["op12_phrases"](spark, edge_dir).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases([(r.lang, r.text) for r in rows]))


@pytest.mark.parametrize("words,chunk", [(2, 3), (3, 7), (4, 5), (5, 1 << 20)])
def test_phrases_across_chunks(spark, monkeypatch, words, chunk):
    """Chunks of a few words, phrases of up to five, strata with common words; separators, case and other scripts."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = np.random.default_rng(words)
    vocabulary = ["a", "B", "c", "Ärger", "ärger", "漢字", "x y", "d\x00e", "the"]
    rows = []
    for _ in range(60):
        ws = rng.choice(vocabulary, rng.integers(0, 40), p=[0.3, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.1])
        rows.append((["en", "de", None, "und", "e\nn"][rng.integers(5)], "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n"], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for w in ws)))
    rows += [("en", None), (None, ""), ("de", " \t.\n")] + [("en", "the same row again, and the same")] * 12
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("id", F.lit("clash")).withColumn("chunk", F.lit(1)).repartition(3)
    got = phrases.collocations(df, words=words, least=4, top=50)
    want = brute_phrases(rows, words, 4, 50, 50)
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(want) and want


def test_phrase_slices_and_vocabularies(monkeypatch):
    """A text taken in slices is the same words; so is a task that starts its dictionary anew."""
    text = ("Aa bb, cc\tdd " * 50 + "x" * 300 + " ee.").encode()
    whole = b" ".join(phrases._slices(text)).split()
    monkeypatch.setattr(phrases, "SLICE", 13)
    parts = list(phrases._slices(text))
    assert len(parts) > 20 and b" ".join(parts).split() == whole


def test_score_is_exact(spark):
    cases = [(10, 10, 10), (10, 11, 13), (3 * 10**15, 3 * 10**15 + 7, 9 * 10**15), (9_999_999_999_999_999, 9_999_999_999_999_999, 9_999_999_999_999_999), (12, 10**15, 10**15)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert {(r.a, r.l, r.r): r.s for r in got} == {(a, l, r): 1_000_000 * a * a // (l * r) for a, l, r in cases}


@given(st.lists(st.integers(0, 2**63 - 1), max_size=50))
def test_packed_numbers(values):
    x = np.array(values, dtype=np.uint64)
    assert np.array_equal(phrases.unpacked(phrases.packed(x), np.uint64), x)


# Fill-in-middle


def brute_infill(ident, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    h = hashlib.sha256(("42:" + ("" if ident is None else str(ident))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_op13(spark, edge_dir, rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((r.doc_id, *(b := brute_infill(r.doc_id, r.text))[:4], sha(b[4]), sha(r.text or "")) for r in rows)
    got = queries.QUERIES["op13_infill"](spark, edge_dir)
    assert Counter(map(tuple, got.collect())) == want


MARKS = st.lists(st.sampled_from(["<", ">", "P", "S", "M", "<P>", "<S>", "<M>", " ", "\t", "\n", "\x0b", "\x85", " ", "é", "🙂", "wort"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), MARKS), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_infill_against_brute_force(text, ident):
    assert infill.infilled(text, ident) == brute_infill(ident, text)


def test_restored(spark):
    """Texts full of halves of marks, each under many seeds, come back exactly."""
    texts = ["<<P <P>x", "<P", "P> <", "<< <S M>", "a <M", " \n", "", None, "<S<P<M", "S>P>M> x y", "ä<P ö>ü<", "\ttab  two "]
    df = spark.createDataFrame([(i, t) for i in range(120) for t in texts], "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("n", F.lit("clash"))
    out = infill.fill_in_middle(df)
    back = out.select("id", "form", infill.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert Counter((r.id, r.text) for r in back) == Counter((i, t or "") for i in range(120) for t in texts)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_a_text_of_a_million_words(spark, tmp_path):
    """One very long text beside short ones: phrases and fill-in-middle take it whole."""
    long = " ".join(f"w{i % 997}" for i in range(1_000_000)) + "\n tail"
    df = spark.createDataFrame([(2, "short one"), (4, None)], "doc_id long, text string").unionByName(
        spark.range(1).select(F.lit(6).cast("long").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda i: F.concat(F.lit("w"), (i % 997).cast("string"))), " "), F.lit("\n tail")).alias("text"))
    )
    got = {r.id: (r.n, r.output_sha256) for r in infill.fill_in_middle(df).collect()}
    n, _, _, _, output = brute_infill(6, long)
    assert got[6] == (n, hashlib.sha256(output.encode()).hexdigest()) and n == 1_000_001
    best = phrases.collocations(df.withColumn("lang", F.lit("xx"))).collect()
    assert sorted(tuple(r)[:8] for r in best) == sorted(brute_phrases([("xx", long), ("xx", "short one")])) and len(best) == 997


def test_a_million_words_through_the_other_operators(spark, tmp_path):
    """A text of a million words beside its near copy and a short one: counted, compared, packed and encoded as a whole."""
    n = 1_000_000
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i), F.lit(50_000)).cast("string")))
    long = spark.range(2).select(F.col("id").alias("doc_id"), F.concat(F.array_join(words, " "), F.when(F.col("id") == 1, "\na last line that is longer").otherwise("\nshort")).alias("text"))
    docs = long.unionByName(spark.createDataFrame([(2, "a short text of six words\na last line that is longer")], "doc_id long, text string"))
    docs = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    run = lambda name: {r[0]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {i: r.size for i, r in run("op1_mix").items()} == {0: n + 1, 1: n + 6, 2: 12}
    assert {i: r.n_dropped for i, r in run("op4_lines").items()} == {0: 0, 1: 1, 2: 1}  # the long line is in both
    near = run("op8_jaccard")
    assert near[1].component_id == 0 and near[2].component_id == 2 and abs(near[0].n_shingles - (n - 3)) < 10
    assert {i: r.n_words for i, r in run("op10_quality").items()} == {0: n + 1, 1: n + 6, 2: 12}
    tokens = run("op7_tokens")
    assert tokens[0].n_tokens > n and tokens[1].start == tokens[0].n_tokens
    assert {r.lang_pred for r in run("op2_language").values()} <= {"en", "und"} and len(run("op6_toxicity")) == 3
    pieces = queries.QUERIES["op5_pack"](spark, str(tmp_path)).where("doc_id = 0").collect()
    assert len({r.piece for r in pieces}) == len(pieces) > 500 and max(r.length for r in pieces) == 2048
