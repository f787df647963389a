"""Signals, scores, blocking, questions and sources: fixed cases and properties."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuweave.functions import enrich as E
from skuweave.functions import text as T
from skuweave.functions.signals import search_terms, with_signals
from skuweave.operators import match as M
from skuweave.operators import retrieval as R
from skuweave.operators import postings as P
from skuweave.operators import score as S
from skuweave.operators import vectors as V
from skuweave.operators import submission as B
from skuweave.plans import questions as Q
from skuweave.sources import ingest as I
from skuweave.sources.pages import deep_collect, deep_get, field, kept_pages, page_counts, page_nodes, parse_pages, read_scraped

PRODUCT = "reference string, name string, brand string, ean string, specifications map<string,string>"


def products(spark, *rows):
    full = [(r.get("reference", f"R{i}"), r.get("name"), r.get("brand"), r.get("ean"), r.get("specifications")) for i, r in enumerate(rows)]
    return with_signals(spark.createDataFrame(full, PRODUCT))


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    given = ["Hello World", "Kühlschrank", "Geschirr spüler", "TV & Audio", None, "Heißluftfritteuse", "Łódź ½"]
    assert column(spark, given, T.normalize) == ["hello world", "kuhlschrank", "geschirr spuler", "tv and audio", "", "hei luftfritteuse", "odz 1 2"]
    once = column(spark, given, T.normalize)
    assert column(spark, once, T.normalize) == once


def test_canonical_url(spark):
    given = ["http://www.Shop.at//a//b/?q=1#x", "HTTPS://amazon.de/x/dp/B0ABCDEFGH/ref=1", "//x.at/a", "  ", None, "https://e-tec.at/details.php?artnr=1", "https://x.at/a b/"]
    want = ["http://shop.at/a/b", "https://amazon.de/dp/B0ABCDEFGH", "https://x.at/a", None, None, "https://e-tec.at/details.php", "https://x.at/a b"]
    assert column(spark, given, T.canonical_url) == want
    kept = [u for u in want if u]
    assert column(spark, kept, T.canonical_url) == kept


def test_prices(spark):
    assert column(spark, ["1.299,00", "299.99", "12", "0", "x", None], T.coerce_price) == [1299.0, 299.99, 12.0, None, None, None]
    assert column(spark, ["kostet € 1.299,50 nur", "99,90 EUR", "nichts"], T.price_from_text) == [1.29, 99.9, None]
    assert column(spark, ["10", "10.5", "50000", "abc"], T.clean_price) == [None, 10.5, None, None]


def test_slug(spark):
    assert column(spark, ["https://x.at/p/Bosch_Waschmaschine-Serie-6-12345.html", "https://x.at/a%20b+c"], T.url_slug_name) == ["Bosch Waschmaschine Serie 6", "a b+c"]


def test_signals(spark):
    rows = products(
        spark,
        {"name": "Samsung QE55Q7FAAUXXN QLED 4K TV", "ean": "8806097123057", "specifications": {"Hersteller Modellnummer": "QE55Q7FAAUXXN", "_x": "1"}},
        {"name": "Samsung 55 Zoll Fernseher QLED"},
        {"name": "Bosch Waschmaschine Serie 6", "ean": "123"},
        {"name": "Siemens Geschirrspüler", "specifications": {"Marke": "LG", "GTIN": "4242003867112"}},
        {"name": "Waschtrockner X"},
        {"name": "AEG KDW 6051 B FI", "brand": "Amazon"},
        {"name": None},
        {"name": "Gerät", "specifications": {"Bildschirmdiagonale": "139,7 cm"}},
    ).orderBy("reference").collect()
    a, b, c, d, e, f, g, h = rows
    assert (a.brand_norm, a.eans, a.strong_models, a.kind, a.screen_size_inch) == ("SAMSUNG", ["8806097123057"], ["QE55Q7FAAUXXN"], "tv", None)
    assert (b.brand_norm, b.kind, b.screen_size_inch) == ("SAMSUNG", "tv", 55.0) and "QLED" not in b.strong_models
    assert (c.kind, c.eans, c.tokens) == ("washer", [], ["bosch", "serie", "waschmaschine"])
    assert (d.brand_norm, d.kind, d.eans) == ("LG", "dishwasher", ["4242003867112"])
    assert e.kind == "dryer"
    assert f.brand_norm == "AEG" and f.strong_models == [] and {"KDW6051B", "KDW6051"} <= set(f.family_models)
    assert (g.name_norm, g.brand_norm, g.kind, g.tokens) == ("", None, None, [])
    assert h.screen_size_inch == 55.0


def scored(spark, a, b, threshold=0.8):
    s, t = products(spark, a | {"reference": "S"}), products(spark, b | {"reference": "T"}).withColumn("listing_id", F.lit(1))
    pairs = S.flags(M.pair_up(s.select(F.col("reference").alias("s_id")).crossJoin(t.select(F.col("listing_id").alias("t_id"))), s, t))
    return S.scores(pairs, S.sequence_ratio("s_name_norm", "t_name_norm"), threshold).first()


def test_scores(spark):
    r = scored(spark, {"name": "Samsung TV", "ean": "8806097123057"}, {"name": "Samsung Television", "ean": "8806097123057"})
    assert r.matched and r.score == 0.99 and r.method == "gtin" and r.reasons[0] == "ean_exact"
    r = scored(spark, {"name": "Samsung X", "brand": "Samsung"}, {"name": "LG X", "brand": "LG"})
    assert not r.matched and r.score == 0 and r.method == "brand_conflict"
    r = scored(spark, {"name": "Samsung 55 Zoll TV"}, {"name": "Samsung 65 Zoll TV"})
    assert r.method == "size_conflict"
    r = scored(spark, {"name": "Samsung QE55Q7FAA", "ean": "8806097123057"}, {"name": "Samsung QE65Q8FAA", "ean": "8806097123057"})
    assert (r.score, r.method) == (0.0, "model_conflict")
    same = {"name": "Samsung QLED Fernseher 55 Zoll", "ean": "8806097123057"}
    r = scored(spark, same, same)
    assert (r.score, r.method, r.reasons[0]) == (0.89, "name_sim", "ean_exact")
    r = scored(spark, {"name": "Samsung QE55Q7FAAUXXN", "specifications": {"Modellnummer": "QE55Q7FAAUXXN"}}, {"name": "TV QE55Q7FAAUXXN"})
    assert r.matched and r.score >= 0.9 and r.method == "model"


def test_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(S.sequence_ratio("a", "b")).collect()] == [0.25, 0.5, 0.0]


def test_blocking_loses_nothing(spark):
    brands, kinds, sizes = ["Samsung", "LG", "Bosch", ""], ["Fernseher", "Toaster", "", "Waschmaschine"], [" 55 Zoll", " 56 Zoll", " 65 Zoll", ""]
    names = [f"{b} {k} KX1{i % 7}{i % 3}B{z} wort{i % 4}".strip() for i, (b, k, z) in enumerate((b, k, z) for b in brands for k in kinds for z in sizes)]
    rows = [{"name": n, "ean": f"44444444{i % 9:05d}" if i % 3 else None, "reference": f"P{i % 40}"} for i, n in enumerate(names)]
    s = products(spark, *rows[:40])
    t = products(spark, *rows).withColumn("listing_id", F.monotonically_increasing_id()).withColumn("retailer", F.lit("x"))
    t = spark.createDataFrame(t.collect(), t.schema)
    got = {(r.s_id, r.t_id): (r.score, r.method) for r in M.match(s, t).collect()}
    every = S.flags(M.pair_up(s.select(F.col("reference").alias("s_id")).crossJoin(t.select(F.col("listing_id").alias("t_id"))), s, t, extra=("reference",)))
    want = {}
    for r in S.scores(every, S.sequence_ratio("s_name_norm", "t_name_norm")).collect():
        if r.s_reference == r.t_reference:
            want[r.s_id, r.t_id] = (1.0, "direct_ref")
        elif r.matched:
            want[r.s_id, r.t_id] = (r.score, r.method)
    assert got == want and len(want) > 50
    # A lower threshold has other blocks: single evidence with likeness of words.
    low = {(r.s_id, r.t_id): r.score for r in M.match(s, t, threshold=0.55, extra=()).collect()}
    assert low == {(r.s_id, r.t_id): r.score for r in S.scores(every, S.sequence_ratio("s_name_norm", "t_name_norm"), 0.55).collect() if r.matched} and len(low) > 200
    with pytest.raises(ValueError):
        M.match(s, t, threshold=0.5)


def test_ratio_runs_once_on_few_pairs(spark):
    """One Arrow node, above the shuffle that deals the pairs anew; the letters leave out pairs that lengths let through."""
    letter = lambda i: chr(97 + i % 20)
    names = [" ".join(["Fernseher 55 Zoll", *(letter(i * k) * (4 + k) for k in (1, 3, 7, 9))]) for i in range(120)]
    s = products(spark, *[{"name": n, "brand": "Samsung"} for n in names])
    t = s.withColumn("listing_id", F.monotonically_increasing_id()).withColumn("retailer", F.lit("x"))
    out = M.match(s, t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("Exchange hashpartitioning(s_id") > plan.index("ArrowEvalPython")
    pairs = S.flags(M.candidates(s, t, extra=("reference",))).where("veto is null")
    by = lambda bound: S.scores(pairs, bound).where("matched").count()
    lengths = F.when(F.length("s_name_norm") > 0, 2.0 * F.least(F.length("s_name_norm"), F.length("t_name_norm")) / (F.length("s_name_norm") + F.length("t_name_norm")))
    exact, bags, long = by(S.sequence_ratio("s_name_norm", "t_name_norm")), by(S.ratio_bound(F.col("s_letters"), F.col("t_letters"))), by(lengths)
    assert exact <= bags < long
    over = pairs.where(S.sequence_ratio("s_name_norm", "t_name_norm") > S.ratio_bound(F.col("s_letters"), F.col("t_letters")) + 1e-12)
    assert over.count() == 0


def test_stored_targets_are_not_shuffled(spark, tmp_path):
    """Matching against a bucketed table: only the sources are shuffled by key, filters on its folders leave others unread, same matches."""
    names = [f"Samsung OLED Fernseher {n} {m}" for n in ("55 Zoll", "65 Zoll", "") for m in ("QE55Q7F", "KX101B", "GQ65S90", "")]
    s = products(spark, *[{"name": n, "ean": f"400000000000{i % 10}"} for i, n in enumerate(names)])
    t = s.withColumn("listing_id", F.monotonically_increasing_id()).withColumn("retailer", F.lit("x")).withColumn("visible", F.col("listing_id") % 2 == 0).withColumn("category", F.concat(F.lit("c"), (F.col("listing_id") % 3).cast("string")))
    name = f"matchable_{tmp_path.name}".replace("-", "_")
    M.write_matchable(t, name, str(tmp_path / "t"), by=("visible", "category"), buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.table(name)
        joined = M._meet(M._source_side(s, "reference", 0.8), table.where("visible and category = 'c1'").withColumnsRenamed({c: f"t_{c}" for c in ("visible", "category")}))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("FileScan parquet") :]
        assert plan.count("Exchange hashpartitioning(key") == 1 and "Bucketed: true" in scan and "PartitionFilters: [isnotnull(visible" in scan.replace("t_visible", "visible")
        got = {(r.s_id, r.t_id, r.score, r.method) for r in M.match_stored(s, table, by=("visible", "category")).collect()}
        assert got == {(r.s_id, r.t_id, r.score, r.method) for r in M.match(s, t).collect()} and got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE {name}")


def test_letters_count_as_often_as_they_occur(spark):
    df = spark.createDataFrame([("aab", "abb"), ("", "a"), (None, "a"), ("x y x", "yxxx ")], "a string, b string")
    from collections import Counter

    got = df.select("a", "b", F.size(S.letters(F.col("a"))).alias("n"), S.ratio_bound(S.letters(F.col("a")), S.letters(F.col("b"))).alias("r")).collect()
    for r in got:
        common = sum((Counter(r.a or "") & Counter(r.b)).values())
        assert r.n == len(r.a or "") and r.r == (2 * common / (len(r.a) + len(r.b)) if r.a else 0.0)


def test_weighted_exact_meets_only_what_passes(spark):
    s = spark.createDataFrame([(1, "a", "k", None), (2, "a", None, "e"), (3, None, None, None), (4, "b", "k", "f")], "s int, brand string, kind string, ean string")
    t = spark.createDataFrame([(1, "a", "k", "e"), (2, "b", "k", "f"), (3, "a", "x", None), (4, None, None, None)], "t int, brand string, kind string, ean string")
    w = {"brand": 0.5, "kind": 0.3, "ean": 1.0}
    got = {(r.s_id, r.t_id): round(r.score, 6) for r in M.weighted_exact(s, t, w, 0.8, "s", "t").collect()}
    want = {}
    for a in s.collect():
        for b in t.collect():
            score = round(sum(x for f, x in w.items() if a[f] is not None and a[f] == b[f]), 6)
            if score >= 0.8:
                want[a.s, b.t] = score
    assert got == want == {(1, 1): 0.8, (2, 1): 1.5, (4, 2): 1.8}


def test_payload_filter_and_vectors(spark):
    df = spark.createDataFrame([(1, "c", "tv", 5.0, 55.0, "Zoll"), (2, "c", "tv", None, None, None), (3, "c", "tv", 50.0, 55.0, "cm"), (4, "d", "tv", 5.0, 55.0, "Zoll")], "i int, category string, product_type string, price_eur double, size double, size_unit string")
    ids = lambda **k: [r.i for r in R.payload_filter(df, **k).orderBy("i").collect()]
    assert ids(category="c", price=(1, 10)) == [1, 2] and ids(price=(1, 10), price_or_null=False) == [1, 4]
    assert ids(size=(50, 60), size_unit="Zoll") == [1, 2, 4] and ids(size=(50, 60)) == [1, 2, 3, 4] and ids(product_type="hob") == []
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [2.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in R.cosine_topk(v, v.where("vec_id in (1, 5)"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 6, 1), (1, 2, 2)]


def test_vector_index_is_exact_and_skips(spark, tmp_path):
    """Clustered vectors of two lengths, odd ones, ties: as a full scan finds them, from a part of the cells and pairs; also after more are added."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 12))
    x = [(i, (centers[i % 40] + rng.normal(size=12) * 0.15).tolist()) for i in range(3000)] + [(i, [1.0, float(i % 3), 2.0]) for i in range(3000, 3040)]
    x += [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (None, [1.0] * 12)] + [(6000 + i, x[7][1]) for i in range(15)]
    more = [(7000 + i, (centers[i % 40] * 1.5 + rng.normal(size=12) * 0.2).tolist()) for i in range(200)]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path, asked = str(tmp_path / "v"), df([r for r in x if r[0] in (7, 100, 2999, 3001, 5000, 5001)] + [(9999, [1.0] * 12)])
    V.write_index(df(x), path)
    for rows in (x, x + more):
        if rows is not x:
            V.add_to_index(df(more), path)
        found = V.search_index(path, asked, 12)
        want = {(r.query_id, r.vec_id, r["rank"]) for r in R.cosine_topk(df(rows), asked, 12).collect()}
        assert {(r.query_id, r.vec_id, r["rank"]) for r in found.rows.collect()} == {w for w in want if w[0] != 5002}
        assert found.looked < 0.5 * found.cells and found.compared < 0.3 * found.pairs


def test_vector_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    V.write_index(empty, str(tmp_path / "v"))
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert V.search_index(str(tmp_path / "v"), some, 5).rows.count() == 0
    V.add_to_index(some, str(tmp_path / "v"))
    assert [r.vec_id for r in V.search_index(str(tmp_path / "v"), some.withColumn("vec_id", F.lit(2)), 5).rows.collect()] == [1]


def test_postings_score_as_a_scan_does(spark, tmp_path):
    """Stored postings against bm25() over all documents, with and without a filter and a least score; most postings are left alone."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words, 5 + i % 60, p=np.arange(400, 0, -1) / 80200)) + (" rare gem" if i % 500 == 3 else ""), "ab"[i % 2], float(i % 50)) for i in range(4000)]
    docs += [(4000, None, "a", 1.0), (4001, "", "b", None), (4002, "rare rare gem", "a", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, category string, price_eur double")
    asked = spark.createDataFrame([(1, "rare gem"), (2, "w390 w395 w3"), (3, "nothing known"), (4, None), (5, "gem w0 w1")], "q long, t string")
    P.write_postings(df, str(tmp_path / "p"), ident="doc_id", text="text", keep=("category", "price_eur"), size=32)
    scan = R.bm25(df, asked, 5000, doc_id="doc_id", doc_text="text", query_id="q", query_text="t")
    key = lambda rows: {(r.query_id, r.doc_id, r.score) for r in rows.collect()}
    found = P.search_postings(str(tmp_path / "p"), asked, 6, query_id="q", query_text="t")
    assert key(found.rows) == key(scan.where("rank <= 6")) and found.scored < 0.6 * found.postings
    only = lambda d: R.payload_filter(d, category="a", price=(10, 20))
    some = P.search_postings(str(tmp_path / "p"), asked, 6, query_id="q", query_text="t", only=only, least=1.5)
    fit = only(scan.join(df, "doc_id").where("score > 1.5"))
    want = {(q, d, s) for q in (1, 2, 5) for d, s in sorted(((r.doc_id, r.score) for r in fit.collect() if r.query_id == q), key=lambda x: (-x[1], x[0]))[:6]}
    assert key(some.rows) == want and want


def test_postings_of_nothing(spark, tmp_path):
    P.write_postings(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "p"), ident="doc_id", text="text")
    asked = spark.createDataFrame([(1, "rare gem")], "q long, t string")
    assert P.search_postings(str(tmp_path / "p"), asked, 6, query_id="q", query_text="t").rows.count() == 0


def test_cap_and_filter(spark):
    df = spark.createDataFrame([("s", "r", "name_sim", i / 100, i) for i in range(8)] + [("s", "r", "gtin", 0.5, 100 + i) for i in range(7)], "s_id string, t_retailer string, method string, score double, id int")
    kept = M.cap_per_retailer(df, F.desc("score"), "id").collect()
    assert sum(r.method == "gtin" for r in kept) == 7 and sorted(r.id for r in kept if r.method != "gtin") == [3, 4, 5, 6, 7]
    t = spark.createDataFrame([(1, True, "A", None, "r", None), (2, False, "B", "tv", "r", 5.0), (3, True, "B", "tv", "r", 5.0), (4, True, "A", "hob", "q", 50.0)], "listing_id int, visible boolean, category string, kind string, retailer string, price_eur double")
    assert [r.listing_id for r in M.candidate_filter(t, category="A", kinds=["tv"], max_price=10).orderBy("listing_id").collect()] == [1, 2]


def test_questions(spark):
    said = ["Show TVs under 500 euros from Amazon", "Show all dishwashers", "P_0a7A0D68 and P_0A7A0D68", "under 499.99", "between 100-500", "show me the technology", "between 100 and 300", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, q string")
    r = Q.read_questions(df, "q").orderBy("i").collect()
    assert (r[0].q_max, r[0].q_retailers, r[0].q_kinds) == (500.0, ["Amazon AT"], ["tv"]) and "euros" in r[0].q_anchors
    assert r[1].q_kinds == ["dishwasher"] and r[2].q_refs == ["P_0A7A0D68"]
    assert (r[3].q_max, r[3].q_min) == (499.0, None) and (r[4].q_min, r[4].q_max) == (None, None)
    assert r[5].q_retailers == ["E-Tec"] and (r[6].q_min, r[6].q_max) == (100.0, 300.0) and not r[7].q_anchored


def test_follow_up(spark):
    turns = [(1, 1, "Show all dishwashers"), (1, 2, "Under €400 only"), (1, 3, "toasters"), (1, 4, "only Cyberport"), (2, 1, "under 5")]
    df = spark.createDataFrame(turns, "c int, t int, q string")
    got = {(r.c, r.t): r.q_effective for r in Q.effective_questions(df, "q", "c", "t").collect()}
    assert got == {(1, 1): "Show all dishwashers", (1, 2): "Show all dishwashers Under €400 only", (1, 3): "toasters", (1, 4): "toasters only Cyberport", (2, 1): "under 5"}


def test_search_terms(spark):
    df = products(spark, {"name": "Samsung  QE55Q7FAAUXXN tv", "ean": "8806097123057"})
    assert df.select(search_terms().alias("t")).first().t[:3] == ["8806097123057", "Samsung QE55Q7FAAUXXN", "QE55Q7FAAUXXN"]


def test_upsert_and_validation(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = I.first_wins(spark.createDataFrame([(2, "x"), (2, "y"), (3, "c")], "k int, v string"), ["k"], "v")
    out = I.upsert(now, new, ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "x"), (3, "c")]
    assert sorted(map(tuple, I.upsert(out, new, ["k"]).collect())) == sorted(map(tuple, out.collect()))
    df = spark.createDataFrame([("r", "n"), (None, "n")], "reference string, name string")
    assert I.validate_upload(df).first().asDict() == {"rows": 2, "missing": 1, "valid": False}
    assert I.product_rows(df).count() == 1


def test_json_source(spark, tmp_path):
    (tmp_path / "source_products_small.json").write_text(json.dumps([{"reference": "a", "name": "n", "specifications": {"k": "1.5"}}, {"reference": "b"}]))
    df = I.read_products(spark, str(tmp_path / "*.json"))
    assert df.count() == 2 and df.where("reference = 'a'").first().specifications == {"k": "1.5"}
    assert df.select(I.category_from_file(F.col("_file"))).first()[0] == "small"
    assert I.read_products(spark, str(tmp_path / "none.json")).count() == 0


def test_pages(spark):
    html = '<title>T</title><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Product"],"name":"N","brand":{"name":"B"},"gtin13":"4242003867112","offers":[{"price":"1.299,00"}]}]}</script>'
    df = spark.createDataFrame([(1, "https://www.x.at/a/b-c-1.html", html), (2, "https://x.at/q", "<title>Access denied</title>"), (3, None, None)], "page_id int, url string, html string")
    a, b, c = parse_pages(df).orderBy("page_id").collect()
    assert (a.name, a.brand, a.ean, a.price_eur, a.category, a.host, a.useful) == ("N", "B", "4242003867112", 1299.0, "a", "x.at", True)
    assert not b.useful and not c.useful
    assert column(spark, ['{"a":{"K":"deep"},"b":[{"k":1}]}', "no json", None, '{"k":""}'], deep_get("k")) == ["deep", None, None, None]


def test_page_data_beside_products(spark):
    html = '<script id="__NEXT_DATA__" type="x">{"props":{"productName":"Deep","ean":"4242003867112","x":[{"price":12.5}]}}</script>'
    ld = '<script type="application/ld+json">{"@type":"Product","name":"P","color":"red","additionalProperty":[{"name":"Watt","value":900}],"description":"d"}</script>'
    df = spark.createDataFrame([(1, "https://x.at", html), (2, "https://x.at", ld), (3, "https://x.at", '<script type="application/ld+json">{broken</script>')], "i int, url string, html string")
    a, b, c = parse_pages(df).orderBy("i").collect()
    assert (a.name, a.ean, a.price_eur, a.specifications) == ("Deep", "4242003867112", 12.5, {"ean": "4242003867112"})
    assert (b.name, b.specifications) == ("P", {"Watt": "900", "color": "red", "description": "d"}) and not c.useful


def test_deep_get_in_the_order_of_the_page(spark):
    deep = '{"a":' * 400 + '{"k": 7}' + "}" * 400
    given = ['{"b":1,"a":2}', '{"K":null,"k":1}', '{"x":{"a":3},"y":[{"b":4}]}', '{"x":[{"z":1},{"B":5}],"a":{}}', "[]", deep]
    assert column(spark, given[:5], deep_get("a", "b")) == ["1", None, "3", "5", None]
    assert column(spark, [given[1], deep], deep_get("k")) == ["1", "7"]
    assert column(spark, ['{"a":{"k":1,"b":{"K":[2]}},"k":"x","l":[{"k":""},{"k":3}]}', None], deep_collect("k")) == [["1", "[2]", "x", "3"], []]
    df = spark.createDataFrame([('{"specifications":{"GTIN":"1"},"a.b":2}',)], "doc string")
    assert df.select(field("doc", "specifications.GTIN"), field("doc", "specifications.none"), field("doc", "x.y")).first()[:] == ("1", None, None)


def test_specifications_of_pages(spark):
    ld = '{"@type":"Product","url":"u","image":"http://i","brand":"b","material":{"name":"steel"},"sku":5,"additionalProperty":[{"propertyID":"P","unitText":"kg"},{"name":"N","value":0}],"description":"' + "d" * 900 + '"}'
    data = '{"x":{"details":{"a":1,"b":{"c":2}},"featuresList":[{"label":"L","data":"D"},{"attribute":"A","val":0}]},"weight":"3 kg","brand":"B2"}'
    html = f'<script type="application/ld+json">{ld}</script><script>window.__INITIAL_STATE__ = {data};</script>'
    df = spark.createDataFrame([(1, "https://x.at/pdp/tv-audio/samsung-tv~p123.html", html)], "i int, url string, html string")
    r = parse_pages(df).first()
    assert r.specifications == {"material": "steel", "sku": "5", "P": "kg", "N": "0", "description": "d" * 800, "a": "1", "L": "D", "weight": "3 kg", "brand": "B2"}
    assert (r.category, r.brand, r.image_url) == ("tv audio", "b", "http://i")


def test_page_nodes_in_the_order_of_search(spark):
    """An object's own values come before what is below them; lists in lists are at any depth; texts that aren't JSON are none."""
    ld, data = ['[[{"a":{"b":1},"c":[]}],{"d":null}]', "{broken", None], ['{"x":"y"}; var z = {};', "[]"]
    df = spark.createDataFrame([(ld, data)], "ld array<string>, data array<string>")
    nodes = df.select(F.explode(page_nodes("ld", "data")).alias("n")).select("n.*").orderBy("at").collect()
    got = [(n.blob, n.ld, n.of, n.via, n.key, n.deep, n.kind, n.filled, n.text) for n in nodes]
    assert got == [
        (0, True, -1, None, None, 0, "l", True, None), (0, True, -1, None, None, 1, "l", True, None), (0, True, -1, None, None, 2, "o", True, None),
        (0, True, 2, "a", "a", 0, "o", True, None), (0, True, 2, "c", "c", 0, "l", False, None), (0, True, 3, "b", "b", 0, "n", True, "1"),
        (0, True, -1, None, None, 1, "o", True, None), (0, True, 6, "d", "d", 0, None, False, None), (1, False, -1, None, None, 0, "o", True, None), (1, False, 8, "x", "x", 0, "s", True, "y"),
    ]


def test_pages_of_odd_shapes(spark):
    """Values of other types than expected say nothing and stop nothing; what comes first counts."""
    product = lambda **x: json.dumps({"@type": "Product", **x})
    cases = [
        ([product(name=5, brand=["b"], offers=7, image={"url": "http://o"}, category={"name": "c"}, additionalProperty="x")], [], (None, None, None, "http://o", None, None)),
        ([product(name=" ", title="T2", brand={"name": " "}, maker="M"), '{"@type":"Product","name":"later"}'], [], ("later", None, None, None, None, None)),
        ([product(offers=[{"price": "x", "lowPrice": 0.1, "highPrice": "7,50"}], gtin8="1234", mpn="12345678", image=["ftp://x", "http://no"], thumbnail="http://t")], [], (None, None, 7.5, None, None, "12345678")),
        (['[{"@graph":[{"@type":"ProductGroup","name":"graph"}]},{"@type":"Product","name":"block"}]'], [], ("graph", None, None, None, None, None)),
        (['{"@type":"BreadcrumbList","itemListElement":[{"item":"x"},{"name":3},7,{"item":{"name":" b "}}]}'], [], (None, None, None, None, "3 > b", None)),
        ([], ['{"breadcrumb":["a",{"name":"","item":"i","title":"t"}],"price":null,"x":{"PRICE":"12"}}', '{"name":"n","title":"tt"}'], (None, None, 12.0, None, "i", None)),
    ]
    df = spark.createDataFrame([(k, "https://x.at", ld, data) for k, (ld, data, _) in enumerate(cases)], "i int, url string, ld array<string>, data array<string>")
    got = parse_pages(df, ld="ld", data="data").orderBy("i").collect()
    assert [(r.name, r.brand, r.price_eur, r.image_url, r.category, r.ean) for r in got] == [c[2] for c in cases]
    assert got[0].specifications == {"category": "c", "additionalProperty": "x"} and got[2].specifications == {"gtin8": "1234", "mpn": "12345678", "thumbnail": "http://t"}


def test_every_assignment_of_a_script_is_read(spark):
    html = '<script>window.__DATA__ = {"name":"first };"}; var y = 1; window.__STORE__=[{"ean":"4242003867112"}] ; f();</script>'
    r = parse_pages(spark.createDataFrame([("https://x.at", html)], "url string, html string")).first()
    assert (r.name, r.ean) == ("first };", "4242003867112")


def test_scraped_files(spark, tmp_path):
    rows = [
        {"url": "https://www.e-tec.at/details.php?artnr=+77+", "retailer": "E-Tec", "page_title": "Attention Required! | Cloudflare", "search_result": {"title": "Bosch Mixer | Amazon", "description": "ab 49,90 € bei uns", "thumbnail": "https://i/1"}},
        {"url": "https://x.at/a", "error": "timeout", "page_title": "T"},
        {"url": "", "page_title": ""},
        {"url": "https://x.at/b/c~p12", "next_data": {"product": {"title": "Deep Title", "gtin": "4242003867112"}}, "hydration_data": [{"data": {"preis": "1.299,00"}}], "source_name": "Miele Ofen"},
    ]
    (tmp_path / "raw_a.json").write_text(json.dumps(rows))
    out = parse_pages(read_scraped(spark, [str(tmp_path / "raw_a.json"), str(tmp_path / "none.json")]), ld="ld", data="data")
    a, d = sorted(kept_pages(out).collect(), key=lambda r: r.retailer is None)
    assert (a.name, a.brand, a.price_eur, a.image_url) == ("Bosch Mixer", "Bosch", 49.9, "https://i/1")
    assert (d.name, d.brand, d.ean, d.price_eur) == ("Deep Title", "Miele", "4242003867112", 1299.0)
    assert page_counts(out).first()[:] == (2, 1, 1)


def test_seed_files_and_stamps(spark, tmp_path):
    for folder, file, name in (("data", "source_products_tv.json", "old"), ("output", "source_products_tv.json", "new"), ("data", "source_products_small_things.json", "small")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / file).write_text(json.dumps([{"reference": name, "name": name}, {"reference": None, "name": "x"}]))
    got = {(r.name, r.category) for r in I.read_seed(spark, "source_products_*.json", str(tmp_path / "data"), str(tmp_path / "output")).collect()}
    assert got == {("new", "tv"), ("small", "small things")}
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = I.upsert_stamped(now, spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), ["k"], "2024-01-01")
    assert {(r.k, r.v, r.updated_at is not None) for r in out.collect()} == {(1, "a", False), (2, "x", True), (3, "c", False)}
    assert I.product_rows(spark.createDataFrame([("r", "n", None), ("r", "n", "s")], "reference string, name string, source_reference string")).count() == 1


def shop_hits(text):
    return [(text + " one", "https://x.at/1", 9.5), (text + " two", "https://x.at/2", None)]


def test_search_source(spark):
    from skuweave.sources import search

    search.register(spark)
    read = spark.read.format("product_search").option("queries", '["tv", "hob"]')
    assert read.load().count() == 0
    rows = read.option("provider", "tests.test_matching:shop_hits").load().orderBy("query", "rank").collect()
    assert [(r.query, r["rank"], r.title) for r in rows] == [("hob", 1, "hob one"), ("hob", 2, "hob two"), ("tv", 1, "tv one"), ("tv", 2, "tv two")]


def test_seed_and_pools(spark):
    cols = "reference string, name string, brand string, ean string, category string, price_eur double, retailer string, url string"
    seen = spark.createDataFrame([("a", "n1", None, None, "c", 5.0, "R", "https://x.at/1")], cols)
    more = spark.createDataFrame([("a", "n2", None, None, "c", 5.0, "R", "https://x.at/2"), ("b", "n3", None, None, "d", 50.0, "R", "https://x.at/3"), (None, "n4", None, None, "d", 5.0, "R", None)], cols)
    out = I.seed_targets(seen, more)
    assert sorted((r.reference, r.name, r.visible) for r in out.collect()) == [("a", "n1", True), ("b", "n3", False)]
    out.createOrReplaceTempView("prepared")
    I.register_candidates(spark, "prepared")
    assert [r.reference for r in spark.sql("SELECT * FROM target_candidates('c', p_max => 10)").collect()] == ["a"]
    assert I.not_visited(more, seen, ["reference"]).count() == 2
    hits = spark.createDataFrame([("s", [("Other", "https://x.at/shop/red-ring-12.html"), ("Other", "https://x.at/shop/red-ring-12.html"), ("Expert AT", "https://x.at/list")])], "source_reference string, scraped array<struct<retailer:string,url:string>>")
    assert [(r.name, r.category) for r in I.pool_records(hits).collect()] == [("red ring", "shop")]


def test_unvisited_meets_few(spark):
    """A Bloom filter lets most new keys by, holds all visited ones, and the exact join mends what it can't tell."""
    visited = spark.range(0, 2000).select(F.col("id").alias("k"), F.lit("x").alias("s"))
    df = spark.range(1000, 9000).select(F.col("id").alias("k"), F.lit("x").alias("s"), "id").unionByName(spark.createDataFrame([(None, "x", -1), (5, None, -2), (5, "x", -3)], "k long, s string, id long"))
    got = {r.id for r in I.unvisited(df, visited, ["k", "s"], 1 << 15).collect()}
    assert got == set(range(2000, 9000)) | {-1, -2}
    told = I.may_hold(df, I.bloom_filter(visited, ["k", "s"], 1 << 15), ["k", "s"], "seen", 1 << 15)
    assert told.where("id between 1000 and 1999 and not seen").count() == 0 and 0 < told.where("id >= 2000 and seen").count() < 700
    tight = I.unvisited(df, visited, ["k", "s"], 1 << 7)
    assert {r.id for r in tight.collect()} == got
    assert I.unvisited(df, visited.where("false"), ["k", "s"], 1 << 10).count() == df.count()


def test_report_and_multi_term(spark):
    shown = spark.createDataFrame([("s", "A", None)], "s_id string, retailer string, url string")
    hidden = spark.createDataFrame([("t", "Expert AT", "https://x/list")], "s_id string, retailer string, url string")
    out = {r.retailer: (r.competitors, r.skipped) for r in B.report(shown, hidden, spark.createDataFrame([("s",), ("t",)], "s_id string")).collect()}
    assert out == {"A": (1, 0), "Expert AT": (0, 1), None: (1, 0)}
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue ring ring"), (3, "green")], "d int, t string")
    asked = spark.createDataFrame([("x", "ring"), ("x", "red ring"), ("y", "green")], "source string, term string")
    got = R.bm25_multi(docs, asked, 1, doc_id="d", doc_text="t").collect()
    assert {(r.source, r.doc_id) for r in got} == {("x", 1), ("x", 2), ("y", 3)}


def test_submission(spark):
    cols = "s_id string, rank int, reference string, retailer string, name string, url string, price double"
    shown = spark.createDataFrame([("s", 1, "r1", "Expert AT", "a", "https://x.at/a", 20.0)], cols)
    hidden = spark.createDataFrame([("s", 1, None, "Expert AT", "b", "https://x.at/b~p12", 5.0), ("s", 2, None, "Expert AT", "c", "https://x.at/list", 20.0), ("s", 3, None, "Other", "a", "http://www.x.at/a/", 20.0)], cols)
    out = B.merge(shown, hidden).first().competitors
    assert [(c.competitor_product_name, c.competitor_price) for c in out][:2] == [("a", 20.0), ("b", None)]
    found = spark.createDataFrame([("s", "k1"), ("s", "k2")], "s_id string, key string")
    truth = spark.createDataFrame([("s", "k1"), ("t", "k9")], "s_id string, key string")
    r = B.quality_score(found, truth, spark.createDataFrame([("s",), ("t",)], "s_id string")).first()
    assert (r.recall, r.precision, r.coverage, r.score) == (0.5, 0.5, 0.5, 25.0)
    assert B.exclude_shown(found, truth).count() == 1


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue ring ring"), (3, "green"), (4, None)], "d int, t string")
    asked = spark.createDataFrame([(7, "ring"), (8, "nothing")], "q int, t string")
    out = R.bm25(docs, asked, 5, doc_id="d", doc_text="t", query_id="q", query_text="t").collect()
    assert [(r.query_id, r.doc_id) for r in sorted(out, key=lambda r: r["rank"])] == [(7, 2), (7, 1)]


def test_enrichment(spark):
    df = products(spark, {"name": "Sony Full HD 43,5 Zoll", "specifications": {"Marke": "Sony", "Modellnummer": "KD43X"}}, {"name": "Kabel", "specifications": {"Kabellänge": "1,5 m"}}, {"name": None})
    a, b, c = E.enrich(df).orderBy("reference").collect()
    assert (a.size, a.size_unit, a.resolution, a.model_number) == (43.5, "Zoll", "FHD", "KD43X")
    assert a.chunk.startswith("Product name: Sony Full HD 43,5 Zoll.\nProduct type: ") and a.chunk.endswith("Specifications:\nMarke: Sony\nModellnummer: KD43X")
    assert (b.size, b.size_unit, b.product_type) == (1.5, "m", "other") and c.size is None


def test_site_queries(spark):
    q = lambda n, e=None: E.site_queries("x.at", F.col("name"), F.lit(None).cast("string"), F.col("ean"), F.create_map().cast("map<string,string>"))
    df = spark.createDataFrame([(1, "Sony KD-43X80L TV", "4548736150"), (2, "Kabel 500ML weiss rund lang breit", None)], "i int, name string, ean string")
    a, b = [r.q for r in df.select("i", q("name").alias("q")).orderBy("i").collect()]
    assert a[:3] == ["site:x.at 4548736150", "site:x.at Sony KD-43X80L", 'site:x.at "KD-43X80L"'] and len(a) == 4
    assert b == ['site:x.at "Kabel 500ML weiss rund lang breit"', "site:x.at Kabel 500ML weiss rund lang"]


def test_point_id(spark):
    import hashlib

    assert column(spark, ["a", "b", "xyz"], E.point_id) == [int(hashlib.md5(x.encode()).hexdigest(), 16) % 2**63 for x in ("a", "b", "xyz")]


def test_replies(spark):
    got = column(spark, ['```json\n{"needs_search": true, "filters": {"a": "b"}}\n```', "no"], E.agent_reply)
    assert got[0].needs_search and got[0].filters == {"a": "b"} and not got[1].needs_search
    df = spark.createDataFrame([("P_A: MATCH\n[P_B]: no_match.\n", ["P_A", "P_B"])], "t string, known array<string>")
    assert [r.reference for r in E.decisions(df, "t", "known").collect()] == ["P_A"]
    bad = spark.createDataFrame([("P_C: MATCH", ["P_A"])], "t string, known array<string>")
    with pytest.raises(Exception, match="unexpected line"):
        E.decisions(bad, "t", "known").collect()
    hits = spark.createDataFrame([("T", "https://x.at", None)], "title string, url string, price double")
    assert E.web_competitors(hits).first().reference.startswith("P_WS_")


def test_product_urls(spark):
    df = spark.createDataFrame([("https://x/a~p1", "Expert AT"), ("https://x/service-center/a-12345.html", "electronic4you.at"), ("https://x/a-12345.html", "electronic4you.at"), ("https://x/details.php?artnr= 1", "E-Tec"), ("https://x", "Other"), ("", "Other"), (None, "Expert AT")], "u string, r string")
    assert [r[0] for r in df.select(B.is_product_url(F.col("u"), F.col("r"))).collect()] == [True, False, True, True, True, False, False]


def test_engine(spark):
    from skuweave.plans.engine import Question, answer, search

    names = ["Samsung KX101B OLED Fernseher 55 Zoll", "LG KX102B Toaster", "Bosch KX103B Waschmaschine"]
    s = with_signals(spark.createDataFrame([(f"P_0000000{i}", n, None, "c") for i, n in enumerate(names)], "reference string, name string, brand string, category string"))
    rows = [(i * 10 + k, f"T{i}{k}", n, None, "c", "Amazon AT" if k else "Expert AT", f"https://x.at/{i}/{k}", 100.0 * (k + 1), True) for i, n in enumerate(names) for k in range(3)]
    t = with_signals(spark.createDataFrame(rows, "listing_id int, reference string, name string, brand string, category string, retailer string, url string, price_eur double, visible boolean"))
    out, n = search(spark, Question("Show toasters under 250 from Amazon"), s, t)
    assert [(r.source_reference, r.reference) for r in out.collect()] == [("P_00000001", "T11")] and n["kind_filter"] == ["toaster"] and n["total_links"] == 1
    assert "LG KX102B Toaster at Amazon AT for 200.00 EUR" in answer(out, n) and "P_00000001 (Amazon AT):" in answer(out, n)
    assert "LG KX102B Toaster (Amazon AT):" in answer(out, n, names=s)
    out, n = search(spark, Question("P_00000000"), s, t)
    assert sorted(r.reference for r in out.collect()) == ["T00", "T01", "T02"]
    shown = spark.createDataFrame([("P_00000000", "ref:T00")], "s_id string, key string")
    out, n = search(spark, Question("any more results?", ["P_00000000"], shown, ["P_00000000"]), s, t)
    assert sorted(r.reference for r in out.collect()) == ["T01", "T02"] and n["follow_up_expand"] and n["excluded_previous_links"] == 1
    out, n = search(spark, Question("all vacuums"), s, t)
    assert n["total_links"] == 0 and answer(out, n) == "No matching products were found."


def test_stream_upsert_restarts_where_it_failed(spark, tmp_path):
    """A batch fails after it has written; the stream goes on from its checkpoint, and each row counts once."""
    from skuweave.streaming.incremental import compacted, read_upserted, upsert_into, upsert_stream

    files, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    events = [(i % 30, i, f"v{i}") for i in range(300)]
    spark.createDataFrame(events[:150], "k int, at int, v string").repartition(3).write.parquet(files)
    stream = lambda: spark.readStream.schema("k int, at int, v string").option("maxFilesPerTrigger", 1).parquet(files)
    broken = {"left": 1}

    def flaky(batch, number):
        upsert_into(table, ["k"], [F.desc("at")])(batch, number)
        if number == 1 and broken["left"]:
            broken["left"] -= 1
            raise RuntimeError("lost in the second batch")

    with pytest.raises(Exception, match="lost in the second batch"):
        upsert_stream(stream(), flaky, state)
    assert read_upserted(spark, table, ["k"], ["at"]).count() > 0
    upsert_stream(stream(), flaky, state)
    spark.createDataFrame(events[150:], "k int, at int, v string").repartition(2).write.mode("append").parquet(files)
    upsert_stream(stream(), flaky, state)
    upsert_stream(stream(), flaky, state)  # nothing new
    want = {(k, 270 + k, f"v{270 + k}") for k in range(30)}
    got = read_upserted(spark, table, ["k"], ["at"])
    assert {tuple(r) for r in got.select("k", "at", "v").collect()} == want and got.count() == 30
    batches = {r.batch for r in spark.read.parquet(table).select("batch").distinct().collect()}
    assert batches == {0, 1, 2, 3, 4}
    compacted(spark, table, ["k"], ["at"], str(tmp_path / "small"))
    upsert_into(str(tmp_path / "small"), ["k"], [F.desc("at")])(spark.createDataFrame([(5, 999, "new"), (5, 1000, "newer"), (77, 1, "other")], "k int, at int, v string"), 9)
    after = {r.k: r.v for r in read_upserted(spark, str(tmp_path / "small"), ["k"], ["at"]).collect()}
    assert len(after) == 31 and after[5] == "newer" and after[77] == "other" and after[6] == "v276"


def test_ratio_is_that_of_sequence_matcher():
    """Also of texts whose frequent characters SequenceMatcher leaves out (200 and more)."""
    import random
    from difflib import SequenceMatcher

    dice = random.Random(5)
    text = lambda of, most: "".join(dice.choice(of) for _ in range(dice.randint(1, most)))
    pairs = [(text(of, most), text(of, most)) for of, most in [("abc ", 12)] * 300 + [("abcdefgh 12", 60)] * 300 + [("ab ", 260)] * 30]
    assert [S._ratio(a, b) for a, b in pairs] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_vetoed_pairs_do_not_meet_and_copies_go_once(spark):
    """The same model under another brand or of another kind, and the same evidence with other models, share no block; equal products are one row."""
    source = {"name": "Samsung KX101B Toaster", "ean": "4444444400001"}
    others = ["LG KX101B Toaster", "Samsung KX101B Wasserkocher", "Samsung KX909C Toaster"]
    s = products(spark, source)
    t = products(spark, *[{"name": n, "ean": "4444444400001" if "KX909C" in n else None} for n in others]).withColumn("listing_id", F.lit(1))
    assert M.candidates(s, t, extra=("reference",), source_id="name").where("s_id is not null").where("s_reference <> t_reference").count() == 0
    copies = products(spark, *[source | {"reference": f"C{i}"} for i in range(M.MEMBERS + 40)]).withColumn("listing_id", F.monotonically_increasing_id()).withColumn("retailer", F.lit("x"))
    assert M.classes(copies, "listing_id", ("reference",)).count() == 2
    got = M.match(products(spark, source | {"reference": "C7"}, source | {"reference": "other"}), copies)
    assert got.count() == 2 * (M.MEMBERS + 40) and {(r.s_id, r.t_reference) for r in got.where("method = 'direct_ref'").collect()} == {("C7", "C7")}


def test_weighted_exact_expands_classes_of_any_size(spark):
    n = M.MEMBERS + 30
    s = spark.createDataFrame([(i, "a", "k", None) for i in range(3)], "s int, brand string, kind string, ean string")
    t = spark.createDataFrame([(i, "a", "k", None) for i in range(n)] + [(n, "a", "x", None)], "t int, brand string, kind string, ean string")
    out = M.weighted_exact(s, t, {"brand": 0.5, "kind": 0.3, "ean": 1.0}, 0.8, "s", "t")
    assert "explode(t_members" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.s, r.t) for r in out.select(F.col("s_id").alias("s"), F.col("t_id").alias("t")).collect()) == [(i, j) for i in range(3) for j in range(n)]


def test_jaccard_join_by_classes(spark):
    rows = [(i, "b" if i % 5 else None, [f"w{j}" for j in range(8) if i >> j & 1] + ([f"own{i}"] if i % 3 == 0 else [])) for i in range(1, 120)]
    s = spark.createDataFrame([*rows, (1, "b", None), (2, "b", [])], "i int, on string, tokens array<string>")
    t = spark.createDataFrame([(i, b, [w for w in ws if w[0] == "w"]) for i, b, ws in rows] * 2, "i int, on string, tokens array<string>")
    got = sorted((r.s_id, r.t_id, round(r.jac, 6)) for r in M.jaccard_join(s, t, ["on"], 0.4, "i", "i").collect())
    want = [(a, b, round(len(x & y) / len(x | y), 6)) for a, p, x in ((i, b, set(w)) for i, b, w in rows) for b, q, y in ((i, b, {v for v in w if v[0] == "w"}) for i, b, w in rows) if p and p == q and x and y and len(x & y) / len(x | y) >= 0.4]
    assert got == sorted(want * 2) and want


def test_counts_of_joins_come_from_counted_rows(spark):
    """Sizes and sets of models are counted before they meet, so that pairs aren't made."""
    from skuweave import catalogue as C

    for name, total in (("size_range_join", "sum(listings"), ("model_overlap_join", "sum(n")):
        assert total in C.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_index_rounds_cosines_as_sql_does(spark, tmp_path):
    """Whole numbers whose cosine lies just between two values of six digits: by one root it's exact, by two a little less."""
    import duckdb

    a, b = [5, 2, 5, 3, 1, 3, 1, 5, 4, 0, 3, 2], [0, 2, 2, 2, 1, 0, 5, 3, 5, 4, 6, 2]
    rows = spark.createDataFrame([(1, [float(x) for x in a]), (2, [float(x) for x in b])], "vec_id long, embedding array<double>")
    V.write_index(rows, str(tmp_path / "i"))
    got = {(r.query_id, r.cosine) for r in V.search_index(str(tmp_path / "i"), rows, 1).rows.collect()}
    want = duckdb.execute("SELECT round(list_cosine_similarity(?::DOUBLE[], ?::DOUBLE[]), 6)", [a, b]).fetchone()[0]
    assert got == {(1, want), (2, want)}


def test_upsert_keeps_listings_of_one_reference(spark, tmp_path):
    """Listings 35487 and 667335, and 274993 and 9019, share reference and retailer (a hash of 32 bits); each is a row, as in SQL."""
    import duckdb

    from skuweave import catalogue as C

    rows = [(k, f"old anvil {k}", 16, 900.5) for k in (35487, 667335, 274993, 9019, 40236, 400704, 7, 8, 9, 12)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(repr, (tuple(r) for r in C.QUERIES["target_upsert"](spark, str(tmp_path)).select("reference", "retailer", "name", "visible").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(f"SELECT reference, retailer, name, visible FROM ({C.SQL['target_upsert']})").fetchall()))
    assert got == want and len({eval(x)[:2] for x in got}) < len(got)


def test_vector_products_stay_small():
    """A batch against many queries is multiplied in pieces; the best are those of a whole product."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    dice = np.random.default_rng(3)
    ids, asked, x = np.arange(3000), dice.normal(size=(3000, 4)), dice.normal(size=(9000, 4))
    batch = pa.record_batch([pa.array(np.arange(9000)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    tracemalloc.start()
    (out,) = R._best_of(SimpleNamespace(value=(ids, asked)), 2)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(unit(asked[:40]) @ unit(x).T, 6)
    want = {q: sorted((-c, i) for i, c in enumerate(cosine[q].tolist()) if i != q)[:2] for q in range(40)}
    got: dict = {}
    for q, i, c in zip(*(out.column(n).to_pylist() for n in range(3)), strict=True):
        got.setdefault(q, []).append((-c, i))
    assert len(got) == 3000 and {q: got[q] for q in want} == want


def test_scores_are_summed_where_documents_lie(spark, tmp_path):
    """No shuffle by query and document: only each query's best rows leave the tasks."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12) if i >> j & 1)) for i in range(1, 600)], "i long, t string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 2}") for q in range(8)], "q long, s string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = R.bm25(docs, asked, 3, doc_id="i", doc_text="t", query_id="q", query_text="s")
    P.write_postings(docs, str(tmp_path / "p"), ident="i", text="t")
    hits = P.search_postings(str(tmp_path / "p"), asked, 3, query_id="q", query_text="s").rows
    for out in (scan, hits):
        assert "hashpartitioning(query_id" in plan(out) and not re.search(r"hashpartitioning\(query_id#\d+L?, (id|doc_id)", plan(out))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(scan) == rows(hits) and not (tmp_path / "p" / "norm").exists()
