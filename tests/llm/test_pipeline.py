"""The pipeline's stages, each on its own input, against brute force."""

import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from skuweave.llm import queries
from tests.llm.test_operators import brute_lines, brute_near, WORDS


@pytest.fixture(scope="session")
def steps(spark, edge_dir, tmp_path_factory):
    """Every stage's rows, each written and read again."""
    docs, out = spark.read.parquet(f"{edge_dir}/documents.parquet"), {}
    columns = docs.columns
    out["input"] = docs.collect()
    for k, (name, stage) in enumerate(P.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, edge_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k < 4:
            assert docs.columns == columns and (k == 1 or docs.where("kept != 'clash'").count() == 0)
        out[name] = docs.collect()
    return out


def test_quality_rejects_what_the_rules_reject(spark, edge_dir, steps):
    kept = Counter(r.doc_id for r in queries.QUERIES["op10_quality"](spark, edge_dir).collect() if r.kept)
    assert Counter(r.doc_id for r in steps["quality rules"]) == kept
    texts = Counter((r.doc_id, r.text) for r in steps["input"])
    assert not Counter((r.doc_id, r.text) for r in steps["quality rules"]) - texts


def test_lines_go(steps):
    want = Counter((i, hashlib.sha256(t.encode()).hexdigest(), len(t)) for i, _, _, t in brute_lines(steps["quality rules"]))
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars) for r in steps["line dedup"]) == want


def test_one_of_each_group_stays(steps):
    before, after = steps["line dedup"], steps["n-gram Jaccard join"]
    found = brute_near(before)
    want = Counter({c: 1 for i, n, c in found if n}) + Counter(i for i, n, _ in found if not n)
    assert Counter(r.doc_id for r in after) == want
    texts = Counter((r.doc_id, r.text) for r in before)
    assert not Counter((r.doc_id, r.text) for r in after) - texts


def test_one_of_each_group_without_ids_stays(spark, tmp_path):
    """Two groups of copies whose ids are all null, one that a smaller id joins, and texts without words."""
    texts = [" ".join(f"{g}{k}" for k in range(30)) for g in "abc"]
    data = [(None, texts[0])] * 5 + [(None, texts[1])] * 4 + [(None, texts[1] + " tail")] * 2 + [(None, texts[2]), (7, texts[2]), (7, texts[2]), (9, texts[2])] + [(None, "")] * 2 + [(None, None), (11, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    docs.write.parquet(str(tmp_path / "d"))
    got = P.near_dedup(spark, spark.read.parquet(str(tmp_path / "d")), "").collect()
    kept = Counter((r.doc_id, (r.text or "")[:2]) for r in got)
    assert kept == Counter({(None, "a0"): 1, (None, "b0"): 1, (7, "c0"): 1, (None, ""): 3, (11, ""): 1})


def test_mix_takes_whole_documents_up_to_twice(steps):
    before, after = steps["n-gram Jaccard join"], steps["mixing sources"]
    size = lambda r: len(WORDS.findall(r.text or ""))
    times, have = Counter((r.doc_id, r.text) for r in after), Counter((r.doc_id, r.text) for r in before if size(r))
    assert all(n <= 2 * have[k] for k, n in times.items())
    total = sum(map(size, before))
    assert sum(map(size, after)) == pytest.approx(1.5 * total, rel=0.05)


def test_all_is_packed(steps):
    after = steps["best-fit packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in steps["mixing sources"])
    assert len({r.sequence_id for r in after}) <= -(-sum(r.length for r in after) // 2048) + 2


def test_run_and_empty(spark, empty_dir):
    assert P.run(spark, empty_dir).count() == 0


def test_stages_do_not_depend_on_how_scans_are_split(spark, many_files, restless):
    """Each stage decides on the rows that it judged, though files are split differently from one step to the next."""
    docs = spark.read.parquet(f"{many_files}/documents.parquet")
    judged = queries.QUERIES["op10_quality"](spark, many_files).collect()
    kept = P.quality_rules(spark, docs, many_files).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in judged if r.kept) and len(kept) < len(judged)
    rows, left = docs.collect(), P.near_dedup(spark, docs, many_files).collect()
    found = brute_near(rows)
    want = Counter({c: 1 for i, n, c in found if n and c is not None})
    assert Counter(r.doc_id for r in left if r.doc_id is not None) == want
    assert not Counter((r.doc_id, r.text) for r in left) - Counter((r.doc_id, r.text) for r in rows)
    # What is left links with nothing.
    assert all(i == c for i, _, c in brute_near(left) if c is not None)
    mixed = Counter((r.doc_id, r.text) for r in P.mix_sources(spark, docs, many_files).collect())
    assert all(n <= 2 * m for k, m in Counter((r.doc_id, r.text) for r in rows).items() if (n := mixed[k]))
    size = lambda c: sum(n * len(WORDS.findall(t)) for (_, t), n in c.items())
    assert size(mixed) == pytest.approx(1.5 * size(Counter((r.doc_id, r.text) for r in rows)), rel=0.05)


def test_columns_named_like_the_stages_own(spark, tmp_path):
    """Every stage keeps columns that have the names of its own, with their values."""
    names = ["__sw_row", "__sw_id", "__sw_tie", "__sw_text", "__sw_times", "__sw_kept", "__sw_drop", "__sw_at", "__SW_LINE_ROW", "row", "id", "file"]
    line = "a line that all of these documents share"
    data = [(i if i % 3 else None, " ".join(f"w{i % 40}x{k}" for k in range(30)) + f"\n{line}", "en", f"s{i % 2}", 1) for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(n), F.sha2("text", 256)).alias(n) for n in names])
    docs.coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, told = spark.read.parquet(str(tmp_path / "documents.parquet")), {r["__sw_row"] for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        rows = docs.collect()
        assert docs.columns[5:] == names and rows and {r["__sw_row"] for r in rows} <= told
        assert all(r[n][len(n) :] == r["__sw_row"][len("__sw_row") :] for r in rows for n in names)
    assert P.best_fit_packing(spark, docs, str(tmp_path)).count() >= docs.count() > 0
