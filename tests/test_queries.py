"""Every query against its SQL on the smallest tables, and the entry without the corpus subpackage."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from skuweave import catalogue as C
from skuweave.functions.signals import with_signals
from skuweave.operators import match as M
from skuweave.operators import score as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_query(spark, name):
    got = C.QUERIES[name](spark, SF).toPandas()
    if name not in C.SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(C.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(repr([None if x is None or x != x else x for x in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert key(got) == key(want)


def test_submissions_hold_matches_by_name_ratio(spark):
    """The best 12 of all pairs, scored with the ratio and the same reference, without blocking."""
    s, t = with_signals(C.sources(spark, SF)), with_signals(C.listings(spark, SF))
    every = s.select(F.col("source_id").alias("s_id")).crossJoin(t.select(F.col("listing_id").alias("t_id")))
    pairs = S.flags(M.pair_up(every, s, t, "source_id", extra=("reference", "url")))
    scored = [(r, 1.0 if r.s_reference is not None and r.s_reference == r.t_reference else r.score) for r in S.scores(pairs, S.sequence_ratio("s_name_norm", "t_name_norm")).collect() if r.matched or r.s_reference is not None and r.s_reference == r.t_reference]
    want = set()
    for source in {r.s_id for r, _ in scored}:
        own = sorted(((-x, r.t_id, r.t_url) for r, x in scored if r.s_id == source))[:12]
        want |= {(source, k + 1, url) for k, (_, _, url) in enumerate(own)}
    got = {(r.s_id, r["rank"], r.url) for part in C._parted(spark, SF) for r in part.collect()}
    assert got == want and want


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_corpus_subpackage(tmp_path, pipeline):
    """The folders of the subpackage are gone, the pipeline's file with them or not."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "skuweave"), tmp_path / "skuweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if os.path.exists(os.path.join(top, name)):
            shutil.copy(os.path.join(top, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
