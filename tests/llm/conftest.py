import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuweave.llm import common

SF = "/root/testdata/sf0.001"

#: Rows beside the prose: nulls, empty and blank texts, ties, repeated rows, short and long texts, near copies.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(12_000))
EDGE = [
    (9001, None, "en", "src1"),
    (9002, "", "en", None),
    (9003, " \t\n ", None, "src1"),
    (9004, "one two three", "en", "src2"),
    (9004, "one two three", "en", "src2"),
    (9005, "One TWO three", "en", "src2"),
    (9006, LONG, "en", "src1"),
    (9007, LONG + " tail", None, "src3"),
    (9008, "first line of a text\n  First LINE of a text \nshort\nshort\nother words here\x0b", "en", "src1"),
    (9009, "first line of a text\nÄÖÜ äöü ß ﬁ ½ Σ̈ 漢字 🙂 'tis x_y <|endoftext|> ...,, a.b,c", "de", "src3"),
    (9010, "a b c d e f g h i j k l m n o p q r s t", "en", "src2"),
    (9011, "a b c d e f g h i j k l m n o p q r s u", "en", "src2"),
    (9012, "*** ### !!! 123 456", "fr", "Src"),
    (None, "a text whose id is null, with enough words to be a text of its own", "en", "src1"),
    (None, "one two three", None, None),
]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """A folder of tables: the small prose and the rows above, with extra columns whose names clash with operators' own."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    extra = spark.createDataFrame([(*r, len(r[1] or "")) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(extra)
    for c in ("size", "row", "component", "kept", "shard", "slot", "id", "node", "target", "n_words", "length", "stratum", "h1", "piece", "score"):
        both = both.withColumn(c, F.lit("clash"))
    both.coalesce(3).write.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(9004, 1, 0), (9004, 0, 1), (9006, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    labels.withColumn("score", F.lit(1)).write.parquet(f"{at}/labels.parquet")
    vectors = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.99, 0.1, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0, 0.0]), (8, []), (None, [-1.0, 0.0, 0.0, 0.0]), (9, [-2.0, 0.0, 0.0, 0.1]), (10, [-0.0, 5.0, 0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).withColumn("pos", F.lit("clash")).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").where("1 = 0").write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.fixture(scope="session")
def rows(spark, edge_dir):
    return spark.read.parquet(f"{edge_dir}/documents.parquet").collect()


@pytest.fixture
def restless(spark, monkeypatch):
    """From one stored step to the next, scans of many files are split for another number of cores."""
    cores = itertools.cycle([3, 29, 1, 11, 40])
    kept, key = common.stored, "spark.sql.leafNodeDefaultParallelism"

    def stored(df):
        spark.conf.set(key, str(next(cores)))
        return kept(df)

    monkeypatch.setattr(common, "stored", stored)
    yield stored
    spark.conf.unset(key)


@pytest.fixture(scope="session")
def many_files(spark, tmp_path_factory):
    """Texts of three kinds in 50 files: rows with and without ids, near copies, shared lines; and vectors."""
    at, rng = str(tmp_path_factory.mktemp("many")), np.random.default_rng(8)
    data = []
    for i in range(1500):
        words = [f"w{rng.integers(4000)}" for _ in range(40)]
        if i % 5 == 0 and data:
            words = [*data[-1][1].split()[:-1], "other"]
        line = f"a line that {i % 40} documents share, of some length"
        data.append((None if i % 4 == 0 else i, " ".join(words) + (f"\n{line}" if i % 3 == 0 else "") + ("\n" + "# % & " * 30 if i % 7 == 0 else "")))
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 9}", len(t)) for k, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(50).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 7 != 0) for i in range(1500)], "doc_id long, q boolean").select("doc_id", F.col("q").cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    x = rng.normal(size=(400, 16))
    x = np.concatenate([x, x[:200] + rng.normal(size=(200, 16)) * 0.05, x[:50]])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(40).write.parquet(f"{at}/embeddings.parquet")
    return at
