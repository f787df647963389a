"""Quality rules: cutoffs whose false rejection is bounded, from labelled documents and exact binomial tests.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import SPACE, bounded, cut, documents

#: Words in a window whose repeats count.
WINDOW = 5
#: Rules: a document fails one if its value is over the stratum's cutoff.  All cutoffs tried, per rule.
GRID = {
    "symbols": [0.01, 0.02, 0.05, 0.1, 0.2],
    "dup_lines": [0.3, 0.4, 0.5, 0.6, 0.8],
    "repeats": [0.1, 0.2, 0.3, 0.5, 0.7],
    "caps": [0.1, 0.15, 0.2, 0.3, 0.5],
    "bangs": [0.02, 0.05, 0.1, 0.2],
}
#: Good documents of a stratum that one rule may reject at most, and the chance that any cutoff used breaks that.
ALPHA, DELTA = 0.005, 0.05
#: Standard deviations of a binomial sum that are added term by term; what is left is under exp(-72) of the sum.
SPREAD = 12


def statistics(docs: DataFrame, ident: str, text: str, *extra) -> DataFrame:
    """Per row: ident, extra, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_caps, n_bangs.

    Null text counts as none; repeated rows are counted each; no rows for an empty table.  One pass over the text without a shuffle: windows are hashed (64 bits) into an array, and
    only documents in which a hash repeats sort that array to find the repeated windows and the words they cover.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    df = docs.select(F.col(ident), *extra, t.alias("__t"), trimmed.alias("__s"))
    df = df.select(
        "*",
        F.when(F.col("__s") == "", F.array().cast("array<string>")).otherwise(F.split("__s", r"[\x20\x09-\x0D]+")).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_caps"),
        F.regexp_count("__t", F.lit("!")).cast("long").alias("n_bangs"),
    ).drop("__s", "__t")
    window = lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)])
    df = df.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__w") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), window)).alias("__h"),
    ).drop("__w", "__l")
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__o", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.get("__o", a).h == F.get("__o", b).h
    last = F.size("__o") - 1
    found = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j - 1, j)) | ((j < last) & same(j, j + 1)))
    df = df.withColumn("__p", F.when(F.col("__o").isNotNull(), F.sort_array(F.transform(found, lambda j: F.get("__o", j).i))))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a.n + F.least(F.lit(WINDOW), p - a["at"])).alias("n")),
        lambda a: a.n,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__o", "__p")


def values() -> dict:
    """The rules' values, from the columns of statistics()."""
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "caps": share("n_caps", "word_chars"),
        "bangs": share("n_bangs", "word_chars"),
    }


def _ln_factorial(n):
    x = n.cast("double")
    stirling = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k, n, p: float):
    """P(X <= k) for X ~ Bin(n, p), as a column; 1 where k is at the mean or over it.

    The exact sum, downwards from the term at k.  Below the mean the j-th term from there is at most exp(-j * j / 2np) of
    the first, so terms beyond SPREAD standard deviations are less than what a double can tell, and aren't added.
    """
    ln_top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    down = lambda a, j: a.t * (k - j) / (n - k + j + 1) * F.lit((1 - p) / p)
    terms = F.least(k, F.ceil(F.sqrt(n * F.lit(p)) * SPREAD) + 64)
    below = (k > 0) & (k < n * p)
    steps = F.when(below, F.sequence(F.lit(0), terms.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, lambda a, j: F.struct(down(a, j).alias("t"), (a.s + down(a, j)).alias("s")), lambda a: a.s)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(ln_top) * total))


def cutoffs(scored: DataFrame, grid: dict, alpha: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff): from rows (stratum, good, one column per rule) of labelled documents.

    Per stratum, rule and cutoff tried, H0 says that over alpha of the good documents have a value over the cutoff; it is
    rejected by the exact binomial test at delta divided by the number of tests (Bonferroni over strata, rules and
    cutoffs).  Of the certified cutoffs a rule gets the one that catches most bad for good documents lost (ties: the
    largest); no rule without one that catches more than it loses.  Labelled rows are only counted, in one aggregation.
    """
    tries = [F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(r).alias("value")) for r, cs in grid.items() for c in cs]
    sums = [
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.count_if(F.col("good") & (F.col(r) > c)).alias("k"), F.count_if(~F.col("good") & (F.col(r) > c)).alias("bad"))
        for r, cs in grid.items()
        for c in cs
    ]
    counts = scored.groupBy("stratum").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("n_bad"), F.array(*sums).alias("tries"))
    counts = cut(counts)
    strata = F.broadcast(counts.agg(F.count("*").alias("strata")))  # a single row
    tests = counts.crossJoin(strata).withColumn("x", F.explode("tries")).select("stratum", "n", "n_bad", "strata", "x.*")
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    sure = binomial_tail(F.col("k"), F.col("n"), alpha) <= delta / len(tries) / F.col("strata")
    kept = tests.withColumn("gain", gain).where((F.col("gain") > 0) & sure)
    return kept.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))


def quality(docs: DataFrame, labels: DataFrame, *, ident: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA, carry: list = ()) -> DataFrame:
    """Per row of docs: ident, the columns named in carry, the statistics, base_failed, failed (names of rules over their cutoff), kept.

    base_failed: under 10 words, or repeated windows cover over a fifth of the words.  labels: (ident, label), 1 for
    good; rows with a null and repeated ids count once or not at all (any 0 makes a document bad).  A stratum without
    enough labels, or none, has no cutoffs and rejects by base_failed alone.  A null stratum is one of its own.  A null id
    has no label; repeated rows are judged each by itself; empty docs give no rows, empty labels no cutoffs.  Values equal
    to a cutoff pass.  Other columns are ignored, whatever their names.
    """
    stats = cut(statistics(docs, ident, text, *carry, F.coalesce(F.col(stratum), F.lit("")).alias("__stratum")))
    rules = values()
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("__id")).agg((F.min(label) == 1).alias("good"))
    scored = stats.join(known, F.col(ident) == F.col("__id")).select(F.col("__stratum").alias("stratum"), "good", *[c.alias(r) for r, c in rules.items()])
    chosen = cutoffs(scored, GRID, alpha, delta).groupBy(F.col("stratum").alias("__stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__c_{r}") for r in rules])
    chosen = cut(chosen)
    out = stats.join(bounded(chosen, chosen.count(), 10_000), "__stratum", "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(c > F.col(f"__c_{r}"), F.lit(r)) for r, c in rules.items()]), lambda x: x.isNotNull())
    out = out.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.drop("__stratum", *[f"__c_{r}" for r in rules])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """quality() of all documents by the table of labels; nulls, empty and repeated rows as there."""
    out = quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op10_sql() -> str:
    tries = ", ".join(f"('{r}', {c}::DOUBLE)" for r, cs in GRID.items() for c in cs)
    n_tries = sum(map(len, GRID.values()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) >= 5),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM pos),
rep AS (SELECT doc_id, i FROM win WHERE n >= 2),
cov AS (SELECT doc_id, sum(least(5, coalesce(i - before, 5))) AS n_repeat_words FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM rep) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_caps, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
),
v AS (SELECT *, map {{'symbols': n_symbols::DOUBLE / greatest(word_chars, 1), 'dup_lines': n_dup_lines::DOUBLE / greatest(n_lines, 1), 'repeats': n_repeat_words::DOUBLE / greatest(n_words, 1),
  'caps': n_caps::DOUBLE / greatest(word_chars, 1), 'bangs': n_bangs::DOUBLE / greatest(word_chars, 1)}} AS x FROM s),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
tries(rule, cutoff) AS (VALUES {tries}),
counts AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS n_bad,
    count(*) FILTER (WHERE good AND x[rule] > cutoff) AS k, count(*) FILTER (WHERE NOT good AND x[rule] > cutoff) AS bad
  FROM v JOIN known USING (doc_id) CROSS JOIN tries GROUP BY ALL
),
tested AS (
  SELECT *, bad / greatest(n_bad, 1) - k / greatest(n, 1) AS gain,
    CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS p
  FROM counts
),
chosen AS (
  SELECT stratum, rule, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM tested
  WHERE gain > 0 AND p <= {DELTA} / {n_tries} / (SELECT count(DISTINCT stratum) FROM counts) GROUP BY stratum, rule
),
fails AS (SELECT DISTINCT doc_id FROM v JOIN chosen c ON v.stratum = c.stratum AND x[c.rule] > c.cutoff)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND f.doc_id IS NULL AS kept
FROM v LEFT JOIN fails f ON v.doc_id = f.doc_id
"""


OP10_SQL = _op10_sql()
