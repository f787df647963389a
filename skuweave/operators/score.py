"""Pair scores: similarities and the cascade of vetoes and evidence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skuweave.functions.text import bind

THRESHOLD = 0.80


#: Texts of so many characters and more have frequent characters left out by SequenceMatcher, so that it's asked itself.
LONG = 200
#: Rests of names beside their longest common stretch, which recur, and what they have in common; so many at most.
_RESTS: dict = {}
MAX_RESTS = 200_000


def _common(a: str, b: str) -> int:
    """Characters in common: the longest stretch of a that b holds (the first of several), then what is left and right of it."""
    size, at, n = 0, 0, len(a)
    for i in range(n):
        while i + size < n and a[i : i + size + 1] in b:
            size, at = size + 1, i
        if i + size >= n:
            break
    if not size:
        return 0
    j = b.find(a[at : at + size])
    for rest in ((a[:at], b[:j]), (a[at + size :], b[j + size :])):
        if rest[0] and rest[1]:
            found = _RESTS.get(rest)
            if found is None:
                if len(_RESTS) >= MAX_RESTS:
                    _RESTS.clear()
                found = _RESTS[rest] = _common(*rest)
            size += found
    return size


def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio() if len(b) >= LONG else 2.0 * _common(a, b) / (len(a) + len(b))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """SequenceMatcher's ratio, each distinct pair once."""
    out: dict = {}
    for pair in zip(a, b, strict=True):
        if pair not in out:
            out[pair] = _ratio(*pair)
    return pd.Series([out[pair] for pair in zip(a, b, strict=True)], dtype=float)


#: Ratcliff-Obershelp similarity of the first to the second text (not symmetric); 0 if either is empty.  Said to be
#: non-deterministic so that Catalyst doesn't move a filter on the outcome below a shuffle and compute it on both sides.
sequence_ratio = F.pandas_udf(_ratios, DoubleType()).asNondeterministic()


def letters(name: Column) -> Column:
    """A name's characters as distinct numbers: the character and how often it came before, so that sets compare as bags."""
    ordered = bind(F.array_sort(F.filter(F.split(name, ""), lambda c: c != "")), lambda cs: F.transform(cs, lambda c, i: F.ascii(c) * 65536 + i - F.array_position(cs, c).cast("int")))
    return F.coalesce(ordered, F.array().cast("array<int>"))


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that sequence_ratio can be by the names' letters(): it counts a character as often as both have it."""
    la, lb = F.size(a), F.size(b)
    return F.when((la > 0) & (lb > 0), 2.0 * F.size(F.array_intersect(a, b)) / (la + lb)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / union).otherwise(0.0)


def once(df: DataFrame, columns: dict) -> DataFrame:
    """df with columns added as the one row of a generator: Catalyst leaves them where they are, so that filters on several
    of them compute none of them again (nor plan with their expressions)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def flags(pairs: DataFrame) -> DataFrame:
    """pairs (columns s_* and t_* of with_signals(), and models, all of a side's) with veto, same_*, jac and the identifier overlaps."""
    s, t = (lambda c: F.col(f"s_{c}")), (lambda c: F.col(f"t_{c}"))
    equal = lambda c: F.coalesce(s(c) == t(c), F.lit(False))
    differ = lambda c: F.coalesce(s(c) != t(c), F.lit(False))
    near = F.coalesce(F.abs(s("screen_size_inch") - t("screen_size_inch")) <= 1.0, F.lit(False))
    far = F.coalesce(F.abs(s("screen_size_inch") - t("screen_size_inch")) > 1.0, F.lit(False))
    any_model = overlap(s("models"), t("models"))
    models_differ = equal("brand_norm") & (F.size(s("models")) > 0) & (F.size(t("models")) > 0) & ~any_model
    veto = (
        F.when(differ("brand_norm"), "brand_conflict")
        .when(differ("kind"), "kind_conflict")
        .when(far, "size_conflict")
        .when(models_differ, "model_conflict")
    )
    return once(
        pairs,
        {
            "veto": veto,
            "same_brand": equal("brand_norm"),
            "same_kind": equal("kind"),
            "same_size": near,
            "jac": jaccard(s("tokens"), t("tokens")),
            "ean_hit": overlap(s("eans"), t("eans")),
            "asin_hit": overlap(s("asins"), t("asins")),
            "strong_hit": overlap(s("strong_models"), t("strong_models")),
            "family_hit": any_model,
        },
    )


#: What a pair's score is made of, beside the name ratio.
INPUTS = ["veto", "same_brand", "same_kind", "same_size", "jac", "ean_hit", "asin_hit", "strong_hit", "family_hit"]


def scores(flagged: DataFrame, ratio: Column, threshold: float = THRESHOLD) -> DataFrame:
    """flagged with ratio, score (4 places), matched (by the score before rounding), method and reasons.

    Each step is added once, for the one after it.  Evidence is compared before its cap: a strong model beside a barcode
    can lower the score to the cap.
    """
    c = F.col
    add = lambda test, w: F.when(test, F.lit(w)).otherwise(0.0)
    df = flagged.drop("ratio", "score", "method").withColumn("__ratio", ratio)
    ident = F.when(c("ean_hit"), 0.99).when(c("asin_hit"), 0.985).otherwise(0.0)
    strong = 0.92 + add(c("same_brand"), 0.03) + add(c("same_size"), 0.03) + add((c("__ratio") >= 0.70) | (c("jac") >= 0.45), 0.02)
    family = 0.38 + add(c("same_brand"), 0.12) + add(c("same_kind"), 0.16) + add(c("same_size"), 0.16) + add(c("jac") >= 0.45, 0.12) + add(c("__ratio") >= 0.72, 0.12)
    text = add(c("same_brand"), 0.22) + add(c("same_kind"), 0.18) + add(c("same_size"), 0.18) + 0.28 * c("jac") + 0.24 * c("__ratio")
    df = once(df, {"ratio": c("__ratio"), "__ident": ident, "__model": F.when(c("strong_hit"), strong).when(c("family_hit"), family).otherwise(0.0), "__text": text}).drop("__ratio")
    cap, by_model = F.when(c("strong_hit"), 0.98).otherwise(0.86), c("__model") > c("__ident")
    df = once(df, {"__by_model": by_model, "__best": F.when(by_model, F.least("__model", cap)).otherwise(c("__ident"))}).drop("__ident", "__model")
    by_text = c("__text") > c("__best")
    raw = F.when(c("veto").isNotNull(), 0.0).when(by_text, F.least(c("__text"), F.lit(0.89))).otherwise(c("__best"))
    method = (
        F.when(c("veto").isNotNull(), c("veto"))
        .when(by_text, "name_sim")
        .when(c("__by_model") & c("strong_hit"), "model")
        .when(c("__by_model"), "family_model")
        .when(c("ean_hit"), "gtin")
        .when(c("asin_hit"), "asin")
        .otherwise("none")
    )
    df = once(df, {"__raw": raw, "method": method}).drop("__by_model", "__best", "__text")
    reason = lambda test, text: F.when(test, F.lit(text))
    reasons = F.array_compact(
        F.array(
            reason(c("ean_hit"), "ean_exact"),
            reason(c("asin_hit") & ~c("ean_hit"), "asin_exact"),
            reason(c("strong_hit"), "model_exact"),
            reason(~c("strong_hit") & c("family_hit"), "model_family"),
            reason(c("same_brand"), "brand_match"),
            reason(c("same_kind"), "kind_match"),
            reason(c("same_size"), "size_match"),
            reason(c("jac") >= 0.45, "token_overlap"),
            reason(c("ratio") >= 0.72, "name_close"),
        )
    )
    return df.withColumns(
        {
            "matched": c("__raw") >= threshold,
            "score": F.round("__raw", 4),
            "reasons": F.when(c("veto").isNotNull(), F.array("veto")).otherwise(reasons),
        }
    ).drop("__raw")
