"""Fill-in-middle: each text is cut into prefix, middle and suffix and written as psm or spm by seeds of its id.

One Arrow-batched pandas function cuts, writes and hashes: the ends of all units go into a compact array (4 bytes a unit),
two lookups there give the cuts, and hashlib gives the seeds and the digest.  No shuffle; a text is one row throughout.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuweave.llm.common import documents

#: A unit: a word with the white space before it; white space at the end is a unit too.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = regex.compile("<[PSM]>")
#: Per cent of texts that are cut, and of those that are written suffix first.
CUT, SPM = 50, 80
SEED = 42

PARTS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def seeds(ident: int | None, seed: int = SEED) -> list:
    """Four unsigned 32-bit numbers for an id; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def infilled(text: str, ident: int | None, seed: int = SEED, cut: int = CUT, spm: int = SPM) -> tuple:
    """(units, form, code points of the prefix and of the middle, output) of a text."""
    ends = array("I", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    n = len(ends) - 1
    h1, h2, h3, h4 = seeds(ident, seed)
    if not text or h3 % 100 >= cut or MARK.search(text):
        return n, "plain", None, None, text
    a, z = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < spm:
        return n, "spm", a, z - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, z - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _infill(seed: int, cut: int, spm: int):
    @F.pandas_udf(PARTS)
    def run(texts: pd.Series, idents: pd.Series) -> pd.DataFrame:
        rows = [infilled(t or "", None if i is None or i == "" else int(i), seed, cut, spm) for t, i in zip(texts, idents, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
        out["output_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in out["output"]]
        return out

    return run


def fill_in_middle(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", seed: int = SEED, cut: int = CUT, spm: int = SPM) -> DataFrame:
    """Per row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output, output_sha256.

    A null or empty text is plain and has no units; a text that contains one of the marks is plain.  Texts of white space
    alone are one unit.  A null id is hashed as no digits.  Rows with the same id are cut by the same seeds, each in its
    own text; repeated rows come out equal.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    ident = F.col(ident).cast("long")
    # The id goes as digits: a column of longs with nulls would become floats on the way.
    made = _infill(seed, cut, spm)(F.coalesce(F.col(text), F.lit("")), F.coalesce(ident.cast("string"), F.lit("")))
    return docs.select(ident.alias("id"), made.alias("made")).select("id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The text that output was written from.  No text that is cut contains a mark, so the marks split it without doubt."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)), F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_infill(spark, sf_dir: str) -> DataFrame:
    """fill_in_middle() of all documents, and the digest of what restored() makes of each; edge cases as there."""
    out = fill_in_middle(documents(spark, sf_dir))
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", again.alias("restored_sha256"))


OP13_SQL = r"""
WITH seeded AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM seeded
),
cuts AS (
  SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS z,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
