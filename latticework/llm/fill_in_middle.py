"""Fill-in-the-middle examples from documents.

Method: an Arrow-batched pandas UDF.  The regex library's finditer walks the
units of a text (code points, or any other pattern) and their end offsets go
into one compact array; two look-ups in it slice the text into prefix, middle
and suffix; hashlib makes the draws, seeded by the document's id, and digests.
A third draw leaves a share of the texts as they are, a fourth chooses between
prefix-suffix-middle (psm) and suffix-prefix-middle (spm).

Each row is worked on by itself, so nothing is shuffled, no key is hot, and a
lost task is run again with the same result.  Memory is a batch of about
BATCH_BYTES of text and four bytes (eight beyond 4 GB) for each unit of one
text; a longer text is a batch of its own and is cut whole.

Defined results: null texts count as empty; empty texts and those that hold a
marker stay plain; text that no unit matches (units may leave gaps) belongs to
the unit after it, and at the end to the suffix; a null id is drawn as an empty
one, rows of equal ids are drawn alike, and repeated rows are returned each.
No rows give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many are cut, and how many of those are written suffix first.
CUT, SPM = 90, 20
CODE_POINT = r"(?s:.)"
SEED = "1:"
_ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def draws(seed: str) -> list[int]:
    """Four numbers of 32 bits."""
    raw = hashlib.sha256(seed.encode()).digest()
    return [int.from_bytes(raw[i : i + 4], "big") for i in range(0, 16, 4)]


def unit_ends(unit: regex.Pattern, text: str) -> array:
    """End offsets of the units of a text, 0 first."""
    ends = array("I" if len(text) < 1 << 32 else "Q", (0,))
    ends.extend(m.end() for m in unit.finditer(text) if m.end() > m.start())
    return ends


def cut(text: str, ends: array, one: int, two: int) -> tuple[str, str, str]:
    """Prefix, middle and suffix by two numbers of units."""
    a, b = ends[min(one, two)], ends[max(one, two)]
    return text[:a], text[a:b], text[b:]


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(form: str, output: str) -> str:
    """The text of an output; markers occur in none of its parts, and none begins inside another."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    x, rest = output[len(first) :].split(second, 1)
    y, middle = rest.split(MIDDLE, 1)
    return x + middle + y if form == "psm" else y + middle + x


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transform(unit: str, seed: str, texts: bool):
    names = [c.split()[0] for c in _ROW.split(", ")] + ["output"] * texts

    def run(ids: pd.Series, missing: pd.Series, column: pd.Series) -> pd.DataFrame:
        pattern, rows = regex.compile(unit), []
        for key, none, text in zip(ids, missing, column):
            text = text or ""
            ends = unit_ends(pattern, text)
            n = len(ends) - 1
            h = draws(seed + ("" if none else str(key)))
            sizes = None, None
            if not text or h[2] % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                form, output = "plain", text
            else:
                form = "spm" if h[3] % 100 < SPM else "psm"
                parts = cut(text, ends, h[0] % (n + 1), h[1] % (n + 1))
                output, sizes = joined(form, *parts), (len(parts[0]), len(parts[1]))
            rows.append((None if none else key, n, form, *sizes, _hex(output), _hex(restored(form, output)), *[output] * texts))
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"doc_id": "Int64", "n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: str = SEED, texts: bool = True) -> DataFrame:
    """Form, sizes and digests of every row of docs (doc_id, text); with texts, the output itself too.

    unit is a pattern of the regex library: code points, r"\\X" for graphemes, r"\\s*\\S+" for words.
    """
    bounded_batches(docs.sparkSession)
    made = F.pandas_udf(_transform(unit, seed, texts), _ROW + ", output string" * texts)
    key = F.col("doc_id").cast("long")
    return docs.select(made(F.coalesce(key, F.lit(0)), key.isNull(), "text").alias("m")).select("m.*")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}' || doc_id) AS h FROM documents),
e AS (SELECT *, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS y,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= {CUT} THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, CAST(least(x, y) AS BIGINT) AS a, CAST(greatest(x, y) AS BIGINT) AS b, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
