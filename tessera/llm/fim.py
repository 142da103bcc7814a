"""Fill-in-the-middle rewriting of texts: an Arrow-batched pandas UDF cuts each text at two units.

A unit is a word or a single other character (``UNIT``).  The regex library runs over a whole text once
and leaves the end offset of every unit in a compact array (four bytes each), so that the two cuts are
two lookups and three slices.  Cuts and form follow from the id alone (hashlib's SHA-256 of a seed and
the id), so a row gives the same result wherever and however often it runs.

A null text is empty and gives the plain form; a null id is taken as an empty id.  Repeated rows give
repeated results.  An empty table gives an empty result.  Columns other than the id and the text are
left out.  A text is held once, with four bytes a unit, whatever its length.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROOT, id_text, table

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: What marks the prefix, the suffix and the middle in an output.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts so many are rewritten, and of 100 of those so many put the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def draws(seed: int, name: str) -> list[int]:
    """Four numbers of 32 bits that follow from the seed and the id."""
    import hashlib

    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def ends(text: str, unit):
    """The offset after each unit of ``text``."""
    from array import array

    return array("I", (m.end() for m in unit.finditer(text)))


def rewritten(name: str, text: str, seed: int, rewritten_of_100: int, suffix_first_of_100: int, unit) -> tuple:
    """(units, form, characters of prefix and middle, output) of a text."""
    offsets = ends(text, unit)
    n = len(offsets)
    a, b, c, d = draws(seed, name)
    if not text or c % 100 >= rewritten_of_100 or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    start, stop = offsets[low - 1] if low else 0, offsets[high - 1] if high else 0
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    if d % 100 < suffix_first_of_100:
        return n, "spm", start, stop - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, stop - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text of an output; no mark occurs in a text that was cut, so the first of each kind counts."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, rest = output[len(first) :].partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def transform_batches(batches, seed, rewritten_of_100, suffix_first_of_100):
    """(ids, texts) as pandas Series -> a frame of RESULT for each pair."""
    import hashlib

    import pandas as pd
    import regex

    unit = regex.compile(UNIT)
    columns = [c.split()[0] for c in RESULT.split(", ")]
    for names, texts in batches:
        rows = []
        for name, text in zip(names, texts):
            row = rewritten(name, text, seed, rewritten_of_100, suffix_first_of_100, unit)
            rows.append((*row, hashlib.sha256(row[-1].encode()).hexdigest()))
        frame = pd.DataFrame(rows, columns=columns)
        yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def restore_batches(batches):
    """(outputs, forms) as pandas Series -> the texts."""
    import pandas as pd

    for outputs, forms in batches:
        yield pd.Series([rebuilt(o, f) for o, f in zip(outputs, forms)], dtype=object)


def _udf(name: str, kind: str, args=()):
    """The iterator pandas UDF of a function of this module; only its name travels."""
    from collections.abc import Iterator

    import pandas as pd

    root = ROOT

    def call(batches):
        if root not in sys.path:
            sys.path.append(root)
        import importlib

        yield from getattr(importlib.import_module("tessera.llm.fim"), name)(batches, *args)

    out = pd.DataFrame if kind == RESULT else pd.Series
    call.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[out]}
    return F.pandas_udf(call, kind)


def transform(docs: DataFrame, seed: int = SEED, rewritten_of_100: int = REWRITTEN, suffix_first_of_100: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and RESULT of every row: units, form, sizes of prefix and middle, the output and its digest."""
    cut = _udf("transform_batches", RESULT, (seed, rewritten_of_100, suffix_first_of_100))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return id_text(docs, id_col, text_col).select("doc_id", cut(name, F.col("text")).alias("r")).select("doc_id", "r.*")


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output and its form."""
    return _udf("restore_batches", "string")(output, form)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = "('0x' || substr(h, {}, 8))::BIGINT"
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
c AS (SELECT *, len(units) AS n, {_H.format(1)} % (len(units) + 1) AS a, {_H.format(9)} % (len(units) + 1) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H.format(17)} % 100 >= 90 THEN 'plain' WHEN {_H.format(25)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
