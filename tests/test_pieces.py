"""Small steps on odd values."""

import pytest


def test_progress_and_escape(spark):
    from pyspark.sql import functions as F
    from tessera.functions import columns as C

    nan, inf = float("nan"), float("inf")
    cases = [(5.0, 10.0, 0.5), (15.0, 10.0, 1.0), (-5.0, 10.0, 0.0), (0.4, 0.0, 0.4), (3.0, 0.0, 1.0), (3.0, None, 1.0), (None, 10.0, 0.0), (nan, nan, 0.0), (0.2, nan, 0.2), (0.2, inf, 0.2), (inf, None, 0.0), (-1.0, None, 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, loaded double, total double, want double")
    assert [(r.got, r.want) for r in rows.select("want", C.progress(F.col("loaded"), F.col("total")).alias("got")).collect() if r.got != r.want] == []
    one = spark.createDataFrame([('<a href="x">&amp;',), (None,), ("",)], "t string").select(C.escaped(F.col("t")).alias("e")).collect()
    assert [r.e for r in one] == ["&lt;a href=&quot;x&quot;>&amp;amp;", "", ""]


def test_prompts_and_empty_records(spark):
    from pyspark.sql import functions as F
    from tessera.functions import chunks, patterns as P
    from tessera.operators import records

    row = spark.createDataFrame([("u", None, "x" * 5000)], "url string, lang string, md string").select(chunks.prompt(F.lit("T"), F.col("url"), F.col("lang"), F.col("md"), F.lit(600), F.lit(None).cast("int")).alias("p")).first()
    assert row.p == "T\n\nURL: u\nLanguage: \n\n" + "x" * 1024
    cells = records.empty(spark.createDataFrame([(1, "u"), (2, None)], "id int, source_url string")).collect()
    assert len(cells) == 2 * len(P.FIELDS) and {(c.value, c.confidence, c.dirty, c.verified) for c in cells} == {("", "low", False, False)}


@pytest.mark.parametrize("base, patch, want", [("", "B", "B"), ("A", "", "A"), ("A", "A", "A"), ("A", "B", "B"), (None, "B", "B")])
def test_patches(spark, base, patch, want):
    from tessera.operators import records

    schema = "site string, key string, value string, confidence string, source_url string, dirty boolean, verified boolean"
    of = lambda v, c: spark.createDataFrame([("s", "k", v, c, "", False, False)], schema)
    assert records.patched(of(base, "low"), of(patch, "high")).first().value == want
    assert records.patched(of(base, "low").limit(0), of(patch, "high")).first().value == patch
