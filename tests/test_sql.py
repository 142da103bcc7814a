"""SQL functions against the Column functions on odd values, and the table functions' edges."""

import pytest

from tessera.functions import columns as C
from tessera.functions import sql

ODD = [None, "", "HTTPS://User@Example.COM:443/A/../b/./c/..", "http://x.example:80", "http://x.example:8080/a.PDF?x=1", "https://y.example/login", "ftp://z", "https://z.example/a/a/a/a/b", "https://z.example/?utm_source=1&q=ü&ref=2#f", "mailto:jobs@a.example", "https:\\\\b.example\\Ä b\\c?x\\y", "https://c.example/😀/{x}", "Jobs@a.example", "noreply@a.example", "@b", "a@", "x" * 50, "<title> T\n　U </title><h1>x</h1><p>y &amp; z", "  a  b \t"]


def test_scalars(spark):
    from pyspark.sql import functions as F

    sql.register(spark)
    spark.createDataFrame([(v,) for v in ODD], "v string").createOrReplaceTempView("odd")
    pairs = {"url_origin": C.url_origin, "canonical_url": C.canonical_url, "mask_email": C.mask_email, "email_department": C.email_department, "valid_email": C.valid_email, "page_title": C.page_title, "html_to_markdown": C.html_to_markdown, "squeezed": C.squeezed, "token_estimate": C.token_estimate}
    for name, column in pairs.items():
        for row in spark.sql(f"SELECT v, {name}(v) AS got FROM odd").withColumn("want", column(F.col("v"))).collect():
            assert row["got"] == row["want"], (name, row)
    for base in ("https://a.example/x/y", "https://a.example"):
        for href in ("/r", "//h.example/z", "?q=1", "t.html", "mailto:x@y", "../up"):
            row = spark.sql(f"SELECT resolve_url('{href}', '{base}') AS got").withColumn("want", C.resolve(F.lit(href), F.lit(base))).first()
            assert row["got"] == row["want"]


def test_table_functions(spark):
    sql.register(spark)
    assert spark.sql("SELECT * FROM links_of(NULL, 'https://a.example')").count() == 0
    assert [tuple(r) for r in spark.sql("SELECT * FROM links_of('<a href=\"/b\">B <i>c</i></a><a href=\"#x\">y</a>', 'https://a.example')").collect()] == [(0, "https://a.example/b", "B c")]
    spark.createDataFrame([("k", "edit", 1, 1), ("k", "edit", 2, 2), (None, "edit", 5, 1), ("k", "undo", None, 3)], "name string, action string, record long, n int").createOrReplaceTempView("edits")
    out = spark.sql("SELECT * FROM undo_of(TABLE(edits) PARTITION BY name ORDER BY n)")
    assert out.columns == ["name", "record", "past", "future"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == ["('k', 1, [], [2])", "(None, 5, [], [])"]
    with pytest.raises(Exception, match="needs a key"):
        spark.sql("SELECT * FROM undo_of(TABLE(SELECT name, n FROM edits) PARTITION BY name ORDER BY n)").collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM undo_of(1)").collect()
