"""Exports and addresses of pages with bars and near copies, against their SQL."""

import duckdb
import pytest

from tessera import plans

HTML = [
    "<title>x</title><p>10117 Berlin | Mitte | Haus</p>", "<p>Address: 1 Main Street |</p>", "<p>Address: a long one | | other</p>", "<p>Address: aaaaaa|bbbbbb =x</p>", "<p>Address: | 12 aaaaaaa |b| c</p>",
    "<p>Address: 12 High Street North London W1 UK</p><p>Office: 12 High Street London North W1 UK</p>", "<p>Address: abcdef</p>", "<p>ADDREſS: long s street 9</p>", "<p>Headquarters Address:\n12 Elm Road</p>", "<p>- **Jane Doe** — CEO — jane@a.example</p>", "",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd-pages")
    pages = [(i, f"https://s{i}.example/a", h) for i, h in enumerate(HTML)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, h.replace("<p>", "\n").replace("</p>", "\n"), "en", "a") for i, h in enumerate(HTML)] + [(99, None, None, None)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["addresses_dedup", "addresses_extract", "address_tokens", "address_jaccard", "export_json", "export_full_json", "export_target", "cache_slim", "cache_mask"])
def test_same_as_sql(spark, odd, name):
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.sql(f"create view {table} as select * from '{odd}/{table}.parquet/*.parquet'")
    held = con.sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, str(odd)).select(*held.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, held.fetchall()))
