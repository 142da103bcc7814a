"""What pages are looked through for: once, for what is asked, and with the results of the plain patterns."""

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import columns as C
from tessera.functions import entities as E
from tessera.functions import patterns as P
from tessera.operators import crawl

SF = "/root/testdata/sf0.001"
HTML = [
    None, "", "plain", "<SCRIPT>a</script><svg>x</SVG>b", "<scr<style></style>ipt>x</script>", "<nosc<script></script>ript>x</noscript>y", "<p onClick=\"a\" style=\"b\">x</p>", " on=\"a\" ona=\"b\" STYLE=\"c\"", "<IMG width='1'>a<img src=x>",
    "<LINK rel=x>a", "a<!-- b -->c<!-- d", "<h1>a</h1><H2 x>b</h2><h3>c</h3><h4>d</h4>", "<h<canvas></canvas>2>a</h2>", "a&amp;amp;&nbsp;&nbsp;b", "a<p></p><p></p>b", "&am<!-- -->p;", "<i<svg></svg>frame>a</iframe>b", "<ul><li>a<li>b</li></ul><a href='u'>t</a><br/>x",
]
TEXTS = [
    None, "", "- **Jane Doe** — CEO — jane@a.example\n* **Max** - Founder\r\n- **A — B** — Director of X — y\n", "Ann Lee — Chief Officer  \n\n\nBo Ek – Founder – b@c.example \nx\n", "- **Q** — CEO\nEva Moe, Director\r\nLi Wu, VP Al Bo, President",
    "Address: 1 Main Street\nHQ: 2 Side Ave\nprimary\nOffice 3 Elm Road", "ADDREſS: 4 Long Lane", "locatıon: 5 Dot Way", "LOCATİON: 6 Dot Way", "本社: 東京都", "hq 7 Park Drive, Town\nAddress:\n\n8 Low Road", "12345 Berlin rest\nAddress: x", "Headquarters: y 9\nabc 123 Xyz",
    "European Standort Office: z\nAnschrift\tq", "Head office here", "call +1 (415) 555-0199 or 415.555.0199, (415) 555-0199 00 49 30 123456", "LINKEDIN.COM/in/a_b", "https://www.lınkedin.com/company/x xing.coM/pages/y",
    "## h\nshort\n" + "A first long line of prose that is over fifty characters long.\n" + "Another long line of prose that is over fifty characters long.", "Cookie " + "x" * 60 + "\n  " + "y" * 60, "a  \n b" + "  " * 900 + "c" * 300, " " * 2000 + "d e",
]


@pytest.fixture(scope="module")
def html(spark):
    return spark.createDataFrame(list(enumerate(HTML)), "i int, t string")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def same(df, got, want):
    assert [r for r in df.select("i", got.alias("got"), want.alias("want")).collect() if r.got != r.want] == []


def test_markdown_as_by_all_steps(html):
    t = F.col("t")
    same(html, C.html_to_markdown(t), C.trimmed(C.replaced(t, P.SANITIZE + P.MARKDOWN)))


def test_people_and_matches_as_in_the_whole_text(texts):
    t = F.col("t")
    for pattern, groups in ((P.EXEC_BOLD, {"a": 1, "b": 2, "c": 3}), (P.EXEC_DASH, {"a": 1, "b": 2, "c": 3}), (P.EXEC_COMMA, {"a": 1, "b": 2})):
        whole = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(pattern), F.lit(g)).alias(n) for n, g in ({"all": 0} | groups).items()])
        same(texts, E._found(t, pattern, groups)(lambda m: F.lit(True)).cast("string"), whole.cast("string"))


def test_contacts_as_by_the_plain_patterns(texts):
    t = F.col("t")
    all_of = lambda pattern, g: F.regexp_extract_all(t, F.lit(P.java(pattern)), F.lit(g))
    same(texts, all_of(P.ADDRESS_START + P.ADDRESS_LABELLED, 1), all_of(P.ADDRESS_LABELLED, 1))
    same(texts, E.phones_found(t), F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit(P.PHONE), F.lit(0)), C.trimmed), lambda p: F.length(p) >= 7)))
    for pattern in (P.LINKEDIN, P.XING):
        found = C.trimmed(F.regexp_extract(t, P.java(pattern), 0))
        same(texts, E.profile_link(t, pattern), F.when((found == "") | found.startswith("http"), found).otherwise(F.concat(F.lit("https://"), found)))
    same(texts, C.squeezed_start(t, 160), F.substring(C.squeezed(t), 1, 160))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cache_slim", "cache_mask"])
def test_cells_of_a_page_come_from_one_look(spark, name):
    own = plan(plans.QUERIES[name](spark, SF))
    assert "Join" not in own and own.count("(?is)<iframe") == 1


@pytest.mark.parametrize("name", ["missing_fields", "completeness", "page_record"])
def test_only_wanted_fields_are_sought(spark, name):
    own = plan(plans.QUERIES[name](spark, SF))
    assert "xing" not in own and "wechat" not in own


def test_facts_of_some_fields(spark):
    docs = spark.createDataFrame([("s", "https://a.example/x", "T", "en", "# Acme\nmail a@b.example")], "site string, url string, title string, lang string, markdown string")
    some = crawl.facts(docs, ("email", "company_name")).first()
    assert [(c.key, c.value) for c in some.cells] == [("email", "a@b.example"), ("company_name", "Acme")]
    assert [c.key for c in crawl.facts(docs).first().cells] == list(P.FIELDS)
