"""Page trees: outlines of odd markup, and Markdown and stamps against a recursive walk over all pages."""

import re

import pytest

from tessera.functions import columns as C
from tessera.functions import patterns as P
from tessera.operators import dom

BLANKS = re.compile(f"{C.BLANK}+", re.A)
SF = "/root/testdata/sf0.001"
CASES = [
    ("<p>a<p>b", "html(body(p('a') p('b')))"),
    ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", "html(body(ul(li('a') li('b' ul(li('c')) 'd')) 'e'))"),
    ("<b><i>x</b>y</i>z", "html(body(b(i('x')) 'y' 'z'))"),
    ("<html><head><title>T &amp; U</title></head><body class=x><br>q</body>tail</html>", "html(head(title('T & U')) body(br() 'q' 'tail'))"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "html(body(table(tr(td('1') td('2')) tr(td('3')))))"),
    ("<title>t</title><p>x", "html(title('t') body(p('x')))"),
    ("plain <b>bold", "html(body('plain ' b('bold')))"),
    ("<a href=1>x<a href=2>y</a>", "html(body(a('x') a('y')))"),
    ("<p>x<div>y</div></p>z", "html(body(p('x') div('y') 'z'))"),
    ("<script>if (a<b) '</p>'</script><!-- c -->t", "html(script(\"if (a<b) '</p>'\") body('t'))"),
    ("</div>a</p><img src=x>", "html(body('a' img()))"),
    ("<td><table><tr><td>in</td></tr></table>out</td>", "html(body(td(table(tr(td('in'))) 'out')))"),
]


def outline(rows):
    kids = {}
    for r in sorted(rows, key=lambda r: r["node"]):
        kids.setdefault(r["parent"], []).append(r)

    def show(r):
        return repr(r["own"]) if r["tag"] == dom.TEXT else f"{r['tag']}({' '.join(show(k) for k in kids.get(r['node'], []))})"

    return " ".join(show(r) for r in kids.get(None, []))


def test_outlines(spark):
    pages = spark.createDataFrame([(i, "u", html) for i, (html, _) in enumerate(CASES)] + [(100, "u", None), (101, "u", ""), (0, "u", CASES[0][0])], "page_id long, url string, html string")
    rows = dom.nodes(pages).collect()
    for i, (_, want) in enumerate(CASES):
        assert outline([r for r in rows if r["page_id"] == i]) == want
    assert {r["page_id"] for r in rows} == set(range(len(CASES)))


def test_pieces_and_intervals(monkeypatch):
    """A page cut into pieces of a few characters gives the same rows; intervals nest."""
    import pyarrow as pa

    html = "<div><p>one two &amp; three<ul>" + "<li>x<b>y" * 50 + "</div>" + "<b>" * 400 + "deep"
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "page": [7], "html": [html]})
    whole = [r for b in dom.parse([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(dom, "PIECE", 5)
    monkeypatch.setattr(dom, "ROWS", 3)
    assert [r for b in dom.parse([batch]) for r in b.to_pylist()] == whole
    at = {r["node"]: r for r in whole}
    assert sorted(at) == list(range(1, len(whole) + 1))
    for r in whole:
        if r["parent"]:
            assert at[r["parent"]]["node"] < r["node"] <= r["stop"] <= at[r["parent"]]["stop"]


def walked_markdown(rows, url, resolve):
    kids, root = {}, None
    for r in sorted(rows, key=lambda r: r["node"]):
        kids.setdefault(r["parent"], []).append(r)
        if root is None and not r["hidden"] and (r["tag"] in ("main", "article", "body") or (r["attributes"] or {}).get("role") == "main"):
            root = r
    text = lambda r: r["own"] if r["tag"] == dom.TEXT else "".join(text(k) for k in kids.get(r["node"], []) if not k["hidden"])
    blocks = []

    def walk(r):
        if r["tag"] == dom.TEXT or r["hidden"]:
            return
        t = BLANKS.sub(" ", text(r)).strip(" ")
        if r["tag"] in ("h1", "h2", "h3", "h4") and t:
            blocks.append("#" * int(r["tag"][1]) + " " + t)
        elif r["tag"] == "a" and r["attributes"].get("href"):
            href = resolve(r["attributes"]["href"], url)
            blocks.append(f"[{t or href}]({href})")
        elif r["tag"] == "li" and t:
            blocks.append("- " + t)
        elif r["tag"] in ("p", "address", "figcaption", "td", "th") and t:
            blocks.append(t)
        else:
            for k in kids.get(r["node"], []):
                walk(k)

    if root:
        walk(root)
    return "\n\n".join(blocks)[:200_000], len(blocks)


def walked_stamps(rows):
    hint = re.compile(P.STAMP_ROLE_HINTS, re.I)
    mail, phone = re.compile(P.EMAIL, re.I), re.compile(P.PHONE)
    rows = sorted((r for r in rows if r["tag"] != dom.TEXT), key=lambda r: r["node"])
    out, seen, number = [], set(), 0

    def mark(r, kind):
        nonlocal number
        seen.add(r["node"])
        number += 1
        text = r["inner"] or BLANKS.sub(" ", r["attributes"].get("href", "")).strip(" ")
        if text:
            out.append((r["node"], f"src-{kind}-{number}", kind, text[:240]))

    for r in rows:
        if r["tag"] in ("h1", "h2", "h3", "h4"):
            mark(r, "heading")
    for kind, scheme in (("email", "mailto:"), ("phone", "tel:")):
        for r in rows:
            if r["tag"] == "a" and r["attributes"].get("href", "").startswith(scheme):
                mark(r, kind)
    body = next((r["node"] for r in rows if r["tag"] == "body"), None)
    for r in rows:
        if body is None or r["node"] < body or r["node"] in seen or r["tag"] in dom.STRIPPED:
            continue
        if mail.search(r["own"]):
            mark(r, "email")
        elif phone.search(r["own"]) and len(r["own"]) < 40:
            mark(r, "phone")
        elif r["tag"] in ("li", "p", "article", "figcaption", "td") and r["inner"] and len(r["inner"]) < 220 and hint.search(r["inner"]):
            mark(r, "person")
    return out


ODD = [
    (-1, "https://a.example/x/y", "<body><h1> Team <script>no</script></h1><p>Jane Roe, Chief Optics Officer</p><a href='mailto:a@a.example'></a><a href='tel:+14155550100'>call <b>us</b></a><div>mail b@a.example now</div><td>415-555-0100</td><p></p><a href='z'></a><svg><text>Director</text></svg><ul><li>a <a href=/q>q</a><li>Board<ul><li>in</ul></ul>"),
    (-2, "https://b.example/", "<main><p>in main</p></main><p>out</p><h2></h2><address>1 Road</address>"), (-3, "https://c.example/", "<h4>x<h5>y<p>z" * 40), (-4, "https://d.example/", "<title>only a title</title>"),
    (None, "https://e.example/", "<p>no id"), (-5, "https://f.example/", "<p>" + "word " * 400 + "<span>" * 300 + "CEO" * 3), (-6, "https://g.example/", "<div role=main><p>r"),
]


@pytest.fixture(scope="module")
def trees(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(ODD, "page_id long, url string, html string")).cache()
    held = {}
    for r in dom.nodes(pages).collect():
        held.setdefault(r["page_id"], []).append(r)
    return pages, held


def test_markdown(spark, trees):
    from pyspark.sql import functions as F

    pages, held = trees
    urls = pages.select("page_id", F.xxhash64("html").alias("page"), "url")
    url_of = {r["page_id"]: r["url"] for r in urls.collect()}
    pairs = sorted({(r["attributes"]["href"], url_of[i]) for i, rows in held.items() for r in rows if r["tag"] == "a" and r["attributes"].get("href")})
    full = spark.createDataFrame(pairs, "href string, url string").select("href", "url", C.resolve(C.trimmed(F.col("href")), F.col("url")).alias("full")).collect()
    absolute = {(r["href"], r["url"]): r["full"] for r in full}
    got = {r["page_id"]: (r["markdown"], r["n_blocks"]) for r in dom.markdown(dom.nodes(pages), urls).collect()}
    want = {i: walked_markdown(rows, url_of[i], lambda h, u: absolute[h, u]) for i, rows in held.items()}
    assert got == {i: m for i, m in want.items() if m[1]}


def test_stamps(spark, trees):
    pages, held = trees
    got = {}
    for r in dom.stamps(dom.nodes(pages)).collect():
        got.setdefault(r["page_id"], []).append((r["number"], r["node"], r["id"], r["kind"], r["text"]))
    want = {i: walked_stamps(rows) for i, rows in held.items()}
    assert {i: [x[1:] for x in sorted(v)] for i, v in got.items()} == {i: w for i, w in want.items() if w}


def test_no_pages(spark):
    none = dom.nodes(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and dom.stamps(none).count() == 0
