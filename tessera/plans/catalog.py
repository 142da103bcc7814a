"""The queries of the library and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import entities as E
from tessera.functions import patterns as P
from tessera.operators import links, records
from tessera.plans.base import has, query, quoted, read, rows_of, sql_all, sql_fold, sql_squeeze, sql_steps, sql_trim, values

# ---- page texts

TITLE = sql_squeeze("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, {sql_steps('html', P.SANITIZE)} AS clean FROM pages")
def html_sanitize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.sanitize_html(F.col("html")).alias("clean"))


MD = sql_trim(sql_steps("html", P.SANITIZE + P.MARKDOWN))


@query(f"SELECT page_id, {MD} AS markdown FROM pages")
def html_to_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.html_to_markdown(F.col("html")).alias("markdown"))


@query(f"SELECT page_id, len(regexp_split_to_array({MD}, {quoted(C.BLANK + '+')})) AS n_tokens FROM pages")
def token_count(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.token_count(C.html_to_markdown(F.col("html"))).alias("n_tokens"))


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH m AS (SELECT page_id, {MD} AS md, {sql_squeeze("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages),
c AS (SELECT page_id, {sql_trim("regexp_extract(md, '(?m)^#\\s+(.+)$', 1)")} AS h1, {sql_trim("regexp_extract(title, '^([^|–—-]*)', 1)")} AS t FROM m)
SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE t END AS company,
  CASE WHEN h1 = '' AND t = '' THEN 'low' WHEN length(h1) > 3 THEN 'high' WHEN length(CASE WHEN h1 <> '' THEN h1 ELSE t END) > 8 THEN 'medium' ELSE 'low' END AS confidence,
  {has("CASE WHEN h1 <> '' THEN h1 ELSE t END", P.LEGAL_FORM)} AS is_legal_name FROM c""")
def company_extract(spark, sf_dir):
    return companies(spark, sf_dir).select("page_id", "company", "confidence", "is_legal_name")


def companies(spark, sf_dir):
    """(page_id, url, md, company, confidence, is_legal_name) of every page; its Markdown is made once."""
    html = F.col("html")
    rows = C.once(read(spark, sf_dir, "pages").select("page_id", "url", "html"), {"md": C.html_to_markdown(html), "t": C.trimmed(F.regexp_extract(C.page_title(html), "^([^|–—-]*)", 1))})
    rows = C.once(rows.select("page_id", "url", "md", "t"), {"h1": C.trimmed(F.regexp_extract("md", r"(?m)^#\s+(.+)$", 1))})
    name = F.when(F.col("h1") != "", F.col("h1")).otherwise(F.col("t"))
    sure = F.when(name == "", "low").when(F.length("h1") > 3, "high").when(F.length(name) > 8, "medium").otherwise("low")
    return rows.select("page_id", "url", "md", name.alias("company"), sure.alias("confidence"), C.matches(name, P.LEGAL_FORM).alias("is_legal_name"))


@query(f"""WITH m AS (SELECT page_id, unnest(string_split({MD}, chr(10))) AS line, generate_subscripts(string_split({MD}, chr(10)), 1) AS pos FROM pages),
l AS (SELECT page_id, pos, {sql_trim('line')} AS line FROM m),
ok AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM l WHERE length(line) > 50 AND NOT regexp_matches(line, '^(#|-|Address:|Contact:)') AND NOT {has('line', P.BORING)})
SELECT page_id, substr({sql_trim(f"regexp_replace(line, {quoted('(?i)' + P.GREETING)}, '')")}, 1, 320) AS description FROM ok WHERE n = 1""")
def description_extract(spark, sf_dir):
    # explode passes rows on one by one, so that the regex chain runs once and the filter doesn't repeat it
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(F.array(C.description(C.html_to_markdown(F.col("html"))))).alias("description"))
    return rows.filter("description is not null")


PAGE = f"""array_to_string(list_filter(list_transform(string_split({MD}, chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> ''), chr(10))"""


@query(f"""WITH c AS (SELECT lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) AS site, page_id, url, {TITLE} AS title, substr({PAGE}, 1, 12000) AS body FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS place FROM c)
SELECT site, page_id, place, CASE WHEN place > 1 THEN chr(10) || chr(10) || repeat('=', 40) || chr(10) || chr(10) ELSE '' END || '--- Page ' || place || ': ' || url || ' (' || coalesce(nullif(title, ''), 'No Title') || ') ---' || chr(10) || body AS part FROM n""")
def context_concat(spark, sf_dir):
    """A site's context, one row a page: its parts in the order of place, joined, are the whole text.

    Sites are not gathered in one cell, so a site may have any number of pages."""
    body = F.array_join(F.filter(F.transform(F.split(C.html_to_markdown(F.col("html")), "\n"), C.trimmed), lambda s: s != ""), "\n")
    rows = read(spark, sf_dir, "pages").select(C.url_origin(F.col("url")).alias("site"), "page_id", "url", C.page_title(F.col("html")).alias("title"), F.substring(body, 1, 12000).alias("body"))
    rows = records.numbered(rows, "site", "page_id").withColumnRenamed("number", "place")
    gap = F.when(F.col("place") > 1, F.concat(F.lit("\n\n"), F.lit("=" * 40), F.lit("\n\n"))).otherwise("")
    head = F.concat(F.lit("--- Page "), F.col("place").cast("string"), F.lit(": "), "url", F.lit(" ("), F.coalesce(F.nullif("title", F.lit("")), F.lit("No Title")), F.lit(") ---\n"))
    return rows.select("site", "page_id", "place", F.concat(gap, head, "body").alias("part"))


# ---- URLs and links

@query("SELECT page_id, lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) AS origin FROM pages")
def url_origin(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.url_origin(F.col("url")).alias("origin"))


@query("""SELECT page_id, lower(printf('%x', list_reduce(list_transform(string_split(url, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)))) AS hash FROM pages""")
def url_hash(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.fnv1a(F.col("url")).alias("hash"))


def sql_origin(url: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({url}, '(?i)^(https?://[^/?#]+)', 1)), '^(https?://)[^@]*@', '\\1'), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"


_DOTTED = sql_fold("string_split(raw_path, '/')", "CASE WHEN {x} = '.' THEN acc WHEN {x} = '..' THEN CASE WHEN len(acc) > 1 THEN acc[1:len(acc) - 1] ELSE acc END ELSE list_append(acc, {x}) END")


_UNSAFE = quoted(C.UNSAFE)


def sql_encoded(path: str) -> str:
    return f"CASE WHEN regexp_matches({path}, {_UNSAFE}) THEN array_to_string(list_transform(string_split({path}, ''), lambda c: CASE WHEN regexp_matches(c, {_UNSAFE}) THEN url_encode(c) ELSE c END), '') ELSE {path} END"


def sql_canonical(url: str) -> str:
    """A scalar subquery; ``url`` must be an absolute URL column."""
    assets, tracking = ", ".join(map(quoted, P.ASSETS)), ", ".join(map(quoted, P.TRACKING))
    return f"""(SELECT CASE WHEN o <> '' AND CASE WHEN contains(coalesce(segs[-1], ''), '.') THEN string_split(segs[-1], '.')[-1] ELSE '' END NOT IN ({assets})
 AND NOT {has('path', P.PATH_TRAP)} AND NOT (len(segs) > 3 AND len(list_distinct(segs)) < len(segs) / 1.5)
 THEN regexp_replace(o || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END, '/+$', '') END
 FROM (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM (SELECT *, CASE WHEN regexp_matches(raw_path, '(^|/)[.][.]?(/|$)') THEN array_to_string({_DOTTED}, '/') || CASE WHEN regexp_matches(raw_path, '/[.][.]?$') THEN '/' ELSE '' END ELSE raw_path END AS path
 FROM (SELECT {sql_origin(url)} AS o, lower({sql_encoded(f"regexp_extract({url}, '(?i)^https?://[^/?#]+([^?#]*)', 1)")}) AS raw_path,
 array_to_string(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda kv: kv <> '' AND lower(string_split(kv, '=')[1]) NOT IN ({tracking})), '&') AS kept))))"""


URLS = rows_of(
    (-1, "HTTPS://Example.COM/About/"), (-2, "https://example.com/contact?utm_source=google&fbclid=xyz#top"), (-3, "https://example.com/team?session_id=12345"), (-4, "https://example.com/locations?lang=en"),
    (-5, "https://example.com/a.pdf"), (-6, "https://example.com/style.css"), (-7, "https://example.com/catalog/category/catalog/category/catalog/category"), (-8, "http://user:pw@Example.com:80/a/./b/../c/"),
    (-9, "https://example.com:443/x/.."), (-10, "https://example.com:8443/research/paper"), (-11, "mailto:a@example.com"), (-12, "https://example.com"), (-13, "https://example.com/Über uns/a{b}?q=ü"), (-14, "https://example.com/日本/😀"),
)


@query(f"SELECT page_id, {sql_canonical('url')} AS canonical FROM (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {URLS}) t(page_id, url))")
def url_canonical(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url").union(values(spark, URLS, "page_id, url"))
    return rows.select("page_id", C.canonical_url(F.col("url")).alias("canonical"))


ABSOLUTE = r"""CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw WHEN starts_with(raw, '//') THEN regexp_extract(url, '(?i)^(https?:)', 1) || raw
 WHEN starts_with(raw, '/') THEN lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) || raw WHEN starts_with(raw, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || raw
 ELSE rtrim(regexp_extract(url, '(?i)^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1), '/') || '/' || raw END"""
# pages with links of all classes, ties, traps, labels, more than are wanted
LINK_PAGES = rows_of(
    (-1, "https://acme.example/", '<a href="/team">Team</a> <a href="/about-us">About us</a> <a class="x" href="/contact">Contact</a> <a href="/blog/1">Team blog</a> <a href="/TEAM?utm_source=x">Our <b>team</b></a> <a href="/leadership">Leadership</a> <a href="/board.pdf">Board</a> <a href="/offices#map">Offices</a> <a href="/legal/impressum">Impressum</a> <a href="/legal">Legal</a> <a href="//www.acme.example/company">Company</a>'),
    (-2, "https://beta.example/de/index.html", '<a aria-label="Kontakt" href="kontakt"><img src="x"></a> <a href="../team">x</a> <a href="?page=2">More</a> <a href="#top">Top</a> <a href="javascript:go()">Go</a> <a href="mailto:a@beta.example">Mail</a> <a href="/people">People</a> <a href="/directors">Directors</a> <a href="/management">Management</a> <a href="/vorstand">Vorstand</a>'),
)
_PAGES = f"(SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES {LINK_PAGES}) t(page_id, url, html))"


def _pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", "html").union(values(spark, LINK_PAGES, "page_id, url, html"))


_TEXT = sql_squeeze("regexp_replace(text, '<[^>]+>', '', 'g')")
_RAW = f"""raw AS (SELECT page_id, url, unnest({sql_all('html', P.ANCHOR)}) AS tag, unnest({sql_all('html', P.ANCHOR, 1)}) AS href, unnest({sql_all('html', P.ANCHOR, 2)}) AS text, generate_subscripts({sql_all('html', P.ANCHOR)}, 1) - 1 AS pos FROM {_PAGES}),
anchors AS (SELECT page_id, url, tag, pos, {sql_trim('href')} AS raw, {_TEXT} AS text FROM raw)"""
LINKS = f"""{_RAW}, found AS (SELECT *, {ABSOLUTE} AS absolute FROM anchors WHERE raw <> '' AND NOT starts_with(raw, 'javascript:') AND NOT starts_with(raw, '#')),
links AS (SELECT page_id, url, pos, href, text FROM (SELECT *, {sql_canonical('absolute')} AS href FROM found) WHERE href IS NOT NULL)"""
_ARIA = quoted(r"""(?is)^<a[^>]*\saria-label=["']([^"']*)["']""")
COLLECTED = f"""{_RAW}, seen AS (SELECT *, {ABSOLUTE} AS href, substr(CASE WHEN text <> '' THEN text ELSE {sql_trim(f'regexp_extract(tag, {_ARIA}, 1)')} END, 1, 80) AS shown FROM anchors WHERE pos < 80),
links AS (SELECT page_id, url, pos, href, shown AS text FROM seen WHERE starts_with(href, 'http') AND shown <> '')"""


@query(f"WITH {LINKS} SELECT page_id, pos, href, text FROM links")
def links_extract(spark, sf_dir):
    return links.extract(_pages(spark, sf_dir)).select("page_id", "pos", "href", "text")


@query(f"WITH {COLLECTED} SELECT page_id, pos, href, text FROM links")
def links_collect_cap(spark, sf_dir):
    return links.collect(_pages(spark, sf_dir)).select("page_id", "pos", "href", "text")


EXTRA = rows_of((1, 0, "https://shop.example/team", "Our team"), (1, 1, "https://shop.example/team", "Again"), (1, 2, "", "Nothing"), (2, 0, "https://two.example/contact", "Contact"))


@query(f"""WITH {COLLECTED}, pool AS (SELECT page_id, 0 AS part, pos, href, text FROM links UNION ALL SELECT page_id, 1, pos, href, text FROM (VALUES {EXTRA}) t(page_id, pos, href, text))
SELECT page_id, href, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY part, pos) AS n FROM pool WHERE href <> '') WHERE n = 1""")
def link_union(spark, sf_dir):
    extra = values(spark, EXTRA, "page_id, pos, href, text").select(F.col("page_id").cast("long"), F.col("pos").cast("long"), "href", "text")
    return links.union(links.collect(_pages(spark, sf_dir)).select("page_id", "pos", "href", "text"), extra).select("page_id", "href", "text")


def sql_frontier_value(missing=()):
    """Score of ``canon`` with ``text`` relative to ``base``; needs hay and depth."""
    terms = " + ".join(f"CASE WHEN {has('hay', p)} THEN {b + (0.35 if missing else 0.0)}::DOUBLE ELSE 0.0::DOUBLE END" for k, b, p in P.INTENTS if not missing or k in missing)
    return f"least(0.99::DOUBLE, greatest(0.01::DOUBLE, round(0.22::DOUBLE - least(0.20::DOUBLE, depth * 0.04::DOUBLE) + {terms} + CASE WHEN length(text) > 2 AND NOT {has('text', '^(click|here|more|link|read|view)$')} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 3)))"


_HAY = "lower(text || ' ' || CASE WHEN strpos(canon, base) > 0 THEN substr(canon, 1, strpos(canon, base) - 1) || substr(canon, strpos(canon, base) + length(base)) ELSE canon END)"
_DEPTH = "len(list_filter(string_split(regexp_extract(canon, '(?i)^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''))"
_TAX = " ".join(f"WHEN {has('words', p)} THEN {{}}".format(repr(w)) for _, w, p in P.TAXONOMY)
_WHY = " ".join(f"WHEN {has('words', p)} THEN {quoted('zero-shot · ' + n)}" for n, _, p in P.TAXONOMY)


def sql_scored(missing=()):
    own = f"CASE WHEN canon IS NULL THEN 0.0::DOUBLE ELSE {sql_frontier_value(missing)} END" if missing else "0.0::DOUBLE"
    return f"""{COLLECTED}, b AS (SELECT *, {sql_canonical('href')} AS canon, {sql_origin('url')} AS base FROM links),
c AS (SELECT *, coalesce(canon, href) AS abs FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY page_id, abs ORDER BY pos) AS n, text || ' ' || href || ' ' || abs AS words, {_HAY} AS hay, {_DEPTH} AS depth FROM c),
e AS (SELECT *, {has('abs', P.LINK_TRAP)} OR ({has('abs', P.LEGAL_TRAP)} AND NOT {has('abs', P.LEGAL_ALLOWED)}) OR {has('words', P.TEXT_TRAP)} OR {has('abs', P.PATH_TRAP)} AS trap, {own} AS own FROM d WHERE n = 1),
f AS (SELECT *, CAST(CASE WHEN trap THEN 0.01 {_TAX} ELSE 0.05 END AS DOUBLE) AS plain, CASE WHEN trap THEN 'trap · ignored' {_WHY} ELSE 'unclassified' END AS why FROM e),
g AS (SELECT page_id, pos, abs, text, CASE WHEN NOT trap AND own > plain THEN own ELSE plain END AS score, CASE WHEN NOT trap AND own > plain THEN 'frontier · deficit (' || CAST(own AS VARCHAR) || ')' ELSE why END AS reason FROM f),
scored AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM g)"""


@query(f"WITH {sql_scored()} SELECT * FROM scored")
def links_score(spark, sf_dir):
    return links.score(links.collect(_pages(spark, sf_dir)))


@query(f"WITH {sql_scored(('emails', 'executives'))} SELECT * FROM scored")
def links_score_deficit(spark, sf_dir):
    return links.score(links.collect(_pages(spark, sf_dir)), F.array(F.lit("email"), F.lit("executives")))


@query(f"WITH {sql_scored(('emails', 'executives'))} SELECT page_id, pos, abs, score, rank FROM scored WHERE score >= 0.7 AND rank <= 4")
def frontier_topk(spark, sf_dir):
    return links.top_k(links_score_deficit(spark, sf_dir).drop("rank"), 4).select("page_id", "pos", "abs", "score", "rank")


@query(f"WITH {sql_scored(('emails', 'executives'))} SELECT page_id, string_agg(text || ' ' || CAST(floor(score * 100 + 0.5) AS BIGINT) || '%', ' · ' ORDER BY rank) AS detail FROM scored WHERE score >= 0.7 AND rank <= 3 GROUP BY page_id")
def frontier_preview(spark, sf_dir):
    return links.preview(links_score_deficit(spark, sf_dir).drop("rank"))


@query(f"WITH {sql_scored()}, pages2 AS (SELECT DISTINCT {sql_canonical('url')} AS canon FROM {_PAGES}) SELECT page_id, pos, abs FROM scored WHERE abs NOT IN (SELECT canon FROM pages2 WHERE canon IS NOT NULL)")
def frontier_anti(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    visited = pages.select(C.canonical_url(F.col("url")).alias("abs")).filter("abs is not null").distinct()
    return links.score(links.collect(pages)).join(visited, "abs", "left_anti").select("page_id", "pos", "abs")


def sql_frontier(missing=()):
    return f"""{LINKS}, b AS (SELECT *, href AS canon, {sql_origin('url')} AS base FROM links), c AS (SELECT *, {_HAY} AS hay, {_DEPTH} AS depth FROM b),
frontier AS (SELECT page_id, pos, canon, text, {sql_frontier_value(missing)} AS score FROM c)"""


@query(f"WITH {sql_frontier()} SELECT * FROM frontier")
def frontier_score(spark, sf_dir):
    return links.frontier_score(links.extract(_pages(spark, sf_dir)))


@query(f"WITH {sql_frontier(('emails', 'executives'))} SELECT * FROM frontier")
def frontier_score_deficit(spark, sf_dir):
    return links.frontier_score(links.extract(_pages(spark, sf_dir)), ["email", "executives"])


VISITED = "(SELECT canon FROM frontier WHERE page_id % 7 = 0)"


@query(f"""WITH {sql_frontier(('emails', 'executives'))}, once AS (SELECT *, row_number() OVER (PARTITION BY page_id, canon ORDER BY pos) AS n FROM frontier)
SELECT page_id, pos, canon AS href, text, score, printf('frontier · deficit (%.2f)', score) AS reason, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM once WHERE n = 1 AND canon NOT IN {VISITED}""")
def frontier_expand(spark, sf_dir):
    found = links.extract(_pages(spark, sf_dir))
    return links.expand(found, ["email", "executives"], found.filter("page_id % 7 = 0").select("href"))


@query(f"WITH {LINKS} SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM links GROUP BY page_id")
def link_graph_degree(spark, sf_dir):
    return links.extract(_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"))


# ---- languages and contacts

_ATTR = "CASE doc_id % 5 WHEN 0 THEN 'de-AT' WHEN 1 THEN '' WHEN 2 THEN 'und' ELSE NULL END"


@query(f"SELECT doc_id, CASE WHEN {_ATTR} NOT IN ('', 'und') THEN string_split({_ATTR}, '-')[1] WHEN regexp_matches(text, '[぀-ヿ一-龯]') THEN 'ja' WHEN regexp_matches(text, '[äöüßÄÖÜ]') OR {has('text', P.GERMAN)} THEN 'de' ELSE 'en' END AS detected FROM documents")
def lang_detect(spark, sf_dir):
    """Every fifth document has a language attribute, others an empty one, und or none."""
    return read(spark, sf_dir, "documents").select("doc_id", C.detect_language(C.text(F.expr(_ATTR)), F.col("text")).alias("detected"))


_NAMES = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in P.LANGUAGE_NAMES.items())


@query(f"SELECT doc_id, coalesce(CASE lower(string_split(coalesce(lang, 'en'), '-')[1]) {_NAMES} END, nullif(lang, ''), 'English') AS language FROM documents")
def language_name(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.language_name(F.col("lang")).alias("language"))


@query(f"SELECT doc_id, lower(regexp_extract(text, {quoted(P.EMAIL)})) AS email FROM documents WHERE regexp_matches(text, {quoted(P.EMAIL)})")
def emails_first(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_extract("text", P.EMAIL, 0)).alias("email"))
    return rows.filter("email <> ''")


MAILS = rows_of(
    (-1, 1, "Info@Acme.example", "general"), (-1, 2, "jobs@acme.example", None), (-1, 3, "INFO@acme.example", "press"), (-1, 4, "lead@acme.example", "board"), (-1, 5, "noreply@acme.example", None),
    (-1, 6, "test@example.com", None), (-1, 7, "not an address", None), (-1, 8, "sales.eu@acme.example ", None),
)
_DEPT = " ".join(f"WHEN {has('u', p)} THEN {quoted(n)}" for n, p in P.DEPARTMENTS)


@query(f"""WITH f AS (SELECT doc_id, unnest({sql_all('text', P.EMAIL)}) AS email, generate_subscripts({sql_all('text', P.EMAIL)}, 1) AS pos FROM documents),
e AS (SELECT doc_id, pos, lower(email) AS email, '' AS given FROM f UNION ALL SELECT doc_id, pos, lower(trim(email)), coalesce(given, '') FROM (VALUES {MAILS}) t(doc_id, pos, email, given)),
d AS (SELECT *, string_split(email, '@')[1] AS u, row_number() OVER (PARTITION BY doc_id, email ORDER BY pos) AS n FROM e WHERE {has('email', f'^{P.EMAIL}$')} AND NOT {has('email', P.NO_REPLY)} AND NOT {has('email', P.PLACEHOLDER)})
SELECT doc_id, email, CASE WHEN given NOT IN ('', 'general') THEN given {_DEPT} ELSE 'general' END AS department FROM d WHERE n = 1""")
def emails_aggregate(spark, sf_dir):
    """Addresses found in documents, and one list with departments given, each once, first wins."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(0)), lambda e: F.struct(e.alias("email"), F.lit("").alias("department"))).alias("mails")).filter("size(mails) > 0")
    given = values(spark, MAILS, "doc_id, pos, email, department").groupBy(F.col("doc_id").cast("long")).agg(F.array_sort(F.collect_list(F.struct("pos", "email", "department"))).alias("mails"))  # one literal list
    given = given.select("doc_id", F.transform("mails", lambda m: F.struct(m["email"].alias("email"), C.text(m["department"]).alias("department"))).alias("mails"))
    none = F.expr("cast(array() as array<struct<email:string,department:string>>)")
    return found.unionByName(given).select("doc_id", F.explode(E.distinct_emails(none, F.col("mails"))).alias("e")).select("doc_id", "e.*")


@query(f"SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, {quoted(P.PHONE)}), lambda p: {sql_trim('p')}), lambda p: length(p) >= 7))) AS phone FROM documents")
def phones_extract(spark, sf_dir):
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(P.PHONE), F.lit(0)), C.trimmed), lambda p: F.length(p) >= 7)
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("phone"))


PHONES = rows_of((-1, 1, "+1 (415) 555-0199"), (-1, 2, "030-123456"), (-1, 3, "+1.415.555.0199"), (-1, 4, "+1 415 555 0199 ext. 102"), (-1, 5, "+44 20 7946 0958"), (-1, 6, "123"), (-1, 7, "415-555-0199 x 7"), (-1, 8, "415-555-0199 x102"))
_DIGITS = r"regexp_replace(string_split_regex(trim(raw), '(?i)\b(?:ext|extension|x)\b')[1], '\D', '', 'g')"
_PHONES = f"""f AS (SELECT doc_id, list_transform({sql_all('text', P.PHONE)}, lambda p: {sql_trim('p')}) AS found FROM documents),
u AS (SELECT doc_id, unnest(found) AS raw, generate_subscripts(found, 1) AS pos FROM f UNION ALL SELECT doc_id, raw, pos FROM (VALUES {PHONES}) t(doc_id, pos, raw)),
p AS (SELECT doc_id, pos, raw, d FROM (SELECT *, {_DIGITS} AS d FROM u) WHERE length(d) BETWEEN 7 AND 15)"""


def _phone_lists(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("text", F.lit(P.PHONE), F.lit(0)), C.trimmed)
    rows = read(spark, sf_dir, "documents").select("doc_id", found.alias("phones")).filter("size(phones) > 0")
    given = values(spark, PHONES, "doc_id, pos, raw").groupBy(F.col("doc_id").cast("long")).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("phones"))  # one literal list
    return rows.unionByName(given.select("doc_id", F.transform("phones", lambda p: p["raw"]).alias("phones")))


@query(f"WITH {_PHONES} SELECT doc_id, pos, raw, CASE WHEN starts_with(trim(raw), '+') THEN '+' ELSE '' END || d AS clean, right(d, 8) AS footprint, length(string_split_regex(trim(raw), '(?i)\\b(?:ext|extension|x)\\b')[1]) < length(trim(raw)) AS has_extension FROM p")
def phone_normalize(spark, sf_dir):
    rows = _phone_lists(spark, sf_dir).select("doc_id", F.posexplode("phones").alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "raw", C.phone_digits(F.col("raw")).alias("d")).filter("d is not null")
    whole = F.get(F.split(C.trimmed(F.col("raw")), P.java(r"\b(?:ext|extension|x)\b")), 0)
    return rows.select("doc_id", "pos", "raw", F.concat(F.when(F.startswith(F.trim("raw"), F.lit("+")), "+").otherwise(""), "d").alias("clean"), F.right("d", F.lit(8)).alias("footprint"), (F.length(whole) < F.length(C.trimmed(F.col("raw")))).alias("has_extension"))


@query(f"""WITH {_PHONES}, g AS (SELECT doc_id, right(d, 8) AS footprint, min(pos) AS first, list_reduce(list(raw ORDER BY pos), lambda cur, x: CASE WHEN length(x) > length(cur) OR (starts_with(x, '+') AND NOT starts_with(cur, '+')) THEN x ELSE cur END) AS phone FROM p GROUP BY doc_id, right(d, 8))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place, phone FROM g""")
def phones_dedup(spark, sf_dir):
    """Phones of every document and of one literal list, one for each last eight digits."""
    rows = _phone_lists(spark, sf_dir).select("doc_id", F.posexplode(E.distinct_phones(F.array().cast("array<string>"), F.col("phones"))).alias("place", "phone"))
    return rows.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "phone")


@query(f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(P.EMAIL)})) AS email FROM documents)
SELECT doc_id, left(email, 1) || '•••@' || string_split(email, '@')[2] AS masked FROM e""")
def pii_mask(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.EMAIL), F.lit(0))).alias("email"))
    return rows.select("doc_id", C.mask_email(F.col("email")).alias("masked"))


@query(f"SELECT lang, count(*) FILTER (regexp_matches(text, {quoted(P.EMAIL)})) AS with_email, count(*) FILTER (regexp_matches(text, {quoted(P.PHONE)})) AS with_phone, count(*) AS n FROM documents GROUP BY lang")
def pii_by_lang(spark, sf_dir):
    t = F.col("text")
    mail, phone = t.contains("@") & t.rlike(P.EMAIL), t.rlike(r"\d{3}|00|\+") & t.rlike(P.PHONE)  # the cheap test first
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(mail).alias("with_email"), F.count_if(phone).alias("with_phone"), F.count("*").alias("n"))


# ---- history and numbers

@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def history_clip(spark, sf_dir):
    return records.keep_last(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id")


NUMBERS = "(1, 1.2D), (2, 2.5D), (3, 999.4D), (4, 4321.0D), (5, 65432.1D), (6, -3.0D), (7, NULL), (8, CAST('NaN' AS DOUBLE)), (9, CAST('Infinity' AS DOUBLE))"
_NUM_SQL = NUMBERS.replace("D)", "::DOUBLE)")
_FINITE = "n IS NOT NULL AND NOT isnan(n) AND NOT isinf(n)"


_ALL_NUMBERS = f"(SELECT CAST(id AS VARCHAR) AS id, n FROM (VALUES {_NUM_SQL}) t(id, n) UNION ALL SELECT 'e' || event_id, value FROM events)"


def _numbers(spark, sf_dir):
    """Literal numbers, odd ones too, and the values of all events."""
    given = values(spark, NUMBERS, "id, n").select(F.col("id").cast("string").alias("id"), "n")
    return given.union(read(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id"), "value"))


@query(f"SELECT id, CASE WHEN {_FINITE} THEN CAST(least(6, greatest(2, floor(n + 0.5))) AS INT) ELSE 4 END AS cap FROM {_ALL_NUMBERS}")
def page_cap(spark, sf_dir):
    n = F.col("n")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return _numbers(spark, sf_dir).select("id", F.when(finite, F.least(F.lit(6), F.greatest(F.lit(2), F.floor(n + 0.5))).cast("int")).otherwise(4).alias("cap"))


@query(f"SELECT id, CASE WHEN n < 0 OR NOT ({_FINITE}) THEN '' WHEN n < 1000 THEN CAST(CAST(floor(n + 0.5) AS BIGINT) AS VARCHAR) || ' ms' WHEN n >= 10000 THEN printf('%.1f s', n / 1000) ELSE printf('%.2f s', n / 1000) END AS shown FROM {_ALL_NUMBERS}")
def fmt_duration(spark, sf_dir):
    return _numbers(spark, sf_dir).select("id", C.duration(F.col("n")).alias("shown"))


@query("SELECT user_id, event_id, CAST((n - 1) % 3 + 1 AS INT) AS attempt, 250 * pow(2, (n - 1) % 3) AS delay_ms FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error')")
def backoff_schedule(spark, sf_dir):
    """The wait before each retry: a user's errors in order are first, second and third attempts."""
    rows = records.numbered(read(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id"), "user_id", "event_id")
    attempt = ((F.col("number") - 1) % 3 + 1).cast("int")
    return rows.select("user_id", "event_id", attempt.alias("attempt"), (F.lit(250) * F.pow(F.lit(2), attempt - 1)).alias("delay_ms"))


# ---- roll-ups

@query("SELECT lower(regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1)) AS site, count(*) AS n_pages, CAST(sum(length(html)) AS BIGINT) AS n_chars FROM pages GROUP BY 1")
def site_rollup(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(C.url_origin(F.col("url")).alias("site")).agg(F.count("*").alias("n_pages"), F.sum(F.length("html")).alias("n_chars"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_window(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
