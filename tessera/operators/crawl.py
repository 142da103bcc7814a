"""Crawls over tables of documents: facts of a page, healing of incomplete records, breadth-first walks.

Documents are rows (site, url, title, lang, markdown, links), a page each; a crawl starts at one URL a
site and reads few pages (page_cap), so what is gathered for a site is bounded by the cap.  Levels are
a driver loop over DataFrames; all sites take a level together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import entities as E
from tessera.functions import patterns as P
from tessera.operators import links as L
from tessera.operators import records as R
from tessera.sources import kept

PAGES, DEPTH = 4, 2
REQUIRED = ("company_name", "address", "email", "executives")


def page_cap(n=None) -> int:
    """2 to 6 pages; PAGES where no finite number is given."""
    try:
        n = float(n)
    except (TypeError, ValueError):
        return PAGES
    return min(6, max(2, int(n + 0.5))) if n == n and abs(n) != float("inf") else PAGES


def facts(docs: DataFrame, fields=tuple(P.FIELDS)) -> DataFrame:
    """``docs`` with what their Markdown says: a value and a confidence for each of ``fields``, and the lists.

    No field is sought that isn't asked for."""
    md, none = C.text(F.col("markdown")), F.array().cast("array<string>")
    heading = C.trimmed(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1))
    title = C.trimmed(F.regexp_extract(C.text(F.col("title")), "^([^|–—-]*)", 1))
    rows = C.once(docs, {"heading": heading, "found": E.addresses_found(md), "phones": E.phones_found(md), "email": F.lower(C.trimmed(C.first_email(md))), "executives": E.executives(md)})
    rows = rows.withColumn("company_name", F.when(F.col("heading") != "", F.col("heading")).otherwise(title))
    name = F.col("company_name")
    sure = F.when(name == "", "low").when((F.col("heading") != "") & (F.length(name) > 3), "high").when(F.length(name) > 8, "medium").otherwise("low")
    legal = F.when(C.matches(name, P.LEGAL_FORM), name).otherwise("")
    no_mail = F.expr("cast(array() as array<struct<email:string,department:string>>)")
    mails = F.when(F.col("email") != "", E.distinct_emails(no_mail, F.array(F.struct("email", F.lit("").alias("department"))))).otherwise(no_mail)
    first = lambda c: C.text(F.get(F.col(c), 0))
    at = lambda c, level: F.when(c != "", level).otherwise("low")
    website, description = C.url_origin(F.col("url")), C.text(C.description(md))
    cells = {
        "company_name": (name, sure), "legal_name": (legal, F.when(legal != "", sure).otherwise("low")), "industry": (F.lit(""), F.lit("low")), "description": (description, at(description, "medium")),
        "address": (first("found"), at(first("found"), "medium")), "email": (F.col("email"), at(F.col("email"), "high")), "phone": (first("phones"), at(first("phones"), "medium")),
        "website": (F.when(website != "", website).otherwise(F.col("url")), F.when(website != "", "high").otherwise("low")),
        "linkedin": (E.profile_link(md, P.LINKEDIN), F.lit("low")), "xing": (E.profile_link(md, P.XING), F.lit("low")), "wechat": (E.wechat(md), F.lit("low")),
    }
    cell = lambda k: F.struct(F.lit(k).alias("key"), cells[k][0].alias("value"), cells[k][1].alias("confidence"))
    return rows.select("site", "url", "title", C.detect_language(C.text(F.col("lang")), md).alias("language"), F.array(*[cell(k) for k in fields]).alias("cells"), E.distinct_addresses(none, F.col("found")).alias("addresses"), E.distinct_phones(none, F.col("phones")).alias("phone_numbers"), mails.alias("emails"), "executives")


def value_of(key: str):
    return F.get(F.filter(F.col("cells"), lambda c: c["key"] == key), 0)["value"]


def has_of():
    """Columns that say which required fields a page's facts have."""
    return {"company_name": value_of("company_name") != "", "address": (value_of("address") != "") | (F.size("addresses") > 0), "email": (value_of("email") != "") | (F.size("emails") > 0), "executives": F.size("executives") > 0}


def observations(visits: DataFrame) -> DataFrame:
    """Field observations of facts with a place (pos), for ``records.merge``."""
    rows = visits.select("site", "pos", "url", F.explode("cells").alias("c"))
    return rows.select("site", "c.key", "pos", "c.value", "c.confidence", F.col("url").alias("source_url"), F.lit(False).alias("dirty"), F.lit(False).alias("verified"))


def merged(visits: DataFrame) -> DataFrame:
    """One record a site (the form of ``exports``) of the facts of a crawl's pages, in the order of pos."""
    cells = R.merge(observations(visits)).groupBy("site").pivot("key", list(P.FIELDS)).agg(F.first("value"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "url", "language", "addresses", "phone_numbers", "emails", "executives")))  # a crawl's pages
    rows = visits.groupBy("site").agg(parts.alias("parts"))
    fold = lambda name, kind, add: F.aggregate(F.col("parts"), F.expr(f"cast(array() as {kind})"), lambda held, p: add(held, p[name]))
    people = "array<struct<name:string,role:string,email:string,confidence:string>>"
    lists = rows.select(
        "site", F.get("parts", 0)["language"].alias("language"), F.array_distinct(F.transform("parts", lambda p: p["url"])).alias("pages_visited"),
        fold("addresses", "array<string>", E.distinct_addresses).alias("addresses"), fold("phone_numbers", "array<string>", E.distinct_phones).alias("phone_numbers"),
        fold("emails", "array<struct<email:string,department:string>>", E.distinct_emails).alias("emails"),
        E.first_of_equal(F.flatten(F.transform("parts", lambda p: p["executives"])), lambda e: F.lower(e["name"])).cast(people).alias("executives"),
    )
    back = {"address": F.get("addresses", 0), "phone": F.get("phone_numbers", 0), "email": F.get("emails", 0)["email"]}
    rows = cells.join(lists, "site")
    strings = [F.coalesce(F.nullif(F.col(k), F.lit("")), back[k], F.lit("")).alias(k) if k in back else C.text(F.col(k)).alias(k) for k in P.FIELDS]
    return rows.select("site", *strings, "language", "pages_visited", "addresses", "phone_numbers", "emails", "executives")


def heal(starts: DataFrame, docs: DataFrame, max_pages=None, infer: Callable[[DataFrame], DataFrame] = facts, cached: DataFrame | None = None) -> DataFrame:
    """Visits (site, pos, depth, url, read, facts) of the crawls from ``starts`` (site, url).

    ``infer`` gives the facts of documents, in the form of ``facts``; sites in ``cached`` (site) are not crawled.

    A site whose record lacks a required field follows its best links (0.7 or more, scored for what
    is missing), ``max_pages`` in all and DEPTH levels deep, and stops as soon as nothing is missing.
    A page that can't be read counts as visited and adds nothing.
    """
    starts = starts.join(cached.select("site").distinct(), "site", "left_anti") if cached is not None else starts
    cap = page_cap(max_pages)

    def facts_of(wanted):
        """Facts and links of the documents that are read; no others are looked at."""
        own = docs.join(wanted.select("site", "url").distinct(), ["site", "url"], "left_semi")
        found = infer(own).withColumns({f"has_{k}": v for k, v in has_of().items()})
        return found.join(own.select("site", "url", "links"), ["site", "url"])

    visits = kept(starts.join(facts_of(starts), ["site", "url"]).select("*", F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(True).alias("read")), "level-0")
    base = starts.select("site", F.col("url").alias("start"))
    for depth in range(1, DEPTH + 1):
        state = visits.groupBy("site").agg(F.count("*").alias("n"), *[F.max(F.coalesce(F.col(f"has_{k}"), F.lit(False))).alias(f"had_{k}") for k in REQUIRED])
        open_ = state.withColumn("missing", R.missing_fields({k: ~F.col(f"had_{k}") for k in REQUIRED})).filter((F.size("missing") > 0) & (F.col("n") < cap)).join(base, "site")
        pool = visits.filter("read").select("site", F.col("pos").alias("page"), F.posexplode("links").alias("at", "link")).select("site", F.struct("page", "at").alias("pos"), "link.href", "link.text")
        pool = R.first_of_each(pool.filter("coalesce(href, '') <> ''"), ["site", "href"], "pos").join(open_, "site").withColumn("url", F.col("start"))
        scored = L.score(pool, F.col("missing"), F.col("start"), key="site").select("site", F.col("abs").alias("url"), "score", "rank")
        queue = scored.filter(F.col("score") >= L.THRESHOLD).join(visits.select("site", "url"), ["site", "url"], "left_anti").join(open_, "site")
        queue = queue.withColumn("place", F.row_number().over(W.partitionBy("site").orderBy("rank"))).filter(F.col("place") <= cap - F.col("n"))
        queue = kept(queue, f"queue-{depth}")
        tried = queue.join(facts_of(queue), ["site", "url"], "left").withColumn("read", F.col("cells").isNotNull())
        before = W.partitionBy("site").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
        done = F.lit(True)
        for k in REQUIRED:  # a page after the one that completes the record is not visited
            done = done & (F.col(f"had_{k}") | F.coalesce(F.max(F.coalesce(F.col(f"has_{k}"), F.lit(False))).over(before), F.lit(False)))
        tried = tried.withColumn("done", done).filter("not done").withColumn("pos", (F.col("n") + F.col("place") - 1).cast("int"))
        visits = visits.unionByName(kept(tried.withColumn("depth", F.lit(depth)).select(*visits.columns), f"level-{depth}"))
    return visits


def walk(starts: DataFrame, docs: DataFrame, max_pages: int = PAGES) -> DataFrame:
    """(site, place, url, title) of the pages that a breadth-first walk reads: links scored 0.7 or more in the
    order of their pages and scores, each URL once, until ``max_pages`` pages were read.

    Every level reads a page at least or ends the walk, so there are ``max_pages`` levels at most.
    """
    pages = docs.select("site", "url", "title", "links")
    frontier = starts.select("site", "url", F.struct(F.lit(0).cast("long").alias("place"), F.lit(0).alias("rank")).alias("at"))
    seen, got = frontier.select("site", "url"), None
    for _ in range(max_pages):
        have = got.groupBy("site").agg(F.count("*").alias("n")) if got is not None else starts.select("site", F.lit(0).cast("long").alias("n")).distinct()
        read = frontier.join(pages, ["site", "url"]).join(have, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        read = read.withColumn("place", F.col("n") + F.row_number().over(W.partitionBy("site").orderBy("at"))).filter(F.col("place") <= max_pages)
        read = kept(read, "walk")
        got = read.select("site", "place", "url", "title") if got is None else got.unionByName(read.select("site", "place", "url", "title"))
        found = read.select("site", "place", "url", F.posexplode("links").alias("pos", "link")).select("site", "place", "url", "pos", "link.href", "link.text")
        found = found.withColumn("page", F.struct("site", "place"))
        ranked = L.score(found, key="page").filter(F.col("score") >= L.THRESHOLD).select("page.site", F.col("abs").alias("url"), F.struct("page.place", "rank").alias("at"))
        frontier = R.first_of_each(ranked, ["site", "url"], "at").join(seen, ["site", "url"], "left_anti")
        seen = seen.unionByName(frontier.select("site", "url"))
    return got


def events(visits: DataFrame) -> DataFrame:
    """(site, seq, stage, status, detail) that the crawls of ``heal`` report, in order."""
    complete = F.lit(True)
    for k in REQUIRED:
        complete = complete & F.max(F.coalesce(F.col(f"has_{k}"), F.lit(False))).over(W.partitionBy("site"))
    own = visits.withColumn("complete", complete).withColumn("last", F.col("pos") == F.max("pos").over(W.partitionBy("site")))
    said = lambda stage, status, detail: F.struct(F.lit(stage).alias("stage"), (status if not isinstance(status, str) else F.lit(status)).alias("status"), detail.alias("detail"))
    url, none = F.col("url"), F.lit("")
    first = F.array(said("sanitize", "ok", url), said("infer", "running", url))
    page = F.when(F.col("read"), F.array(said("navigate", "running", url), said("merge", "ok", url))).otherwise(F.array(said("navigate", "running", url), said("navigate", "warn", url)))
    end = F.array(said("cache", "ok", none), said("done", F.when(F.col("complete"), "ok").otherwise("warn"), none))
    every = F.concat(F.when(F.col("pos") == 0, first).otherwise(page), F.when(F.col("last"), end).otherwise(F.slice(end, 1, 0)))
    rows = own.select("site", "pos", F.posexplode(every).alias("at", "e"))
    return rows.select("site", (F.col("pos") * 10 + F.col("at")).cast("long").alias("seq"), "e.*")
