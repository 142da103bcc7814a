"""Links of pages: extraction, scoring, frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import patterns as P
from tessera.functions.columns import let
from tessera.operators.records import first_of_each

#: Anchors of a page that are looked at when links are collected from a rendered page, and characters of a text.
ANCHORS, TEXT_CHARS = 80, 80
THRESHOLD = 0.7
ALIASES = {"address": "addresses", "email": "emails", "phone": "phone_numbers"}


def _anchors(html):
    return F.arrays_zip(*[F.regexp_extract_all(html, F.lit(P.ANCHOR), F.lit(g)).alias(name) for name, g in {"tag": 0, "href": 1, "text": 2}.items()])


def _shown(inner):
    return C.squeezed(F.regexp_replace(inner, "<[^>]+>", ""))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, text of every anchor whose target has a canonical URL, which is its href."""
    rows = pages.select("page_id", "url", F.posexplode(_anchors(F.col("html"))).alias("pos", "a"))
    rows = rows.select("page_id", "url", F.col("pos").cast("long").alias("pos"), C.trimmed(F.col("a.href")).alias("raw"), _shown(F.col("a.text")).alias("text"))
    rows = rows.filter("raw <> '' and not startswith(raw, 'javascript:') and not startswith(raw, '#')")
    return rows.select("page_id", "url", "pos", C.canonical_url(C.resolve(F.col("raw"), F.col("url"))).alias("href"), "text").filter("href is not null")


def collect(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, text of the first ANCHORS anchors, where they lead to a web URL and have a text or a label."""
    rows = pages.select("page_id", "url", F.posexplode(F.slice(_anchors(F.col("html")), 1, ANCHORS)).alias("pos", "a"))
    label = C.trimmed(F.regexp_extract("a.tag", r"""(?is)^<a[^>]*\saria-label=["']([^"']*)["']""", 1))
    shown = _shown(F.col("a.text"))
    href = C.resolve(C.trimmed(F.col("a.href")), F.col("url"))
    rows = rows.select("page_id", "url", F.col("pos").cast("long").alias("pos"), href.alias("href"), F.substring(F.when(shown != "", shown).otherwise(label), 1, TEXT_CHARS).alias("text"))
    return rows.filter("startswith(href, 'http') and text <> ''")


def union(pool: DataFrame, extra: DataFrame, key: str = "page_id") -> DataFrame:
    """The links of ``pool`` and, after them, those of ``extra`` with an href that is new for the key."""
    both = pool.withColumn("__part", F.lit(0)).unionByName(extra.withColumn("__part", F.lit(1)))
    both = both.filter("coalesce(href, '') <> ''").withColumn("order", F.struct("__part", "pos")).drop("__part")
    return first_of_each(both, [key, "href"], "order")


def trap(absolute, hay):
    legal = C.matches(absolute, P.LEGAL_TRAP) & ~C.matches(absolute, P.LEGAL_ALLOWED)
    return C.matches(absolute, P.LINK_TRAP) | legal | C.matches(hay, P.TEXT_TRAP) | C.matches(absolute, P.PATH_TRAP)


def frontier_value(canon, text, base, missing=None):
    """Score of a canonical URL: base value, depth, intents (more for those of ``missing``, an array), telling text."""
    def without(x):
        at = F.call_function("locate", x["base"], x["canon"])
        return F.when((x["base"] != "") & (at > 0), F.concat(F.substring(x["canon"], F.lit(1), at - 1), F.substring(x["canon"], at + F.length(x["base"]), F.length(x["canon"])))).otherwise(x["canon"])

    rest = let(F.struct(base.alias("base"), canon.alias("canon")), without)
    depth = F.size(F.filter(F.split(C.url_path(canon), "/"), lambda s: s != ""))

    def scored(hay):
        boost = lambda more: [F.when(C.matches(hay, p), b + more).otherwise(0.0) for _, b, p in P.INTENTS]
        plain = sum(boost(0.0)[1:], boost(0.0)[0])
        if missing is None:
            return plain
        own = F.create_map(*[x for (k, _, _), b in zip(P.INTENTS, boost(0.35)) for x in (F.lit(k), b)])
        names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
        wanted = lambda table: F.aggregate(missing, F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(table, F.coalesce(F.try_element_at(names, k), k)), F.lit(0.0)))
        return F.when(F.size(missing) > 0, let(own, wanted)).otherwise(plain)

    telling = (F.length(text) > 2) & ~C.matches(text, "^(click|here|more|link|read|view)$")
    value = F.lit(0.22) - F.least(F.lit(0.20), depth * 0.04) + let(F.lower(F.concat_ws(" ", text, rest)), scored) + F.when(telling, 0.05).otherwise(0.0)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.round(value, 3)))


def score(links: DataFrame, missing=None, base=None, key: str = "page_id") -> DataFrame:
    """One row for each key and absolute URL: its first link's score and reason, and its rank.

    ``missing`` is an array column of fields that are sought; a link whose frontier score is higher
    than its class's weight then takes that score.  ``base`` is the URL that scores are relative to.
    """
    missing_, base_ = missing if missing is not None else F.array().cast("array<string>"), base if base is not None else C.url_origin(F.col("url"))
    absolute = C.resolve(F.col("href"), F.col("url"))
    rows = links.withColumns({"absolute": absolute, "__missing": missing_, "__base": base_}).withColumn("canon", C.canonical_url(F.col("absolute")))
    rows = rows.withColumn("abs", F.coalesce("canon", "absolute")).select(key, "pos", "abs", "canon", "text", "href", "__missing", "__base")
    rows = first_of_each(rows, [key, "abs"], "pos")
    rows = rows.withColumn("hay", F.concat_ws(" ", C.text(F.col("text")), "href", "abs"))
    best = F.when(trap(F.col("abs"), F.col("hay")), F.struct(F.lit(0.01).alias("score"), F.lit("trap · ignored").alias("reason")))
    for label, weight, pattern in P.TAXONOMY:
        best = best.when(C.matches(F.col("hay"), pattern), F.struct(F.lit(weight).alias("score"), F.lit(f"zero-shot · {label}").alias("reason")))
    rows = rows.withColumn("best", best.otherwise(F.struct(F.lit(0.05).alias("score"), F.lit("unclassified").alias("reason"))))
    if missing is not None:
        own = F.when(F.col("canon").isNull(), 0.0).otherwise(frontier_value(F.col("canon"), C.text(F.col("text")), F.col("__base"), F.col("__missing")))
        rows = rows.withColumn("own", own)
        better = (F.size("__missing") > 0) & (F.col("best.reason") != "trap · ignored") & (F.col("own") > F.col("best.score"))
        named = F.concat(F.lit("frontier · deficit ("), F.col("own").cast("string"), F.lit(")"))
        rows = rows.withColumn("best", F.when(better, F.struct(F.col("own").alias("score"), named.alias("reason"))).otherwise(F.col("best")))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("best.score"), "pos"))
    return rows.select(key, "pos", "abs", "text", "best.score", "best.reason", rank.alias("rank"))


def frontier_score(links: DataFrame, missing: list[str] = ()) -> DataFrame:
    """Frontier score of every link with a canonical URL."""
    rows = links.withColumn("canon", C.canonical_url(C.resolve(F.col("href"), F.col("url")))).filter("canon is not null")
    wanted = F.array(*map(F.lit, missing)) if missing else None
    return rows.select("page_id", "pos", "canon", "text", frontier_value(F.col("canon"), C.text(F.col("text")), C.url_origin(F.col("url")), wanted).alias("score"))


def expand(links: DataFrame, missing: list[str] = (), visited: DataFrame | None = None) -> DataFrame:
    """Canonical links, each once a page, that are not in ``visited`` (href), with score, reason and rank."""
    rows = frontier_score(links, missing).filter("score > 0")
    rows = first_of_each(rows, ["page_id", "canon"], "pos")
    if visited is not None:
        rows = rows.join(visited.select(F.col("href").alias("canon")).distinct(), "canon", "left_anti")
    reason = F.concat(F.lit("frontier · deficit ("), F.format_string("%.2f", "score"), F.lit(")"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return rows.select("page_id", "pos", F.col("canon").alias("href"), "text", "score", reason.alias("reason"), rank.alias("rank"))


def top_k(scored: DataFrame, k: int, threshold: float = THRESHOLD, key: str = "page_id") -> DataFrame:
    """The k best links of each key at or above a threshold; ties by position."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return scored.filter(F.col("score") >= threshold).withColumn("rank", rank).filter(F.col("rank") <= k)


def preview(scored: DataFrame, key: str = "page_id", n: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """The n best links of each key as one line: text and percentage."""
    best = top_k(scored, n, threshold, key)
    line = F.concat("text", F.lit(" "), F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit("%"))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # n of them
    return best.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["line"]), " · ").alias("detail"))
