"""Queries over the trees of all pages.  SQL has no stack of open elements: tests hold them against a walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import dom, snippets
from tessera.plans.base import query, read


def _nodes(spark, sf_dir):
    return dom.nodes(read(spark, sf_dir, "pages"))


@query(None)
def dom_nodes(spark, sf_dir):
    """Every element and text of every page, with the interval of what lies inside."""
    return _nodes(spark, sf_dir).select("page_id", "node", "parent", "place", "depth", "tag", F.to_json("attributes").alias("attributes"), "stop", "own")


@query(None)
def dom_markdown(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    urls = pages.select("page_id", F.xxhash64("html").alias("page"), "url").distinct()
    return dom.markdown(dom.nodes(pages), urls).select("page_id", "n_blocks", "markdown")


@query(None)
def dom_stamps(spark, sf_dir):
    return dom.stamps(_nodes(spark, sf_dir)).select("page_id", "node", "id", "kind", "text")


@query(None)
def snippet_spans(spark, sf_dir):
    """Every place in all pages of the first words of every page's title."""
    pages = read(spark, sf_dir, "pages")
    words = F.slice(F.split(C.page_title(F.col("html")), " "), 1, 2)
    return snippets.spans(pages, pages.select(F.array_join(words, " ").alias("snippet"))).drop("page")
