"""Small steps that records, prompts and panels are made of, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import chunks
from tessera.functions import columns as C
from tessera.functions import patterns as P
from tessera.operators import crawl, history, keyed, records
from tessera.plans import catalog, entities, streams
from tessera.plans.base import SQL, query, quoted, read
from tessera.sources import work_folder


@query("SELECT doc_id, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') AS escaped FROM documents")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.escaped(F.col("text")).alias("escaped"))


_TOTAL = "CASE event_type WHEN 'view' THEN 300.0 WHEN 'click' THEN 0.0 WHEN 'error' THEN 'NaN'::DOUBLE WHEN 'signup' THEN NULL ELSE 490.0 END"


@query(f"SELECT event_id, least(1.0, greatest(0.0, CASE WHEN total > 0 AND NOT isnan(total) THEN value / total WHEN value <= 1 THEN value ELSE 1.0 END)) AS ratio FROM (SELECT event_id, value, CAST({_TOTAL} AS DOUBLE) AS total FROM events)")
def progress_ratio(spark, sf_dir):
    """What part of a download is done; where the total is not known, a number up to 1 is the part itself."""
    total = F.expr("CASE event_type WHEN 'view' THEN 300D WHEN 'click' THEN 0D WHEN 'error' THEN double('NaN') WHEN 'signup' THEN NULL ELSE 490D END")
    return read(spark, sf_dir, "events").select("event_id", C.progress(F.col("value"), total).alias("ratio"))


_KEYS = "[" + ", ".join(map(quoted, P.FIELDS)) + "]"


@query(f"SELECT page_id, unnest({_KEYS}) AS key, '' AS value, 'low' AS confidence, url AS source_url, false AS dirty, false AS verified FROM pages")
def record_empty(spark, sf_dir):
    """The cells that a page's record has before anything is known."""
    return records.empty(read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url")))


_PATCHED = f"SELECT page_id, company, confidence, t.title FROM ({SQL['company_extract']}) JOIN ({SQL['page_title']}) t USING (page_id)"


@query(f"SELECT page_id, CASE WHEN title <> '' AND title <> company AND (company = '' OR confidence = 'low') THEN title ELSE company END AS value, CASE WHEN title <> '' AND title <> company AND (company = '' OR confidence = 'low') THEN 'medium' ELSE confidence END AS confidence FROM ({_PATCHED})")
def record_patch(spark, sf_dir):
    """A record merged with a patch: every page's company, and its title as a patch of medium confidence."""
    base = catalog.company_extract(spark, sf_dir).select(F.col("page_id").cast("string").alias("site"), F.col("company").alias("value"), "confidence")
    patch = catalog.page_title(spark, sf_dir).select(F.col("page_id").cast("string").alias("site"), F.col("title").alias("value"), F.lit("medium").alias("confidence"))
    cell = lambda rows: rows.select("site", F.lit("company_name").alias("key"), "value", "confidence", F.lit("").alias("source_url"), F.lit(False).alias("dirty"), F.lit(False).alias("verified"))
    merged = records.patched(cell(base), cell(patch))
    return merged.select(F.col("site").cast("long").alias("page_id"), "value", "confidence")


@query(f"SELECT page_id, '# Task' || chr(10) || 'Give the company of this page as JSON.' || chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'Language: en' || chr(10) || chr(10) || left({catalog.MD}, 1024) AS prompt FROM pages")
def prompt_text(spark, sf_dir):
    """Every page's prompt, with as much of its Markdown as a window of 600 tokens leaves."""
    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", chunks.prompt(F.lit("# Task\nGive the company of this page as JSON."), F.col("url"), F.lit("en"), C.html_to_markdown(html), F.lit(600), F.lit(0)).alias("prompt"))


@query(f"""SELECT c.page_id, company AS company_name, CASE WHEN is_legal_name THEN company ELSE '' END AS legal_name, coalesce(d.description, '') AS description, coalesce(a.address, '') AS address, lower(regexp_extract({catalog.MD}, {quoted(P.EMAIL)})) AS email,
 CASE WHEN {catalog.sql_origin('url')} <> '' THEN {catalog.sql_origin('url')} ELSE url END AS website, company <> '' AND coalesce(a.address, '') <> '' AND regexp_matches({catalog.MD}, {quoted(P.EMAIL)}) AND coalesce(x.n, 0) > 0 AS complete, '2024-01-15T00:00:00.000Z' AS extracted_at
 FROM ({SQL['company_extract']}) c JOIN pages USING (page_id) LEFT JOIN ({SQL['description_extract']}) d USING (page_id) LEFT JOIN ({SQL['addresses_extract']}) a ON a.id = 'p' || c.page_id LEFT JOIN (SELECT id, count(*) AS n FROM ({SQL['exec_extract']}) GROUP BY id) x ON x.id = 'p' || c.page_id""")
def page_record(spark, sf_dir):
    """The record of every page alone: its fields, whether it is complete, and when it was made."""
    docs = entities.page_docs(spark, sf_dir).select(F.col("id").alias("site"), "url", "title", "lang", F.col("md").alias("markdown"))
    names = ("company_name", "legal_name", "description", "address", "email", "website")
    found = crawl.facts(docs, names)
    complete = F.lit(True)
    for has in crawl.has_of().values():
        complete = complete & has
    return found.select(F.substring("site", 2, 20).cast("long").alias("page_id"), *[C.text(crawl.value_of(k)).alias(k) for k in names], complete.alias("complete"), F.lit("2024-01-15T00:00:00.000Z").alias("extracted_at"))


@query(f"SELECT * FROM ({streams._UNDONE}) WHERE user_id IN (3, 14, 15)")
def history_read(spark, sf_dir):
    """Stacks written to a store by user, and read for three of them and one who has none."""
    stacks = history.folded(streams._actions(read(spark, sf_dir, "events")), "user_id", ["ts", "event_id"])
    store = keyed.Store(spark, work_folder(spark, "histories"), "user_id", "user_id long, record long, past array<long>, future array<long>")
    store.upsert(stacks)
    return streams._stacks(store.get([3, 14, 15, -1]))
