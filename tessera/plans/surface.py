"""The same questions asked in SQL, through the library's functions and table functions."""

from __future__ import annotations

from tessera.functions import patterns as P
from tessera.functions import sql
from tessera.plans import catalog, streams
from tessera.plans.base import has, query, quoted, read, sql_all


def _view(spark, sf_dir, name):
    sql.register(spark)
    read(spark, sf_dir, name).createOrReplaceTempView(f"tessera_{name}")


@query(f"WITH {catalog.LINKS} SELECT page_id, pos, href, text FROM links")
def sql_links(spark, sf_dir):
    sql.register(spark)
    catalog._pages(spark, sf_dir).createOrReplaceTempView("tessera_pages")
    return spark.sql("SELECT page_id, l.* FROM tessera_pages, LATERAL links_of(html, url) AS l")


@query(f"""WITH f AS (SELECT doc_id, unnest({sql_all('text', P.EMAIL)}) AS email, generate_subscripts({sql_all('text', P.EMAIL)}, 1) - 1 AS pos FROM documents), e AS (SELECT doc_id, pos, lower(email) AS email, string_split(lower(email), '@')[1] AS u FROM f)
SELECT doc_id, pos, email, CASE {catalog._DEPT} ELSE 'general' END AS department FROM e WHERE {has('email', f'^{P.EMAIL}$')} AND NOT {has('email', P.NO_REPLY)} AND NOT {has('email', P.PLACEHOLDER)}""")
def sql_emails(spark, sf_dir):
    _view(spark, sf_dir, "documents")
    return spark.sql("SELECT doc_id, e.* FROM tessera_documents, LATERAL emails_of(text) AS e")


@query(f"SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS phone FROM (SELECT doc_id, list_transform(regexp_extract_all(text, {quoted(P.PHONE)}), lambda x: {catalog.sql_trim('x')}) AS p FROM documents) WHERE len(p) > 0")
def sql_phones(spark, sf_dir):
    """Phones have seven characters and more by their pattern."""
    _view(spark, sf_dir, "documents")
    return spark.sql("SELECT doc_id, p.* FROM tessera_documents, LATERAL phones_of(text) AS p")


@query(f"SELECT page_id, {catalog.TITLE} AS title, {catalog.sql_canonical('url')} AS canonical, {catalog.sql_origin('url')} AS origin, {catalog.MD} AS markdown FROM pages")
def sql_pages(spark, sf_dir):
    _view(spark, sf_dir, "pages")
    return spark.sql("SELECT page_id, page_title(html) AS title, canonical_url(url) AS canonical, url_origin(url) AS origin, html_to_markdown(html) AS markdown FROM tessera_pages")


@query(streams._UNDONE)
def sql_undo(spark, sf_dir):
    _view(spark, sf_dir, "events")
    rows = f"SELECT user_id, {streams._ACTION} AS action, event_id AS record, ts FROM tessera_events"
    return spark.sql(f"SELECT user_id, record, array_join(cast(past AS ARRAY<STRING>), ' ') AS past, array_join(cast(future AS ARRAY<STRING>), ' ') AS future FROM undo_of(TABLE({rows}) PARTITION BY user_id ORDER BY (ts, record))")
