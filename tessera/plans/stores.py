"""Queries through stores and loops that can be resumed, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import keyed, levels, links, observed, settings
from tessera.plans import catalog
from tessera.plans.base import query, read
from tessera.sources import kept, work_folder

_LAST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
_THIRDS = ("event_type in ('view', 'click')", "event_type in ('error', 'signup')", "event_type = 'purchase'")


def _store(spark, sf_dir):
    """The last event of every user in a store, after a commit for views and clicks, one for errors and signups, one for purchases."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    store = keyed.Store(spark, work_folder(spark, "store"), "user_id", "user_id long, ts timestamp_ntz, event_id long, event_type string, value double")
    for part in _THIRDS:
        # what is held counts as well: an older event doesn't replace a younger one
        store.rewrite(rows.filter(part), lambda old, part=part: _last(old.unionByName(rows.filter(part))))
    return store


def _last(rows):
    return rows.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


@query(_LAST)
def store_upsert(spark, sf_dir):
    return _store(spark, sf_dir).read().select("user_id", "event_id", "event_type", "value")


@query(f"SELECT * FROM ({_LAST}) WHERE event_type NOT IN ('error', 'signup')")
def store_delete(spark, sf_dir):
    """The store without the users whose last event is an error or a signup."""
    store = _store(spark, sf_dir)
    store.delete(store.read().filter("event_type in ('error', 'signup')").select("user_id"))
    store.vacuum()
    return store.read().select("user_id", "event_id", "event_type", "value")


@query(f"""WITH RECURSIVE {catalog.LINKS}, e AS (SELECT DISTINCT page_id, href FROM links),
near AS (SELECT DISTINCT x.page_id AS a, y.page_id AS b FROM e x JOIN e y USING (href)), reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT a AS page_id, min(b) AS component FROM reach GROUP BY a""")
def link_components(spark, sf_dir):
    """Pages that are joined through targets they link to, by a loop that can be resumed."""
    edges = links.extract(catalog._pages(spark, sf_dir)).select(F.col("page_id").alias("node"), F.col("href").alias("hub")).distinct()
    return levels.components(kept(edges, "edges"), levels.Levels(spark, work_folder(spark, "levels"))).select(F.col("node").alias("page_id"), "component")


_SETTINGS = "SELECT 'u' || user_id || '/' || event_type AS key, props, event_id FROM events UNION ALL SELECT * FROM (VALUES ('u1/bad', '{not json', -1), ('u1/none', NULL, -2)) t(key, props, event_id)"
_KEPT = f"SELECT key, CASE WHEN props IS NULL THEN 'null' WHEN json_valid(props) THEN json(props)::VARCHAR ELSE to_json(props)::VARCHAR END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM ({_SETTINGS})) WHERE n = 1"


@query(f"""WITH k AS ({_KEPT}) SELECT 'all' AS form, substr(key, 4) AS key, value FROM k WHERE starts_with(key, 'u1/') UNION ALL SELECT 'one', key, value FROM k WHERE key = 'u7/view'
UNION ALL SELECT 'list', key, value FROM k WHERE key IN ('u3/view', 'u99/click') UNION ALL SELECT 'defaults', d.key, coalesce(k.value, d.value) FROM (VALUES ('u5/click', '1'), ('missing', '{{"a":[1]}}')) d(key, value) LEFT JOIN k ON k.key = d.key""")
def settings_get(spark, sf_dir):
    """The last properties of every user and type of event, read in the four forms."""
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type").alias("key"), F.col("props").alias("raw"), "event_id")
    odd = spark.sql("SELECT * FROM VALUES ('u1/bad', '{not json', -1L), ('u1/none', NULL, -2L) AS t(key, raw, event_id)")
    folder, out = work_folder(spark, "settings"), None
    settings.write(rows.union(odd), folder, ["event_id"])
    forms = {"all": settings.get(spark, folder, prefix="u1/"), "one": settings.get(spark, folder, "u7/view"), "list": settings.get(spark, folder, ["u3/view", "u99/click", "nothing"]), "defaults": settings.get(spark, folder, {"u5/click": 1, "missing": {"a": [1]}})}
    for form, found in forms.items():
        own = found.select(F.lit(form).alias("form"), "key", F.to_json("value").alias("value"))
        out = own if out is None else out.union(own)
    return out


@query(f"WITH {catalog.LINKS} SELECT 'links' AS stage, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM links UNION ALL SELECT 'links', 'n_chars', coalesce(sum(length(text)), 0)::DOUBLE FROM links UNION ALL SELECT 'pages', 'n_rows', count(*)::DOUBLE FROM {catalog._PAGES}")
def run_metrics(spark, sf_dir):
    """What the extraction of all links reports of itself, without a job of its own."""
    seen = observed.Observer()
    pages = seen.watch(catalog._pages(spark, sf_dir), "pages")
    found = seen.watch(links.extract(pages), "links", n_chars=F.coalesce(F.sum(F.length("text")), F.lit(0)))
    found.write.parquet(work_folder(spark, "links"))
    return seen.frame(spark)
