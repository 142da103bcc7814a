"""The library in SQL: functions with SQL bodies, table functions, and a table function that keeps state.

``register(spark)`` makes them temporary functions of a session.  Bodies are SQL that Catalyst inlines, so
they cost what the Column functions cost::

    SELECT page_id, l.* FROM pages, LATERAL links_of(html, url) AS l
    SELECT * FROM undo_of(TABLE(SELECT user_id, action, record, ts FROM edits) PARTITION BY user_id ORDER BY ts)

Nulls: text functions take null as empty, as the Column functions do; table functions give no rows for it.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from tessera.functions import columns as C
from tessera.functions import patterns as P

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def text(value: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _steps(col: str, steps) -> str:
    for pattern, by in steps:
        col = f"regexp_replace({col}, {text(pattern)}, {text(by)})"
    return col


def _cases(col: str, cases, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN coalesce({col} rlike {text(P.java(p))}, false) THEN {text(n)}" for n, p in cases) + f" ELSE {otherwise} END"


def _let(value: str, name: str, body: str) -> str:
    """``body`` over a value that is named once: a parameter used several times would be written out at each use."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_HOST = "(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)"
#: name, parameters, result, body; each may use those above it
SCALARS = [
    ("trimmed", "t STRING", "STRING", f"regexp_replace(t, {text(f'^{C.BLANK}+|{C.BLANK}+$')}, '')"),
    ("squeezed", "t STRING", "STRING", f"trimmed(regexp_replace(t, {text(C.BLANK + '+')}, ' '))"),
    ("token_estimate", "t STRING", "BIGINT", "CAST(ceil(length(coalesce(t, '')) / 4.0) AS BIGINT)"),
    ("page_title", "html STRING", "STRING", f"squeezed(regexp_extract(html, {text('(?is)<title[^>]*>(.*?)</title>')}, 1))"),
    ("html_to_markdown", "html STRING", "STRING", f"trimmed({_steps('html', P.SANITIZE + P.MARKDOWN)})"),
    ("host_of", "url STRING", "STRING", _let("url", "u", f"CASE WHEN lower(u) LIKE 'http://%' THEN regexp_replace(lower(regexp_extract(u, {text(_HOST)}, 1)), ':80$', '') ELSE regexp_replace(lower(regexp_extract(u, {text(_HOST)}, 1)), ':443$', '') END")),
    ("url_origin", "url STRING", "STRING", _let("struct(lower(regexp_extract(url, '(?i)^(https?)://', 1)) AS scheme, host_of(url) AS host)", "x", "CASE WHEN x.scheme <> '' AND x.host <> '' THEN concat(x.scheme, '://', x.host) ELSE '' END")),
    ("undotted", "path STRING", "STRING", _let("path", "p", f"""CASE WHEN p rlike {text(r'(?:^|/)[.]{1,2}(?:/|$)')} THEN concat(array_join(aggregate(split(p, '/'), cast(array() AS ARRAY<STRING>), (held, s) -> CASE WHEN s = '.' THEN held
 WHEN s = '..' THEN CASE WHEN size(held) > 1 THEN slice(held, 1, size(held) - 1) ELSE held END ELSE concat(held, array(s)) END), '/'), CASE WHEN p rlike {text(r'/[.]{1,2}$')} THEN '/' ELSE '' END) ELSE p END""")),
    ("percent_encoded", "path STRING", "STRING", _let("path", "p", f"CASE WHEN p rlike {text(C.UNSAFE)} THEN array_join(transform(split(p, ''), c -> CASE WHEN c rlike {text(C.UNSAFE)} THEN replace(url_encode(c), '+', '%20') ELSE c END), '') ELSE p END")),
    ("slashed", "url STRING", "STRING", _let("url", "u", f"CASE WHEN contains(u, {text(chr(92))}) AND lower(u) LIKE 'http%' THEN concat(replace(regexp_extract(u, '^([^?#]*)', 1), {text(chr(92))}, '/'), regexp_extract(u, '^[^?#]*(.*)$', 1)) ELSE u END")),
    ("url_path", "url STRING", "STRING", f"undotted(lower(percent_encoded(regexp_extract(url, {text('(?i)^https?://[^/?#]+([^?#]*)')}, 1))))"),
    ("url_query", "url STRING", "STRING", f"array_join(filter(split(regexp_extract(url, {text(r'^[^?#]*[?]([^#]*)')}, 1), '&'), kv -> kv <> '' AND lower(substring_index(kv, '=', 1)) NOT IN ({', '.join(map(text, P.TRACKING))})), '&')"),
    ("canonical_from", "parts STRUCT<origin STRING, path STRING, query STRING>", "STRING", _let("parts", "x", _let("filter(split(x.path, '/'), s -> s <> '')", "segments", f"""CASE WHEN x.origin <> '' AND CASE WHEN coalesce(get(segments, size(segments) - 1), '') LIKE '%.%' THEN substring_index(get(segments, size(segments) - 1), '.', -1) ELSE '' END NOT IN ({', '.join(map(text, P.ASSETS))})
 AND NOT coalesce(x.path rlike {text(P.java(P.PATH_TRAP))}, false) AND NOT (size(segments) > 3 AND size(array_distinct(segments)) < size(segments) / 1.5)
 THEN regexp_replace(concat(x.origin, CASE WHEN x.path = '' THEN '/' ELSE x.path END, CASE WHEN x.query <> '' THEN concat('?', x.query) ELSE '' END), '/+$', '') END"""))),
    ("canonical_of", "url STRING", "STRING", "canonical_from(struct(url_origin(url) AS origin, url_path(url) AS path, url_query(url) AS query))"),
    ("canonical_url", "url STRING", "STRING", "canonical_of(slashed(url))"),
    ("resolve_in", "x STRUCT<href STRING, base STRING, origin STRING>", "STRING", _let("x", "r", f"""CASE WHEN r.href rlike {text('(?i)^[a-z][a-z0-9+.-]*:')} THEN r.href WHEN startswith(r.href, '//') THEN concat(regexp_extract(r.base, '(?i)^(https?:)', 1), r.href) WHEN startswith(r.href, '/') THEN concat(r.origin, r.href)
 WHEN startswith(r.href, '?') THEN concat(regexp_extract(r.base, '^([^?#]*)', 1), r.href) ELSE concat(rtrim('/', regexp_extract(r.base, {text('(?i)^(https?://[^/?#]+(?:/[^?#]*/|/)?)')}, 1)), '/', r.href) END""")),
    ("resolve_url", "href STRING, base STRING", "STRING", "resolve_in(struct(href AS href, base AS base, url_origin(base) AS origin))"),
    ("valid_email", "e STRING", "BOOLEAN", f"coalesce(e rlike {text(P.java(f'^{P.EMAIL}$'))}, false) AND NOT coalesce(e rlike {text(P.java(P.NO_REPLY))}, false) AND NOT coalesce(e rlike {text(P.java(P.PLACEHOLDER))}, false)"),
    ("email_department", "e STRING", "STRING", _cases("substring_index(lower(e), '@', 1)", P.DEPARTMENTS, "'general'")),
    ("mask_email", "email STRING", "STRING", _let("email", "e", "CASE WHEN coalesce(get(split(e, '@'), 1), '') <> '' THEN concat(CASE WHEN locate('@', e) > 1 THEN left(e, 1) ELSE '' END, '•••@', get(split(e, '@'), 1)) WHEN e = '' THEN '' ELSE '•••' END")),
]
_ALL = lambda group: f"regexp_extract_all(html, {text(P.ANCHOR)}, {group})"
#: name, parameters, result, query
TABLES = [
    ("links_of", "html STRING, url STRING", "pos BIGINT, href STRING, text STRING", f"""SELECT CAST(pos AS BIGINT), href, text FROM (
 SELECT pos, canonical_url(resolve_url(trimmed(a.href), url)) AS href, squeezed(regexp_replace(a.text, '<[^>]+>', '')) AS text
 FROM posexplode(zip_with({_ALL(1)}, {_ALL(2)}, (h, t) -> named_struct('href', h, 'text', t))) AS t(pos, a) WHERE trimmed(a.href) <> '' AND NOT startswith(trimmed(a.href), 'javascript:') AND NOT startswith(trimmed(a.href), '#'))
 WHERE href IS NOT NULL"""),
    ("emails_of", "t STRING", "pos BIGINT, email STRING, department STRING", f"SELECT CAST(pos AS BIGINT), lower(e), email_department(e) FROM posexplode(regexp_extract_all(t, {text(P.EMAIL)}, 0)) AS x(pos, e) WHERE valid_email(e)"),
    ("phones_of", "t STRING", "pos BIGINT, phone STRING", f"SELECT CAST(pos AS BIGINT), trimmed(p) FROM posexplode(regexp_extract_all(t, {text(P.PHONE)}, 0)) AS x(pos, p) WHERE length(trimmed(p)) >= 7"),
]


def _undo_of():
    """The undo machine as a table function: PARTITION BY the key, ORDER BY the order of the edits."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import ArrayType, LongType, StructType

    root = ROOT

    class UndoOf:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("undo_of takes a table: TABLE(...) PARTITION BY a key ORDER BY the order of the edits")
            names = rows.dataType.fieldNames()
            if len(names) < 3 or not {"action", "record"} <= set(names):
                raise ValueError("undo_of needs a key, action and record")
            key = next(n for n in names if n not in ("action", "record"))
            schema = StructType().add(key, rows.dataType[key].dataType).add("record", LongType()).add("past", ArrayType(LongType())).add("future", ArrayType(LongType()))
            return AnalyzeResult(schema=schema)

        def __init__(self):
            if root not in sys.path:
                sys.path.append(root)
            from tessera.operators import history

            self.step, self.state, self.key, self.seen = history.step, history.EMPTY, None, False

        def eval(self, rows):
            if not self.seen:
                self.key, self.seen = next(v for k, v in rows.asDict().items() if k not in ("action", "record")), True
            self.state = self.step(self.state, rows["action"], rows["record"])

        def terminate(self):
            if self.seen:
                yield self.key, self.state[0], list(self.state[1]), list(self.state[2])

    return udtf(UndoOf)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {body}")
    spark.udtf.register("undo_of", _undo_of())
