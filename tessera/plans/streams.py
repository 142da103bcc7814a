"""Queries that run as streams over the events table, and their SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import history
from tessera.plans.base import query
from tessera.sources import work_folder
from tessera.streaming import state


def _events(spark, sf_dir):
    """The events as a stream, ts as an instant; the pattern stands for the table, be it a file or a folder."""
    return streaming.source(spark, f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def stream_history(spark, sf_dir):
    """The last 20 events of every user, merged batch by batch."""
    store = streaming.keep_last_n(_events(spark, sf_dir).select("user_id", "event_id", "ts"), work_folder(spark, "history"), "user_id", ["ts", "event_id"], 20)
    return store.read().select("user_id", "event_id")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    """Every event once, though the stream brings it twice."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    path = streaming.distinct_within(rows.unionByName(rows), work_folder(spark, "distinct"), ["event_id"], "ts", "40 days")
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


_NEW = "CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END"
_SESSIONS = f"""SELECT user_id, session, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n
 FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT user_id, event_id, ts, {_NEW} AS fresh FROM events)) GROUP BY user_id, session"""


@query(f"SELECT user_id, start, n FROM ({_SESSIONS})")
def events_session(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query(f"SELECT user_id, start, n FROM ({_SESSIONS}) WHERE stop <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def stream_sessions(spark, sf_dir):
    """Sessions that are closed a day before the stream's end."""
    path = streaming.sessions(_events(spark, sf_dir).select("user_id", "ts"), work_folder(spark, "sessions"), "user_id", "ts", "30 minutes", "1 day")
    return spark.read.parquet(path).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_ACTION = "CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END"
_NONE = "CAST([] AS BIGINT[])"
_UNDONE = f"""SELECT user_id, list_reduce(list({{'action': action, 'id': event_id, 'record': CAST(NULL AS BIGINT), 'past': {_NONE}, 'future': {_NONE}}} ORDER BY ts, event_id), lambda s, x: CASE
 WHEN x.action = 'edit' THEN {{'action': '', 'id': x.id, 'record': x.id, 'past': CASE WHEN s.record IS NULL THEN s.past ELSE list_append(s.past, s.record)[-20:] END, 'future': CASE WHEN s.record IS NULL THEN s.future ELSE {_NONE} END}}
 WHEN x.action = 'undo' AND len(s.past) > 0 THEN {{'action': '', 'id': x.id, 'record': s.past[-1], 'past': s.past[1:len(s.past) - 1], 'future': list_append(s.future, s.record)[-20:]}}
 WHEN x.action = 'redo' AND len(s.future) > 0 THEN {{'action': '', 'id': x.id, 'record': s.future[-1], 'past': list_append(s.past, s.record)[-20:], 'future': s.future[1:len(s.future) - 1]}} ELSE s END,
 {{'action': '', 'id': 0::BIGINT, 'record': CAST(NULL AS BIGINT), 'past': {_NONE}, 'future': {_NONE}}}) AS s FROM (SELECT user_id, event_id, ts, {_ACTION} AS action FROM events) GROUP BY user_id"""
_UNDONE = f"SELECT user_id, s.record AS record, array_to_string(s.past, ' ') AS past, array_to_string(s.future, ' ') AS future FROM ({_UNDONE})"


def _actions(rows):
    """Events as actions on a user's record: errors undo, signups redo, all others edit."""
    return rows.select("user_id", "ts", "event_id", F.expr(_ACTION).alias("action"), F.col("event_id").alias("record"))


def _stacks(rows):
    return rows.select("user_id", "record", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("past", "future")])


@query(_UNDONE)
def stream_undo(spark, sf_dir):
    """Every user's record with its undo and redo stacks, kept by the state API."""
    return _stacks(state.undo(_actions(_events(spark, sf_dir)), work_folder(spark, "undo")))


@query(_UNDONE)
def history_undo(spark, sf_dir):
    """The same as a fold over the whole table."""
    return _stacks(history.folded(_actions(spark.read.parquet(f"{sf_dir}/events.parquet")), "user_id", ["ts", "event_id"]))


@query("""WITH w AS (SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS wrote FROM events)
SELECT user_id, event_id, coalesce(ts - wrote <= INTERVAL 7 DAY, false) AS hit FROM w WHERE event_type <> 'purchase'""")
def stream_cache(spark, sf_dir):
    """Whether a user's last purchase is a fresh entry, seven days at most, at each other event."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("writes"))
    return state.cache_reads(rows, work_folder(spark, "cache"), 7 * 24 * 3600 * 1000, "1 day")[0]


@query("SELECT x.user_id, x.event_id AS first_id, y.event_id AS second_id FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_type = 'click' AND y.event_type = 'error' AND y.ts > x.ts AND y.ts <= x.ts + INTERVAL 30 MINUTE")
def stream_pairs(spark, sf_dir):
    """Errors within half an hour of a click of the same user, joined as streams."""
    of = lambda kind: _events(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    path = streaming.followed(of("click"), of("error"), work_folder(spark, "pairs"), "user_id", "30 MINUTES", "1 day")
    return spark.read.schema("user_id long, first_id long, second_id long").parquet(path)
