"""Undo stacks and cache entries with a life: streams that stop and go on, against plain folds."""

import datetime
import random

import pytest

from tessera import streaming
from tessera.operators import history
from tessera.streaming import state

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def test_the_machine():
    s = history.EMPTY
    for action, record, want in [
        ("undo", 0, history.EMPTY), ("edit", 1, (1, (), ())), ("edit", 2, (2, (1,), ())), ("undo", 0, (1, (), (2,))), ("undo", 0, (1, (), (2,))), ("redo", 0, (2, (1,), ())),
        ("undo", 0, (1, (), (2,))), ("edit", 3, (3, (1,), ())), ("redo", 0, (3, (1,), ())), (None, 9, (3, (1,), ())), ("clear", 0, history.EMPTY),
    ]:
        s = history.step(s, action, record)
        assert s == want
    for k in range(50):
        s = history.step(s, "edit", k)
    assert s == (49, tuple(range(29, 49)), ())
    for _ in range(30):
        s = history.step(s, "undo", None)
    assert s == (29, (), tuple(range(49, 29, -1)))


def _append(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def actions():
    dice, rows = random.Random(3), []
    for k in range(900):
        user = None if k % 97 == 0 else 1 if dice.random() < 0.5 else dice.randrange(2, 30)  # one user has half of all
        rows.append((user, START + datetime.timedelta(minutes=k // 2), k, dice.choice(["edit", "edit", "edit", "undo", "redo", "clear" if k % 31 == 0 else "edit", "odd"]), k))
    return rows


ACTIONS = "user_id long, ts timestamp, event_id long, action string, record long"


def plain(rows):
    out = {}
    for user, _, _, action, record in sorted(rows, key=lambda r: (r[1], r[2])):
        if user is not None:
            out[user] = history.step(out.get(user, history.EMPTY), action, record)
    return {u: (r, list(p), list(f)) for u, (r, p, f) in out.items()}


def test_batch_fold(spark, actions):
    mixed = actions[::2] + actions[1::2]
    got = history.folded(spark.createDataFrame(mixed, ACTIONS), "user_id", ["ts", "event_id"]).collect()
    assert {r["user_id"]: (r["record"], r["past"], r["future"]) for r in got} == plain(actions)
    assert history.folded(spark.createDataFrame([], ACTIONS), "user_id", ["ts"]).count() == 0


def test_stream_goes_on_from_its_checkpoint(spark, actions, tmp_path):
    rows, folder = str(tmp_path / "rows"), str(tmp_path / "undo")
    provider = spark.conf.get(state._PROVIDER, None)
    for stop in (300, 310, 900):
        start = {300: 0, 310: 300, 900: 310}[stop]
        _append(spark, actions[start:stop], ACTIONS, rows)
        got = state.undo(streaming.source(spark, rows, 1), folder).collect()
        assert {r["user_id"]: (r["record"], r["past"], r["future"]) for r in got} == plain(actions[:stop])
    assert spark.conf.get(state._PROVIDER, None) == provider


LIFE = 7 * 24 * 3600 * 1000
READS = "user_id long, event_id long, ts timestamp, writes boolean"


def test_an_entry_lives_as_long_as_said(spark, tmp_path):
    exact, late = START + 7 * DAY, START + 7 * DAY + datetime.timedelta(microseconds=1)
    rows = [(1, 0, START, False), (1, 1, START, True), (1, 2, exact, False), (1, 3, late, False), (2, 4, exact, False), (None, 5, exact, False), (1, 6, late, True), (1, 7, late, False)]
    _append(spark, rows, READS, str(tmp_path / "rows"))
    got, _ = state.cache_reads(streaming.source(spark, str(tmp_path / "rows")), str(tmp_path / "out"), LIFE, "1 day")
    assert sorted((r["event_id"], r["hit"]) for r in got.collect()) == [(0, False), (2, True), (3, False), (4, False), (7, True)]


def test_the_state_stays_flat(spark, tmp_path):
    """Ten users write every five days and never again; entries older than life and lateness are forgotten."""
    rows, held, want = str(tmp_path / "rows"), [], []
    for k in range(8):
        day = START + 5 * k * DAY
        more = [(10 * k + u, 100 * k + u, day, True) for u in range(10)] + [(10 * j + u, 100 * k + 10 * (1 + j) + u, day + DAY, False) for j in range(k + 1) for u in (0, 9)]
        want += [(e, day + DAY - (START + 5 * (u // 10) * DAY) <= 7 * DAY) for u, e, _, w in more if not w]
        _append(spark, more, READS, rows)
        got, query = state.cache_reads(streaming.source(spark, rows, 1), str(tmp_path / "out"), LIFE, "1 day")
        held.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    assert sorted((r["event_id"], r["hit"]) for r in got.collect()) == sorted(want)
    assert held[-1] <= max(held[:4]) and held[-1] > 0
