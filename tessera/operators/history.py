"""Undo and redo: a machine with two stacks of records, as a fold over sorted rows.

Rows have a key, an action (edit, undo, redo or clear) and a record.  An edit puts the present record on the
past and empties the future; undo and redo move the present record from one stack to the other and do
nothing where there is nothing to take; clear forgets all.  Each stack keeps its last ``DEPTH`` records.
Other actions, null ones too, change nothing.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Fixed value
DEPTH = 20

EMPTY = (None, (), ())


def step(state: tuple, action: str | None, record) -> tuple:
    """(record, past, future) after an action."""
    now, past, future = state
    if action == "edit":
        return (record, (*past, now)[-DEPTH:], ()) if now is not None else (record, past, future)
    if action == "undo" and past and now is not None:
        return past[-1], past[:-1], (*future, now)[-DEPTH:]
    if action == "redo" and future and now is not None:
        return future[-1], (*past, now)[-DEPTH:], future[:-1]
    return EMPTY if action == "clear" else state


def fold_batches(batches, key, action, record):
    """Frames sorted by key and order -> (key, record, past, future), a row for each key; one state is held."""
    import pandas as pd

    at, state = None, None

    def row():
        return pd.DataFrame({key: [at], "record": pd.array([state[0]], dtype="Int64"), "past": [list(state[1])], "future": [list(state[2])]})

    for frame in batches:
        out = []
        for k, a, r in zip(frame[key], frame[action], frame[record]):
            if state is None or k != at:
                if state is not None:
                    out.append(row())
                at, state = k, EMPTY
            state = step(state, a, r)
        if out:
            yield pd.concat(out)
    if state is not None:
        yield row()


def folded(rows: DataFrame, key: str, order: list[str], action: str = "action", record: str = "record") -> DataFrame:
    """The machine's state after all rows of each key: (key, record, past, future).

    A key's rows pass through one task in order, as each state needs the one before, but are not held:
    a task holds one state of at most two times DEPTH records.  Null keys are left out.
    """
    root = ROOT

    def call(batches):
        if root not in sys.path:
            sys.path.append(root)
        from tessera.operators import history

        yield from history.fold_batches(batches, key, action, record)

    kind = dict(rows.dtypes)[key]
    own = rows.filter(rows[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).select(key, action, record)
    return own.mapInPandas(call, f"{key} {kind}, record bigint, past array<bigint>, future array<bigint>")
