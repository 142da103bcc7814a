"""State that streams keep by key through the state API: undo stacks, and cache entries that have a life.

Both need the RocksDB state store, which is set while a query starts and not left to the session.
A query that is started again on its folder goes on from its checkpoint.
"""

from __future__ import annotations

import os
import sys
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming import finish

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark):
    """RocksDB for the queries that start inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _run(rows: DataFrame, folder: str):
    with rocksdb(rows.sparkSession):
        query = rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    finish(query)
    return query


def _undo():
    """The machine of operators.history: the record in a value, the stacks in two lists.

    The class is made in a function and so travels with the query; executors add the repository to their path."""
    root = ROOT

    class Undo(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            if root not in sys.path:
                sys.path.append(root)
            from tessera.operators import history

            self.step = history.step
            self.record = handle.getValueState("record", "record bigint")
            self.past, self.future = handle.getListState("past", "record bigint"), handle.getListState("future", "record bigint")

        def handleInputRows(self, key, rows, timerValues):
            held = [tuple(r[0] for r in stack.get()) if stack.exists() else () for stack in (self.past, self.future)]
            state, last = (self.record.get()[0] if self.record.exists() else None, *held), None
            for last in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):  # a key's share of a micro-batch
                state = self.step(state, last["action"], last["record"])
            for stack, own in ((self.past, state[1]), (self.future, state[2])):
                stack.put([(r,) for r in own]) if own else stack.clear()
            self.record.update((state[0],)) if state[0] is not None else self.record.clear()
            yield Row(user_id=key[0], ts=last["ts"], event_id=last["event_id"], record=state[0], past=list(state[1]), future=list(state[2]))

        def close(self) -> None:
            pass

    return Undo()


def undo(stream: DataFrame, folder: str) -> DataFrame:
    """(user_id, record, past, future) after all rows (user_id, ts, event_id, action, record) of each user.

    Rows of a user are taken in the order of ts and event_id inside a micro-batch; what a later batch
    brings comes later.
    """
    schema = "user_id long, ts timestamp, event_id long, record long, past array<long>, future array<long>"
    _run(stream.filter("user_id is not null").groupBy("user_id").transformWithState(_undo(), schema, "Append", "None"), folder)
    spark = stream.sparkSession
    after = spark.read.schema(schema).parquet(folder)  # a row for each user and batch
    return after.groupBy("user_id").agg(F.max_by(F.struct("record", "past", "future"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*")


def _life(life_ms: int):
    """When a key's entry was written.  A timer forgets an entry once the watermark has passed the end of its life."""

    class Life(StatefulProcessor):
        life = life_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.entry = handle, handle.getValueState("entry", "wrote bigint")

        def handleInputRows(self, key, rows, timerValues):
            wrote = before = self.entry.get()[0] if self.entry.exists() else None
            for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
                if r["writes"]:
                    wrote = r["us"]
                else:
                    yield Row(user_id=key[0], event_id=r["event_id"], hit=wrote is not None and r["us"] - wrote <= self.life * 1000)
            if wrote != before:
                if before is not None:
                    self.handle.deleteTimer(before // 1000 + self.life + 1)
                self.handle.registerTimer(wrote // 1000 + self.life + 1)
                self.entry.update((wrote,))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.entry.exists() and self.entry.get()[0] // 1000 + self.life + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Life()


def cache_reads(stream: DataFrame, folder: str, life_ms: int, horizon: str):
    """(user_id, event_id, hit) of every row that reads, and the query that ran.

    Rows (user_id, event_id, ts, writes) write a user's entry or read it; a read is a hit where the last entry
    is at most ``life_ms`` old.  Entries go by event time, so the state holds those younger than
    their life and the ``horizon`` by which rows may be late.
    """
    rows = stream.filter("user_id is not null").withWatermark("ts", horizon).withColumn("us", F.unix_micros("ts"))
    schema = "user_id long, event_id long, hit boolean"
    query = _run(rows.groupBy("user_id").transformWithState(_life(life_ms), schema, "Append", "EventTime"), folder)
    return stream.sparkSession.read.schema(schema).parquet(folder), query
