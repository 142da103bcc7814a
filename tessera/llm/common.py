"""What the operators of this package share: tables, staging and Python stages."""

from __future__ import annotations

import atexit
import functools
import importlib
import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of an Arrow batch of a Python stage, which bounds a worker's memory whatever the length of texts; one row at least.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows of one key beyond which a Python stage over sorted rows takes them in parts.
MANY = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one set by setCheckpointDir.

    Where neither is set, a local master (tests, one machine) gets a temporary folder of its own; on a
    cluster that folder would not be shared, so an error is raised instead.
    """
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = context.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster clears its checkpoint folder
        pass


class Stage:
    """Intermediate tables of one query, written as Parquet to the shared folder.

    Writing cuts the lineage: a lost executor costs at most the tasks since the last table.
    ``drop`` deletes a table that no later step reads; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tessera-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                _delete(self.spark, path)

    def clear(self) -> None:
        self.drop(*list(self.paths))


def _size(text: str) -> int:
    """Bytes of a size such as 67108864b or 64m; without a bound a very large number."""
    number, unit = text.rstrip("bBkKmMgG"), text.lower().rstrip("b")[-1:]
    n = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
    return n if n > 0 else 1 << 62


def slices(batches):
    """The rows of Arrow batches, BATCH_BYTES at a time."""
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def python_stage(df: DataFrame, target: str, schema: str, *args) -> DataFrame:
    """mapInArrow with the function named ``module:function`` of this package.

    Only the name travels, so executors keep one copy of the module and its tables for all tasks.  A
    session whose Arrow batches may be larger than BATCH_BYTES is set to that size: Spark has no such
    setting for one query, and several tasks of an executor would else hold 64 MB each more than once.
    """
    root = ROOT

    def call(batches):
        if root not in sys.path:
            sys.path.append(root)
        module, name = target.split(":")
        cut = importlib.import_module("tessera.llm.common").slices
        yield from getattr(importlib.import_module(module), name)(cut(batches), *args)

    conf = df.sparkSession.conf
    if _size(conf.get(_BATCH)) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(call, schema)


def releasing(stage):
    """A Python stage that gives memory back to the system when a task ends: workers outlive their tasks, and
    what Arrow, NumPy and the C library keep for later would count for the stages that follow."""

    @functools.wraps(stage)
    def call(*args):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from stage(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return call


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text (null: empty) alone; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def runs_of_equal(batches, key):
    """Arrow tables that hold whole runs of equal ``key``, but for runs longer than MANY rows, which
    come in parts; yields (table, part of a longer run)."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        keys = held.column(key).to_numpy()
        cut = int(keys.searchsorted(keys[-1]))
        if cut:
            yield held.slice(0, cut), False
            held = held.slice(cut)
        if held.num_rows > MANY:
            yield held, True
            held = held.slice(0, 0)
    if held is not None and held.num_rows:
        yield held, False


def let(value, body):
    """``body`` of a value that is computed once; lambdas would else compute it at every use."""
    return F.get(F.transform(F.array(value), body), 0)
