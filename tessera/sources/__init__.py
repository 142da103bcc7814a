"""Where rows and work folders come from."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import files


def pages_given(spark: SparkSession, pages: list[tuple] | DataFrame | None, path: str | None = None) -> DataFrame:
    """Pages (page_id, url, html) that a caller hands over, else those of a table; neither is an error."""
    if isinstance(pages, DataFrame):
        return pages.select("page_id", "url", "html")
    if pages:
        return spark.createDataFrame(pages, "page_id long, url string, html string")
    if path is None:
        raise ValueError("pages or a path are needed")
    return spark.read.parquet(path).select("page_id", "url", "html")


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder of setCheckpointDir; where neither is set only a local master may go on, with one
    temporary folder a process."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def clear() -> None:
    """Deletes all work folders and the checkpoints of streams beside them; runs when the process ends."""
    while _made:
        spark, path = _made.pop()
        for folder in (path, f"{path}-checkpoint"):
            try:
                files.delete(spark, folder)
            except Exception:  # the session is gone; the cluster clears its checkpoint folder
                pass


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables and streams, in the shared folder; it goes with the process (``clear``)."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:  # after the session was made, so that this runs before it ends
        atexit.register(clear)
    _made.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a work folder, read again: what is used several times is computed once, and a
    lost executor costs the tasks since then at most."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
