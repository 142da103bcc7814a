"""State over streams: kept tables that batches are merged into, and duplicates inside a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keyed import Store
from tessera.operators.records import keep_last


def source(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The Parquet files of a path (a folder, a file or a pattern) as a stream with the schema that they have now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def finish(query) -> None:
    """Waits for a query with the trigger availableNow, and raises what it died of."""
    query.awaitTermination()
    if error := query.exception():
        raise error


def keep_last_n(stream: DataFrame, folder: str, key: str, order: list[str], n: int, buckets: int = 16) -> Store:
    """Merges every micro-batch into a store of the last ``n`` rows of each key; returns the store.

    A batch commits the version of its own number, so a batch that is run again after a failure starts from
    the same rows and writes the same.  Only buckets of its keys are rewritten; versions before the last two are deleted.
    """
    spark = stream.sparkSession
    store = Store(spark, folder, key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema), buckets)

    def merge(batch: DataFrame, number: int) -> None:
        store.rewrite(batch, lambda old: keep_last(old.unionByName(batch), key, order, n), number + 1)
        store.vacuum()

    done = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    finish(done)
    return store


def distinct_within(stream: DataFrame, folder: str, keys: list[str], at: str, horizon: str) -> str:
    """Rows of which none with equal ``keys`` came before inside ``horizon`` of event time; returns the table's path.

    What a key was seen is forgotten once the watermark has passed it, so the state doesn't grow with
    the stream: the life of a cached entry.
    """
    rows = stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)
    done = rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    finish(done)
    return folder


def sessions(stream: DataFrame, folder: str, key: str, at: str, gap: str, horizon: str) -> str:
    """(key, start, stop, n) of the sessions that the watermark has closed; returns the table's path."""
    window = F.session_window(at, gap)
    rows = stream.withWatermark(at, horizon).groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
    done = rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    finish(done)
    return folder


def followed(first: DataFrame, second: DataFrame, folder: str, key: str, within: str, horizon: str) -> str:
    """(key, first_id, second_id) of rows (key, id, ts) of ``second`` that come after one of ``first`` of the same key, ``within`` at
    most; returns the table's path.

    Both streams have watermarks and the join an interval, so that a row is forgotten once no partner can come.
    """
    x = first.select(F.col(key), F.col("id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", horizon)
    y = second.select(F.col(key).alias("_key"), F.col("id").alias("second_id"), F.col("ts").alias("second_ts")).withWatermark("second_ts", horizon)
    near = (F.col(key) == F.col("_key")) & (F.col("second_ts") > F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    rows = x.join(y, near).select(key, "first_id", "second_id")
    done = rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    finish(done)
    return folder
