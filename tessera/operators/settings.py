"""A key-value table of JSON values: sorted by key into shelves, read in the four forms of a storage area.

``write`` keeps the last value of each key (by ``order``) as VARIANT; text that is no JSON is kept as it stands, as a
string.  Keys are dealt by range into shelves, which are partitions; a small table names the first and
last key of each.  ``get`` reads only shelves that may hold what is asked for.  Null keys are left
out, null values are JSON's null.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE = "key string, value variant, shelf int"


def write(rows: DataFrame, folder: str, order: list[str], key: str = "key", raw: str = "raw", shelves: int = 16) -> None:
    """Writes (key, raw JSON text); ``order`` says which row of a key is the last."""
    last = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(raw, F.struct(*order)).alias("raw"))
    bad = F.try_parse_json("raw").isNull() & F.col("raw").isNotNull()
    value = F.when(bad, F.variant_get(F.parse_json(F.to_json(F.array("raw"))), "$[0]", "variant")).otherwise(F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("null"))))
    sorted_rows = last.repartitionByRange(shelves, "key").withColumn("shelf", F.spark_partition_id()).sortWithinPartitions("key")
    sorted_rows.select("key", value.alias("value"), "shelf").write.partitionBy("shelf").parquet(f"{folder}/rows")
    bounds = _rows(rows.sparkSession, folder).groupBy("shelf").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    bounds.coalesce(1).write.parquet(f"{folder}/shelves")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_TABLE).parquet(f"{folder}/rows")


def get(spark: SparkSession, folder: str, keys: str | list[str] | dict | None = None, prefix: str = "") -> DataFrame:
    """(key without prefix, value) of all keys with the prefix (None), of one, of a list, or of a dict's keys with its
    values as defaults; keys that are missing and have no default give no row."""
    names = None if keys is None else [keys] if isinstance(keys, str) else list(keys)
    wanted = None if names is None else [prefix + n for n in names]
    first, last = F.col("first"), F.col("last")
    if wanted is None:
        near = (last >= prefix) & ((F.left(first, F.lit(len(prefix))) <= prefix) if prefix else F.lit(True))
        own = F.startswith("key", F.lit(prefix))
    else:
        near = F.lit(False)
        for w in wanted:
            near = near | ((first <= w) & (last >= w))
        own = F.col("key").isin(wanted)
    shelves = [r[0] for r in spark.read.schema("shelf int, first string, last string").parquet(f"{folder}/shelves").filter(near).select("shelf").collect()]  # as many as ``write`` made, at most
    found = _rows(spark, folder).filter(F.col("shelf").isin(shelves)).filter(own).select(F.substring("key", len(prefix) + 1, 1 << 30).alias("key"), "value")
    if not isinstance(keys, dict):
        return found
    defaults = spark.createDataFrame([(k, json.dumps(v)) for k, v in keys.items()], "key string, raw string").select("key", F.parse_json("raw").alias("fallback"))
    return defaults.join(found, "key", "left").select("key", F.coalesce("value", "fallback").alias("value"))
