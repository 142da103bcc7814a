"""Key-value reads, reports of stages, and joins of streams."""

import datetime
import json

from tessera import streaming
from tessera.operators import observed, settings

START = datetime.datetime(2024, 1, 1)


def asked(spark, folder, *args, **how):
    from pyspark.sql import functions as F

    return {r["key"]: json.loads(r["v"]) for r in settings.get(spark, folder, *args, **how).select("key", F.to_json("value").alias("v")).collect()}


def test_four_forms(spark, tmp_path):
    rows = [(f"a:{k:03d}", json.dumps({"n": k}), 1) for k in range(200)] + [("a:005", "5", 2), ("a:006", "{bad", 2), ("a:007", None, 2), (None, "1", 1), ("b:x", '"s"', 1), ("a", "[]", 1), ("ä:1", "true", 1)]
    folder = str(tmp_path / "kv")
    settings.write(spark.createDataFrame(rows, "key string, raw string, n int").repartition(5), folder, ["n"], shelves=8)
    everything = asked(spark, folder)
    assert len(everything) == 203 and everything["a:005"] == 5 and everything["a:006"] == "{bad" and everything["a:007"] is None
    assert set(asked(spark, folder, prefix="a:")) == {f"{k:03d}" for k in range(200)}
    assert asked(spark, folder, "x", prefix="b:") == {"x": "s"} and asked(spark, folder, "none") == {}
    assert asked(spark, folder, ["a:001", "ä:1", "zz"]) == {"a:001": {"n": 1}, "ä:1": True}
    assert asked(spark, folder, {"001": 0, "new": [1, None]}, prefix="a:") == {"001": {"n": 1}, "new": [1, None]}
    assert asked(spark, folder, []) == {} and asked(spark, folder, prefix="nothing") == {}
    one = settings.get(spark, folder, "a:150")
    assert one.count() == 1 and len(one.inputFiles()) == 8  # what is listed
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan.replace("isnotnull(shelf#", "shelf#").replace("[(shelf", "[shelf") and "IN (" not in plan.split("PartitionFilters")[1].split("PushedFilters")[0]  # one shelf of eight


def test_stages_report(spark, tmp_path):
    from pyspark.sql import functions as F

    told = []
    seen = observed.Observer(told.append)
    first = seen.watch(spark.range(100), "read", least=F.min("id"))
    seen.watch(first.filter("id >= 90"), "kept").write.parquet(str(tmp_path / "out"))
    assert told == [] and seen.collect() == told
    assert told == [{"stage": "read", "n_rows": 100, "least": 0}, {"stage": "kept", "n_rows": 10}]
    assert seen.frame(spark).count() == 3 and len(told) == 2


def test_streams_report(spark, tmp_path):
    spark.range(30).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).lit(START)).write.parquet(str(tmp_path / "in"))
    told = []
    listener = observed.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        streaming.distinct_within(streaming.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), ["id"], "ts", "1 day")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert told[0]["stage"] == "started" and sum(e.get("n_rows", 0) for e in told) == 30 and max(e.get("n_state", 0) for e in told) == 30


def test_pairs(spark, tmp_path):
    minute = datetime.timedelta(minutes=1)
    clicks = [("u", 1, START), ("u", 2, START + 10 * minute), ("v", 3, START), (None, 4, START)]
    errors = [("u", 10, START), ("u", 11, START + 30 * minute), ("u", 12, START + 31 * minute), ("v", 13, START + 50 * minute), (None, 14, START + minute)]
    for name, rows in (("clicks", clicks), ("errors", errors)):
        for k, r in enumerate(rows):  # a file each, so that partners come in different batches
            spark.createDataFrame([r], "user string, id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    path = streaming.followed(streaming.source(spark, str(tmp_path / "clicks"), 2), streaming.source(spark, str(tmp_path / "errors"), 1), str(tmp_path / "out"), "user", "30 MINUTES", "1 day")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("u", 1, 11), ("u", 2, 11), ("u", 2, 12)]
