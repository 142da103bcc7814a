"""Tables that a key is looked up, written and deleted in: hash buckets, copy on write, versions.

``data/version=<n>/bucket=<b>`` holds a bucket as the n-th commit wrote it; ``manifest/version=<n>`` names,
for every bucket, the commit that holds it (one row a bucket, so its size is that of a parameter).  A commit
rewrites the buckets that it touches and no others.  It counts once its manifest is whole (Spark's
success marker, written last): a commit that dies leaves files that no manifest names.  Commits follow one
another; there is no lock for two writers.

A null key is a key like others.  Of rows of one key in a batch the one last by ``order`` stays (ties: any of the last, the
same at each run if rows differ in their columns).  Empty batches make a version that changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources import files

_MANIFEST = "bucket int, held int"


class Store:
    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 64):
        """``schema`` is the DDL of the rows, with ``key`` in it; ``buckets`` holds for the life of the store."""
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), key, schema, buckets
        self.fields = StructType.fromDDL(schema)

    # ---- versions

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        found = [n for n in files.names(self.spark, f"{self.folder}/manifest") if n.startswith("version=")]
        return sorted(int(n.split("=")[1]) for n in found if files.exists(self.spark, f"{self.folder}/manifest/{n}/_SUCCESS"))

    def _held(self, version: int) -> dict[int, int]:
        """bucket -> version of its data."""
        return dict(map(tuple, self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/version={version}").collect())) if version else {}

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version (the last)."""
        known = self.versions()
        return self._rows(self._held(version if version is not None else known[-1] if known else 0))

    def get(self, keys: list) -> DataFrame:
        """The rows of a few keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([self.fields[self.key]]))
        near = {r[0] for r in wanted.select(self._bucket()).collect()}
        known = self.versions()
        held = self._held(known[-1] if known else 0)
        rows, wanted = self._rows({b: v for b, v in held.items() if b in near}), wanted.toDF("_key")
        return rows.join(wanted, rows[self.key].eqNullSafe(wanted["_key"]), "left_semi")

    # ---- commits

    def rewrite(self, touched: DataFrame, build: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        """Commits ``build(old rows)`` of the buckets of ``touched`` (rows with the key); returns the version.  What is built
        has keys of these buckets alone.

        With ``version`` the commit is that one, from the version before: run again, it gives the same.
        """
        known = self.versions()
        version = version or (known[-1] + 1 if known else 1)
        held = self._held(max([v for v in known if v < version], default=0))
        buckets = [r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        if buckets:
            old = self._rows({b: held[b] for b in buckets if b in held})
            new = build(old).withColumn("bucket", self._bucket())
            path = f"{self.folder}/data/version={version}"
            new.repartition(min(len(buckets), self.buckets), "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
            there = {int(n.split("=")[1]) for n in files.names(self.spark, path) if n.startswith("bucket=")}
            if there - set(buckets):
                raise ValueError("a commit made rows with keys of buckets that it doesn't touch")
            held = {b: v for b, v in held.items() if b not in buckets} | {b: version for b in there}
        self.spark.createDataFrame(sorted(held.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return version

    def upsert(self, rows: DataFrame, order: list[str] = (), version: int | None = None) -> int:
        """Writes rows over those of equal key."""
        names = self.fields.fieldNames()
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(*order, *names)).alias("r")).select("r.*")
        keys = last.select(F.col(self.key).alias("_key"))
        return self.rewrite(rows, lambda old: old.join(keys, old[self.key].eqNullSafe(keys["_key"]), "left_anti").unionByName(last), version)

    def delete(self, keys: DataFrame, version: int | None = None) -> int:
        """Takes the rows of ``keys`` (a frame with the key) out."""
        gone = keys.select(F.col(self.key).alias("_key")).distinct()
        return self.rewrite(keys, lambda old: old.join(gone, old[self.key].eqNullSafe(gone["_key"]), "left_anti"), version)

    def clear(self) -> int:
        """A version without rows."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        self.spark.createDataFrame([], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what only versions before the last ``keep`` need, and data of commits that died."""
        known = self.versions()
        last = known[-keep:]
        needed = {(b, v) for n in last for b, v in self._held(n).items()}
        for n in files.names(self.spark, f"{self.folder}/data"):
            version = int(n.split("=")[1])
            if version > (known[-1] if known else 0):
                continue  # a commit under way
            own = [b for b in files.names(self.spark, f"{self.folder}/data/{n}") if b.startswith("bucket=")]
            left = [b for b in own if (int(b.split("=")[1]), version) in needed]
            for b in set(own) - set(left):
                files.delete(self.spark, f"{self.folder}/data/{n}/{b}")
            if not left:
                files.delete(self.spark, f"{self.folder}/data/{n}")
        for n in known[:-keep]:
            files.delete(self.spark, f"{self.folder}/manifest/version={n}")
