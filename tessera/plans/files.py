"""Queries through the library's own data sources: pages read from dumps, records written as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.base import query, read
from tessera.sources import formats, work_folder
from tessera.streaming import finish

_DUMPED = "SELECT page_id, url, md5(html) AS digest FROM pages"


def _dumps(spark, sf_dir):
    """All pages as dumps of a work folder."""
    folder = work_folder(spark, "dumps")
    read(spark, sf_dir, "pages").select("page_id", "url", "html").write.option("ignoreNullFields", "false").json(folder)
    formats.register(spark)
    return folder


@query(_DUMPED)
def source_pages(spark, sf_dir):
    rows = spark.read.format("site_pages").option("splitBytes", 1 << 20).load(_dumps(spark, sf_dir))
    return rows.select("page_id", "url", F.md5("html").alias("digest"))


@query(_DUMPED)
def stream_pages(spark, sf_dir):
    stream, out = spark.readStream.format("site_pages").load(_dumps(spark, sf_dir)), work_folder(spark, "stream-pages")
    rows = stream.select("page_id", "url", F.md5("html").alias("digest"))
    finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
    return spark.read.schema("page_id long, url string, digest string").parquet(out)


@query("SELECT 'page-' || page_id || '.json' AS file, json_object('page_id', page_id, 'url', url)::VARCHAR AS content FROM pages")
def sink_records(spark, sf_dir):
    """A file for every page, written by the sink and read again."""
    out = work_folder(spark, "records")
    formats.register(spark)
    rows = read(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("site"), F.to_json(F.struct("page_id", "url")).alias("json"))
    rows.write.format("site_records").option("as", "json").mode("append").save(out)
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(out)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("content"))
