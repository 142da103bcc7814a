"""The corpus pipeline: documents in, token ids out.

Each stage works on all rows that the one before it kept and returns the columns of documents; the
last returns token ids.  Every stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language_id, ngram_join, suffix_dedup
from tessera.llm.common import Stage, table

#: Words from which on a repeated passage goes.
PASSAGE = 50
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names each document's language in lang; documents without one (und) go."""
    model = language_id.fit(docs.filter(language_id.fold() != 2))
    named = language_id.tagged(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'")
    return named.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with name, which is never null and stands for doc_id, and key, the hash of the text."""
    return rows.withColumns({"name": F.to_json(F.struct("doc_id")), "key": F.xxhash64(F.coalesce("text", F.lit("")))})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every group of near copies, and all that have no words.

    Rows are told apart by doc_id and text: where an id repeats, only the row that is first of its group
    stays, and of rows that repeat both one stays.
    """
    groups = ngram_join.link(docs).select(F.to_json(F.struct("doc_id")).alias("name"), "doc_id", "key", "component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "name")
    first = groups.filter("component is not null").groupBy("component").agg(F.min(order).alias("first")).select("first.name", "first.key")
    stay = first.union(groups.filter("component is null").select("name", "key").distinct())
    # one shuffle of the texts: what removes repeated rows is dealt out as the join was
    return _named(docs.select(*COLUMNS)).join(stay, ["name", "key"], "left_semi").dropDuplicates(["name", "key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out all passages of PASSAGE words or more that occur more than once."""
    meta = _named(docs).select("name", "key", "lang", "source").dropDuplicates(["name", "key"])
    cut = suffix_dedup.deduplicate(docs, PASSAGE, as_text=True, unit="words").withColumn("name", F.to_json(F.struct("doc_id")))
    out = cut.join(meta, ["name", "key"])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item."""
    hit = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.to_json(F.struct("doc_id")).alias("name"), "key").distinct()
    return _named(docs.select(*COLUMNS)).join(hit, ["name", "key"], "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed) and the digests of ids and decoded bytes of every document left."""
    coded = bpe.encode(docs, decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_overlap),
    ("byte_level_bpe", tokens),
]

#: Language models, near copies and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark)
    for name, function in STAGES[:-1]:
        docs = stage.keep(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
