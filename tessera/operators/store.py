"""Cached records: what is kept, how long it is fresh, what is masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import entities as E

VERSION, TTL, SNIPPET = 2, "INTERVAL 7 DAY", 160


def slim(cells: DataFrame) -> DataFrame:
    """Field cells as they are stored: no nulls, snippets squeezed and cut; lists and Markdown are not stored."""
    text = {c: C.text(F.col(c)).alias(c) for c in ("value", "source_url", "source_id")}
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("dirty", "verified")]
    sure = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("low")).alias("confidence")
    return cells.select("site", "key", text["value"], sure, text["source_url"], text["source_id"], C.squeezed_start(C.text(F.col("source_snippet")), SNIPPET).alias("source_snippet"), *flags)


def fresh(entries: DataFrame, now: str) -> DataFrame:
    """``entries`` (schema_version, has_fields, extracted_at, cached_at as text) with fresh: the right version,
    fields, and a readable time (extracted_at, else cached_at) not more than TTL before ``now``."""
    at = F.try_to_timestamp(F.coalesce(F.nullif("extracted_at", F.lit("")), F.nullif("cached_at", F.lit(""))))
    good = (F.col("schema_version") == VERSION) & F.col("has_fields") & (F.lit(now).cast("timestamp") - at <= F.expr(TTL))
    return entries.withColumn("fresh", F.coalesce(good, F.lit(False)))


def masked(cells: DataFrame) -> DataFrame:
    """Cells with e-mail and phone values masked, and what their snippets hold of either."""
    value = F.when(F.col("key") == "email", C.mask_email(F.col("value"))).when(F.col("key") == "phone", C.mask_phone(F.col("value"))).otherwise(F.col("value"))
    return cells.withColumns({"value": value, "source_snippet": E.masked_text(F.col("source_snippet"))})
