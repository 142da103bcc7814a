"""Language identification by multilingual mixture inference.

Character trigrams of labelled texts give each language a smoothed distribution.  For a document,
expectation-maximisation estimates the proportion of every language from the likelihoods of its
trigrams.  Languages are then tried in the order of their proportions, one more at a time, and the
set with the best penalised likelihood (BIC) is kept; its largest proportion names the document's
language and is the score.

Texts that are null or hold no letter are ``und`` with score 0.  A null or empty language label
teaches nothing.  Without any labelled text every document is ``und``.  Repeated rows are judged each.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import python_stage, table

#: Labelled documents taken for each language (about: chosen by a hash of doc_id against this bound).
SAMPLE = 400
BITS = 16
ROUNDS = 12
#: Weight of the penalty of a further language, in halves of log(trigrams).
PENALTY = 4.0


def trigrams(text: str):
    """Trigram buckets of the text's letters, words parted by one space; None without letters."""
    import numpy as np

    clean = "".join([c if c.isalpha() else " " for c in text.lower()])
    words = clean.split()
    if not words:
        return None
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    mix = (codes[:-2] * np.uint64(0x9E3779B1)) ^ (codes[1:-1] * np.uint64(0x85EBCA77C2)) ^ (codes[2:] * np.uint64(0xC2B2AE3D27D))
    return ((mix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def mixture(like, counts, rounds: int = ROUNDS):
    """Proportions and log likelihood of a mixture; ``like`` is trigrams x languages."""
    import numpy as np

    share = np.full(like.shape[1], 1.0 / like.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        mixed = like @ share
        share = share * (like.T @ (counts / mixed)) / total
    return share, float(counts @ np.log(like @ share))


def infer(grams, model):
    """(language index, its share, {index: share}) by penalised likelihood over nested language sets."""
    import numpy as np

    seen, counts = np.unique(grams, return_counts=True)
    like, counts = model[seen], counts.astype(np.float64)
    share, _ = mixture(like, counts)
    order = np.argsort(-share, kind="stable")
    best = (float(counts @ np.log(like[:, order[0]])), {int(order[0]): 1.0})
    fee = PENALTY * 0.5 * np.log(counts.sum() + 1)
    for k in range(2, len(order) + 1):
        if share[order[k - 1]] < 0.01:
            break
        part, fit = mixture(like[:, order[:k]], counts)
        if fit - fee * (k - 1) <= best[0]:
            break
        best = (fit - fee * (k - 1), {int(i): float(s) for i, s in zip(order[:k], part)})
    top = max(best[1], key=lambda i: (best[1][i], -i))
    return top, min(1.0, best[1][top]), best[1]


def _counts(batches):
    import numpy as np
    import pyarrow as pa

    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if (grams := trigrams(text)) is not None:
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                sums[lang] += np.bincount(grams, minlength=1 << BITS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})


@functools.lru_cache(maxsize=2)
def _model(raw: bytes, langs: int):
    import zlib

    import numpy as np

    return np.frombuffer(zlib.decompress(raw), np.float32).reshape(-1, langs).astype(np.float64)


def _identify(batches, raw, langs):
    import pyarrow as pa

    model = _model(raw.value, len(langs)) if langs else None
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            grams = trigrams(text) if langs and text else None
            if grams is None:
                found.append(("und", 0.0, []))
            else:
                top, score, parts = infer(grams, model)
                found.append((langs[top], score, sorted(((langs[i], s) for i, s in parts.items()), key=lambda x: (-x[1], x[0]))))
        kept = [n for n in batch.schema.names if n.startswith("kept_")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
             pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
            names=["doc_id", "lang_pred", "score", "languages"],
        ) if not kept else pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), *[batch.column(n) for n in kept]], names=["doc_id", "lang_pred", *kept])


def fit(labelled: DataFrame, sample: int = SAMPLE):
    """Languages and their trigram distributions from at most about ``sample`` documents each.

    The counts are summed by Spark; at most 2**BITS rows a language reach the driver.
    """
    import numpy as np

    rows = labelled.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).filter("lang is not null and lang <> ''")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    spark = labelled.sparkSession
    parts = spark.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, part double")
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    taken = rows.join(F.broadcast(parts), "lang").filter(dice < F.col("part")).select("lang", "text")  # one row a language is sent
    counts = python_stage(taken, "tessera.llm.language_id:_counts", "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((1 << BITS, len(langs)), 0.05)
    place = counts["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int)
    n[counts["gram"].to_numpy(int), place] += counts["n"].to_numpy(float)
    return langs, (n / n.sum(axis=0)).astype(np.float32)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and the estimated mixture of every document."""
    import zlib

    langs, probs = model
    raw = docs.sparkSession.sparkContext.broadcast(zlib.compress(probs.tobytes(), 1))  # 2**BITS floats a language
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return python_stage(rows, "tessera.llm.language_id:_identify", f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>", raw, langs)


def tagged(docs: DataFrame, model) -> DataFrame:
    """``docs`` with a column lang_pred; all columns pass through the stage, none is joined back."""
    import zlib

    langs, probs = model
    raw = docs.sparkSession.sparkContext.broadcast(zlib.compress(probs.tobytes(), 1))
    rows = docs.select("doc_id", "text", *[F.col(c).alias(f"kept_{c}") for c in docs.columns])
    kinds = ", ".join(f"`kept_{c}` {kind}" for c, kind in docs.dtypes)
    out = python_stage(rows, "tessera.llm.language_id:_identify", f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, {kinds}", raw, langs)
    return out.select(*[F.col(f"`kept_{c}`").alias(c) for c in docs.columns], "lang_pred")


def fold(id_col="doc_id", n: int = 4):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts for all rows."""
    model = fit(docs.filter(fold() != 2), sample)
    return identify(docs, model).withColumn("held_out", fold() == 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "languages")
