"""Audit of how sources differ inside a language: exact divergences of sources and the terms that set them apart.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps those found
in at least ``LEAST_DOCS`` of its documents.  With smoothed integer probabilities p (of a source) and q,
a term counts f = floor((p - q)^2 / q).  Everything is integer arithmetic.

* ``counts``: a Python stage counts the terms of whole texts and combines a task's documents of a language and
  source before the shuffle; what it holds is bounded (``HELD`` terms, long texts in parts).  One
  shuffle by language and term then gives each source's count and the language's.
* ``terms``: the search by upper bounds.  The terms of a source lie in buckets of similar counts; a
  bucket's largest p and least q bound f for all its terms.  Buckets are opened best first until
  they hold k terms; the k-th value so far closes all buckets whose bound is strictly below it, the
  others are opened.  Ranks come from the terms of opened buckets alone.
* ``pairs``: f summed over all kept terms for every two sources of a language.  Terms that both have are
  met in the postings of the term; those that one of them has follow from its histogram of counts, those
  that none has from their number.  So no grid of terms and sources is made; the result itself
  has a row for every two sources.

Null texts, languages and sources are ''.  A group whose texts have no kept term has its pairs; with no kept
term in the language their value is 0.  Ties rank by item in UTF-8 order.  Repeated rows are documents
each.  Ids are not read.  An empty table gives an empty result.  Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import Stage, python_stage, table

LEAST_DOCS = 3
#: Ranks of part ``term``.
TOP = 200
#: Probabilities are integers out of so many.
SCALE = 1_000_000_000
#: Different terms, over all groups, that a counting task holds; more are handed on.
HELD = 200_000
#: Bytes of a text that are split into words at a time.
PART_BYTES = 1 << 20

COUNTED = "lang string, source string, term string, n long, docs long"


def _words() -> bytes:
    """For bytes.translate: A-Z to a-z; what belongs to no term becomes a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _parts(text: bytes):
    """``text`` in parts that end at blanks."""
    at = 0
    while len(text) - at > PART_BYTES:
        stop = text.rfind(b" ", at, at + PART_BYTES)
        stop = stop if stop > at else text.find(b" ", at + PART_BYTES)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def count_terms(batches):
    """Rows (lang, source, text as bytes) -> COUNTED, combined as far as ``HELD`` terms reach."""
    from collections import Counter

    import pyarrow as pa

    words, held, size = _words(), {}, 0

    def flush():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 16):
                own = terms[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            had = len(n)
            own = set()
            for part in _parts(text.translate(words)):
                found = part.split()
                n.update(found)
                own.update(found)
            docs.update(own)
            size += len(n) - had
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def _named(docs: DataFrame, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")]


def counts(docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, lang_n, head) of every kept term and source that has it; head marks one row a term."""
    rows = docs.select(*_named(docs, lang_col, source_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = python_stage(rows, "tessera.llm.divergence:count_terms", COUNTED)
    # one shuffle serves the sources' sums and the language's; a term meets one row a source and task
    own = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = W.partitionBy("lang", "term")
    whole = own.select("lang", "source", "term", "n", F.sum("n").over(every).alias("lang_n"), F.sum("docs").over(every).alias("lang_docs"), (F.min("source").over(every) == F.col("source")).alias("head"))
    return whole.filter(F.col("lang_docs") >= least_docs).drop("lang_docs")


def totals(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every group (lang, source) with its occurrences of kept terms (total), its kept terms (size), and the
    language's kept terms (v) and occurrences (lang_total)."""
    groups = docs.select(*_named(docs, lang_col, source_col)).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.count_if("head").alias("heads"))
    known = groups.join(sums, ["lang", "source"], "left").fillna(0, ["total", "size", "heads"])
    langs = known.groupBy("lang").agg(F.sum("heads").alias("v"), F.sum("total").alias("lang_total"))
    return known.drop("heads").join(langs, "lang")


def share(n, total, v) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)); the product may pass 64 bits.  Without kept terms nothing is divided by."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1), wide(F.greatest(total + v, F.lit(1))))


def gain(p, q) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _bucket(n) -> Column:
    """Counts up to 16 alone, larger ones by eighths of a doubling; any split is right, this one keeps buckets few."""
    return F.when(n <= 16, n).otherwise(16 + F.floor(8 * F.log2(n / 16.0)))


def terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` terms that a source has more of than its language."""
    key = ["lang", "source"]
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = kept.join(groups, key).select(*key, "term", _bucket(F.col("n")).alias("bucket"), p.alias("p"), q.alias("q")).filter("p > q")
    bounds = rows.groupBy(*key, "bucket").agg(F.count("*").alias("size"), F.max("p").alias("most"), F.min("q").alias("least"))
    best_first = W.partitionBy(*key).orderBy(F.desc("bound"), "bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = bounds.withColumn("bound", gain(F.col("most"), F.col("least"))).withColumn("before", F.coalesce(F.sum("size").over(best_first), F.lit(0))).select(*key, "bucket", "bound", "before")
    valued = lambda opened: rows.join(opened.select(*key, "bucket"), [*key, "bucket"]).select(*key, F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    kth = ranked(valued(buckets.filter(F.col("before") < top))).filter(F.col("rank") == top).select(*key, F.col("value").alias("kth"))
    opened = buckets.join(kth, key, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
    return ranked(valued(opened))


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of every source and each other source of its language."""
    own = groups.select("lang", "source", "size", "v", share(F.lit(0), F.col("total"), F.col("v")).alias("none"))
    x = own.withColumnsRenamed({"source": "a", "size": "size_a", "none": "none_a"})
    y = own.drop("v").withColumnsRenamed({"source": "b", "size": "size_b", "none": "none_b"})
    neither = x.join(y, "lang").filter("a <> b").select("lang", "a", "b", ((F.col("v") - F.col("size_a") - F.col("size_b")) * gain(F.col("none_a"), F.col("none_b"))).alias("value"))
    # what one source has, by its counts
    shared = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.lit(0), F.col("total"), F.col("v")).alias("none"))
    held = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).withColumnRenamed("source", "a")
    meets = held.join(y, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("times") * gain(F.col("p"), F.col("none_b"))).alias("there"), F.sum(F.col("times") * gain(F.col("none_b"), F.col("p"))).alias("back"))
    # what both have: postings of a term, each two of its sources once
    left, right = (shared.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("none").alias(f"none_{s}")) for s in "ab")
    diff = lambda s, t: gain(F.col(f"p_{s}"), F.col(f"p_{t}")) - gain(F.col(f"p_{s}"), F.col(f"none_{t}")) - gain(F.col(f"none_{s}"), F.col(f"p_{t}")) + gain(F.col(f"none_{s}"), F.col(f"none_{t}"))
    both = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(diff("a", "b")).alias("there"), F.sum(diff("b", "a")).alias("back"))
    both_ways = F.inline(F.array(F.struct(F.col("a"), F.col("b"), F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value"))))
    ways = lambda found: found.select("lang", both_ways)
    whole = neither.union(ways(meets)).union(ways(both)).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    return whole.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, all ranks, and part term, ranks up to ``top``."""
    stage = Stage(docs.sparkSession)
    kept = stage.keep(counts(docs, least_docs), "term-counts")
    groups = stage.keep(totals(docs, kept), "group-totals")
    parts = [("pair", pairs(kept, groups)), ("term", terms(kept, groups, top))]
    out = [rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, rows in parts]
    return out[0].union(out[1])


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = "1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)"
SQL = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY lang),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, lang_n, v, lang_total FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM grid),
p AS (SELECT *, ({_P.format(n='n', total='total')})::BIGINT AS p, ({_P.format(n='lang_n', total='lang_total')})::BIGINT AS q FROM s),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= 200"""
