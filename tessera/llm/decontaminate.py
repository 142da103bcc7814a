"""Benchmark decontamination by spaced-seed hashing [native].

Fixed masks over runs of tokens ignore some positions; the hashes of the others are joined between
benchmark items and documents, so a seed survives a substituted token at an ignored position.  A hit
fixes an alignment of item and document.  Around it the aligned tokens are compared one by one: the
pair counts when some ``WINDOW`` consecutive item tokens (all of them for shorter items) agree on at
least ``SHARE`` of their positions.

The masks leave no gap: whatever two tokens of a window are substituted, some seed of it survives.
Items shorter than a window are cut into one part more than they may lose tokens; one of the parts
stays whole, and its hash is their seed.

Tokens are runs of letters and digits, lower-cased.  Null and empty texts match nothing, nor do items
without a token.  Documents are told apart by doc_id, null or not, and by their text: rows that repeat
both give one result, rows that repeat only the id one each.  Items are told apart likewise, by item_id, null or
not, and text: an id with two texts is two items.  The result has one row for each document
and item that overlap, with key, the hash of the document's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stage, let, table

MASKS = ("11011011", "111001011", "1011001101", "111111")
WINDOW, SHARE = 13, 0.8
#: Benchmark seeds, counted first, up to which they are sent to all executors; beyond it the join shuffles.
MAX_SENT = 1_000_000


def tokens(text):
    """Hashes of the tokens of a text column."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seed_columns(lengths: list[int]) -> dict:
    """name -> hash of the tokens t0, t1, ... of a position under each mask, and of the whole runs of ``lengths``."""
    out = {}
    for m, mask in enumerate(MASKS):
        used = [F.col(f"t.t{k}") for k, bit in enumerate(mask) if bit == "1"]
        out[f"mask{m}"] = F.when(used[-1].isNotNull(), F.xxhash64(F.lit(m), *used))
    for n in lengths:
        out[f"run{n}"] = F.when(F.col(f"t.t{n - 1}").isNotNull(), F.xxhash64(F.lit(-n), F.array(*[f"t.t{k}" for k in range(n)])))
    return out


def _runs(rows: DataFrame, keys: list[str], lengths: list[int] = ()) -> DataFrame:
    """One row for each token position, with its seeds (null past the end)."""
    span = max([len(mask) for mask in MASKS] + list(lengths))
    n = F.size("tokens")
    parts = [F.slice(F.col("tokens"), k + 1, n).alias(f"t{k}") for k in range(span)]
    at = rows.filter(n >= min([len(mask) for mask in MASKS] + list(lengths))).select(*keys, F.posexplode(F.arrays_zip(*parts)).alias("pos", "t"))
    return at.select(*keys, "pos", *[c.alias(name) for name, c in _seed_columns(list(lengths)).items()])


def _item_seeds(known: DataFrame) -> DataFrame:
    """(item, item_pos, seed, n): of windows the seeds under all masks, of shorter items those of their parts (n tokens)."""
    long_items = _runs(known.filter(F.size("tokens") >= WINDOW), ["item"])
    masked = long_items.select("item", F.col("pos").alias("item_pos"), F.explode(F.array(*[f"mask{m}" for m in range(len(MASKS))])).alias("seed"), F.lit(0).alias("n")).filter("seed is not null")
    n = F.size("tokens")
    cuts = n - F.ceil(n * SHARE).cast("int") + 1
    begin = lambda k: F.floor(k * n / cuts).cast("int")
    part = lambda k: F.struct(begin(k).alias("at"), F.slice(F.col("tokens"), begin(k) + 1, begin(k + 1) - begin(k)).alias("own"))
    parts = known.filter((n > 0) & (n < WINDOW)).select("item", F.explode(F.transform(F.sequence(F.lit(0), cuts - 1), part)).alias("p"))
    whole = parts.select("item", F.col("p.at").alias("item_pos"), F.xxhash64(-F.size("p.own"), F.col("p.own")).alias("seed"), F.size("p.own").alias("n"))
    return masked.unionByName(whole)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, key, item_id, matched (agreeing tokens), aligned (item tokens inside the document), offset
    (the document token where the item's first token lies) for every overlap."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null").withColumn("key", F.xxhash64("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    known = named.select(F.xxhash64(F.to_json(F.struct("item_id")), "text").alias("item"), "item_id", tokens(F.col("text")).alias("tokens")).dropDuplicates(["item"])
    stage = Stage(docs.sparkSession)
    seeds = stage.keep(_item_seeds(known), "seeds")
    n_seeds, lengths = seeds.count(), sorted(r[0] for r in seeds.filter("n > 0").select("n").distinct().collect())  # lengths below WINDOW
    names = [f"mask{m}" for m in range(len(MASKS))] + [f"run{n}" for n in lengths]
    send = F.broadcast if n_seeds <= MAX_SENT else (lambda x: x)
    runs = _runs(texts.select("doc_id", "key", tokens(F.col("text")).alias("tokens")), ["doc_id", "key"], lengths)
    if n_seeds <= MAX_SENT:  # existence first, a probe for each mask in one pass over the positions
        keys = seeds.select("seed").distinct()
        for name in names:
            runs = runs.join(F.broadcast(keys.select(F.col("seed").alias(name), F.lit(1).alias(f"hit_{name}"))), name, "left")
        runs = runs.filter(F.coalesce(*[f"hit_{name}" for name in names]).isNotNull())
    # a table of its own: it is small, and one generated method for all joins would be too long to be compiled
    runs = stage.keep(runs.select("doc_id", "key", "pos", *names), "hits")
    found = runs.select("doc_id", "key", "pos", F.explode(F.array(*names)).alias("seed")).filter("seed is not null")
    hits = found.join(send(seeds.select("item", "item_pos", "seed")), "seed")
    lines = hits.select("doc_id", "key", "item", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct()
    sizes = known.select("item", F.size("tokens").alias("m"))
    own = lines.join(send(sizes), "item").groupBy(F.col("doc_id").alias("own"), F.col("key").alias("own_key")).agg(F.collect_list(F.struct("item", "offset", "m")).alias("lines"))  # numbers of one document's alignments
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key"))

    def aligned(all_):
        """Each line with the document's tokens that lie along its item, the first of them at the item's token ``lead``."""
        def line(x):
            lead = F.greatest(-x["offset"], F.lit(0))
            return F.struct(x["item"].alias("item"), x["offset"].alias("offset"), lead.alias("lead"), F.slice(all_, F.greatest(x["offset"], F.lit(0)) + 1, x["m"] - lead).alias("part"))

        return F.transform(F.col("lines"), line)

    rows = texts.join(own, same).select("doc_id", "key", F.explode(let(tokens(F.col("text")), aligned)).alias("x")).select("doc_id", "key", "x.*").join(send(known), "item")

    def judged(agree):
        m = F.size("tokens")
        width = F.least(m, F.lit(WINDOW))
        sums = F.transform(F.sequence(F.lit(1), m - width + 1), lambda i: F.aggregate(F.slice(agree, i, width), F.lit(0), lambda s, v: s + v))
        held = F.array_max(sums) >= F.ceil(width * SHARE)
        return F.struct(held.alias("held"), F.aggregate(agree, F.lit(0), lambda s, v: s + v).alias("matched"), F.size("part").alias("aligned"), F.col("offset").alias("offset"))

    agree = F.transform("tokens", lambda t, j: F.coalesce((j >= F.col("lead")) & (F.get("part", j - F.col("lead")) == t), F.lit(False)).cast("int"))
    best = rows.select("doc_id", "key", "item", "item_id", let(agree, judged).alias("line")).filter("line.held")
    best = best.groupBy("doc_id", "key", "item", "item_id").agg(F.max(F.struct("line.matched", "line.aligned", "line.offset")).alias("line"))
    return best.select("doc_id", "key", "item_id", "line.matched", "line.aligned", "line.offset")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
