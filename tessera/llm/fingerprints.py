"""Document fingerprints by consistent weighted sampling [native].

Terms are five-word shingles (a shorter text is one term), weighted by how often they occur.  For
sample k a term of weight w has r and c ~ Gamma(2, 1) and b ~ U(0, 1), all from hashes of the term and k:

    t = floor(ln w / r + b)      ln y = r (t - b)      ln a = ln c - ln y - r

and the sample is the (term, t) of the least a.  Two texts agree on a sample with a probability
that equals their generalised Jaccard similarity, sum of min weights over sum of max weights.

Most terms occur once, where t = 0, so the draws begin with what counts there: a0, the a of t = 0, is
exponential, and given it

    c = a0 + E1      r = ln(c / a0) + E2      b = E2 / r      a = a0 exp(-r t)

with E1 and E2 exponential has the law above (c and r are Gamma(2, 1), b is uniform and independent of
them).  A term that occurs once thus takes one hash and no logarithm: as samples are compared by
x = 1 - exp(-a), which grows with a, its x is the hash as a number between 0 and 1.

As x is a function of the term and t that no other term shares but by a chance of some 2**-50, a sample
is kept as the least x itself: a plain min() inside a hash aggregate.

Words are what white space parts, lower-cased.  Null texts are empty; texts without words share one
fingerprint and are like each other (1) and unlike the rest (0).  Repeated rows stay apart: they are
numbered inside their range of ids.  A single document is its own next one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import id_text, let, table

SAMPLES, WORDS = 64, 5
#: Documents in a range of ids, and the most ranges; a range is one window partition.
RANGE_ROWS, MAX_RANGES = 1000, 20_000
#: The sample of a text without terms, above all others.
EMPTY = 2.0


def words(text):
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def _shingles(own, size: int):
    def many(h):
        parts = [F.slice(h, k + 1, F.size(h) - (size - 1)).alias(f"h{k}") for k in range(size)]
        return F.transform(F.arrays_zip(*parts), lambda z: F.xxhash64(*[z[f"h{k}"] for k in range(size)]))

    hashed = let(F.transform(own, lambda w: F.xxhash64(w)), many)
    return F.when(F.size(own) >= size, hashed).when(F.size(own) > 0, F.array(F.xxhash64(F.array_join(own, " ")))).otherwise(F.array().cast("array<bigint>"))


def shingles(text, size: int = WORDS):
    """Hashes of the word shingles of a text column, one an occurrence."""
    return let(words(text), lambda own: _shingles(own, size))


def weighted(terms):
    """(s, w): distinct terms with their counts."""

    def runs(ordered):
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(ordered, i - 2) != F.get(ordered, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i - 1).alias("s"), (F.coalesce(F.get(at, k + 1), n + 1) - i).alias("w"))))

    def pick(own):
        once = F.transform(own, lambda s: F.struct(s.alias("s"), F.lit(1).alias("w")))
        return F.when(F.size(F.array_distinct(own)) == F.size(own), once).otherwise(let(F.sort_array(own), runs))

    return let(terms, pick)


def _salt(i: int) -> int:
    return int.from_bytes(hashlib.blake2b(b"%d" % i, digest_size=8).digest(), "little", signed=True)


def _sample(k: int):
    """x of a term (s, w) for sample k; it stands for the term and its t as well, being a function of them."""
    h, g = (F.xxhash64(F.col("s").bitwiseXOR(F.lit(_salt(i)))) for i in (2 * k, 2 * k + 1))  # s is a hash already
    once = F.shiftrightunsigned(h, 11) * 2.0**-53 + 2.0**-54
    e1, e2 = (-F.log((half + 0.5) * 2.0**-32) for half in (F.shiftrightunsigned(g, 32), g.bitwiseAND(F.lit(0xFFFFFFFF))))
    a = -F.log1p(-once)
    r = F.log1p(e1 / a) + e2
    t = F.floor((F.log(F.col("w")) + e2) / r)
    return F.when(F.col("w") == 1, once).otherwise(F.when(t == 0, once).otherwise(-F.expm1(-a * F.exp(-r * t))))


def signatures(rows: DataFrame, keys: list[str], text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature`` (array of doubles) of every text; keys must tell rows apart."""
    terms = rows.select(*keys, weighted(shingles(F.col(text_col))).alias("terms")).select(*keys, F.explode_outer("terms").alias("term")).select(*keys, "term.s", "term.w")
    least = terms.groupBy(*keys).agg(*[F.min(F.when(F.col("s").isNotNull(), _sample(k))).alias(f"m{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[F.coalesce(F.col(f"m{k}"), F.lit(EMPTY)) for k in range(samples)]).alias("signature"))


def likeness(a, b, samples: int = SAMPLES):
    """Share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return sum((F.get(a, k) == F.get(b, k)).cast("int") for k in range(samples)) / float(samples)


def _bounds(docs: DataFrame, ranges: int) -> list:
    """Ascending ids that cut the table into about ``ranges`` parts of as many rows, however the ids lie."""
    kind = dict(docs.dtypes)["doc_id"]
    if ranges < 2:
        return []
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges))).first()[0]
    else:  # every m-th id by hash, about four a range
        m = max(1, docs.count() // (4 * ranges))
        held = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0)).distinct().sort("doc_id").collect()
        cuts = [r[0] for r in held][::4]
    return sorted(set(cuts or []))


def _zone(bounds: list, kind: str):
    """How many bounds an id reaches, by binary search (0 for null)."""
    if not bounds:
        return F.lit(0)
    top = 1 << (len(bounds).bit_length() - 1)
    steps = F.array(*[F.lit(top >> k) for k in range(top.bit_length())])
    held = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")  # a constant, computed once

    def search(own):
        reach = lambda at, step: F.when(F.coalesce(F.get(own, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), reach)

    return let(held, search)


def with_next(docs: DataFrame, copies: bool = False) -> DataFrame:
    """Rows (zone, place, copy, doc_id, text, next_text) in the order of doc_id; after the last comes the first.

    Ids (of any type that has an order) are cut into ranges of about RANGE_ROWS rows each; each range
    also gets a copy of the first row of the next range that has rows, so that no window spans more
    than one range.  Null ids come first.  ``copies`` returns these rows as well (copy = 1): the row
    after any own one is then at the next place of its zone.
    """
    spark = docs.sparkSession
    ranges = max(1, min(MAX_RANGES, docs.count() // RANGE_ROWS))
    zone = _zone(_bounds(docs, ranges), dict(docs.dtypes)["doc_id"])
    rows = docs.select(zone.alias("zone"), "doc_id", "text")
    firsts = rows.select("zone", "doc_id").groupBy("zone").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null_first"))
    heads = [(z, None if nulls else first) for z, first, nulls in sorted(firsts.collect(), key=lambda r: r[0])]  # one a range
    follow = [(heads[i - 1][0], heads[i][0], heads[i][1]) for i in range(len(heads))]
    kind = dict(docs.dtypes)["doc_id"]
    after = spark.createDataFrame(follow, f"zone int, next_zone int, head {kind}")
    heads_of = rows.select("doc_id", "text").join(F.broadcast(after.withColumnRenamed("zone", "own")), F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("own").alias("zone"), "doc_id", "text", F.lit(1).alias("copy"))
    order = W.partitionBy("zone").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.withColumn("copy", F.lit(0)).unionByName(heads_of).select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    return (placed if copies else placed.filter("copy = 0")).select("zone", "place", "copy", "doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


#: What a term counts for: the whole text, the part of it that its edit keeps, the part that comes into
#: the edit of the document before, and the edit itself.
WHOLE, KEPT, CAME, EDIT = 4, 2, 1, 8


def _inner(part):
    """(first, stop, n) of the words of a text's beginning that are whole words wherever it is put: not the
    first one unless blank space is in front, not the last one unless blank space follows; n words in all."""
    def of(x):
        first = F.when(x["head"].rlike(r"\s"), 0).otherwise(1)
        stop = x["n"] - F.when(x["tail"].rlike(r"\s"), 0).otherwise(1)
        return F.struct(first.alias("first"), stop.alias("stop"), x["n"].alias("n"))

    return let(part, lambda p: let(F.struct(F.left(p, F.lit(1)).alias("head"), F.right(p, F.lit(1)).alias("tail"), F.size(words(p)).alias("n")), of))


def _labelled(terms, uses: int):
    return F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["w"].alias("w"), F.lit(uses).alias("uses")))


def edit_terms(text, kept, came, arrived, size: int = WORDS):
    """Terms (s, w, uses) from which a text's signature and its edit's follow as minima.

    A term that occurs once in the edit lies in the part kept, in the part that arrives from the next
    document, or across the cut.  Those of the parts are drawn once, with the texts that they come
    from; what is left for the edit are the terms across the cut and those that it holds more than
    once, with their whole weight: a sample only falls as a weight grows, so the parts' own samples of
    the same terms never win.
    """
    def own(x):
        stop, came_ = x["kept"]["stop"] - (size - 1), x["came"]

        def uses(j):
            first = F.when(j < stop, KEPT).otherwise(0)  # the first word of a text is whole in its own edit
            return F.lit(WHOLE) + first + F.when((j >= came_["first"]) & (j < came_["stop"] - (size - 1)), CAME).otherwise(0)

        def listed(terms):
            once = F.transform(terms, lambda s, j: F.struct(s.alias("s"), F.lit(1).alias("w"), uses(j).alias("uses")))
            parts = F.concat(
                _labelled(weighted(terms), WHOLE), _labelled(weighted(F.slice(terms, 1, F.greatest(stop, F.lit(0)))), KEPT),
                _labelled(weighted(F.slice(terms, came_["first"] + 1, F.greatest(came_["stop"] - (size - 1) - came_["first"], F.lit(0)))), CAME),
            )
            return F.when(F.size(F.array_distinct(terms)) == F.size(terms), once).otherwise(parts)

        return let(_shingles(x["own"], size), listed)

    def of_edit(x):
        begin = F.size(x["words"]) - x["arrived"]["n"]  # the word of the edit where the arrived part's first one lies
        low, high = begin + x["arrived"]["first"], begin + x["arrived"]["stop"] - size

        def listed(terms):
            across = F.filter(terms, lambda s, j: (j >= x["kept"]["stop"] - (size - 1)) & ~((j >= low) & (j <= high)))
            once = F.transform(F.array_distinct(across), lambda s: F.struct(s.alias("s"), F.lit(1).alias("w"), F.lit(EDIT).alias("uses")))
            more = F.when(F.size(F.array_distinct(terms)) == F.size(terms), F.slice(once, 1, 0)).otherwise(_labelled(F.filter(weighted(terms), lambda t: t["w"] > 1), EDIT))
            return F.concat(once, more)

        return let(_shingles(x["words"], size), listed)

    def both(x):
        parts = F.struct(words(x["text"]).alias("own"), _inner(x["kept"]).alias("kept"), _inner(x["came"]).alias("came"), words(F.concat(x["kept"], x["arrived"])).alias("words"), _inner(x["arrived"]).alias("arrived"))
        return let(parts, lambda y: F.concat(own(y), of_edit(y)))

    return let(F.struct(text.alias("text"), kept.alias("kept"), came.alias("came"), arrived.alias("arrived")), both)


def shown(signature):
    """A signature as text, 16 digits a sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex((x * float(1 << 61)).cast("long")), 16, "0")), "")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(id_text(table(spark, sf_dir, "documents")), copies=True)
    order = W.partitionBy("zone").orderBy("place")
    n, text = F.col("n"), F.col("text")
    rows = rows.withColumn("n", F.char_length("text")).withColumn("before", F.coalesce(F.lag("n").over(order), F.lit(0)))
    start = lambda t, k: F.substring(t, F.lit(1), k)
    half, half_before = F.floor(n / 2).cast("int"), F.floor(F.col("before") / 2).cast("int")
    kept, arrived = start(text, n - half), start(F.col("next_text"), half)
    keys = ["zone", "place", "copy", "uses"]
    none = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).alias("w"), F.lit(0).alias("uses")))  # counts for nothing: every text has a row
    terms = rows.select("zone", "place", "copy", F.explode(F.concat(edit_terms(text, kept, start(text, half_before), arrived), none)).alias("t"))
    terms = terms.select("zone", "place", "copy", "t.uses", "t.s", "t.w")
    parts = terms.groupBy(*keys).agg(*[F.min(_sample(k)).alias(f"m{k}") for k in range(SAMPLES)])
    parts = parts.select(*keys, F.array(*[f"m{k}" for k in range(SAMPLES)]).alias("m"))
    held = parts.groupBy("zone", "place", "copy").agg(F.collect_list(F.struct("uses", "m")).alias("parts"))  # nine at most

    def least(use: int):
        own = F.transform(F.filter("parts", lambda p: p["uses"].bitwiseAND(F.lit(use)) > 0), lambda p: p["m"])
        return F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.array_min(F.transform(own, lambda m: F.get(m, k))))

    held = held.select("zone", "place", "copy", least(WHOLE).alias("whole"), least(KEPT | EDIT).alias("edit"), least(CAME).alias("came"))
    held = held.withColumns({"next_whole": F.lead("whole").over(order), "next_came": F.lead("came").over(order)}).filter("copy = 0").drop("copy")
    filled = lambda a: F.transform(a, lambda x: F.coalesce(x, F.lit(EMPTY)))
    held = held.select("zone", "place", filled(F.col("whole")).alias("signature"), filled(F.zip_with("edit", "next_came", lambda x, y: F.least(x, y))).alias("edited_signature"), filled(F.col("next_whole")).alias("next_signature"))
    meta = rows.filter("copy = 0").select("zone", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.concat(kept, arrived).cast("binary"), 256).alias("edited_sha256"))
    out = meta.join(held, ["zone", "place"])
    return out.select("doc_id", "n_chars", "edited_sha256", shown(F.col("signature")).alias("fingerprint"), shown(F.col("edited_signature")).alias("edited_fingerprint"), likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
