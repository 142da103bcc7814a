"""Company records: merge of field observations with conflicts, unions in order, keep-last-N.

Observations are long rows (site, key, pos, value, confidence, source_url, dirty, verified); those with
the least pos of a site and key are the record that later ones are merged into, in the order of pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import patterns as P
from tessera.sources import kept

CELL = ["pos", "value", "confidence", "source_url"]


def _rank(conf):
    return F.when(conf == "high", 2).when(conf == "medium", 1).otherwise(0)


#: Places of a site and field that one task looks through at a time.
RANGE = 4096


def survivors(observations: DataFrame, width: int) -> DataFrame:
    """The few observations of each range of ``width`` places of a site and field that can decide its cell.

    Whatever the cell is before a range, its value and rank decide which observation takes it first: of those with
    a higher rank the first, or where that has the cell's own value the first with another.  What follows the taker
    inside the range follows from the taker alone, at most two more, as ranks rise.  So a range is stood
    for by its first observation, by the first takers for each rank, and by what comes after these.
    """
    rank, pos, value = _rank(F.col("confidence")), F.col("pos"), F.col("value")
    own = F.struct("pos", rank.alias("rank"), "value")
    span = W.partitionBy("site", "key", "__range")
    least = lambda on: F.min(F.when(on & (value != ""), own)).over(span)
    above = lambda r: rank > r
    after = lambda x: (pos > F.col(f"{x}.pos")) & (rank > F.col(f"{x}.rank")) & (value != F.col(f"{x}.value"))
    rows = observations.withColumn("__range", F.floor(pos / width))
    rows = rows.withColumns({"__start": F.min("pos").over(span), "__any": least(F.lit(True)), "__a0": least(above(0)), "__a1": least(above(1))})
    rows = rows.withColumns({"__b0": least(above(0) & (value != F.col("__a0.value"))), "__b1": least(above(1) & (value != F.col("__a1.value"))), "__c": least(after("__any")), "__d": least(after("__a0"))})
    rows = rows.withColumns({"__e": least(after("__b0")), "__f": least(after("__c"))})
    keep = pos == F.col("__start")
    for x in ("__any", "__a0", "__a1", "__b0", "__b1", "__c", "__d", "__e", "__f"):
        keep = keep | F.coalesce(pos == F.col(f"{x}.pos"), F.lit(False))
    return rows.filter(keep).select(*observations.columns)


def merge(observations: DataFrame, width: int = RANGE) -> DataFrame:
    """(site, key, pos, value, confidence, source_url, dirty, verified): the cell of every site and key.

    An empty cell takes the first value and keeps its own verified mark; an equal value changes
    nothing; a dirty or verified cell stays; else a higher confidence replaces the cell.

    Observations are thinned twice, in ranges of ``width`` places and of its square, to those that can decide anything
    (``survivors``); only these meet by site and field, so that a site with very many pages is many tasks' work.
    As there are three confidences, a cell is then taken or replaced three times at most.  Places of a
    site and field are distinct.
    """
    keys = ["site", "key"]
    rows = observations.select("site", "key", *CELL, "dirty", "verified").withColumn("value", C.text(F.col("value")))
    seen = kept(survivors(survivors(rows, width), width * width), "observations")
    cell = seen.groupBy(*keys).agg(F.min_by(F.struct(*CELL, "dirty", "verified"), "pos").alias("cell"))
    for _ in range(3):
        now = seen.join(cell, keys)
        open_ = ~F.col("cell.dirty") & ~F.col("cell.verified") & (_rank(F.col("confidence")) > _rank(F.col("cell.confidence")))
        takes = (F.col("pos") > F.col("cell.pos")) & (F.col("value") != "") & (F.col("value") != F.col("cell.value")) & ((F.col("cell.value") == "") | open_)
        still = (F.col("cell.value") == "") & F.col("cell.verified")
        new = F.struct(*CELL, F.lit(False).alias("dirty"), still.alias("verified"))
        step = now.filter(takes).groupBy(*keys).agg(F.min_by(new, "pos").alias("new"))
        cell = cell.join(step, keys, "left").select(*keys, F.coalesce("new", "cell").alias("cell"))
    return cell.select(*keys, "cell.*")


def empty(sources: DataFrame) -> DataFrame:
    """``sources`` (with source_url) times all fields: cells without a value."""
    cell = [F.lit("").alias("value"), F.lit("low").alias("confidence"), "source_url", F.lit(False).alias("dirty"), F.lit(False).alias("verified")]
    keys = F.explode(F.array(*map(F.lit, P.FIELDS))).alias("key")
    return sources.select([c for c in sources.columns if c != "source_url"] + [keys] + cell)


def patched(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Cells of ``base`` (one a site and key) with those of ``patch`` merged in; a field without a base is taken."""
    return merge(base.withColumn("pos", F.lit(0)).unionByName(patch.withColumn("pos", F.lit(1))))


def conflicts(observations: DataFrame, merged: DataFrame | None = None, width: int = RANGE) -> DataFrame:
    """One row for each later value that a dirty or verified cell turned down (``merged``: what ``merge`` gave).

    Locked cells go to the ranges of their site and field, so that observations meet them range by range."""
    cell = (merge(observations) if merged is None else merged).filter("dirty or verified").select("site", "key", F.col("value").alias("current"), F.col("pos").alias("since"))
    rows = observations.filter("coalesce(value, '') <> ''").withColumn("__range", F.floor(F.col("pos") / width))
    locked = rows.select("site", "key", "__range").distinct().join(cell, ["site", "key"])
    late = rows.join(locked, ["site", "key", "__range"]).filter("pos > since and value <> current")
    labels = F.create_map(*[F.lit(x) for pair in P.FIELDS.items() for x in pair])
    return late.select("site", "key", F.try_element_at(labels, F.col("key")).alias("label"), "pos", "current", F.col("value").alias("incoming"), "source_url")


def resolved(cells: DataFrame, taken: DataFrame) -> DataFrame:
    """Cells with the incoming value of each conflict (site, key, pos, incoming) taken; the last one counts."""
    last = taken.groupBy("site", "key").agg(F.max_by("incoming", "pos").alias("incoming"))
    value, dirty = F.coalesce("incoming", "value"), F.when(F.col("incoming").isNotNull(), False).otherwise(F.col("dirty"))
    return cells.join(last, ["site", "key"], "left").select("site", "key", value.alias("value"), "confidence", dirty.alias("dirty"), "verified")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key by an order column, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first")).select(*keys, "first.*")


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, "last.*")


def visited(pages: DataFrame) -> DataFrame:
    """(site, pos, url, title): the first visit of every URL; those after the site's first page have the role heal."""
    once = first_of_each(pages.select("site", "url", "pos", "title"), ["site", "url"], "pos")
    start = pages.groupBy("site").agg(F.min("pos").alias("start"))
    return once.join(start, "site").select("site", "pos", "url", "title", F.when(F.col("pos") == F.col("start"), "primary").otherwise("heal").alias("role"))


def keep_last(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


def missing_fields(row_fields: dict):
    """Names of empty required fields, in order."""
    return F.filter(F.array(*[F.when(empty, F.lit(name)) for name, empty in row_fields.items()]), lambda k: k.isNotNull())


def running(rows: DataFrame, key: str, order: str, value, name: str, width: int = 4096) -> DataFrame:
    """``rows`` with the sum of ``value`` over a key's rows up to their own, by a whole-number order column.

    Sums are taken in ranges of the order column and shifted by what the ranges before hold, so one
    key with very many rows is many tasks' work.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / width)).withColumn("__value", value)
    sums = ranged.groupBy(key, "__range").agg(F.sum("__value").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(key).alias("__key"), F.col("__range").alias("__at"), before.alias("__before"))
    own = F.sum("__value").over(W.partitionBy(key, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("__range").eqNullSafe(F.col("__at"))
    return ranged.withColumn("__own", own).join(sums, same).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__range", "__value", "__key", "__at")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with their number inside each key, from 1."""
    return running(rows, key, order, F.lit(1), "number")
