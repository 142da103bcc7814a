"""N-gram Jaccard join with several global token orders.

A document's set holds the hashes of its distinct five-word shingles.  Documents with equal sets are
one class, so copies cost one member.  Two classes that link agree on 80 % of either set, hence each
has at most n - ceil(0.8 n) shingles that the other lacks, and they share a shingle in every prefix
that is one longer than that, whatever the order of all shingles:

1. Order of hashes, per document: of a prefix a little longer than needed so many shingles must
   occur in another class that the rest could be the ones that the partner lacks.  Most documents
   end here, and no pairs are formed.
2. Order of rarity among the documents left (exact counts): classes that share a shingle of their
   prefixes fall into one bucket, a connected component of a graph with one edge an entry.
3. Inside a bucket a pair must share a shingle in the prefixes of all three orders (rarity, ascending
   and descending hashes) and fit in size; then the sets are compared whole.  Every such pair is
   judged, so the number of links of each class is exact, but only counts and the edges of a spanning
   forest leave the task, never all pairs.

Buckets are worked in pairs of blocks on many tasks and their forests joined.  A bucket's members are
sent to as many tasks as it has blocks, and the pairs in a bucket are as many as its members squared:
that is the price of exact link counts in a group of near copies.

Null texts and texts without words have an empty set and link with nothing; shorter texts are one
shingle.  Rows with the same doc_id count as documents of their own that share a name.  Shingles are
known by 64-bit hashes and classes by a 63-bit hash of their set.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import MANY, Stage, id_text, python_stage, releasing, runs_of_equal, table
from tessera.llm.components import components

WORDS, PERCENT = 5, 80
#: Part of a set by which the first prefix is longer than the bound asks for.
EXTRA = 0.05
#: Members of a block: an eighth of the bucket, but between these bounds.
BLOCK, MOST = 250, 1000
#: The side of a member in the unit of its own block.
OWN = 2
#: Distinct shingles that are compared at once where many pairs are.
COLUMNS = 2048


def lacking(n: int) -> int:
    """The most members of a set of n that a linked set may lack."""
    return n - -(-PERCENT * n // 100)


def shingle_set(text: str, size: int = WORDS):
    """Sorted hashes of the distinct word shingles."""
    import numpy as np

    from tessera.llm.rolling import hashes, sums

    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    keep = word.copy()
    keep[1:] |= space[1:] & word[:-1]  # one separator after a word
    data = np.where(space[keep], np.uint8(32), data[keep])
    if not len(data):
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(data == 32)
    start, stop = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    if start[-1] == len(data):
        start, stop = start[:-1], stop[:-1]
    total = sums(data)
    if len(start) < size:
        return hashes(total, start[:1], stop[-1:])
    return np.unique(hashes(total, start[: len(start) - size + 1], stop[size - 1 :]))


def set_id(own) -> int:
    """63 bits that stand for a set; -1 for the empty one."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little") >> 1 if len(own) else -1


@releasing
def _sets(batches, what):
    """what: 'prefix' or 'whole' sets, packed."""
    import pyarrow as pa

    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        if what == "prefix":
            sizes = [min(len(s), lacking(len(s)) + 1 + ceil(EXTRA * len(s))) for s in sets]
            packed = [s[:k].tobytes() for s, k in zip(sets, sizes)]
        else:
            packed = [s.tobytes() for s in sets]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n": pa.array([len(s) for s in sets], pa.int32()), "c": pa.array([set_id(s) for s in sets], pa.int64()), "packed": pa.array(packed, pa.binary())})


@releasing
def _explode(batches):
    """(token, c, n) of packed sets."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        packed, c, n = batch.column("packed").to_pylist(), batch.column("c").to_numpy(), batch.column("n").to_numpy()
        sizes = [len(p) // 8 for p in packed]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(c, sizes)), pa.array(np.repeat(n, sizes))], names=["token", "c", "n"])


@releasing
def _shared(batches, counted):
    """Of rows sorted by token and c: (c, n, token, df) of the tokens that two classes have."""
    import numpy as np
    import pyarrow as pa

    long_token = None
    for rows, part in runs_of_equal(batches, "token"):
        token, c, n = (rows.column(k).to_numpy() for k in ("token", "c", "n"))
        first = np.concatenate(([True], (token[1:] != token[:-1]) | (c[1:] != c[:-1])))  # copies count once
        token, c, n = token[first], c[first], n[first]
        begins = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        df = np.repeat(np.diff(np.append(begins, len(token))), np.diff(np.append(begins, len(token))))
        if part or long_token is not None:  # a run in parts is a run of many
            df = np.where((token == long_token) | (part & (token == token[-1])), MANY, df)
        long_token = token[-1] if part else None
        at = np.flatnonzero(df > 1)
        if len(at):
            cols = [pa.array(c[at]), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(token[at]), pa.array(np.minimum(df[at], MANY).astype(np.int32))] if counted else []), names=["c", "n"] + ["token", "df"] * counted)


@releasing
def _prefixes(batches):
    """Of shared tokens sorted by c, then by df and token downwards: (token, c) of the prefixes by rarity.

    The tokens that no one shares come first in the order of rarity and take their places of the
    prefix, which ends ceil(0.8 n) - 1 tokens before the end of the set.  Counted from that end, the
    place alone decides, so a class may come in any number of batches.
    """
    import numpy as np
    import pyarrow as pa

    own, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c, n, token = (batch.column(k).to_numpy() for k in ("c", "n", "token"))
        begins = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        sizes = np.diff(np.append(begins, len(c)))
        before = np.zeros(len(begins), np.int64)
        before[0] = seen if c[0] == own else 0
        place = np.arange(len(c)) - np.repeat(begins - before, sizes)
        own, seen = c[-1], place[-1] + 1
        at = np.flatnonzero(place >= (PERCENT * n.astype(np.int64) + 99) // 100 - 1)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(c[at])], names=["token", "c"])


@releasing
def _stars(batches):
    """Of entries sorted by token: edges between the first class of a token and its others."""
    import numpy as np
    import pyarrow as pa

    token, head = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, c = batch.column("token").to_numpy(), batch.column("c").to_numpy()
        begins = np.flatnonzero(np.concatenate(([tokens[0] != token], tokens[1:] != tokens[:-1])))
        heads = np.full(len(c), head)
        if len(begins):
            heads[begins[0] :] = np.repeat(c[begins], np.diff(np.append(begins, len(c))))
        token, head = tokens[-1], heads[-1]
        at = np.flatnonzero(heads != c)
        if len(at):
            edges = np.unique(np.stack([heads[at], c[at]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])


def _common(sets, pairs):
    """Sizes of the intersections of pairs (two index arrays) of sorted sets."""
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    known, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = df > 1
    n_shared = int(shared.sum())
    if len(pairs[0]) * 1e4 < len(sets) ** 2 * n_shared * 0.05:  # few pairs: one by one
        return np.array([len(np.intersect1d(sets[i], sets[j], True)) for i, j in zip(*(p.tolist() for p in pairs))], np.int64)
    place = np.cumsum(shared) - 1  # many: as products of incidence matrices, some columns at a time
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, n_shared, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, n_shared - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    return both[pairs].astype(np.int64)


def linked(ids, sets, side):
    """Links between sets: (degree of each, edges of a spanning forest).

    ``side`` is OWN for sets of one block, whose pairs are all judged, else 0 or 1: then only pairs of
    unlike sides are.
    """
    import numpy as np

    n, side = len(sets), np.asarray(side)
    cross = side[0] != OWN
    sizes = np.array([len(s) for s in sets])
    known, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    cut = sizes - (PERCENT * sizes + 99) // 100 + 1
    prefixes = []  # of each order: the columns of each set's prefix
    for order in ("rarity", "ascending", "descending"):
        own = []
        for i in range(n):
            c = column[bounds[i] : bounds[i + 1]]
            c = c[np.lexsort((c, df[c]))][: cut[i]] if order == "rarity" else c[: cut[i]] if order == "ascending" else c[-cut[i] :]
            own.append(c[df[c] > 1])
        prefixes.append(own)
    indexes = []
    for own in prefixes:
        at = np.concatenate(own)
        who = np.repeat(np.arange(n), [len(c) for c in own])
        order = np.argsort(at, kind="stable")
        indexes.append((who[order], np.searchsorted(at[order], np.arange(len(known) + 1))))
    left, right = [], []
    for i in range(n):
        may = (sizes[i + 1 :] * 100 >= PERCENT * sizes[i]) & (sizes[i] * 100 >= PERCENT * sizes[i + 1 :])
        if cross:
            may &= side[i + 1 :] != side[i]
        for own, (who, start) in zip(prefixes, indexes):
            if not may.any():
                break
            seen = np.zeros(n, bool)
            for c in own[i].tolist():
                seen[who[start[c] : start[c + 1]]] = True
            may &= seen[i + 1 :]
        at = np.flatnonzero(may)
        left.append(np.full(len(at), i))
        right.append(at + i + 1)
    left, right = np.concatenate(left), np.concatenate(right)
    if not len(left):
        return np.zeros(n, np.int64), []
    both = _common(sets, (left, right))
    good = 100 * both >= PERCENT * (sizes[left] + sizes[right] - both)
    left, right = left[good], right[good]
    degree = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    root, edges = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            edges.append((ids[i], ids[j]))
    return degree, edges


@releasing
def _verify(batches):
    """Of rows sorted by unit: (a, b) of spanning edges of the links inside each unit, and (a, null, links)."""
    import numpy as np
    import pyarrow as pa

    unit, ids, sets, side = None, [], [], []

    def close():
        degree, edges = linked(ids, sets, side) if len(ids) > 1 else ([], [])
        own = [(c, int(n)) for c, n in zip(ids, degree) if n]
        return pa.RecordBatch.from_pydict({"a": pa.array([e[0] for e in edges] + [c for c, _ in own], pa.int64()), "b": pa.array([e[1] for e in edges] + [None] * len(own), pa.int64()), "links": pa.array([None] * len(edges) + [n for _, n in own], pa.int64())})

    for batch in batches:
        for u, c, s, packed in zip(*(batch.column(k).to_pylist() for k in ("unit", "c", "side", "packed"))):
            if u != unit:
                yield close()
                unit, ids, sets, side = u, [], [], []
            ids.append(c)
            sets.append(np.frombuffer(packed, np.uint64))
            side.append(s)
    yield close()


def _sorted(df: DataFrame, key: str, *then) -> DataFrame:
    return df.repartition(F.col(key)).sortWithinPartitions(key, *then)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), component (a number of the
    component's own; null for empty sets), class_id (rows with equal sets), n_links (other classes
    that the row's class links with) and key (hash of the text) of every row."""
    here = "tessera.llm.ngram_join:"
    stage, rows = Stage(docs.sparkSession), id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    sets = f"doc_id {kind}, key long, n int, c long, packed binary"
    first = stage.keep(python_stage(rows, here + "_sets", sets, "prefix"), "prefixes")

    entries = python_stage(first.filter("n > 0").select("c", "n", "packed"), here + "_explode", "token long, c long, n int")
    shared = python_stage(_sorted(entries, "token", "c"), here + "_shared", "c long, n int", False).groupBy("c").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    lacks = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    live = stage.keep(shared.filter(F.col("shared") >= F.least(F.col("n"), lacks + 1 + F.ceil(F.col("n") * EXTRA)) - lacks).select("c"), "live")

    first = stage.keep(first.select("doc_id", "key", "n", "c"), "rows")
    stage.drop("prefixes")

    # the texts of one document for each class left
    one = first.select("c", "doc_id").join(live, "c").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    again = python_stage(rows.join(one.select(F.col("doc_id").alias("own")).distinct(), F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", "key", "text"), here + "_sets", sets, "whole")
    whole = stage.keep(again.join(live, "c").select("c", "n", "packed").dropDuplicates(["c"]), "whole")
    stage.drop("live")

    entries = python_stage(whole, here + "_explode", "token long, c long, n int")
    shared = python_stage(_sorted(entries, "token", "c"), here + "_shared", "c long, n int, token long, df int", True)
    chosen = python_stage(_sorted(shared, "c", F.desc("df"), F.desc("token")), here + "_prefixes", "token long, c long")
    edges = stage.keep(python_stage(_sorted(chosen, "token", "c"), here + "_stars", "a long, b long"), "stars")
    buckets = components(edges, stage, "buckets")
    stage.drop("stars")

    sizes = buckets.groupBy("label").agg(F.count("*").alias("members"))
    per_block = F.least(F.greatest(F.ceil(F.col("members") / 8), F.lit(BLOCK)), F.lit(MOST))
    placed = buckets.join(sizes, "label").withColumn("blocks", F.ceil(F.col("members") / per_block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a member of block i goes to the units {i, j} for all blocks j of its bucket; its own block's pairs are judged in {i, i}
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.concat_ws(" ", F.col("label"), F.least(F.col("block"), j), F.greatest(F.col("block"), j)).alias("unit"), F.when(F.col("block") == j, OWN).otherwise((F.col("block") > j).cast("int")).alias("side")))
    units = placed.select(F.col("node").alias("c"), F.explode(pair).alias("u")).select("c", "u.unit", "u.side")
    links = stage.keep(python_stage(_sorted(units.join(whole.select("c", "packed"), "c"), "unit", "c"), here + "_verify", "a long, b long, links long"), "links")
    joined = components(links.filter("b is not null").select("a", "b"), stage, "links")
    degrees = links.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("n_links"))

    classes = first.select("c", "doc_id").filter("c >= 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = classes.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.select("c", "label").join(names, "label").join(degrees, "c", "left").select("c", "label", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    final = stage.keep(final, "classes")
    stage.drop(*[name for name in stage.paths if name not in ("classes", "rows")])
    return first.join(final, "c", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("label").alias("component"), F.col("c").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "key")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
