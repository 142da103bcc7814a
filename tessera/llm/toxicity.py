"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are character n-grams inside words, hashed.  A bounded sample of labelled documents is the
example set; the vocabulary is the terms that the sample ties to the toxic label (a cosine over all
terms was tried and finds fewer toxic texts, see README).  Document frequencies are summed by Spark,
and of the examples only the vocabulary's terms reach the driver.  Examples lie in
blocks of an inverted index that also stores, for each term and block, the largest weight.  A query
bounds every block from these maxima, visits blocks from the highest bound down and stops when no
block can beat its k-th best example, so the k neighbours are exact.  Votes weighted by cosine, with
a small constant vote for the base rate, are calibrated by a logistic fit on the examples left out
one at a time.

Null and empty texts, and texts without a vocabulary term, get the score of no evidence.  Without
labelled examples of both classes every score is the base rate (0 without any label).  A document
labelled twice counts with its highest label; documents that share a doc_id are examples each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import python_stage, table
from tessera.llm.language_id import fold

#: Labelled documents taken of each class (about: chosen by a hash of doc_id against this bound).
TOXIC_SAMPLE, CLEAN_SAMPLE = 1000, 4000
NEIGHBOURS, BLOCK, BITS = 15, 64, 20
#: Blocks visited at once at first; each further visit takes twice as many.
VISIT = 8
#: Lengths of the n-grams.
GRAMS = (5, 6, 7, 8)
#: The vote of the base rate, as a cosine.
BACKGROUND = 0.5
#: Terms must occur in so many toxic examples, and so many times likelier in them than in clean ones.
SUPPORT, LIFT = 5, 12.0

#: Distinct words whose columns a task remembers before it starts afresh.
MEMO = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(words: list[str]):
    """(hashed n-gram, index of its word) of all occurrences in ``words``, boundaries included."""
    import numpy as np

    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    breaks, found, owner = np.concatenate(([0], np.cumsum(codes == 32))), [], []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        mix = codes[:m] + np.uint64(n << 32)
        for k in range(1, n):
            mix = mix * np.uint64(0x100000001B3) + codes[k : m + k]
        at = np.flatnonzero(breaks[n - 1 : m + n - 1] == breaks[1 : m + 1])  # a space at the ends only
        found.append((mix[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        owner.append(breaks[at + 1] - 1)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found).astype(np.int64), np.concatenate(owner)) if found else (none, none)


def terms(text: str | None):
    return grams_of(words_of(text))[0]


@dataclass
class Index:
    """Examples as rows of unit length over a selected vocabulary, with block maxima."""

    place: object  # term -> column, -1: not in the vocabulary
    idf: object
    labels: object
    starts: object  # postings of a cell (column * blocks + block): starts[cell]:starts[cell + 1]
    rows: object
    weights: object
    maxima: object  # columns x blocks
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def columns(self, found):
        """Columns of the terms that the vocabulary has, one an occurrence."""
        cols = self.place[found]
        return cols[cols >= 0]

    def learn(self, words: set[str], known: dict[str, tuple[int, ...]]) -> None:
        """Adds the columns of new words to ``known``."""
        import numpy as np

        new = [w for w in words if w not in known]
        known.update(dict.fromkeys(new, ()))
        found, owner = grams_of(new)
        cols = self.place[found]
        for i in np.flatnonzero(cols >= 0):
            known[new[owner[i]]] += (int(cols[i]),)

    def vector(self, cols):
        """Columns and unit weights of a document's column occurrences."""
        import numpy as np

        return self.weighted(*np.unique(np.asarray(cols, np.int64), return_counts=True))

    def weighted(self, cols, tf):
        """Columns and unit weights of distinct columns and their counts."""
        import numpy as np

        w = (1 + np.log(tf)) * self.idf[cols]
        return cols, w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, cols, w, k: int = NEIGHBOURS, but: int = -1):
        """Exact k best examples (row, cosine), ties to lower rows."""
        import numpy as np

        bound = w @ self.maxima[cols]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, best_rows, at, step = np.zeros(0), np.zeros(0, np.int64), 0, VISIT
        while at < len(order) and (len(best) < k or bound[order[at]] >= best[-1] - 1e-12):
            blocks = order[at : at + step]
            at, step = at + step, step * 2
            cells = (cols[:, None] * self.maxima.shape[1] + blocks).ravel()
            first, n = self.starts[cells], self.starts[cells + 1] - self.starts[cells]
            own = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())  # postings of all these cells
            place = np.repeat(np.tile(np.arange(len(blocks)) * BLOCK, len(cols)), n) + self.rows[own] % BLOCK
            scores = np.bincount(place, np.repeat(np.repeat(w, len(blocks)), n) * self.weights[own], len(blocks) * BLOCK)
            hits = np.flatnonzero(scores > 0)
            rows = blocks[hits // BLOCK] * BLOCK + hits % BLOCK
            other = rows != but
            best, best_rows = np.concatenate((best, scores[hits[other]])), np.concatenate((best_rows, rows[other]))
            top = np.lexsort((best_rows, -best))[:k]
            best, best_rows = best[top], best_rows[top]
        return [(int(row), min(1.0, float(s))) for row, s in zip(best_rows, best)]

    def vote(self, neighbours) -> float:
        total = BACKGROUND + sum(s for _, s in neighbours)
        return (BACKGROUND * self.base + sum(s * self.labels[r] for r, s in neighbours)) / total

    def score(self, cols):
        """(calibrated score, neighbours) of column occurrences."""
        import math

        cols, w = self.vector(cols)
        near = self.nearest(cols, w) if len(cols) else []
        return 1 / (1 + math.exp(-(self.slope * self.vote(near) + self.shift))), near


def chosen_terms(terms, df, n: tuple[int, int]):
    """Of terms with document frequencies (2 rows: clean, toxic) among ``n`` examples: the vocabulary and its idf."""
    import numpy as np

    lift = (df[1] / n[1]) / ((df[0] + 0.5) / n[0])
    at = np.flatnonzero((df[1] >= min(SUPPORT, n[1])) & (lift >= LIFT))
    return terms[at], np.log(1 + sum(n) / (1 + df[:, at].sum(axis=0)))


def build(examples: list[tuple[int, object]]) -> Index | float:
    """``examples``: (label, term occurrences); the index, or the base rate if there is only one class."""
    import numpy as np

    n1 = sum(y for y, _ in examples)
    n = (len(examples) - n1, n1)
    if not all(n):
        return n1 / max(1, len(examples))
    df = np.zeros((2, 1 << BITS))
    for y, found in examples:
        df[y, np.unique(found)] += 1
    terms, idf = chosen_terms(np.arange(1 << BITS), df, n)
    place = placed(terms)
    cols = [place[found] for _, found in examples]
    return assembled(terms, idf, [(y, *np.unique(c[c >= 0], return_counts=True)) for (y, _), c in zip(examples, cols)])


def placed(terms):
    """term -> its column, -1 for those outside the vocabulary."""
    import numpy as np

    place = np.full(1 << BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    return place


def assembled(terms, idf, examples) -> Index:
    """The index of examples (label, columns, counts), calibrated on them."""
    import numpy as np

    labels = np.array([y for y, _, _ in examples], np.int64)
    index = Index(placed(terms), idf, labels, None, None, None, None, base=float(labels.mean()))
    vectors = [index.weighted(np.asarray(c, np.int64), np.asarray(tf)) for _, c, tf in examples]
    col = np.concatenate([c for c, _ in vectors])
    row = np.repeat(np.arange(len(vectors)), [len(c) for c, _ in vectors])
    weight = np.concatenate([w for _, w in vectors])
    order = np.lexsort((row, col))
    col, index.rows, index.weights = col[order], row[order], weight[order]
    blocks = len(labels) // BLOCK + 1
    index.starts = np.searchsorted(col * blocks + index.rows // BLOCK, np.arange(len(terms) * blocks + 1))
    index.maxima = np.zeros((len(terms), blocks))
    np.maximum.at(index.maxima, (col, index.rows // BLOCK), index.weights)
    votes = np.array([index.vote(index.nearest(c, w, but=i) if len(c) else []) for i, (c, w) in enumerate(vectors)])
    slope, shift = 4.0, -2.0  # logistic fit of label on vote, with a little shrinkage
    for _ in range(40):
        p = 1 / (1 + np.exp(-(slope * votes + shift)))
        g = np.array([((p - labels) * votes).sum() + 0.01 * slope, (p - labels).sum() + 0.01 * shift])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * votes * votes).sum() + 0.01, (v * votes).sum()], [(v * votes).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-9:
            break
    index.slope, index.shift = float(slope), float(shift)
    return index


def _frequencies(batches):
    """(term, clean, toxic): documents with a term, summed over a task's rows; one row of term -1 counts documents."""
    import numpy as np
    import pyarrow as pa

    df, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            df[y, np.unique(terms(text))] += 1
            n[y] += 1
    at = np.flatnonzero(df.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[0, at], n[0])), pa.array(np.append(df[1, at], n[1]))], names=["term", "clean", "toxic"])


def _occurrences(batches, sent):
    import numpy as np
    import pyarrow as pa

    place = placed(sent.value)
    for batch in batches:
        cols = [place[terms(t)] for t in batch.column("text").to_pylist()]
        found = [np.unique(c[c >= 0], return_counts=True) for c in cols]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([c.tolist() for c, _ in found], pa.list_(pa.int32())), pa.array([tf.tolist() for _, tf in found], pa.list_(pa.int32()))], names=["toxic", "cols", "tf"])


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE) -> Index | float:
    """The index of a bounded sample of ``labels`` (doc_id, toxic) with the texts of ``docs``; the base
    rate where the sample has one class only."""
    import numpy as np

    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    dice = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    part = F.when(F.col("toxic") == 1, min(1.0, toxic / max(1, sizes.get(1, 0)))).otherwise(min(1.0, clean / max(1, sizes.get(0, 0))))
    taken = known.filter(dice < part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(taken), "doc_id").select("toxic", "text")  # about 5,000 ids are sent
    here = "tessera.llm.toxicity:"
    df = python_stage(rows, here + "_frequencies", "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = df.filter("term = -1").first()
    n = (n["clean"], n["toxic"]) if n else (0, 0)
    if not all(n):
        return n[1] / max(1, sum(n))
    left = df.filter((F.col("term") >= 0) & (F.col("toxic") >= min(SUPPORT, n[1]))).sort("term").toPandas()  # terms of SUPPORT toxic examples, 2**BITS at most
    vocabulary, idf = chosen_terms(left["term"].to_numpy(), left[["clean", "toxic"]].to_numpy(float).T, n)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    examples = python_stage(rows, here + "_occurrences", "toxic int, cols array<int>, tf array<int>", sent).collect()  # the sample's rows, the vocabulary's terms of each
    return assembled(vocabulary, idf, sorted((r[0], r[1], r[2]) for r in examples))


def _score(batches, sent):
    import pyarrow as pa

    from itertools import chain

    index, known = sent.value, {}
    for batch in batches:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        if isinstance(index, float):
            out = [(index, []) for _ in words]
        else:
            if len(known) > MEMO:
                known.clear()
            index.learn(set(chain.from_iterable(words)), known)
            columns = [list(chain.from_iterable(map(known.__getitem__, own))) for own in words]
            nothing = index.score([])
            out = [index.score(own) if own else nothing for own in columns]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array([len(near) for _, near in out], pa.int32()),
             pa.array([near[0][1] if near else 0.0 for _, near in out], pa.float64())],
            names=["doc_id", "score", "n_neighbours", "best_cosine"],
        )


def score(docs: DataFrame, index: Index | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and as evidence the number of neighbours and the best cosine."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return python_stage(rows, "tessera.llm.toxicity:_score", f"doc_id {kind}, score double, n_neighbours int, best_cosine double", sent)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(docs.filter(fold(n=5) != 0), table(spark, sf_dir, "labels").filter(fold(n=5) != 0))
    return score(docs, index).select("doc_id", (fold(n=5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_neighbours", "best_cosine")
