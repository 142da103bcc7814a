"""Where snippets stand in pages: all places of all snippets, with spans in the text that a page shows.

Snippets are compared in a normal form: blanks squeezed, trimmed, lower case, the first ``NEEDLE`` characters.  A page's text
is what its visible text nodes say, joined; a snippet may run across nodes.  Each page is parsed and normalised
once with a map from normal to raw offsets, and one pass of an Aho-Corasick automaton finds all snippets of
a block.  Blocks (by hash, of some ``BLOCK`` snippets or ``BLOCK_CHARS`` characters) are tables in the shared folder that tasks
read by themselves.  A single block's automaton is built once a worker; of several one is held at a time, for ``HELD``
characters of pages.

Null and blank snippets are nowhere.  Repeated pages count once, repeated snippets give one row a
place.  A place counts even if it overlaps another.
"""

from __future__ import annotations

import os
import sys
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.sources import work_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Fixed value
NEEDLE = 80
BLOCK = 250_000
#: An automaton takes some 40 bytes a character that no other snippet begins with.
BLOCK_CHARS = 4_000_000
HELD = 16_000_000
ROWS = 4096
HITS = "page_id long, page long, snippet string, start long, stop long, first_node long, last_node long"


def normal(col):
    """The normal form of a snippet."""
    return F.left(F.lower(C.squeezed(C.text(col))), F.lit(NEEDLE))


def normalised(text: str) -> tuple[str, list[int]]:
    """The normal form of a whole text (not cut), and for each of its characters the raw offset it comes from."""
    import re

    out, at = [], []
    for word in re.finditer(f"[^{C.BLANK[1:]}+", text, re.ASCII):
        i = word.start()
        if out:
            out.append(" ")
            at.append(i - 1)
        own = word.group()
        if own.isascii():
            out.append(own.lower())
            at.extend(range(i, word.end()))
            continue
        for k, c in enumerate(own, i):  # one by one, as lower case may be longer and depend on neighbours
            low = c.lower()
            out.append(low)
            at += [k] * len(low)
    return "".join(out), at


@lru_cache(maxsize=1)
def _automaton(folder: str):
    import ahocorasick
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    machine = ahocorasick.Automaton()
    for f in files.get_file_info(fs.FileSelector(path)):
        if f.base_name.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                for needle in pq.read_table(source, columns=["needle"]).column("needle").to_pylist():
                    machine.add_word(needle, needle)
    machine.make_automaton()
    return machine


def shown(html: str) -> list[tuple[int, str]]:
    """(node, text) of the visible texts of a page in order."""
    from tessera.operators import dom

    parser = dom._tree()()
    parser.feed(html)
    parser.finish()
    return sorted((r[0], r[8]) for r in parser.rows if r[4] == dom.TEXT and not r[10])


def _groups(batches, limit):
    """(page_id, page, nodes, where their texts start, normal form, its offsets) of pages, in groups of some ``limit`` characters."""
    from itertools import accumulate

    group, size = [], 0
    for batch in batches:
        for page_id, page, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "page", "html"))):
            texts = shown(html)
            starts = [0, *accumulate(len(t) for _, t in texts)][:-1]
            group.append((page_id, page, [n for n, _ in texts], starts, *normalised("".join(t for _, t in texts))))
            size += len(group[-1][4])
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def find(batches, folders):
    """Rows (page_id, page, html) -> HITS of the snippets in the folders of all blocks."""
    from bisect import bisect_right

    import pyarrow as pa

    kinds = [("page_id", pa.int64()), ("page", pa.int64()), ("snippet", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("first_node", pa.int64()), ("last_node", pa.int64())]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))
    for group in _groups(batches, 1 if len(folders) == 1 else HELD):
        for folder in folders:
            machine, rows = _automaton(folder), []
            for page_id, page, nodes, starts, flat, at in group if len(machine) else ():
                node = lambda k: nodes[bisect_right(starts, k) - 1]
                for end, needle in machine.iter(flat):
                    start, stop = at[end - len(needle) + 1], at[end] + 1
                    rows.append((page_id, page, needle, start, stop, node(start), node(stop - 1)))
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def spans(pages: DataFrame, wanted: DataFrame, snippet_col: str = "snippet", block: int = BLOCK) -> DataFrame:
    """HITS of every snippet of ``wanted`` in every page (page_id, html); ``snippet`` is the normal form."""
    spark, root = pages.sparkSession, ROOT
    folder = work_folder(spark, "snippets")
    needles = wanted.select(normal(F.col(snippet_col)).alias("needle")).filter("needle <> ''").distinct()
    n, chars = needles.agg(F.count("*"), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()  # two numbers
    blocks = max(1, -(-n // block), -(-chars // BLOCK_CHARS))
    needles.withColumn("block", F.pmod(F.xxhash64("needle"), F.lit(blocks)).cast("int")).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    html = F.col("html")
    rows = pages.filter(html.isNotNull() & (html != "")).select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(html).alias("page"), html.alias("html")).dropDuplicates(["page_id", "page"])

    from tessera.sources import files

    paths = [f"{folder}/{n}" for n in files.names(spark, folder) if n.startswith("block=")]

    def call(batches):
        if root not in sys.path:
            sys.path.append(root)
        from tessera.operators import snippets

        yield from snippets.find(batches, paths)

    return rows.mapInArrow(call, HITS) if paths else spark.createDataFrame([], HITS)
