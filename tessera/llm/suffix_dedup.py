"""Suffix-array deduplication by depth-limited radix sort.

The suffixes of all texts are ordered only through ``length`` tokens (bytes, or words), by passes
that start from the most significant digit.  After a pass only groups of equal digits with more than
one member go on, so the groups left after the last digit are exactly the strings of ``length``
tokens that start in more than one place.  What the digits are is chosen so that little has to move,
and suffixes stay ranges throughout:

1. First digit: the ``gram`` tokens with the least hash inside the suffix's first ``length`` tokens,
   its anchor.  All neighbouring suffixes with the same anchor form a run, one row instead of many.
2. Further digits: a run is cut where the anchor's offset inside the suffix passes a multiple of a
   width (48, then 6, then 1).  All suffixes of such a piece have the tokens in common that any
   suffix with an offset in that range covers: these are the digit.  The narrower the pieces, the
   longer the digit; at width 1 it is the whole suffix.

In every pass, pieces that agree on all bytes that their suffixes cover are repeats as a whole; of
such a set one goes on, and only where its digit has another set.  Every pass is a count that
combines before the shuffle, at every size, so neither a string that fills a third of all rows nor an
anchor in very many surroundings is a hot key for any task.  Texts move twice, compressed.

Tokens covered by a repeated string go, also those of its first copy.  Null texts are empty; texts
shorter than ``length`` keep everything.  Rows that repeat, doc_id included, are copies of each other.
Anchors and digits are known by 64-bit hashes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stage, id_text, python_stage, table

LENGTH, GRAM = 400, 48
#: For lengths in words.
WORD_GRAM = 6
#: Widths of the pieces, each a multiple of the next; those that a run can't reach are left out.
WIDTHS = (48, 6, 1)
#: Tokens of a long text that are hashed at a time.
PIECE = 1 << 20


def words_of(data: bytes):
    """(codes, starts, stops) of the words of UTF-8 bytes; ASCII white space parts words."""
    import numpy as np

    from tessera.llm.rolling import hashes, sums

    raw = np.frombuffer(data, np.uint8)
    inner = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inner.astype(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    return hashes(sums(raw), starts, stops), starts, stops


def tokens_of(data: bytes, words: bool):
    import numpy as np

    return words_of(data)[0] if words else np.frombuffer(data, np.uint8)


def runs_of(tokens, length: int = LENGTH, gram: int = GRAM):
    """(start, suffixes, anchor's offset in the first suffix, first digit, hash of all tokens covered) of the runs, as arrays."""
    import hashlib

    import numpy as np

    from tessera.llm.rolling import hashes, sliding_min, sums

    starts, counts, anchors, firsts = [], [], [], []
    low = np.uint64(0xFFFFFFFF)
    for base in range(0, len(tokens) - length + 1, PIECE):
        part = tokens[base : base + PIECE + length - 1]
        total = sums(part)
        n = len(part) - gram + 1
        h = hashes(total, slice(0, n), slice(gram, gram + n))
        least = sliding_min((h & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1) & low
        begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        at = least[begins].astype(np.int64)
        starts.append(begins + base)
        counts.append(np.diff(np.append(begins, len(least))))
        anchors.append(at - begins)
        firsts.append(h[at].view(np.int64))
    start, count = np.concatenate(starts), np.concatenate(counts)
    data, size = tokens.tobytes(), tokens.itemsize
    digest = b"".join([hashlib.blake2b(data[a * size : (a + k + length - 1) * size], digest_size=8).digest() for a, k in zip(start.tolist(), count.tolist())])
    return start, count, np.concatenate(anchors), np.concatenate(firsts), np.frombuffer(digest, np.int64)


def _runs(batches, length, gram, words):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows, parts = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            tokens = tokens_of(text.encode("utf-8", "surrogatepass"), words)
            if len(tokens) >= length:
                parts.append(runs_of(tokens, length, gram))
                rows.append(np.full(len(parts[-1][0]), i))
        if rows:
            at = pa.array(np.concatenate(rows))
            start, count, anchor, first, whole = (np.concatenate([p[k] for p in parts]) for k in range(5))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(first), pa.array(whole)], names=["doc_id", "key", "start", "suffixes", "anchor", "d1", "covered"])


def _packed(batches):
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = [pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "packed": pa.array(packed, pa.binary())})


_RUN = {"id": "int64", "start": "int32", "suffixes": "int32", "anchor": "int32", "d1": "int64", "known": "bool_"}


def _units(batches, length, words):
    """The runs that go on, each with the tokens that its suffixes cover."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows, runs, covered = [], [], []
        for i, (packed, own) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("runs").to_pylist())):
            tokens = tokens_of(unpack(packed), words)
            rows += [i] * len(own)
            runs += own
            covered += [tokens[r["start"] : r["start"] + r["suffixes"] + length - 1].tobytes() for r in own]
        at = pa.array(np.array(rows, np.int64))
        columns = {k: pa.array([r[k] for r in runs], getattr(pa, kind)()) for k, kind in _RUN.items()}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), "key": batch.column("key").take(at), **columns, "tokens": pa.array(covered, pa.binary())})


def _pieces(batches, length, gram, width, words):
    """The parts of units, cut at multiples of ``width`` of the anchor's offset, with their digits."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.rolling import hashes, mixed, sums

    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch.column("tokens").to_pylist()
        size = np.array([len(t) for t in held], np.int64) // (8 if words else 1)
        total = sums(np.frombuffer(b"".join(held), np.uint64 if words else np.uint8))
        offset = np.cumsum(size) - size
        parts = batch.column("parts")
        unit = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
        parts = parts.flatten()
        start, n, known = (parts.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        base, anchor = batch.column("start").to_numpy().astype(np.int64)[unit], batch.column("anchor").to_numpy().astype(np.int64)[unit]
        high = anchor - (start - base)  # offsets of the anchor inside the part's first and last suffix
        low = high - n + 1
        cells = high // width - low // width + 1
        part = np.repeat(np.arange(len(unit)), cells)
        cell = low[part] // width + np.arange(len(part)) - np.repeat(np.cumsum(cells) - cells, cells)
        last = np.minimum(high[part], cell * width + width - 1)  # the first suffix has the largest offset
        first = np.maximum(low[part], cell * width)
        place = (offset[unit] + anchor)[part]  # of the anchor among all tokens held
        common = hashes(total, place - cell * width, place - np.minimum(cell * width + width - 1, length - gram) + length)
        digit = mixed(common + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        covered = hashes(total, place - last, place - first + length)
        at = pa.array(unit[part])
        yield pa.RecordBatch.from_pydict(
            {
                **{k: batch.column(k).take(at) for k in ("id", "doc_id", "key", "d1")},
                "start": pa.array((base + anchor)[part] - last, pa.int32()), "suffixes": pa.array(last - first + 1, pa.int32()),
                "known": pa.array(known[part].astype(bool)), "digit": pa.array(digit.view(np.int64)), "covered": pa.array(covered.view(np.int64)),
            }
        )


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted, joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(batches, as_text, words):
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        kept, removed, spans, size = [], [], [], []
        for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
            data = unpack(packed)
            gone = merged([(s["a"], s["b"]) for s in found or ()])
            if words and gone:
                _, starts, stops = words_of(data)
                gone = [[int(starts[a]), int(stops[b - 1])] for a, b in gone]
            at, parts = 0, []
            for a, b in gone:
                parts.append(data[at:a])
                at = b
            stays = b"".join([*parts, data[at:]])
            kept.append(stays.decode("utf-8", "ignore") if as_text else stays)
            removed.append(len(data) - len(stays))
            spans.append([{"a": a, "b": b} for a, b in gone])
            size.append(len(data))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), "kept": pa.array(kept, pa.string() if as_text else pa.binary())})


def _pass(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One digit: ``rows`` of groups of equal ``keys`` with more than one member, and of each what is
    settled: found (a repeat as a whole, not known before), known, and whether it goes on."""
    sets = rows.groupBy(*keys, "covered").agg(F.count("*").alias("n"), F.min("row").alias("one"))
    groups = sets.groupBy(*keys).agg(F.count("*").alias("sets"), F.sum("n").alias("all")).filter("all > 1")
    left = sets.join(groups, keys).select(*keys, "covered", "n", "one", "sets")  # groups of one end here
    on = (F.col("row") == F.col("one")) & (F.col("sets") > 1)
    judged = rows.join(left, [*keys, "covered"]).withColumns({"found": (F.col("n") > 1) & ~F.col("known"), "goes_on": on})
    return judged.withColumn("known", (F.col("n") > 1) | F.col("known")).filter("found or goes_on").drop("n", "one", "sets", "row", "covered")


def deduplicate(docs: DataFrame, length: int | None = None, as_text: bool = False, unit: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), n_bytes, n_removed, spans (removed byte ranges) and kept
    (the bytes that stay) of every row; ``as_text`` gives kept as a string without cut characters.

    ``length`` counts bytes, or words with ``unit="words"`` (then white space plays no part in the
    comparison, and a span reaches from its first word's first byte to its last word's last).
    """
    if unit not in ("bytes", "words"):
        raise ValueError("unit is bytes or words")
    words = unit == "words"
    length = length or LENGTH
    gram = min(WORD_GRAM if words else GRAM, length)
    here, stage = "tessera.llm.suffix_dedup:", Stage(docs.sparkSession)
    rows = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    ids = f"doc_id {dict(rows.dtypes)['doc_id']}, key long"
    span = (F.col("start").alias("a"), (F.col("start") + F.col("suffixes") + (length - 1)).alias("b"))

    runs = python_stage(rows, here + "_runs", f"{ids}, start int, suffixes int, anchor int, d1 long, covered long", length, gram, words)
    runs = stage.keep(runs.withColumns({"row": F.monotonically_increasing_id(), "known": F.lit(False)}), "runs")
    judged = stage.keep(_pass(runs.withColumn("id", F.col("row")), ["d1"]), "pass-1")
    stage.drop("runs")
    found, on = [judged.filter("found").select("doc_id", "key", *span)], judged.filter("goes_on")

    texts = python_stage(rows, here + "_packed", f"{ids}, packed binary")
    by_doc = on.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*_RUN)).alias("runs"))  # the runs of one text
    by_doc = by_doc.withColumnRenamed("doc_id", "own").withColumnRenamed("key", "own_key")
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key"))
    kinds = f"{ids}, id long, start int, suffixes int, anchor int, d1 long, known boolean, tokens binary"
    units = stage.keep(python_stage(texts.join(by_doc, same).select("doc_id", "key", "packed", "runs"), here + "_units", kinds, length, words), "units")

    parts = units.withColumn("parts", F.array(F.struct("start", "suffixes", "known")))
    for width in (w for w in WIDTHS if w == 1 or 4 * w <= length - gram):
        cut = python_stage(parts.select("id", "doc_id", "key", "start", "anchor", "d1", "tokens", "parts"), here + "_pieces", f"id long, {ids}, d1 long, start int, suffixes int, known boolean, digit long, covered long", length, gram, width, words)
        pieces = stage.keep(cut.withColumn("row", F.monotonically_increasing_id()), f"pieces-{width}")
        judged = stage.keep(_pass(pieces, ["d1", "digit"]), f"digit-{width}")
        stage.drop(f"pieces-{width}")
        found.append(judged.filter("found").select("doc_id", "key", *span))
        if width > 1:
            own = judged.filter("goes_on").groupBy("id").agg(F.collect_list(F.struct("start", "suffixes", "known")).alias("parts"))  # pieces of one run
            parts = units.drop("known", "suffixes").join(own, "id")

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    spans = stage.keep(every.groupBy(F.col("doc_id").alias("own"), F.col("key").alias("own_key")).agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    stage.drop(*[name for name in stage.paths if name != "spans"])
    cut = texts.join(spans, same, "left").select("doc_id", "key", "packed", "spans")
    return python_stage(cut, here + "_cut", f"{ids}, n_bytes long, n_removed long, spans array<struct<a:int,b:int>>, kept " + ("string" if as_text else "binary"), as_text, words)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
