"""Operators of the llm package against brute force on small tables with odd rows."""

import collections
import hashlib
import re
import zlib

import pytest

from tessera.llm import bpe, decontaminate, fingerprints, language_id, ngram_join, sharding, suffix_dedup, token_counts, toxicity, url_filters

WORDS = [f"w{i * 7919 % 1000}" for i in range(4000)]


def prose(start, n):
    return " ".join(WORDS[start : start + n])


TEXTS = [
    prose(0, 200), prose(0, 200), prose(0, 190) + " other words at the end of this text", prose(500, 300), None, "", "  \n", "one two", "Öl é 😀 " * 120,
    prose(700, 80) + " " + prose(0, 120), prose(1200, 150) + " " + prose(700, 80), prose(2000, 2000), "x" * 900, "x" * 1000,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d1 int, key int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None, len(t or ""), 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def cut_of(spark, texts, **how):
    from pyspark.sql import functions as F

    held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.deduplicate(held, **how).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    return [tuple(r)[1:] for r in sorted(out)]


def test_suffix_dedup(docs, none):
    from pyspark.sql import functions as F

    out = suffix_dedup.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert [tuple(r)[1:] for r in sorted(out)] == brute_cut(TEXTS, 400)
    assert suffix_dedup.deduplicate(none).count() == 0


def test_suffix_dedup_of_odd_texts(spark):
    import random

    dice = random.Random(5)
    few = ["".join(dice.choice("ab") for _ in range(dice.randrange(30))) * dice.randrange(1, 9) for _ in range(60)]
    many = ["".join(dice.choice("abcd ") for _ in range(dice.randrange(120))) for _ in range(40)]
    shared = "".join(dice.choice("abcdefgh ") for _ in range(60))
    # one passage in many surroundings: a first digit with very many runs, at all distances from the edge
    around = [a[: dice.randrange(40)] + shared[: dice.randrange(45, 61)] + b[: dice.randrange(40)] for a, b in zip(many * 3, many[::-1] * 3)]
    for texts, length in ((few + many, 7), (around, 50), (few + around, 55)):
        assert cut_of(spark, texts, length=length) == brute_cut(texts, length)


def test_suffix_dedup_of_a_common_passage_and_a_long_text(spark):
    import random

    dice = random.Random(7)
    noise = lambda n: "".join(dice.choice("abcdefghijklmnop  ") for _ in range(n))
    passage, long_text = noise(420), noise(suffix_dedup.PIECE + 5000)
    border = long_text[suffix_dedup.PIECE - 250 : suffix_dedup.PIECE + 350]  # a repeat across the pieces of the long text
    texts = [noise(dice.randrange(400)) + passage[dice.randrange(40) :] + noise(dice.randrange(400)) for _ in range(2300)] + [long_text, border, "é" * 300, "è" * 200 + "é" * 250]
    data = [t.encode() for t in texts]
    seen = collections.Counter(hash(b[s : s + 400]) for b in data for s in range(len(b) - 399))
    expected = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[hash(b[s : s + 400])] > 1:
                gone[s : s + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        expected.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert cut_of(spark, texts) == expected


def test_suffix_dedup_by_words(spark):
    near = prose(100, 70)
    texts = [prose(0, 300), "lead in " + "\n".join(prose(40, 51).split()) + " lead out", near, near.upper(), prose(900, 49), "x y " + prose(900, 49), None, "", " \t ", "so " * 120]
    words = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(w[s : s + 50]) for w in words for s in range(len(w) - 49))
    out = sorted(suffix_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 50, True, "words").select("doc_id", "kept").collect())
    for r, own in zip(out, words):
        gone = {k for s in range(len(own) - 49) if seen[tuple(own[s : s + 50])] > 1 for k in range(s, s + 50)}
        assert r.kept.split() == [w for k, w in enumerate(own) if k not in gone]
    assert out[1].kept == "lead in  lead out" and out[4].kept == texts[4]


def test_suffix_dedup_of_rows_that_repeat(spark):
    held = spark.createDataFrame([(1, prose(0, 100), 5), (1, prose(0, 100), 6), (None, prose(200, 90), 7), (None, prose(400, 90), 8), (2, prose(0, 20), 9)], "doc_id long, text string, key int")
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicate(held).collect())
    size = [len(prose(*x)) for x in ((0, 100), (200, 90), (400, 90), (0, 20))]
    assert out == sorted([(0, size[1], 0), (0, size[2], 0), (1, size[0], size[0]), (1, size[0], size[0]), (2, size[3], 0)])


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def brute_links(texts):
    """Of every text: the number of other sets that link with its own."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) else frozenset() for t in texts]
    known = set(sets) - {frozenset()}
    return [sum(100 * len(s & o) >= 80 * len(s | o) for o in known if o != s) if s else 0 for s in sets]


def joined(docs):
    return [tuple(r)[1:] for r in sorted(ngram_join.link(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect())]


def test_ngram_join(docs, none):
    assert joined(docs) == [(*a, b) for a, b in zip(brute_components(TEXTS), brute_links(TEXTS))]
    assert ngram_join.link(none).count() == 0


@pytest.mark.parametrize("block, most", [(1, 1), (3, 5), (250, 2000)])
def test_ngram_join_in_blocks(spark, docs, monkeypatch, block, most):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MOST", most)
    words = prose(0, 120).split()
    near = [" ".join(words[:i] + ["x"] + words[i + 1 :]) for i in range(0, 40)] + [" ".join(words[:i] + ["y", "z"] + words[i + 9 :]) for i in range(0, 40, 3)]
    texts = TEXTS + near + [prose(3100 + k, 30) for k in range(0, 60, 1)]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert joined(held) == [(*a, b) for a, b in zip(brute_components(texts), brute_links(texts))]


def test_links_by_products_and_one_by_one(monkeypatch):
    import numpy as np

    dice = np.random.default_rng(3)
    base = dice.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((dice.choice(base, 360, False), dice.integers(0, 1 << 62, 10).astype(np.uint64)))) for _ in range(60)]
    monkeypatch.setattr(ngram_join, "COLUMNS", 37)
    every = np.triu_indices(60, 1)
    exact = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(*every)]
    assert ngram_join._common(sets, every).tolist() == exact
    assert ngram_join._common(sets, (every[0][:2], every[1][:2])).tolist() == exact[:2]
    good = np.array([100 * b >= 80 * (len(sets[i]) + len(sets[j]) - b) for i, j, b in zip(*every, exact)])
    degree, edges = ngram_join.linked(list(range(60)), sets, [ngram_join.OWN] * 60)
    assert degree.tolist() == (np.bincount(every[0][good], minlength=60) + np.bincount(every[1][good], minlength=60)).tolist()
    assert len(edges) < 60


def test_ngram_join_of_very_long_texts(spark):
    own = [f"w{i}" for i in range(ngram_join.MANY + 30000)]  # more shared shingles than one run may hold
    near = own[:50000] + [f"v{i}" for i in range(2000)] + own[52000:]
    held = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(near)), (3, " ".join(own[:40000]))], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in ngram_join.link(held).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_ngram_join_prefixes_in_parts(monkeypatch, rows):
    import pyarrow as pa

    from tessera.llm import common

    monkeypatch.setattr(common, "MANY", 4)
    sizes = {5: (100, 90), 6: (100, 79), 7: (10, 10), 8: (50, 45)}  # class: tokens, shared ones
    held = [(c, n, 1000 * c + k, k // 2) for c, (n, shared) in sizes.items() for k in range(shared)]
    held.sort(key=lambda r: (r[0], -r[3], -r[2]))
    table = pa.table(dict(zip(("c", "n", "token", "df"), map(list, zip(*held)))))
    got = {t for b in ngram_join._prefixes(table.to_batches(max_chunksize=rows)) for t in zip(b.column("c").to_pylist(), b.column("token").to_pylist())}
    # the rarest n - ceil(0.8 n) + 1 tokens, less the unshared ones in front
    assert got == {(c, 1000 * c + k) for c, (n, shared) in sizes.items() for k in range(n - -(-8 * n // 10) + 1 - (n - shared))}


def test_bpe(docs, none):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in bpe.encode(docs, decoded=True).collect()}
    for i, t in enumerate(TEXTS):
        assert bytes(out[i].ids) == b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(t or ""))
        assert bytes(out[i].decoded).decode() == (t or "")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.encode(none).count() == 0


def test_token_counts(docs, none):
    import public_tokenizers as P
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert out == {i: len(model.encode(t or "")) for i, t in enumerate(TEXTS)}
    own = token_counts.counter(P.path("piece_bpe_32k.model"))
    for text in ("a  bé\nc d ", " x", "Hello big world"):
        got = own.prefixes(text)
        assert [got.at(k) for k in range(len(text) + 1)] == [len(model.encode(text[:k])) for k in range(len(text) + 1)]
    short = {r.doc_id: r.text for r in token_counts.truncated(docs, 10).collect()}
    assert all(len(model.encode(t)) <= 10 for t in short.values())
    assert token_counts.token_counts(none).count() == 0


def test_url_filters(spark):
    urls = ["http://a.example.com/en/7x?q", "https://Example.COM/en/8#f", "http://com/en/", "x://b.net/de/8", "x://example.net/de/81", "ftp://o.org/es/", "nothing", None, "http://notcom/en/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filters.url_filter(pages).collect()}
    assert out[0] == ("a.example.com", "example.com/en/7", "allow") and out[1] == ("example.com", "com/en/", "block")
    assert out[2][1:] == ("com/en/", "block") and out[3][1:] == ("net/de/", "block") and out[4][1:] == ("example.net/de/8", "allow")
    assert out[5][1:] == ("org/es/", "block") and out[6] == out[7] == ("", None, "allow") and out[8][1] is None


def test_sharding(docs, none, spark, tmp_path):
    out, used = sharding.shard(docs, 3)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    for s in range(3):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) and r.size == len((TEXTS[r.doc_id] or "").encode()) + 1 for r in rows)
    load = {k: 10 for k in range(sharding.SLOTS)}
    first = sharding.SlotMap.balanced(4, load)
    grown = first.rebalance(5, load)
    assert grown.version == 2 and all(grown.owner[s] == 4 for s in grown.moved)
    first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).owner == grown.owner
    assert sharding.shard(none, 3)[0].count() == 0


def test_fingerprints(docs, none):
    rows = fingerprints.with_next(docs.selectExpr("doc_id", "coalesce(text, '') text")).collect()
    after = {r.doc_id: r.next_text for r in rows}
    assert after == {i: TEXTS[(i + 1) % len(TEXTS)] or "" for i in range(len(TEXTS))}
    signs = {r.doc_id: r.signature for r in fingerprints.signatures(docs, ["doc_id"], samples=64).collect()}
    assert signs[0] == signs[1] and signs[4] == signs[5] == signs[6]
    like = sum(a == b for a, b in zip(signs[0], signs[2])) / 64
    assert 0.7 < like < 1 and sum(a == b for a, b in zip(signs[0], signs[3])) == 0
    assert fingerprints.with_next(none.selectExpr("doc_id", "text")).count() == 0


def test_samples_agree_as_often_as_weights_do(spark):
    """Sets of weighted terms: the share of equal samples is the generalised Jaccard similarity."""
    from pyspark.sql import functions as F

    pairs = [([1] * 6, [1] * 6), ([1] * 9 + [0] * 3, [0] * 3 + [1] * 9), ([3, 1, 1, 7, 2, 1], [1, 1, 4, 7, 1, 0]), ([50, 1, 2], [5, 9, 2]), ([2] * 5, [3] * 5), ([1000], [1]), ([4, 4], [0, 4])]
    rows = [(p, r, side, 1000 * (100 * p + r) + t, w) for p, both in enumerate(pairs) for r in range(60) for side, ws in enumerate(both) for t, w in enumerate(ws) if w]
    terms = spark.createDataFrame(rows, "p int, r int, side int, term long, w int").withColumn("s", F.xxhash64("term"))
    least = terms.groupBy("p", "r", "side").agg(F.array(*[F.min(fingerprints._sample(k)) for k in range(64)]).alias("m")).collect()
    held = {(x.p, x.r, x.side): x.m for x in least}
    for p, (a, b) in enumerate(pairs):
        got = sum(u == v for r in range(60) for u, v in zip(held[p, r, 0], held[p, r, 1])) / (60 * 64)
        want = sum(map(min, a, b)) / sum(map(max, a, b))
        assert abs(got - want) < 0.035, (p, got, want)  # four standard errors


@pytest.mark.parametrize("kind", ["long", "string"])
def test_next_text_of_odd_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    ids = [-(2**63), 2**63 - 1, 0, None] + [k * k for k in range(2, 90)] if kind == "long" else [None, "", "é"] + [f"id{k}" for k in range(80)]
    held = spark.createDataFrame([(i, f"text of {i}") for i in ids], f"doc_id {kind}, text string")
    rows = fingerprints.with_next(held).collect()
    order = sorted(ids, key=lambda i: (i is not None, i.encode() if isinstance(i, str) else i if i is not None else 0))
    assert {r.doc_id: r.next_text for r in rows} == {i: f"text of {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert len({r.zone for r in rows}) > 3 and max(collections.Counter(r.zone for r in rows).values()) < 40


def test_fingerprints_of_the_query_are_close(spark, tmp_path):
    texts = [prose(37 * i, 40 + i) + " a b c d e f" * (i % 5) for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, str(tmp_path)).collect()}

    def exact(a, b):
        a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (a.split(), b.split()))
        return sum((a & b).values()) / sum((a | b).values())

    errors = []
    for i, t in enumerate(texts):
        after, half = (i + 1) % len(texts), len(t) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [out[i].near_edited - exact(t, edited), out[i].near_next - exact(t, texts[after])]
        mine, other = ([out[k].fingerprint[j : j + 16] for j in range(0, len(out[k].fingerprint), 16)] for k in (i, after))
        assert out[i].near_next == sum(x == y for x, y in zip(mine, other)) / len(mine)
    assert max(map(abs, errors)) < 0.2 and (sum(e * e for e in errors[::2]) / len(texts)) ** 0.5 < 0.08


def brute_overlaps(docs, items):
    split = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = {}
    for doc_id, text in docs:
        d = split(text)
        for item_id, item in items:
            t = split(item)
            m, width = len(t), min(len(t), 13)
            need = -(-width * 8 // 10)
            for offset in range(1 - m, len(d)):
                agree = [0 <= j + offset < len(d) and d[j + offset] == t[j] for j in range(m)]
                if m and max(sum(agree[i : i + width]) for i in range(m - width + 1)) >= need:
                    best = (sum(agree), min(m, len(d) - max(offset, 0)) - max(-offset, 0) if offset < 0 else min(m, len(d) - offset), offset)
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), best), best)
    return out


def test_masks_leave_no_gap():
    import itertools

    w, lost = decontaminate.WINDOW, decontaminate.WINDOW - -(-decontaminate.WINDOW * 8 // 10)
    for gone in itertools.combinations(range(w), lost):
        assert any(not any(mask[g - at] == "1" for g in gone if 0 <= g - at < len(mask)) for mask in decontaminate.MASKS for at in range(w - len(mask) + 1))


def test_edited_fingerprints_are_those_of_the_edited_texts(spark, tmp_path):
    import random

    dice = random.Random(6)
    word = lambda: dice.choice(["a", "b", "Cc", "ΟΔΟΣ", "d,", "longer", "é😀"])
    space = lambda: dice.choice([" ", "  ", "\n", "\t ", " "])
    texts = ["".join(word() + space() for _ in range(dice.randrange(14))) for _ in range(80)] + ["", "   ", "x", "one two three four", prose(0, 200), prose(0, 200), prose(0, 200) + " ", " " + prose(100, 100), prose(100, 90) * 2, "noSpace" * 40, "noSpace" * 40, prose(7, 11)]
    texts += [prose(3 * k, 6 + k % 9) + space() for k in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    edits = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    both = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)] + [(i, 1, t) for i, t in enumerate(edits)], "i int, e int, text string")
    exact = {(r.i, r.e): r.shown for r in fingerprints.signatures(both, ["i", "e"]).select("i", "e", fingerprints.shown("signature").alias("shown")).collect()}
    for r in fingerprints.op4_fingerprints(spark, str(tmp_path)).collect():
        assert r.fingerprint == exact[r.doc_id, 0] and r.edited_fingerprint == exact[r.doc_id, 1], texts[r.doc_id]


def test_decontamination_against_brute_force(spark, tmp_path):
    import random

    dice = random.Random(4)
    vocabulary = [f"t{k}" for k in range(30)]
    text = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 40])] + [(50, None), (51, text(30)), (52, "Ünï-1 ß2, über")]
    docs = [(k, text(dice.randrange(60))) for k in range(25)] + [(30, None), (31, ""), (32, "x ünï 1 ß2 über"), (33, text(3))]
    for k, (_, own) in enumerate(items):  # each item with some of its tokens substituted, cut at the ends or inside other text
        for cut in (0, 2):
            words = (own or "").split()[cut:]
            for at in dice.sample(range(len(words)), min(len(words), dice.randrange(4))):
                words[at] = "zz"
            docs.append((100 + 2 * k + cut // 2, text(dice.randrange(9)) + " " + " ".join(words).upper() + " , " + text(dice.randrange(9))))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id): (r.matched, r.aligned, r.offset) for r in decontaminate.op7_decontamination(spark, str(tmp_path)).collect()}
    assert got == brute_overlaps(docs, items)


def test_decontamination(spark, docs, none, monkeypatch):
    item = prose(3000, 40)
    swapped = item.split()
    for k in (4, 11, 19, 27, 35):
        swapped[k] = "zz"
    held = spark.createDataFrame([(1, "a b c " + item.upper() + ", d", 5), (2, " ".join(swapped), 5), (3, prose(100, 400), 5), (4, None, 5), (None, item, 5), (6, "q " + prose(3010, 20) + " r", 5), (6, "other text", 5), (1, "a b c " + item.upper() + ", d", 6)], "doc_id long, text string, key int")
    items = spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string")
    for most in (1_000_000, 0):  # sent to all, or shuffled
        monkeypatch.setattr(decontaminate, "MAX_SENT", most)
        out = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(held, items).collect()}
        assert set(out) == {(1, 9), (2, 9), (None, 9), (6, 9)}
        assert (out[1, 9].matched, out[1, 9].offset) == (40, 3) and out[2, 9].matched == 35
    assert decontaminate.overlaps(none, items).count() == decontaminate.overlaps(held, items.limit(0)).count() == 0


def test_decontamination_of_items_without_an_id_or_with_one_id(spark):
    first, second, third = prose(0, 30), prose(900, 30), prose(1800, 9)
    docs = spark.createDataFrame([(1, "x " + first + " y"), (2, second), (3, first + " , " + second), (4, third), (5, prose(2500, 50))], "doc_id long, text string")
    items = spark.createDataFrame([(None, first), (7, second), (7, third), (None, second), (7, second), (7, None), (None, None)], "item_id long, text string")
    out = sorted(((r.doc_id, r.item_id, r.matched, r.offset) for r in decontaminate.overlaps(docs, items).collect()), key=str)
    want = [(1, None, 30, 1), (2, 7, 30, 0), (2, None, 30, 0), (3, None, 30, 0), (3, 7, 30, 30), (3, None, 30, 30), (4, 7, 9, 0)]
    assert out == sorted(want, key=str)


def test_language_id(spark, docs, none):
    en, de = "the cat and the dog with that house ", "der hund und die katze mit einem haus "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, en), (2, de), (3, None), (4, "123 !"), (5, en * 3 + de * 6)], "doc_id long, text string")
    out = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [out[k].lang_pred for k in range(1, 6)] == ["en", "de", "und", "und", "de"]
    assert len(out[5].languages) == 2 and 0.5 < out[5].score < 0.9
    assert language_id.language_id(none).count() == 0


def test_toxicity_neighbours_are_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    examples = [(i % 2, toxicity.terms(" ".join(rng.choice(["awful", "horrid", "nasty"] if i % 2 else ["calm", "bright"], 6)) + f" word{i}")) for i in range(200)]
    index = toxicity.build(examples)
    vectors = [index.vector(index.columns(t)) for _, t in examples]
    cols, w = index.vector(index.columns(toxicity.terms("awful horrid things")))
    dense = np.zeros((len(vectors), len(index.idf)))
    for i, (c, x) in enumerate(vectors):
        dense[i, c] = x
    query = np.zeros(len(index.idf))
    query[cols] = w
    best = np.sort(dense @ query)[::-1][: toxicity.NEIGHBOURS]
    assert np.allclose([s for _, s in index.nearest(cols, w)], best)
    assert index.score(index.columns(toxicity.terms("awful nasty")))[0] > 0.5 > index.score(index.columns(toxicity.terms("calm bright")))[0]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and len({r.doc_id for r in out}) == len(out)
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)


# ---- the queries themselves, on tables with odd rows

LONG = "long " + " ".join(f"n{k}" for k in range(30000))
ODD = [
    (1, prose(0, 120), "en", "a"), (2, prose(0, 120), "en", "a"), (2, prose(0, 119) + " end", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", "de", "a"), (6, LONG, "en", "hot"),
    (7, LONG + " tail", "de", "hot"), (8, "É😀 ünï <s> <|endoftext|> " * 40, "de", "hot"), (1, prose(0, 120), "en", "a"), (None, "no id here at all", "en", "a"), (9, "12 34 !!", "en", "a"), (10, "awful horrid nasty words", "en", "a"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, key int, c int, n int, zone int, place int, unit int, d1 int, start int, name int, token int, toxic int, label int, slot int, shard int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Folders with odd documents and with none; both have all tables."""
    folder = tmp_path_factory.mktemp("odd")
    pages = [(1, "http://A.example.com/en/7x?q", 1), (2, None, 1), (2, "no url", 1), (3, "x://net/de/81#f", 1), (3, "x://net/de/81#f", 1), (None, "ftp://sub.Org/es/", 1)]
    labels = [(1, 0), (2, 1), (2, 0), (6, None), (None, 1), (99, 1), (10, 1)]
    for name, rows in (("some", ODD), ("none", [])):
        docs = [(*r, len(r[1] or ""), *([7] * 14)) for r in rows]
        some = bool(rows)
        spark.createDataFrame(docs, CLASH).repartition(3).write.parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame(pages if some else [], "page_id long, url string, host int").write.parquet(f"{folder}/{name}/pages.parquet")
        spark.createDataFrame(labels if some else [], "doc_id long, toxic int").write.parquet(f"{folder}/{name}/labels.parquet")
        spark.createDataFrame([(1, prose(20, 30)), (2, None), (3, "")] if some else [], "item_id long, text string").write.parquet(f"{folder}/{name}/benchmark.parquet")
    return folder


def run(spark, odd, name, which="some"):
    from tessera.llm import registry

    return registry.QUERIES[name](spark, f"{odd}/{which}").collect()


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_ngram_join", "op3_url_filters", "op4_fingerprints", "op5_sharding", "op6_bpe", "op7_decontamination", "op8_token_counts", "op9_toxicity", "op10_language_id"])
def test_queries_of_empty_tables(spark, odd, name):
    assert run(spark, odd, name, "none") == []


def matched(rows):
    """Rows of a query by (doc_id, what tells repeated ids apart)."""
    return sorted(rows, key=str)


def test_op1(spark, odd):
    brute = brute_cut([t for _, t, _, _ in ODD], 400)
    assert matched((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, odd, "op1_suffix_dedup")) == matched((d[0], *b) for d, b in zip(ODD, brute))


def test_op2(spark, odd):
    texts, ids = [t for _, t, _, _ in ODD], [d for d, _, _, _ in ODD]
    sizes, roots = zip(*brute_components(texts))
    least = {k: min((ids[i] for i, r in enumerate(roots) if r == k and ids[i] is not None), default=None) for k in set(roots)}
    expected = [(d, n, least[r] if n else d, k) for d, n, r, k in zip(ids, sizes, roots, brute_links(texts))]
    assert matched((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in run(spark, odd, "op2_ngram_join")) == matched(expected)


def test_op3(spark, odd):
    import duckdb

    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar, no int)")  # SQL takes a page of each id
    for i, u in enumerate(["http://A.example.com/en/7x?q", None, "x://net/de/81#f", "x://example.net/de/8", "ftp://sub.Org/es/"]):
        con.execute("insert into pages values (?, ?, 1)", [i, u])
    from tessera.llm import registry

    held = {r[0]: r[1:] for r in con.sql(f"select page_id, host, path, rule, verdict from ({registry.SQL['op3_url_filters']})").fetchall()}
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in run(spark, odd, "op3_url_filters")]
    assert matched(got) == matched([(1, *held[0]), (2, *held[1]), (2, *held[1]), (3, *held[2]), (3, *held[2]), (None, *held[4])])


def test_op3_by_its_contract(spark, tmp_path):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"x://{sub}{host}{path}" for sub in ("", "a.", "B.a.", "not") for host in ("com", "Example.com", "net", "example.NET", "org", "com.net") for path in ("", "/en/", "/en/7x?q", "/de/", "/de/8#f", "/de/81", "/es/", "/ES/")] + [None, "", "net/de/", "://net/de/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")

    def judged(url):
        rest = (url or "").partition("://")[2]
        host, path = re.match("[^/?#]*", rest).group(), re.match("[^/?#]*([^?#]*)", rest).group(1)
        host = host.lower()  # ASCII here
        fits = [r for r in rules for h, p in [(r.split("/")[0], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        return host, path, rule, rules.get(rule, "allow")

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.op3_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}


def test_op4(spark, odd):
    order = sorted(ODD, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    expected = []
    for k, (i, text, _, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected.append((i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = run(spark, odd, "op4_fingerprints")
    assert matched((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == matched(expected)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
        assert len(r.fingerprint) == 16 * fingerprints.SAMPLES and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[3] == by[4] == by[5] and len(by[1]) == 1 and by[1] <= by[2] and len(by[2]) == 2


def test_op5(spark, odd, tmp_path):
    got = run(spark, odd, "op5_sharding")
    assert matched((r.doc_id, r["size"], r.text_crc32) for r in got) == matched((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in ODD)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and all(0 <= r.shard < 16 for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    spark.createDataFrame([(k, "x" * (k * 7919 % 500)) for k in range(20000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    load = collections.Counter()
    for r in sharding.op5_sharding(spark, str(tmp_path)).collect():
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) < 1.01 * sum(load.values()) / 16


def test_op6(spark, odd):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for d, t, _, _ in ODD:
        ids = enc.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert matched((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, odd, "op6_bpe")) == matched(expected)


def test_op7(spark, odd):
    texts = {}
    for k, (d, t, _, _) in enumerate(ODD):
        texts.setdefault((d, t), k)
    held = brute_overlaps([(k, t if len(t or "") < 5000 else "") for (_, t), k in texts.items()], [(1, prose(20, 30))])
    name = {k: d for (d, _), k in texts.items()}
    assert matched((r.doc_id, r.item_id, r.matched, r.aligned, r.offset) for r in run(spark, odd, "op7_decontamination")) == matched((name[k], i, *v) for (k, i), v in held.items())


def test_op8(spark, odd):
    import public_tokenizers as P
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    expected = [(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t, _, _ in ODD]
    assert matched((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, odd, "op8_token_counts")) == matched(expected) and any(e[3] for e in expected)


def test_prefix_counts_are_those_of_the_library(spark):
    import random

    import public_tokenizers as P
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    dice = random.Random(8)
    parts = ["the", "ing", " ", "  ", "\n", "日本", "é", "😀", "ﬁ", "▁", "<s>", "0x", "A", "tion", "zq", "'", "\u0301"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(25))) for _ in range(60)] + ["noSpacesAtAll" * 30]
    out = {r.doc_id: r.counts for r in token_counts.prefix_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    short = {r.doc_id: r.text for r in token_counts.truncated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 9).collect()}
    for i, t in enumerate(texts):
        exact = [len(model.encode(t[:k])) for k in range(1, len(t) + 1)]
        assert out[i] == exact
        assert len(short[i]) == max([k for k, n in enumerate(exact, 1) if n <= 9], default=0)


def test_op9(spark, odd):
    got = run(spark, odd, "op9_toxicity")
    assert matched((r.doc_id, r.held_out) for r in got) == matched((d, zlib.crc32(str(d if d is not None else "").encode()) % 5 == 0) for d, _, _, _ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


@pytest.mark.parametrize("toxic, expected", [(1, 1.0), (0, 0.0)])
def test_toxicity_of_one_class_is_the_base_rate(spark, toxic, expected):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, toxic) for k in range(5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {expected}


def test_op9_against_brute_force(spark, tmp_path):
    """The whole query against votes of the nearest examples over all pairs."""
    import math
    import random

    import numpy as np

    dice = random.Random(2)
    bad, good = ["awful", "horrid", "nasty"], ["calm", "bright", "gentle", "river"]
    rows = [(k, " ".join(dice.choice(good + bad * (k % 3 == 0)) for _ in range(12)) + f" w{k}") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, str(tmp_path)).collect()}
    taught = [k for k in range(150) if zlib.crc32(str(k).encode()) % 5]
    index = toxicity.build([(int(k % 3 == 0), toxicity.terms(rows[k][1])) for k in taught])
    dense = np.zeros((len(taught), len(index.idf)))
    for i, k in enumerate(taught):
        c, w = index.vector(index.columns(toxicity.terms(rows[k][1])))
        dense[i, c] = w
    y = np.array([int(k % 3 == 0) for k in taught])
    for k, text in rows:
        c, w = index.vector(index.columns(toxicity.terms(text)))
        q = np.zeros(len(index.idf))
        q[c] = w
        s = np.sort(dense @ q)[::-1][: toxicity.NEIGHBOURS]
        assert abs(got[k].best_cosine - min(1, max(0, s[0]))) < 1e-9
        if len(c) and len(set(np.round(np.sort(dense @ q)[::-1][toxicity.NEIGHBOURS - 1 : toxicity.NEIGHBOURS + 1], 12))) == 2:  # no tie at the border
            near = np.argsort(-(dense @ q), kind="stable")[: toxicity.NEIGHBOURS]
            near = near[(dense @ q)[near] > 0]
            top = (dense @ q)[near]
            vote = (toxicity.BACKGROUND * index.base + (top * y[near]).sum()) / (toxicity.BACKGROUND + top.sum())
            assert abs(got[k].score - 1 / (1 + math.exp(-(index.slope * vote + index.shift)))) < 1e-6


def test_op10(spark, odd):
    got = run(spark, odd, "op10_language_id")
    assert matched((r.doc_id, r.held_out) for r in got) == matched((d, zlib.crc32(str(d if d is not None else "").encode()) % 4 == 2) for d, _, _, _ in ODD)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 9}


def test_op10_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    got = language_id.op10_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n


def test_mixture_is_the_likeliest():
    import numpy as np

    dice = np.random.default_rng(1)
    model = dice.dirichlet(np.full(50, 0.3), 3).T
    counts = 400 * (model @ np.array([0.7, 0.3, 0.0]))
    share, fit = language_id.mixture(model + 1e-9, counts, 400)
    assert abs(share - [0.7, 0.3, 0.0]).max() < 0.02
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 41) for b in np.linspace(0, 1 - a, 41)]
    assert fit >= max(counts @ np.log((model + 1e-9) @ np.array(g)) for g in grid) - 1e-6


def test_pipeline_against_brute_force(spark, odd, tmp_path):
    import base64

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").filter("length(text) < 3000").limit(60).collect()
    passage = prose(3000, 60)
    more = [(900, source[0].text + " one more"), (901, source[1].text), (901, source[1].text), (902, source[2].text + " " + passage), (903, passage + " " + source[3].text), (904, prose(100, 30) + " " + prose(20, 30)), (None, source[4].text), (905, None), (906, "12 !"), (2, "another text of an id that repeats")]
    rows = [tuple(r) for r in source] + [(d, t, "en", "s", len(t or "")) for d, t in more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, prose(20, 30)), (2, "never seen words of no document whatever it may be in here at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    docs = [(d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or "")]
    roots = [r for _, r in brute_components([t for _, t in docs])]
    first = {r: min((d is None, d or 0, t) for (d, t), q in zip(docs, roots) if q == r) for r in set(roots)}
    docs = sorted({(d, t) for (d, t), r in zip(docs, roots) if (d is None, d or 0) == first[r][:2]}, key=str)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    seen = collections.Counter(tuple(w[s : s + 50]) for w in words for s in range(len(w) - 49))
    cut = []
    for (d, t), w in zip(docs, words):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        gone = sorted({k for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] > 1 for k in range(s, s + 50)})
        stays, last = [], 0
        while gone:
            a = b = gone.pop(0)
            while gone and gone[0] == b + 1:
                b = gone.pop(0)
            stays.append(t[last : at[a][0]])
            last = at[b][1]
        cut.append((d, "".join(stays) + t[last:]))
    hit = {k for k, _ in brute_overlaps([(k, t) for k, (_, t) in enumerate(cut)], items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for k, (d, t) in enumerate(cut):
        if k not in hit:
            ids = enc.encode_ordinary(t)
            expected.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert matched(got) == matched(expected) and len(hit) == 1
    assert corpus_pipeline.run(spark, f"{odd}/none").collect() == []
    assert len(corpus_pipeline.run(spark, f"{odd}/some").collect()) > 3
