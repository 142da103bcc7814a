"""The divergence audit against a dense brute force, with odd rows and ties."""

import collections
import random
import re

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, least_docs, top):
    terms, docs, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.Counter()
    groups = set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(found))
        terms[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least_docs]
        v = len(kept)
        own = {s: {t: terms[lang, s][t] for t in kept} for x, s in groups if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


def rows_with(seed, n, words, sources):
    dice = random.Random(seed)
    return [(i, " ".join(dice.choice(words) + dice.choice(["", ".", "9", "_"]) for _ in range(dice.randrange(40))), dice.choice(["en", "de", None]), dice.choice(sources), "x", 1) for i in range(n)]


ODD = [(1, None, "xx", "a", "", 0), (2, "", "xx", None, "", 0), (3, "once only", "yy", "a", "", 0), (None, "ÄÖ İ ß 日本 A[b]", "en", "s1", "", 0), (4, "same same", "en", "s2", "", 0), (4, "same same", "en", "s2", "", 0), (4, "same", "en", "s2", "", 0), (5, "long " * 30_000, "en", "s1", "", 0)]


def test_against_brute_force(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" * (1 + k % 3) for k in range(120)] + ["Üb", "éÉ", "日", "The"]
    words += [words[0]] * 60
    rows = rows_with(1, 300, words, ["s1", "s2", "s3", None, "hot", "hot", "hot"]) + ODD
    docs = spark.createDataFrame(rows, SCHEMA)
    for least, top in ((3, 200), (3, 4), (1, 7), (10_000, 5)):
        got = sorted(tuple(r) for r in divergence.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == brute(rows, least, top)


def test_held_terms_are_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PART_BYTES", 16)
    rows = [("en", "a", b"One two THREE four five six seven"), ("en", "b", b"one x" * 9), ("en", "a", b"one  one"), ("en", "a", b"unbrokenunbrokenunbroken two")]
    batch = pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("lang", "source", "text"))})
    n, docs = collections.Counter(), collections.Counter()
    for out in divergence.count_terms([batch]):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n["a", "one"] == 3 and docs["a", "one"] == 2 and n["a", "two"] == 2 and n["b", "xone"] == 8 and n["a", "unbrokenunbrokenunbroken"] == 1


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, v = 7_654_321_987_654, 9_876_543_210_123, 1_234_567
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(v).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (total + v)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
