"""Places of snippets against a plain search of every text."""

import pytest

from tessera.functions import columns as C
from tessera.operators import snippets

PAGES = [
    (1, "<h1>Acme   <b>Corp</b></h1><p>acme\ncorp and ACME CORP<p>aaaa</p>"), (2, "<p>Straße İstanbul ǅ</p><script>acme corp</script>"), (3, None), (4, ""), (5, "no such"), (None, "acme corp"), (6, "acme corp"), (6, "acme corp"),
    (7, "<div>" + "long word " * 30 + "</div>"), (8, "x<br>y&nbsp;z <i>x</i>y"),
]
WANTED = ["Acme Corp", "acme  corp ", "aa", "a", "straße", "İSTANBUL", "ǆ", None, "", "   ", "long word " * 20, "x", "xy z", "nowhere", "y z xy"]


def needle(s):
    return snippets.normalised(s or "")[0][:80]


def brute(pages, wanted):
    out = set()
    for page_id, html in pages:
        texts = snippets.shown(html) if html else []
        raw = "".join(t for _, t in texts)
        flat, at = snippets.normalised(raw)
        for n in {needle(w) for w in wanted} - {""}:
            k = flat.find(n)
            while k >= 0:
                out.add((page_id, n, at[k], at[k + len(n) - 1] + 1))
                k = flat.find(n, k + 1)
    return out


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_all_places(spark, block):
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    wanted = spark.createDataFrame([(w,) for w in WANTED], "snippet string")
    got = [(r["page_id"], r["snippet"], r["start"], r["stop"]) for r in snippets.spans(pages, wanted, block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(PAGES, WANTED)
    first = next(r for r in snippets.spans(pages, wanted).collect() if r["page_id"] == 1 and r["snippet"] == "acme corp")
    assert first["first_node"] < first["last_node"]  # across h1's own text and b


def test_nothing_wanted(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    assert snippets.spans(pages, spark.createDataFrame([(None,)], "snippet string")).count() == 0
    assert snippets.spans(pages.limit(0), spark.createDataFrame([("a",)], "snippet string")).count() == 0


def test_normal_forms_agree(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(w or "",) for w in WANTED], "w string").select("w", snippets.normal(F.col("w")).alias("n")).collect()
    assert all(r["n"] == needle(r["w"]) for r in rows)
    assert C.BLANK


def test_pages_are_parsed_once_for_all_blocks(monkeypatch):
    import ahocorasick
    import pyarrow as pa

    def machine(folder):
        out = ahocorasick.Automaton()
        out.add_word(folder, folder)
        out.make_automaton()
        return out

    calls, parse = [], snippets.shown
    monkeypatch.setattr(snippets, "_automaton", machine)
    monkeypatch.setattr(snippets, "shown", lambda html: calls.append(html) or parse(html))
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2], "page": [1, 2], "html": ["<p>Acme corp", "<p>corp"]})
    rows = [r for b in snippets.find(iter([batch]), ["acme", "corp"]) for r in zip(b.column("page_id").to_pylist(), b.column("snippet").to_pylist())]
    assert sorted(rows) == [(1, "acme"), (1, "corp"), (2, "corp")] and len(calls) == 2
