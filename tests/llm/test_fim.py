"""Fill-in-the-middle rewriting against a plain second form and exact round trips."""

import hashlib
import re

from tessera.llm import fim

TEXTS = [
    "Hello, wörld 42!", "", None, "has <M> inside", "a" * 5, "été 😀 <S", "\n\t \r\n", "one two three four five " * 3000, "<P", "S>x<", "ends with <", "x", "ß", "A1B2C3" * 50,
    "Hello, wörld 42!",
]


def plain_form(name, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or c % 100 >= 90:
        return n, "plain", None, None, text
    low, high = min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_transform_and_restore(spark):
    from pyspark.sql import functions as F

    rows = [(i + 40 * k, t, 7, "psm") for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "no id here", 7, "x"), (3, "same id", 1, "y"), (3, "same id", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    out = fim.transform(docs)
    got = sorted((tuple(r) for r in out.drop("output_sha256").collect()), key=str)
    want = sorted(((i, *plain_form("" if i is None else i, t)) for i, t, *_ in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for text, restored, digest, output in out.join(docs.select("doc_id", "text").distinct(), "doc_id").select("text", fim.restore(F.col("output"), F.col("form")), "output_sha256", "output").collect():
        assert restored == (text or "") or (text in ("same id", "has <M> inside") and restored in ("same id", "has <M> inside"))
        assert digest == hashlib.sha256(output.encode()).hexdigest()


def test_no_rows(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_marks_are_found_where_texts_end_in_parts_of_them():
    for text in ("a<", "<S", "<P<S<M", "S>M>P>", "<<>>"):
        for cut in range(len(text) + 1):
            for stop in range(cut, len(text) + 1):
                p, m, s = text[:cut], text[cut:stop], text[stop:]
                assert fim.rebuilt(f"<P>{p}<S>{s}<M>{m}", "psm") == text
                assert fim.rebuilt(f"<S>{s}<P>{p}<M>{m}", "spm") == text
