"""The data sources: ranges of dumps, offsets of streams, files of records, and what failures leave."""

import json
import os

import pytest

from tessera.sources import formats
from tessera.streaming import finish

ROWS = [(1, "https://a.example/", "<p>ä\n</p>"), (2, None, ""), (None, "u", None), (3, "long", "x" * 5000), (4, "last", "no break after this line")]


def dump(folder, name, rows, end=""):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(json.dumps(dict(zip(("page_id", "url", "html"), r)), ensure_ascii=False) if isinstance(r, tuple) else r for r in rows) + end)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_split_gives_every_line_once(tmp_path):
    from pyarrow import fs

    text = "aé\n\nbb\n" + "c" * 40 + "\nd"
    (tmp_path / "x.jsonl").write_bytes(text.encode())
    want, size = text.encode().split(b"\n"), len(text.encode())
    files = fs.LocalFileSystem()
    for split in range(1, size + 2):
        for block in (1, 3, 1000):
            found = [x for at in range(0, size, split) for x in formats.lines(files, str(tmp_path / "x.jsonl"), at, min(at + split, size), block)]
            assert found == want, (split, block)


def test_pages(spark, tmp_path):
    formats.register(spark)
    folder = str(tmp_path / "d")
    dump(folder, "a.jsonl", ROWS + ["{broken", "[1]", '{"page_id": "x"}', ""])
    dump(folder, "b.jsonl", ROWS[:1], "\n")
    dump(folder, "_hidden.jsonl", ROWS)
    want = sorted([(*r, None) for r in ROWS + ROWS[:1]] + [(None, None, None, b) for b in ("{broken", "[1]", '{"page_id": "x"}')], key=str)
    for split in (64, 1 << 20):
        assert got(spark.read.format("site_pages").option("splitBytes", split).load(folder)) == want
    assert spark.read.format("site_pages").load(str(tmp_path / "none")).count() == 0


def test_a_stream_reads_each_file_once(spark, tmp_path):
    formats.register(spark)
    folder, out = str(tmp_path / "d"), str(tmp_path / "out")

    def run():
        rows = spark.readStream.format("site_pages").load(folder)
        finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start())
        return sorted(r["page_id"] for r in spark.read.parquet(out).filter("page_id is not null").collect())

    dump(folder, "a.jsonl", ROWS[:2])
    assert run() == [1, 2]
    dump(folder, "b.jsonl", ROWS[3:])
    assert run() == [1, 2, 3, 4]
    assert run() == [1, 2, 3, 4]


def test_records(spark, tmp_path):
    formats.register(spark)
    out = tmp_path / "out"
    rows = spark.createDataFrame([("https://a.example", "# A"), ("..", "dots"), (None, None), ("Ünï", "x")], "site string, markdown string").repartition(3)
    rows.write.format("site_records").option("as", "markdown").mode("append").save(str(out))
    found = {f.name: f.read_text() for f in out.rglob("*.md")}
    assert found == {"https%3A%2F%2Fa.example.md": "# A", "%2E..md": "dots", "%.md": "", "%C3%9Cn%C3%AF.md": "x"}
    assert not [f for f in out.iterdir() if f.name.startswith("_staged")] and (out / "_SUCCESS").exists()
    rows.limit(1).write.format("site_records").option("as", "markdown").mode("overwrite").save(str(out))
    assert len(list(out.rglob("*.md"))) == 1
    rows.limit(0).write.format("site_records").option("as", "markdown").mode("append").save(str(out))
    with pytest.raises(Exception, match="as must be"):
        rows.write.format("site_records").option("as", "xml").mode("append").save(str(out))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    formats.register(spark)
    out = tmp_path / "out"
    rows = spark.range(40).repartition(4).selectExpr("concat('s', id) as site", "if(id = 17, raise_error('dead'), 'text') as csv")
    with pytest.raises(Exception, match="dead"):
        rows.write.format("site_records").option("as", "csv").mode("append").save(str(out))
    assert not out.exists() or not list(out.rglob("*"))
