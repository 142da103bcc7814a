"""WARC records in ZIP packages: contract rows, ranges, ZIP64 and archives without an index."""

import hashlib
import io
import zipfile

import pytest

from tessera.llm import warc
from tessera.llm.common import Stage

LONG = "ä" * 60  # 120 bytes
ROWS = [
    (5, "https://a.example/1", LONG), (3, "https://a.example/2", LONG), (9, "https://b.example/", LONG), (1, "https://c.example/", "short"), (2, "https://c.example/x", "short"),
    (4, None, None), (6, "", ""), (7, "https://d.example/\r\nWARC-Type: x", "<p>" + "z" * 300_000), (8, "https://ü.example/", "y" * 99), (10, "https://ü.example/", "y" * 100), (11, "u", "y" * 100),
    (3, "https://a.example/2", LONG), (None, "no id", LONG), (None, "none", "n" * 200), (None, "none", "n" * 200), (12, "x", "\r\n\r\n" * 50), (13, "x", "\r\n\r\n" * 50),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "1", 2) for r in ROWS], "page_id long, url string, html string, digest string, size int")


def expected(rows):
    out = []
    for i, _, body in rows:
        data = (body or "").encode()
        ids = [x for x, _, b in rows if (b or "").encode() == data and x is not None]
        least = min(ids) if ids and len(data) >= 100 else None
        revisit = least is not None and i != least
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1, 2_000, 32 << 20])
def test_written_and_read_back(spark, pages, limit):
    packages = warc.write(pages, Stage(spark), limit=limit)
    out = warc.fetch(warc.entries(packages))
    got = out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)
    assert {bytes(r[0]).decode() for r in out.filter("record_type = 'response'").select("payload").collect()} == {b or "" for _, _, b in ROWS}
    assert out.filter("record_type = 'revisit' and payload is not null").count() == 0
    assert packages.agg({"n_records": "sum"}).first()[0] == len(ROWS)


def test_only_wanted_ranges_are_read(spark, pages):
    index = warc.entries(warc.write(pages.coalesce(1), Stage(spark)))
    one = index.filter("url = 'https://c.example/'")
    assert [r["payload_digest"] for r in warc.fetch(one).collect()] == [hashlib.sha256(b"short").hexdigest()]
    assert one.first()["length"] < 1000


def test_no_rows(spark, pages):
    packages = warc.write(pages.limit(0), Stage(spark))
    assert packages.count() == 0 and warc.fetch(warc.entries(packages)).count() == 0


def _package(path, rows, index=False, **how):
    members = [warc.record(i, u, b.encode(), hashlib.sha256(b.encode()).hexdigest(), len(b.encode()), None) for i, u, b in rows]
    with zipfile.ZipFile(path, "w", **how) as z:
        z.writestr("readme", "not an archive")
        with z.open("archive/other.warc.gz", "w", force_zip64=True) as f:
            f.write(b"".join(members))


def test_archive_without_an_index_and_zip64(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", f"body {i} " * i) for i in range(400)]
    _package(tmp_path / "small.zip", rows)
    for name in ("ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"):
        monkeypatch.setattr(zipfile, name, 1)
    _package(tmp_path / "wide.zip", rows)
    data = (tmp_path / "wide.zip").read_bytes()
    assert b"PK\6\6" in data and b"PK\6\7" in data
    for name in ("small.zip", "wide.zip"):
        found = warc.fetch(warc.entries(spark.createDataFrame([(str(tmp_path / name),)], "package string")))
        assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in found.collect()) == [(i, b) for i, _, b in rows]


def test_bad_packages(tmp_path):
    _package(tmp_path / "packed.zip", [(1, "u", "x")], compression=zipfile.ZIP_DEFLATED)
    data = (tmp_path / "packed.zip").read_bytes()
    read = lambda n, at: data[at : at + n]
    members = warc.directory(read, len(data))
    with pytest.raises(ValueError, match="compressed"):
        warc.member_at(read, members["archive/other.warc.gz"], "archive/other.warc.gz")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(lambda n, at: b"x" * 50, 50)
    cut = warc.record(1, "u", b"x" * 5000, "d", 5000, None)[:-20]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc._walked(lambda n, at: cut[at : at + n], 0, len(cut)))
    assert io.BytesIO(cut).read(2) == b"\x1f\x8b"
