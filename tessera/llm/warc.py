"""WARC archives inside ZIP packages: written by tasks, read back by ranges and never extracted.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, the records
as one gzip member each, and ``indexes/index.cdxj``, one JSON line a record with its place in the
archive.  A reader takes the end of the file, the central directory (ZIP64 where sizes or counts need
it), the local header of a member and the index, and then only the ranges of the records it wants.

Records of equal payloads of at least ``LEAST`` bytes are written once, as the response of the least id;
others are revisits that name it and carry the digest and size of the full payload in their headers.  The least id of a
payload is an aggregate that combines before the shuffle.  Bodies meet these ids in a join that adaptive
execution may split where a payload is frequent.

Files are reached through pyarrow's file systems, by the URI of the shared folder.  A task writes its
packages under names of its own and returns them as rows; the table of these rows holds the packages of
successful tasks alone, so that a lost executor leaves files that nobody reads.  A package ends at
``PACKAGE_BYTES``, which bounds what a writer holds; one record at least.

A null body is an empty payload, a null or empty URL is written as ``urn:none``; line breaks in a URL
are percent-encoded.  A null id has no smaller id, so it is a response only where no row with an id has
the payload; rows that repeat the least id are responses each.  Repeated rows give records each.  Empty
tables give packages for none.  Columns other than the id, the URL and the body are left out.
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stage, python_stage, shared_dir, table

#: Payloads of fewer bytes are always written.
LEAST = 100
PACKAGE_BYTES = 32 << 20
#: Bytes that a reader takes at a time; neighbouring records share a read.
READ_BYTES = 4 << 20
WALK_BYTES = 1 << 18
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

PACKAGES = "package string, n_records long, n_bytes long"
ENTRIES = "package string, page_id long, url string, record_type string, at long, length long"
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


# ---- records


def _name(page_id, digest: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}").urn


def _address(url) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A") if url else "urn:none"


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A WARC/1.1 record as one gzip member; a revisit (``refers_to``) has HTTP headers and no payload."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_name(page_id, digest)}>"), ("WARC-Target-URI", _address(url)), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", size), ("WARC-Page-ID", "" if page_id is None else page_id), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_name(refers_to, digest)}>"), ("WARC-Refers-To-Page-ID", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record and its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _number(text: str):
    return int(text) if text else None


# ---- packages: writing


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_packages(batches, folder, limit):
    """Rows (page_id, url, body, digest, size, first) -> PACKAGES; each package holds whole records up to ``limit`` bytes."""
    import io
    import zipfile

    import pyarrow as pa

    files, root = _files(folder)
    files.create_dir(root, recursive=True)

    def close(parts, lines):
        name = f"{uuid.uuid4().hex}.zip"
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as package:
            package.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
            package.writestr(ARCHIVE, b"".join(parts))
            package.writestr(INDEX, "".join(lines))
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(held.getbuffer())
        return pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "n_records": pa.array([len(lines)], pa.int64()), "n_bytes": pa.array([held.tell()], pa.int64())})

    parts, lines, at = [], [], 0
    for batch in batches:
        for page_id, url, body, digest, size, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "digest", "size", "first"))):
            member = record(page_id, url, (body or "").encode(), digest, size, first)
            lines.append(json.dumps({"url": _address(url), "page": page_id, "type": "response" if first is None else "revisit", "offset": at, "length": len(member)}) + "\n")
            parts.append(member)
            at += len(member)
            if at >= limit:
                yield close(parts, lines)
                parts, lines, at = [], [], 0
    if lines:
        yield close(parts, lines)


def write(pages: DataFrame, stage: Stage, least: int = LEAST, limit: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes a record for every row into packages of the shared folder; returns PACKAGES."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    # payloads that occur once need no partner: what is joined holds the repeated ones alone
    firsts = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    # small payloads have no partner; their keys differ, so that empty bodies are no hot key
    keyed = rows.withColumn("key", F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("small "), F.xxhash64("page_id", "url").cast("string"))))
    known = keyed.join(firsts.withColumnRenamed("digest", "key"), "key", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    folder = f"{shared_dir(stage.spark)}/tessera-warc-{uuid.uuid4().hex}"
    stage.paths[folder] = folder  # goes with the stage
    # written once, as every run of this plan writes new packages
    return stage.keep(python_stage(known.select("page_id", "url", "body", "digest", "size", first.alias("first")), "tessera.llm.warc:write_packages", PACKAGES, folder, limit), "packages")


# ---- packages: reading


def _end_of_directory(read, size: int) -> tuple[int, int, int]:
    """(offset, bytes, members) of the central directory, through the ZIP64 records where the short ones are full."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    locator = tail[max(0, at - 20) : at]
    if locator[:4] == b"PK\6\7" and (count == 0xFFFF or 0xFFFFFFFF in (length, offset)):
        wide = read(56, struct.unpack("<Q", locator[8:16])[0])
        if wide[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 locator doesn't lead to a ZIP64 record")
        count, length, offset = struct.unpack("<QQQ", wide[32:56])
    return offset, length, count


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the local header, stored bytes, compression) of a package's members."""
    offset, length, count = _end_of_directory(read, size)
    data, at, out = read(length, offset), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, whole = struct.unpack("<H8xII", data[at + 10 : at + 28])
        n_name, n_extra, n_comment = struct.unpack("<HHH", data[at + 28 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name, extra = data[at + 46 : at + 46 + n_name].decode(), data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:  # the ZIP64 field has those of whole, packed and header that don't fit above
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out[name] = (header, packed, method)
        at += 46 + n_name + n_extra + n_comment
    return out


def member_at(read, entry: tuple[int, int, int], name: str) -> tuple[int, int]:
    """(offset, bytes) of a stored member's content."""
    header, length, method = entry
    if method:
        raise ValueError(f"{name} is compressed: its records can't be read by ranges")
    n_name, n_extra = struct.unpack("<HH", read(30, header)[26:30])
    return header + 30 + n_name + n_extra, length


def _walked(read, start: int, length: int):
    """(offset, bytes, fields) of each gzip member of an archive without an index, read in order."""
    at, got, stop, rest = start, start, start + length, b""
    while at < stop:
        inflate, head, used = zlib.decompressobj(31), b"", 0
        while not inflate.eof:
            if not rest:
                rest = read(min(WALK_BYTES, stop - got), got)
                got += len(rest)
                if not rest:
                    raise ValueError("an archive ends inside a record")
            out = inflate.decompress(rest)
            head += out if b"\r\n\r\n" not in head else b""
            used += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        yield at, used, _fields(head)
        at += used


def index_packages(batches):
    """Package names -> ENTRIES of all their records."""
    import pyarrow as pa

    schema = pa.schema([("package", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        for package in batch.column("package").to_pylist():
            files, path = _files(package)
            with files.open_input_file(path) as f:
                read = f.read_at
                members = directory(read, f.size())
                rows = []
                for name in (m for m in members if m.startswith("archive/") and m.endswith((".warc.gz", ".warc"))):
                    start, length = member_at(read, members[name], name)
                    if INDEX in members and name == ARCHIVE:
                        at, n = member_at(read, members[INDEX], INDEX)
                        for line in bytes(read(n, at)).decode().splitlines():
                            e = json.loads(line)
                            rows.append((package, e["page"], e["url"], e["type"], start + e["offset"], e["length"]))
                    else:
                        rows += [(package, _number(x.get("WARC-Page-ID", "")), x.get("WARC-Target-URI"), x["WARC-Type"], at, n) for at, n, x in _walked(read, start, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def fetch_records(batches):
    """ENTRIES -> RECORDS; a response's digest and size are those of the payload that was read, and must be those it was written with."""
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    name, handle, block, block_at = None, None, b"", 0
    for batch in batches:
        rows, held = [], 0
        for package, at, length in zip(*(batch.column(c).to_pylist() for c in ("package", "at", "length"))):
            if package != name:
                if handle:
                    handle.close()
                files, path = _files(package)
                name, handle, block, block_at = package, files.open_input_file(path), b"", 0
            if not block_at <= at <= at + length <= block_at + len(block):
                block, block_at = handle.read_at(max(READ_BYTES, length), at), at
            fields, payload = parsed(bytes(block[at - block_at : at - block_at + length]))
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
            revisit = fields["WARC-Type"] == "revisit"
            if not revisit and (digest, size) != (hashlib.sha256(payload).hexdigest(), len(payload)):
                raise ValueError(f"{package} at {at}: the payload isn't the one that was written")
            rows.append((_number(fields["WARC-Page-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], None if revisit else payload, size, digest, _number(fields.get("WARC-Refers-To-Page-ID", ""))))
            held += len(payload)
            if held > READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if handle:
        handle.close()


def entries(packages: DataFrame) -> DataFrame:
    """ENTRIES of the packages: an index that can be filtered before anything is read."""
    return python_stage(packages.select("package"), "tessera.llm.warc:index_packages", ENTRIES)


def fetch(rows: DataFrame) -> DataFrame:
    """RECORDS of the entries, by ranges; entries of a package that follow one another share reads."""
    return python_stage(rows.select("package", "at", "length"), "tessera.llm.warc:fetch_records", RECORDS)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write(table(spark, sf_dir, "pages"), Stage(spark))
    # few rows name many bytes: a package is a task's share
    spread = packages.repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("package"))
    return fetch(entries(spread)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to FROM f"""
