"""Pages and records as data sources of Spark: ``site_pages`` (batch and stream) and ``site_records`` (a sink).

``register(spark)`` makes the names known.  Files are reached by URI through pyarrow's file systems.

* ``spark.read.format("site_pages").load(folder)``: page dumps, one JSON object a line (page_id, url, html).
  A partition is a range of bytes of a file (option ``splitBytes``); a line belongs to the range in which it begins,
  so a large file is read by many tasks.  Lines that are no object give a row of nulls with the line in ``broken``.
* ``spark.readStream.format("site_pages")``: the same, by files in the order of their names; the offset
  is the last name that was read, so new files need later names.
* ``df.write.format("site_records").option("as", "json").save(folder)``: rows (site, <as>) as a file a
  record.  Tasks write under a staging folder; the driver moves what succeeded, a folder a task, and then
  deletes the staging folder, so neither failed tasks nor failed jobs leave anything.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PAGES = "page_id long, url string, html string, broken string"
SPLIT_BYTES = 32 << 20
ENDINGS = {"json": ".json", "csv": ".csv", "markdown": ".md"}


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def listed(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the dumps in a folder, by name."""
    from pyarrow import fs

    files, path = opened(uri)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith((".jsonl", ".json")) and not f.base_name.startswith(("_", ".")))


def lines(files, path: str, start: int, stop: int, block: int = 1 << 20):
    """The lines of a file that begin in [start, stop)."""
    with files.open_input_file(path) as f:
        at, rest = start, b""
        skipping = start > 0
        if skipping:
            at = start - 1  # a line begins at start only if a break is right before it
        begin = at
        while True:
            data = f.read_at(block, at)
            if not data:
                break
            at += len(data)
            rest += data
            while (cut := rest.find(b"\n")) >= 0:
                line, rest = rest[:cut], rest[cut + 1 :]
                if skipping:
                    skipping = False
                elif begin < stop:
                    yield line
                begin += cut + 1
                if begin >= stop:
                    return
        if rest and not skipping and begin < stop:
            yield rest


def page_of(line: bytes):
    """A row of PAGES; None for an empty line."""
    if not line.strip():
        return None
    try:
        page = json.loads(line)
        return (page["page_id"] if page.get("page_id") is None else int(page["page_id"]), page.get("url"), page.get("html"), None) if isinstance(page, dict) and "page_id" in page else (None, None, None, line.decode("utf-8", "replace"))
    except ValueError:
        return (None, None, None, line.decode("utf-8", "replace"))


def file_of(site: str | None) -> str:
    """A file name for a site: letters, digits, dots and dashes stay, the rest is percent-encoded."""
    return "".join(c if c.isascii() and (c.isalnum() or c in ".-") and not (k == 0 and c == ".") else "".join(f"%{b:02X}" for b in c.encode()) for k, c in enumerate(site or "")) or "%"


def _sources():
    """The classes, made in a function so that they travel with a query."""
    root = ROOT

    def formats():
        if root not in sys.path:
            sys.path.append(root)
        from tessera.sources import formats

        return formats

    class Range(InputPartition):
        def __init__(self, path, start, stop):
            super().__init__(path)
            self.path, self.start, self.stop = path, start, stop

    def ranges(found, split):
        return [Range(path, at, min(at + split, size)) for path, size in found for at in range(0, size, split)]

    def read(uri, part):
        if part is None:  # Spark's stand-in where there are no partitions
            return
        own = formats()
        files, _ = own.opened(uri)
        for line in own.lines(files, part.path, part.start, part.stop):
            if (row := own.page_of(line)) is not None:
                yield row

    class Pages(DataSourceReader):
        def __init__(self, options):
            self.uri, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

        def partitions(self):
            return ranges(formats().listed(self.uri), self.split)

        def read(self, partition):
            return read(self.uri, partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options):
            self.uri, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

        def initialOffset(self):
            return {"last": ""}

        def latestOffset(self):
            found = formats().listed(self.uri)
            return {"last": found[-1][0] if found else ""}

        def partitions(self, start, end):
            return ranges([(p, n) for p, n in formats().listed(self.uri) if start["last"] < p <= end["last"]], self.split)

        def read(self, partition):
            return read(self.uri, partition)

        def commit(self, end):
            pass

    class SitePages(DataSource):
        @classmethod
        def name(cls):
            return "site_pages"

        def schema(self):
            return PAGES

        def reader(self, schema):
            return Pages(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    class Wrote(WriterCommitMessage):
        def __init__(self, folder, n):
            self.folder, self.n = folder, n

    class Records(DataSourceWriter):
        def __init__(self, options, overwrite):
            import uuid

            self.uri, self.column, self.overwrite = options["path"].rstrip("/"), options.get("as", "json"), overwrite
            if self.column not in ENDINGS:
                raise ValueError(f"as must be one of {', '.join(ENDINGS)}")
            self.job = f"_staged-{uuid.uuid4().hex}"

        def write(self, rows):
            import uuid

            from pyspark import TaskContext

            own = formats()
            files, base = own.opened(self.uri)
            folder = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
            at, n = f"{base}/{self.job}/{folder}", 0
            for row in rows:
                if not n:
                    files.create_dir(at, recursive=True)
                with files.open_output_stream(f"{at}/{own.file_of(row['site'])}{ENDINGS[self.column]}") as out:
                    out.write((row[self.column] or "").encode())
                n += 1
            return Wrote(folder if n else None, n)

        def _clear(self, files, base):
            if files.get_file_info(f"{base}/{self.job}").type.name != "NotFound":
                files.delete_dir(f"{base}/{self.job}")

        def commit(self, messages):
            files, base = formats().opened(self.uri)
            files.create_dir(base, recursive=True)
            if self.overwrite:
                from pyarrow import fs

                for f in files.get_file_info(fs.FileSelector(base)):
                    if f.base_name.startswith("part-"):
                        files.delete_dir(f.path)
            for m in messages:
                if m is not None and m.folder:
                    files.move(f"{base}/{self.job}/{m.folder}", f"{base}/{m.folder}")
            self._clear(files, base)
            with files.open_output_stream(f"{base}/_SUCCESS") as out:
                out.write(b"")

        def abort(self, messages):
            files, base = formats().opened(self.uri)
            self._clear(files, base)

    class SiteRecords(DataSource):
        @classmethod
        def name(cls):
            return "site_records"

        def writer(self, schema, overwrite):
            return Records(self.options, overwrite)

    return SitePages, SiteRecords


def register(spark: SparkSession) -> None:
    """Makes site_pages and site_records known to a session."""
    for source in _sources():
        spark.dataSource.register(source)
