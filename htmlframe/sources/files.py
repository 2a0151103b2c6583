"""Pages in files as a data source of Spark, to be read and written in any encoding.

register(spark) makes it known; then

    spark.read.format("htmlpages").load(folder)          # doc_id, path, html, encoding
    pages.select("doc_id", "html").write.format("htmlpages").mode("append").save(folder)

Reading: files below the folder are listed once on the driver and dealt out in partitions of `bytesPerPartition`; filters on
path and doc_id (equal to, one of, path beginning with) leave files out before any is opened. Options: glob (on names), hint (an
encoding).

Writing: each task writes one file a page to a folder of its own that readers pass over, and the commit moves these folders to
their place, one by one; where the job fails, they are removed. Names are the ids, so they come back as doc_id.

Folders are opened by pyarrow's file systems: local ones that all executors share, HDFS and object stores. Names that begin with
"_" or "." are passed over. doc_id is the number that a file's name is, or else a hash of its path.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from htmlframe.functions.encodings import decode
from htmlframe.session import ship

SCHEMA = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("html", pa.string()), ("encoding", pa.string())])
SCHEMA_SQL = "doc_id bigint, path string, html string, encoding string"
BYTES_PER_PARTITION = 64 << 20
_NUMBER = re.compile(r"(-?\d+)(?:-\d+)?\.[^.]*")


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """A folder's file system, and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def id_of(path: str) -> int:
    """The number that a file's name is, or else a hash of its path."""
    m = _NUMBER.fullmatch(path.rsplit("/", 1)[-1])
    if m:
        return int(m.group(1))
    import hashlib

    return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little", signed=True)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob, self.hint = options["path"], options.get("glob", "*"), options.get("hint")
        self.size = int(options.get("bytesperpartition", options.get("bytesPerPartition", BYTES_PER_PARTITION)))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("doc_id",)):
                self.wanted.append((f.attribute[0], {f.value}))
            elif isinstance(f, In) and f.attribute in (("path",), ("doc_id",)):
                self.wanted.append((f.attribute[0], set(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.wanted.append(("begin", f.value))
            else:
                yield f

    def _keeps(self, path: str) -> bool:
        given = {"path": path, "doc_id": id_of(path)}
        return all(path.startswith(v) if k == "begin" else given[k] in v for k, v in self.wanted)

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.folder)
        found = []
        for info in system.get_file_info(pafs.FileSelector(base, recursive=True)):
            inside = info.path[len(base) :].lstrip("/").split("/")
            if info.type == pafs.FileType.File and not any(x[:1] in "_." for x in inside) and fnmatch.fnmatch(inside[-1], self.glob) and self._keeps(info.path):
                found.append((info.path, info.size or 0))
        groups: list[list[str]] = []
        room = 0
        for path, size in sorted(found):
            if size > room or not groups:
                groups.append([])
                room = self.size
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        for path in partition.paths if partition is not None else ():
            with system.open_input_stream(path) as f:
                html, encoding = decode(f.read(), self.hint)
            yield pa.record_batch([pa.array([x], t.type) for x, t in zip((id_of(path), path, html, encoding), SCHEMA, strict=True)], schema=SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class PagesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.folder, self.ending, self.overwrite, self.job = options["path"], options.get("ending", "html"), overwrite, uuid.uuid4().hex
        self.at = [next((names.index(n) for n in some if n in names), -1) for some in (("doc_id", "page_id", "id"), ("html", "output", "text"))]
        if min(self.at) < 0:
            raise ValueError("pages need an id (doc_id, page_id or id) and a text (html, output or text)")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.folder)
        place, seen = f"{base}/_{self.job}/{uuid.uuid4().hex}", {}
        for batch in iterator:
            keys, texts = (batch.column(i).to_pylist() for i in self.at)
            for key, text in zip(keys, texts, strict=True):
                if not seen:
                    system.create_dir(place)
                again = seen[key] = seen.get(key, -1) + 1
                with system.open_output_stream(f"{place}/{'null' if key is None else key}{f'-{again}' if again else ''}.{self.ending}") as f:
                    f.write(text if isinstance(text, bytes) else (text or "").encode())
        return Written(place if seen else None)

    def commit(self, messages: list[Written]) -> None:
        system, base = opened(self.folder)
        system.create_dir(base)
        if self.overwrite:
            for info in system.get_file_info(pafs.FileSelector(base)):
                if not info.base_name.startswith("_"):
                    system.delete_dir(info.path) if info.type == pafs.FileType.Directory else system.delete_file(info.path)
        for m in messages:
            if m is not None and m.folder:
                system.move(m.folder, f"{base}/part-{m.folder.rsplit('/', 1)[-1]}")
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = opened(self.folder)
        if system.get_file_info(f"{base}/_{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{base}/_{self.job}")


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "htmlpages"

    def schema(self) -> str:
        return SCHEMA_SQL

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)

    def writer(self, schema, overwrite: bool) -> PagesWriter:
        return PagesWriter(self.options, [f.name for f in schema.fields], overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
