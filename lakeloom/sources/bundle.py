"""A sink for files that readers can check: archives of equal bytes for equal rows, behind a manifest.

Rows ``(path, content)`` go to a number of archives by their path's digest; an
archive holds its files in order, with fixed dates, so two runs write the same
bytes.  Tasks write under names of their own and tell the driver an archive's
number, size and digest, nothing about its files; the commit checks that every
archive is there once and as large as it was told, gives them their names and
writes the manifest last.  A failed write takes its files with it.  What is in
the archives is read, hashed and compared by Spark (``verify``).
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values: the date of every file in an archive
DATED = (1980, 1, 1, 0, 0, 0)
FILES = "path string, size long, sha256 string"
ARCHIVE = "archive string, path string, size long, sha256 string"


@dataclass
class Written(WriterCommitMessage):
    number: int
    staged: str
    size: int
    sha256: str
    files: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        store, root = _open(self.path)
        name = f"_staged/{number:05d}-{uuid.uuid4().hex}"
        store.create_dir(f"{root}/_staged", recursive=True)
        digest, size, files = hashlib.sha256(), 0, 0

        class Sink(io.RawIOBase):  # zipfile writes forwards only: what it writes is hashed as it leaves
            def writable(self) -> bool:
                return True

            def write(self, data) -> int:
                nonlocal size
                data = bytes(data)
                digest.update(data)
                out.write(data)
                size += len(data)
                return len(data)

        with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(Sink(), "w") as archive:
            last = None
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    if not path or path.startswith("/") or ".." in path.split("/") or path == last:
                        raise ValueError(f"no path for a bundle, or one that comes twice: {path!r}")
                    last = path
                    info = zipfile.ZipInfo(path, DATED)
                    info.external_attr = 0o644 << 16
                    archive.writestr(info, content or b"", zipfile.ZIP_DEFLATED, 6)
                    files += 1
        return Written(number, name, size, digest.hexdigest(), files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        if [m.number for m in parts] != list(range(len(messages))):
            raise ValueError("an archive is missing or came twice")
        for m in parts:
            if store.get_file_info(f"{root}/{m.staged}").size != m.size:
                raise ValueError(f"archive {m.number} is not as it was written")
        for m in parts:
            store.move(f"{root}/{m.staged}", f"{root}/part-{m.number:05d}.zip")
        store.delete_dir(f"{root}/_staged")
        listed = [{"archive": f"part-{m.number:05d}.zip", "files": m.files, "sha256": m.sha256, "size": m.size} for m in parts]
        with store.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps(listed, sort_keys=True, separators=(",", ":")).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/_staged").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staged")


class Bundle(DataSource):
    """``df.write.format("bundle").option("path", folder)`` for rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        if schema.names != ["path", "content"]:
            raise ValueError("a bundle takes (path, content)")
        return BundleWriter(self.options["path"])


def write(files: DataFrame, folder: str, archives: int) -> None:
    """``(path string, content binary)`` to a new folder; a path that comes twice is an error."""
    files.sparkSession.dataSource.register(Bundle)
    rows = files.select("path", "content").repartition(archives, "path")
    rows.sortWithinPartitions("path").write.format("bundle").option("path", folder).mode("append").save()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows = []
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    data = archive.read(info)
                    rows.append((path.rsplit("/", 1)[1], info.filename, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_pydict(dict(zip(("archive", "path", "size", "sha256"), zip(*rows, strict=True) if rows else ([], [], [], []), strict=True)))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """``(archive, path, size, sha256)`` of every file in the bundle."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.zip").load(folder).select("path", "content")
    return archives.mapInArrow(_listed, ARCHIVE)


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Archives that the manifest does not name, or that are not as it says: ``(archive, fault)``."""
    manifest = spark.read.schema("archive string, files long, sha256 string, size long").option("multiLine", True).json(f"{folder}/manifest.json")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.zip").load(folder)
    there = there.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.sha2("content", 256).alias("now"))
    both = manifest.join(there, "archive", "full")
    fault = F.when(F.col("sha256").isNull(), "unknown").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("archive", fault.alias("fault")).filter("fault IS NOT NULL")
