"""Packages of logs as tables: archives, folders and single files, one row a line.

``slotwise_package`` is a Spark data source.  The driver lists top-level members (from zip directories and
folders, without unpacking); neighbouring ones, each with everything nested in it, are one input partition up to
a bounded size, so members are read in parallel and nothing is written to local disks.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Limits against archive bombs, and how deep archives may nest.
MOST_BYTES, MOST_RATIO, MOST_DEPTH = 500 * 1024 * 1024, 100, 10
SUFFIXES = (".tar.gz", ".tgz", ".tar", ".zip")
SCHEMA = "path string, line_no long, line string, error string"
#: Lines and characters of a batch at most, but for a single longer line.
BATCH_LINES, BATCH_CHARS = 8192, 4 << 20
#: Files and bytes of an input partition at most, but for a single larger file.
PART_FILES, PART_BYTES = 2048, 8 << 20


def is_safe_member(name: str) -> bool:
    """No empty or absolute name, drive, network share, or step upwards."""
    flat = name.replace("\\", "/")
    return bool(flat) and not flat.startswith("/") and not re.match(r"^[A-Za-z]:", flat) and ".." not in flat.split("/")


def is_archive(name: str) -> bool:
    return name.lower().endswith(SUFFIXES)


@dataclass(frozen=True)
class Member:
    """Bytes of one file, as a stream, under its path in the package."""

    path: str
    data: io.BufferedIOBase
    error: str = ""


def members(name: str, data, depth: int = 0) -> Iterator[Member]:
    """Plain files of an archive, nested archives opened in place under ``<name>_extracted``.

    Folders, links and special files are left out.  For each member with an unsafe name or over the limits,
    and for an archive that lies too deep or can't be read, comes one member with an error under the
    archive's name; the others go on.
    """
    if depth > MOST_DEPTH:
        yield _refused(name, "nested too deep")
        return
    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(data) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield from _zip_member(name, z, info, depth)
    else:
        with tarfile.open(fileobj=data, mode="r:*") as t:
            for info in t:
                if not info.isfile():
                    continue
                if not is_safe_member(info.name) or info.size > MOST_BYTES:
                    yield _refused(name, f"{info.name!r} of {info.size} bytes")
                else:
                    yield from _nested(info.name, lambda i=info: t.extractfile(i), depth)


def _refused(archive: str, why: str) -> Member:
    return Member(os.path.basename(archive), io.BytesIO(), f"LP_ARCHIVE_MEMBER_REFUSED: {why}")


def _zip_member(name: str, z: zipfile.ZipFile, info: zipfile.ZipInfo, depth: int) -> Iterator[Member]:
    bomb = info.file_size > MOST_BYTES or (info.compress_size and info.file_size / info.compress_size > MOST_RATIO)
    if bomb or not is_safe_member(info.filename):
        yield _refused(name, f"{info.filename!r} of {info.file_size} bytes")
    else:
        yield from _nested(info.filename, lambda: z.open(info), depth)


def _nested(path: str, open_it, depth: int) -> Iterator[Member]:
    if not is_archive(path):
        with open_it() as stream:
            yield Member(path, stream)
        return
    try:
        with open_it() as stream:
            for m in members(path, io.BytesIO(stream.read()), depth + 1):
                yield Member(f"{path}_extracted/{m.path}", m.data, m.error)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error) as e:
        yield Member(path, io.BytesIO(), f"LP_ARCHIVE_READ_FAILED: {e}")


def lines_of(path: str, data) -> Iterator[tuple[int, str, str]]:
    """(line_no, line, error) of a file; ``.gz`` is read through.

    Plain files lose bytes that are no UTF-8, compressed ones get U+FFFD for them.  A file that breaks off
    keeps the lines before and ends in a row with an error.
    """
    packed = path.endswith(".gz")
    stream = gzip.GzipFile(fileobj=data) if packed else data
    text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace" if packed else "ignore", newline=None)
    n = 0
    try:
        for n, line in enumerate(text):
            yield n, line.rstrip("\n"), ""
    except (OSError, EOFError, zlib.error) as e:
        yield n + 1, "", f"LP_READ_FAILED: {e}"
    finally:
        text.detach()


def line_batches(found: Iterator[Member]) -> Iterator[pa.RecordBatch]:
    """The lines and errors of files, in Arrow batches of bounded size."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string()]
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "line_no", "line", "error"])

    for m in found:
        path = m.path.replace(os.sep, "/")
        if m.error:
            rows.append((path, 0, "", m.error))
        for n, line, error in lines_of(path, m.data):
            rows.append((path, n, line, error or None))
            held += len(path) + len(line)
            if len(rows) >= BATCH_LINES or held >= BATCH_CHARS:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def names_packed(names: list[str]) -> bytes:
    """Names in a few bytes each, as partitions and commits of a million files go through the driver."""
    return zlib.compress("\0".join(names).encode("utf-8", "surrogateescape"))


def names_unpacked(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode("utf-8", "surrogateescape").split("\0")


def grouped(found: Iterable[tuple[str, int]]) -> Iterator[bytes]:
    """Neighbouring names, with their sizes, in packed groups of bounded size."""
    names: list[str] = []
    held = 0
    for name, size in found:
        if names and (len(names) >= PART_FILES or held + size > PART_BYTES):
            yield names_packed(names)
            names, held = [], 0
        names.append(name)
        held += size
    if names:
        yield names_packed(names)


@dataclass(frozen=True)
class _Part(InputPartition):
    """Packed names: files below a folder, or members of an archive; without names, a file or a whole tar."""

    file: str
    names: bytes = b""


class PackageReader(DataSourceReader):
    """Partitions of neighbouring files of a folder, or top-level members of an archive."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        if os.path.isdir(self.path):
            return [_Part(self.path, g) for g in grouped(walked(self.path))]
        if self.path.lower().endswith(".zip"):
            with zipfile.ZipFile(self.path) as z:
                return [_Part(self.path, g) for g in grouped((i.filename, i.file_size) for i in z.infolist() if not i.is_dir())]
        return [_Part(self.path)]  # a tar has no directory: it is read from front to back

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        yield from line_batches(self._found(part))

    def _found(self, part: _Part) -> Iterator[Member]:
        if os.path.isdir(part.file):
            for name in names_unpacked(part.names):
                with open(os.path.join(part.file, name), "rb") as f:
                    yield from (Member(f"{name}_extracted/{m.path}", m.data, m.error) for m in members(name, f)) if is_archive(name) else (Member(name, f),)
            return
        with open(part.file, "rb") as f:
            if part.names:
                with zipfile.ZipFile(f) as z:
                    yield from chain.from_iterable(_zip_member(part.file, z, z.getinfo(name), 0) for name in names_unpacked(part.names))
            elif is_archive(part.file):
                yield from members(part.file, f)
            else:
                yield Member(os.path.basename(part.file), f)


def walked(root: str, links: bool = False, hidden: bool = True) -> Iterator[tuple[str, int]]:
    """(path below the folder, size) of its regular files, by path parts, a folder's names in memory at a time.

    Unless ``links`` are followed they are refused, special files are left out.  Without ``hidden``, so are names that Spark's readers pass over.
    """

    def folder(at: str, prefix: str) -> Iterator[tuple[str, int]]:
        with os.scandir(at) as found:
            entries = sorted(found, key=lambda e: e.name)
        for e in entries:
            if not links and e.is_symlink():
                raise ValueError(f"links are not allowed in a package: {e.path}")
            if not hidden and (e.name.startswith(".") or (e.name.startswith("_") and "=" not in e.name) or e.name.endswith("._COPYING_")):
                continue
            if e.is_dir():
                yield from folder(e.path, f"{prefix}{e.name}/")
            elif e.is_file():
                yield prefix + e.name, e.stat().st_size

    return folder(root, "")


def folder_files(root: str) -> list[str]:
    """Regular files under a folder, by path parts; links are refused, special files left out."""
    return [os.path.join(root, *name.split("/")) for name, _ in walked(root)]


class PackageSource(DataSource):
    """``spark.read.format("slotwise_package").load(path)``: path, line_no, line, error."""

    @classmethod
    def name(cls) -> str:
        return "slotwise_package"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options["path"])


def read_package(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PackageSource)
    return spark.read.format("slotwise_package").load(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The same table from files in any store that Spark reads; a file is one task's work.

    ``read_package`` opens paths itself and so needs a folder that driver and executors share; here Spark
    hands over the bytes.  Paths are file names, with members of archives under them.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[Member]:
        for batch in batches:
            for full, content in zip(*batch.columns):
                name, data = full.as_py().rsplit("/", 1)[-1], io.BytesIO(content.as_py())
                try:
                    if is_archive(name):
                        yield from (Member(f"{name}_extracted/{m.path}", m.data, m.error) for m in members(name, data))
                    else:
                        yield Member(name, data)
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error) as e:
                    yield Member(name, io.BytesIO(), f"LP_ARCHIVE_READ_FAILED: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from line_batches(found(batches))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gz files through Spark's own reader, for inputs that only Spark can open.

    Files are split, so ``line_no`` orders the lines of a file but does not count them.
    """
    from pyspark.sql import functions as F

    rows = spark.read.text(path, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.select("path", F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"), F.lit(None).cast("string").alias("error"))


def overlap(source: str, target: str) -> bool:
    """Whether one of two folders lies in the other."""
    a, b = (os.path.realpath(p) for p in (source, target))
    return os.path.commonpath([a, b]) in (a, b)
