"""Zipped domain lists as a Spark data source: executors read the archive where it lies, and nothing is put on a disk.

An archive is on the web or on any file system that pyarrow opens. Its directory and its member are read by ranges, so a
connection that breaks costs the rest of one range, and a task that is lost starts over. A deflated member can be read from its start
only, so an archive is one partition; ``read_zipped`` deals the lines over the executors after that.
"""

from __future__ import annotations

import io
import os
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from http.client import HTTPException

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .download import DownloadError, member_of

RANGE = 4 << 20
BATCH_LINES = 20_000
SCHEMA = "file string, line_no long, raw string"


class WebFile(io.RawIOBase):
    """A file on the web, read by ranges with pauses between tries. A server that knows no ranges is an error."""

    def __init__(self, url: str, timeout: float = 120, tries: int = 5, pause: float = 0.5):
        self.url, self.timeout, self.tries, self.pause, self.place = url, timeout, tries, pause, 0
        self.size, self.tag = self._get(0, 1)[1:]

    def _get(self, start: int, end: int) -> tuple[bytes, int, str | None]:
        """Bytes start to end, the size of the whole, and what tells one version of it from another."""
        for turn in range(self.tries):
            try:
                request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{end - 1}"})
                with urllib.request.urlopen(request, timeout=self.timeout) as response:
                    if response.status != 206:
                        raise DownloadError("the server sends no ranges")
                    size = int(response.headers["Content-Range"].rpartition("/")[2])
                    data = response.read()
                    if len(data) != min(end, size) - start:
                        raise ConnectionError(f"{len(data)} bytes came instead of {min(end, size) - start}")
                    return data, size, response.headers.get("ETag") or response.headers.get("Last-Modified")
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429:  # asking again won't help
                    raise DownloadError(f"{e.code} {e.reason}") from e
                failed: Exception = e
            except (OSError, HTTPException) as e:
                failed = e
            time.sleep(self.pause * 2**turn)
        raise DownloadError(str(failed)) from failed

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.size}[whence]
        return self.place

    def readinto(self, buffer) -> int:
        end = min(self.place + len(buffer), self.size)
        if end <= self.place:
            return 0
        data, _, tag = self._get(self.place, end)
        if tag != self.tag:
            raise DownloadError("the archive has changed while it was read")
        buffer[: len(data)] = data
        self.place += len(data)
        return len(data)


def opened(path: str):
    """A seekable file; one on the web is read RANGE bytes at a time."""
    if path.startswith(("http://", "https://")):
        return io.BufferedReader(WebFile(path), RANGE)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return system.open_input_file(at)


def batches_of(path: str, batch_lines: int = BATCH_LINES) -> Iterator[pa.RecordBatch]:
    """The lines of the archive's list in their order; they end at \\n, and bytes that are not UTF-8 become marks."""
    with opened(path) as file, zipfile.ZipFile(file) as archive:
        name, number, own = member_of(archive.namelist()), 0, []
        with archive.open(name) as member:
            for line in member:
                own.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                if len(own) == batch_lines:
                    yield table(path, number, own)
                    number, own = number + len(own), []
        if own:
            yield table(path, number, own)


def table(path: str, first: int, lines: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path] * len(lines), pa.string()), pa.array(range(first + 1, first + 1 + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["file", "line_no", "raw"])


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition.path)


class ZippedLists(DataSource):
    """file, line_no, raw of the archives in option ``paths``, one a line."""

    @classmethod
    def name(cls) -> str:
        return "zipped_lists"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["paths"].split("\n"))


def read_zipped(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lines of zipped lists, as ``read_lines`` gives those of text files; line_no counts the lines of each."""
    spark.dataSource.register(ZippedLists)
    rows = spark.read.format("zipped_lists").option("paths", "\n".join([paths] if isinstance(paths, str) else paths)).load()
    return rows.repartition(F.col("file"), F.floor(F.col("line_no") / BATCH_LINES))
