"""Media columns: texts as grey images in archives, read back through a data source of byte ranges.

Writing: each task puts its payloads as PNG members into ZIP archives of bounded size in the shared folder and returns one
manifest row an archive; a task that is run again writes archives of other names, and only those of the manifest are read.

Reading: the data source ``media_archive`` plans partitions of byte ranges over the archives of the manifest. Archives and
ranges grow with the input, so there are MOST_ARCHIVES manifest rows and MOST_PARTITIONS partitions or a few more at most. A
task reads the directories of its archives, takes the members whose headers start in its ranges, and streams them in Arrow
batches of bounded size. Each member is fetched by its own offset, and fetched again on its own, after a pause, when its bytes
can't be read or don't agree with the directory's CRC.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_path, written

UNIT = 576
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
MOST_BYTES = 1 << 50
MOST_ARCHIVES, MOST_PARTITIONS = 100_000, 20_000
RETRIES, PAUSE = 4, 0.1
PNG = b"\x89PNG\r\n\x1a\n"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MANIFEST = "archive string, bytes long, members long"


def filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def png_of(payload: bytes) -> bytes:
    """An 8-bit grey PNG, a row of UNIT samples wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def samples_of(png: bytes) -> np.ndarray:
    """The samples of an image made by png_of, checked: a matrix of rows."""
    if png[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a chunk's CRC is wrong")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean and deviation of the samples and a 64-bit difference hash of their means over an 8 x 9 grid."""
    height = np.linspace(0, samples.shape[0], 9)
    rows = [samples[int(a) : max(int(b), int(a) + 1)].mean(0) for a, b in zip(height, height[1:])]
    grid = np.array(rows).reshape(8, 9, UNIT // 9).mean(2)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"{samples.mean():.4f}:{samples.std():.4f}:{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pack the texts into archives under folder; the manifest (archive, bytes, members), written beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        made, stream, archive, name, members = [], None, None, "", 0

        def close() -> None:
            archive.close()
            made.append((name, stream.tell(), members))
            stream.close()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    name, members = f"{root}/{uuid.uuid4().hex}.zip", 0
                    stream = fs.open_output_stream(name)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{members}-{'null' if doc_id is None else doc_id}.png"), png_of(payload_of(text.as_py())))
                members += 1
                if stream.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        names, sizes, counts = zip(*made) if made else ((), (), ())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["archive", "bytes", "members"])

    return written(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, MANIFEST), "media-manifest")


class ByteRanges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def planned(archives: list[tuple[str, int]], range_bytes: int, most: int = MOST_PARTITIONS) -> list[ByteRanges]:
    """Ranges of range_bytes, or of so much more that about ``most`` partitions do; a partition may go on in the next archive."""
    step = max(range_bytes, -(-sum(n for _, n in archives) // most))
    out, own, room = [], [], step
    for archive, n in archives:
        at = 0
        while at < n:
            end = min(n, at + room)
            own.append((archive, at, end))
            room -= end - at
            at = end
            if not room or step == range_bytes and at == n:  # small ranges never cross archives
                out.append(ByteRanges(own))
                own, room = [], step
    return out + ([ByteRanges(own)] if own else [])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.range_bytes, self.retries = options["manifest"], int(options.get("range_bytes", RANGE_BYTES)), int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRanges]:
        import pyarrow.dataset as ds

        fs, root = filesystem(self.manifest)
        found = ds.dataset(root, filesystem=fs, format="parquet", schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64())])).to_table()
        return planned(sorted(zip(*(found[c].to_pylist() for c in ("archive", "bytes")))), self.range_bytes)

    def open(self, archive: str):
        fs, _ = filesystem(self.manifest)
        return fs.open_input_file(archive)

    def tries(self) -> Iterator[int]:
        """How many tries are left after each; before each but the first a pause, twice as long as the last."""
        for i in range(self.retries):
            if i:
                time.sleep(PAUSE * 2 ** (i - 1))
            yield self.retries - 1 - i

    def member(self, archive: str, info: zipfile.ZipInfo) -> bytes:
        """The bytes of one member by its offset; tried again with a new handle, whatever becomes of the others."""
        for left in self.tries():
            try:
                with self.open(archive) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    skip = sum(struct.unpack_from("<HH", head, 26))
                    f.seek(info.header_offset + 30 + skip)
                    data = f.read(info.compress_size)
                if head[:4] != b"PK\x03\x04" or len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                    raise OSError(f"{archive}: {info.filename} is damaged")
                return data
            except (OSError, struct.error):
                if not left:
                    raise

    def directory(self, archive: str) -> list[zipfile.ZipInfo]:
        for left in self.tries():
            try:
                with self.open(archive) as f, zipfile.ZipFile(f) as z:
                    return z.infolist()
            except (OSError, zipfile.BadZipFile):
                if not left:
                    raise

    def read(self, partition: ByteRanges | None) -> Iterator[pa.RecordBatch]:
        own: list[tuple[str, str, int, bytes]] = []
        size = 0
        batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*own), (pa.string(), pa.string(), pa.int64(), pa.binary()))], ["archive", "member", "offset", "media"])
        for archive, start, end in partition.ranges if partition else ():  # none: nothing was planned
            for info in self.directory(archive):
                if start <= info.header_offset < end:
                    data = self.member(archive, info)
                    own.append((archive, info.filename, info.header_offset, data))
                    size += len(data)
                    if size >= BATCH_BYTES:
                        yield batch()
                        own, size = [], 0
        if own:
            yield batch()


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("manifest", folder): archive, member, offset, media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_features(media: DataFrame) -> DataFrame:
    """Decode each member of the data source and digest what comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, png in zip(batch.column(0).to_pylist(), batch.column(1)):
                png = png.as_py()
                samples = samples_of(png)
                payload = samples.tobytes()
                doc_id = member[member.index("-") + 1 : -4]
                rows.append((None if doc_id == "null" else int(doc_id), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in OUT.split(", ")])

    return media.select("member", "media").mapInArrow(run, OUT)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The archives are written when this is called; the rows are read from them. Null and empty texts are one row of bytes
    255. Ids may be null or repeat. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "media")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's guess, for the archives' size only
    manifest = write_archives(docs, folder, id_col, text_col, max(ARCHIVE_BYTES, min(size, MOST_BYTES) // MOST_ARCHIVES))
    spark.dataSource.register(MediaArchive)
    at = manifest.inputFiles()
    if not at:
        return spark.createDataFrame([], OUT)
    reader = spark.read.format("media_archive").option("manifest", at[0].rpartition("/")[0])
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return read_features(reader.load())


def op8_query(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
