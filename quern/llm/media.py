"""Media columns: texts kept as audio members of ZIP archives, read back by a custom Spark data source.

The data source `zip_media` writes rows of (name, content) into one or more archives per task and lists
those of the tasks that succeeded in a manifest when the job commits, so that what a lost or repeated
task left behind is never read. To read, it plans byte ranges over the archives without opening them; a
task opens its archive's directory, takes the members whose headers begin in its range, and streams them
in Arrow batches of a bounded size. A member that can't be read is tried again by its offset, on its own,
and after `retries` attempts fails the task (mode "fail") or gives a row with its error (mode "report").

Defined results: null and empty texts are one block of 192 spaces; repeated rows and null ids each give
a member; an empty table gives an archive folder without archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.llm.common import map_batches, new_path, small_batches, utf8
from quern.llm.files import opened

UNIT = 192
RATE = 8000
#: Bytes of an archive before the next is begun, of a range that one task reads, and of a batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 8 << 20
#: At most about so many ranges; they grow longer beyond it.
MOST_RANGES = 100_000
MANIFEST = "manifest.json"
ATTEMPTS = 3


@dataclass
class Archives(WriterCommitMessage):
    found: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    archive: str
    low: int
    high: int


class ZipMediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        found, archive, stream, name = [], None, None, ""

        def close() -> None:
            archive.close()
            found.append((name, stream.tell()))
            stream.close()

        for batch in iterator:
            for key, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if archive is not None and stream.tell() >= ARCHIVE_BYTES:
                    close()
                    archive = None
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = system.open_output_stream(f"{base}/{name}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(key)
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, content, compresslevel=1)
        if archive is not None:
            close()
        return Archives(found)

    def commit(self, messages: list) -> None:
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps([a for m in messages if m for a in m.found]).encode())

    def abort(self, messages: list) -> None:
        system, base = opened(self.path)
        for m in messages:
            for name, _ in m.found if m else ():
                system.delete_file(f"{base}/{name}")


class ZipMediaReader(DataSourceReader):
    def __init__(self, path: str, span: int, retries: int, report: bool) -> None:
        self.path, self.span, self.retries, self.report = path, span, retries, report

    def partitions(self) -> list[Range]:
        system, base = opened(self.path)
        with system.open_input_stream(f"{base}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        span = max(self.span, sum(size for _, size in archives) // MOST_RANGES)
        return [Range(name, low, low + span) for name, size in archives for low in range(0, size, span)] or [Range("", 0, 0)]

    def directory(self, system: fs.FileSystem, place: str) -> list[zipfile.ZipInfo]:
        """The members that an archive's directory names; a read that fails is tried again on its own."""
        for attempt in range(self.retries):
            try:
                with system.open_input_file(place) as f, zipfile.ZipFile(f) as archive:
                    return archive.infolist()
            except (OSError, zipfile.BadZipFile) as e:
                error = e
                time.sleep(0.1 * attempt)
        raise OSError(f"{place}: {error}")

    def member(self, system: fs.FileSystem, place: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """A member's content by the offset of its header, or the last error."""
        error = None
        for attempt in range(self.retries):
            try:
                with system.open_input_file(place) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\3\4":
                        raise ValueError(f"no member at {info.header_offset}")
                    name, extra = struct.unpack("<HH", head[26:30])
                    f.seek(info.header_offset + 30 + name + extra)
                    raw = f.read(info.compress_size)
                content = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
                if len(content) != info.file_size or zlib.crc32(content) != info.CRC:
                    raise ValueError(f"damaged member at {info.header_offset}")
                return content, None
            except (OSError, ValueError, zlib.error) as e:
                error = str(e)
                time.sleep(0.1 * attempt)
        if not self.report:
            raise OSError(f"{place}: {error}")
        return None, error

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["name", "offset", "size", "content", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        if not partition.archive:
            return
        system, base = opened(self.path)
        place = f"{base}/{partition.archive}"
        members = [i for i in self.directory(system, place) if partition.low <= i.header_offset < partition.high]
        rows, size = [], 0
        for info in members:
            content, error = self.member(system, place, info)
            rows.append((info.filename, info.header_offset, info.file_size, content, error))
            size += info.file_size
            if size >= BATCH_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class ZipMedia(DataSource):
    """Options: path, rangeBytes, retries, mode (fail or report)."""

    @classmethod
    def name(cls) -> str:
        return "zip_media"

    def schema(self) -> str:
        return "name string, offset long, size long, content binary, error string"

    def reader(self, schema: StructType) -> ZipMediaReader:
        o = self.options
        return ZipMediaReader(o["path"], int(o.get("rangebytes", RANGE_BYTES)), int(o.get("retries", ATTEMPTS)), o.get("mode", "fail") == "report")

    def writer(self, schema: StructType, overwrite: bool) -> ZipMediaWriter:
        return ZipMediaWriter(self.options["path"])


def padded(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of the unit."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def wave(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; the samples' number is even."""
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8) + struct.pack("<4sI", b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(samples), b"WAVE") + head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, whatever other chunks it has."""
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def described(samples: bytes) -> str:
    """Level, loudness, zero crossings and peak of the samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    up = x >= 0
    crossings = np.count_nonzero(up[1:] != up[:-1]) / max(len(x) - 1, 1)
    return f"mean={x.mean(dtype=np.float64):.4f};rms={np.sqrt(np.square(x).mean(dtype=np.float64)):.4f};zcr={crossings:.6f};peak={np.abs(x).max():.0f}"


def store(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> None:
    """Write every row's text as a WAV member named by its id and its length in bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("t"))
        names = [f"{'null' if i is None else i}/{len(t)}.wav" for i, t in zip(batch.column("i").to_pylist(), texts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([wave(padded(t)) for t in texts], pa.binary())], ["name", "content"])

    docs.sparkSession.dataSource.register(ZipMedia)
    rows = map_batches(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")), run, "name string, content binary")
    rows.write.format("zip_media").mode("append").save(path)


def stored(spark: SparkSession, path: str, mode: str = "fail") -> DataFrame:
    """(name, offset, size, content, error) of every member of the archives at path."""
    spark.dataSource.register(ZipMedia)
    small_batches(spark)
    return spark.read.format("zip_media").option("mode", mode).load(path)


def media_features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per row of docs, from what was stored: digests of payload and medium, and features."""
    path = path or new_path(docs.sparkSession, "media")
    store(docs, path)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for name, media in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
            key, _, size = name.removesuffix(".wav").partition("/")
            payload = samples_of(media)
            sums = hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest()
            rows.append((None if key == "null" else int(key), int(size), len(payload), sums[0], zlib.crc32(payload[-16:]), len(media), sums[1], described(payload)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(stored(docs.sparkSession, path).select("name", "content"), run, schema)
