"""WARC archives: pages written as records of one gzip stream, normalised to a member per record, read back.

A writing task streams its pages into files that are one gzip stream each, as crawlers without seekable
output leave them, and gives a row per record. Which records repeat a payload is decided on those rows
(a count and a join on digests, without the payloads). The normaliser then inflates each whole-file
stream once, writes every record as a gzip member of its own (repeated payloads as revisit records) and a
sidecar index of JSON lines with each record's offset and length. Reading goes by the sidecars. Files
have names of their own for each attempt of a task, and only those that a finished task named are read.

Defined results: null html is an empty payload; equal payloads of at least `LEAST` bytes: the largest
page_id is the response, and so is each repeated row of it; null ids are the smallest, and if all of a
group are null each is a response; an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import left_join_by_parts, new_path, slices, small_batches, utf8, written
from quern.llm.files import opened

LEAST = 1000
#: Bytes of records in a file before the next is begun.
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip member
ID = "<urn:quern:page:{}:{}:{}>"  # page_id, the file it was first written to, its number there


def record(kind: str, urn: str, url: str | None, digest: str, http: bytes, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record; its block is the HTTP head and the payload. urn, refers_to: record ids."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + http + payload + b"\r\n\r\n"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, HTTP head and payload."""
    end = raw.index(b"\r\n\r\n") + 4
    head = fields(raw[: end - 4])
    block = raw[end : end + int(head["content-length"])]
    at = block.index(b"\r\n\r\n") + 4
    return head, block[:at], block[at:]


def page_of(urn: str | None) -> int | None:
    value = urn.split(":")[3] if urn else "None"
    return None if value == "None" else int(value)


def inflated(stream) -> Iterator[bytes]:
    """The records of a gzip stream, one after another; reads and inflates it once."""
    buffer, unzip = bytearray(), zlib.decompressobj(GZIP)
    size = None
    while True:
        if size is None and (end := buffer.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(fields(bytes(buffer[:end]))["content-length"]) + 4
        if size is not None and len(buffer) >= size:
            yield bytes(buffer[:size])
            del buffer[:size]
            size = None
            continue
        data = stream.read(CHUNK)
        if not data:
            break
        while data:  # a file may also hold several members
            buffer += unzip.decompress(data)
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(GZIP)
    if buffer:
        raise ValueError("the stream ends inside a record")


def write_monolithic(pages: DataFrame, path: str) -> DataFrame:
    """Write pages as whole-file gzip streams; a row per record: file, number, page_id, digest, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(path)
        system.create_dir(base, recursive=True)
        out, name, number, size = None, "", 0, 0
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for page, url, payload in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), strict=True):
                if out is not None and size >= FILE_BYTES:
                    out.write(zipper.flush())
                    out.close()
                    out = None
                if out is None:
                    name, number, size, zipper = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, GZIP)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                digest = hashlib.sha1(payload).hexdigest()
                raw = record("response", ID.format(page, name.partition(".")[0], number), url, digest, http_head(len(payload)), payload)
                out.write(zipper.compress(raw))
                rows.append((name, number, page, digest, len(payload)))
                number, size = number + 1, size + len(raw)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "number", "page_id", "digest", "size"])
        if out is not None:
            out.write(zipper.flush())
            out.close()

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string, number long, page_id long, digest string, size long")
    return written(rows, "warc-records")


def decided(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(file, number, refers_to): the id of the record that a record repeats, null for a response."""
    best = F.max(F.struct(F.col("page_id"), F.col("file"), F.col("number"))).alias("first")
    repeated = records.where(F.col("size") >= least).groupBy("digest", "size").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1")
    both = left_join_by_parts(records, repeated, ["digest", "size"], "n", records.count())
    urn = F.format_string(ID.replace("{}", "%s"), F.col("first.page_id"), F.substring_index("first.file", ".", 1), F.col("first.number"))
    return both.select("file", "number", F.when(F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), urn).alias("refers_to"))


def normalise(decisions: DataFrame, source: str, path: str) -> DataFrame:
    """Rewrite each file of source with a member per record and a sidecar index; (archive, sidecar, records)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        system, base = opened(path)
        system.create_dir(base, recursive=True)
        origin, folder = opened(source)
        name, offset, index = uuid.uuid4().hex, 0, []
        with origin.open_input_stream(f"{folder}/{pdf['file'].iloc[0]}", compression=None) as stream, system.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out:
            for raw, refers_to in zip(inflated(stream), pdf["refers_to"].tolist(), strict=True):
                if refers_to is not None and not pd.isna(refers_to):
                    head, http, _ = parsed(raw)
                    raw = record("revisit", head["warc-record-id"], head["warc-target-uri"], head["warc-payload-digest"].removeprefix("sha1:"), http, b"", refers_to)
                zipper = zlib.compressobj(3, zlib.DEFLATED, GZIP)
                member = zipper.compress(raw) + zipper.flush()
                out.write(member)
                index.append({"offset": offset, "length": len(member)})
                offset += len(member)
        with system.open_output_stream(f"{base}/{name}.index.jsonl") as out:
            out.write("".join(json.dumps(x) + "\n" for x in index).encode())
        return pd.DataFrame({"archive": [f"{name}.warc.gz"], "sidecar": [f"{name}.index.jsonl"], "records": [len(index)]})

    # The rows are few and small but each stands for a payload, so they must not be put together in few tasks.
    files = decisions.select("file").distinct().count()
    whole = decisions.repartition(max(1, 2 * files), "file")
    return written(whole.groupBy("file").applyInPandas(run, "archive string, sidecar string, records long"), "warc-archives")


def read_back(archives: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, by the sidecars."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(path)
        for batch in batches:
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{sidecar}") as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                with system.open_input_file(f"{base}/{archive}") as f:
                    for at in range(0, len(index), 1000):
                        rows = []
                        for entry in index[at : at + 1000]:
                            f.seek(entry["offset"])
                            head, http, payload = parsed(zlib.decompress(f.read(entry["length"]), GZIP))
                            size = int(fields(http[:-4])["content-length"])
                            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                                raise ValueError(f"damaged record at {entry['offset']} of {archive}")
                            rows.append((page_of(head["warc-record-id"]), size, digest, kind, page_of(head.get("warc-refers-to"))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    spread = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive", "sidecar").repartition(spread).mapInArrow(entries, schema)


def archived(pages: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Write pages as normalised archives; their folder and a row per archive."""
    path = path or new_path(pages.sparkSession, "warc")
    records = write_monolithic(pages, f"{path}/monolithic")
    return f"{path}/members", normalise(decided(records), f"{path}/monolithic", f"{path}/members")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path, archives = archived(pages)
    return read_back(archives, path)
