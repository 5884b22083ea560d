"""WARC archives as a Spark data source: one gzip member per record, sequential reading, digest verification."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm.common import KeyFilter, Workspace

SCHEMA = "record_key bigint, record_type string, refers_to bigint, url string, payload binary, payload_bytes bigint, payload_digest string"
CHUNK = 1 << 18


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(key: int | None, kind: str, refers_to: int | None, url: str | None, payload: bytes, payload_bytes: int, digest: str, date: str) -> bytes:
    """One record, not yet compressed. A revisit holds the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member in turn, decompressed as the chunks come; memory holds one record."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            parts.append(inflate.decompress(chunk))
            begun, chunk = True, inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a record")


def decode_record(data: bytes) -> tuple:
    """A row of SCHEMA; raises ValueError where framing or a digest is wrong."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    n = int(head["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("the record's length differs from its Content-Length")
    if "sha1:" + sha1_base32(block) != head["warc-block-digest"]:
        raise ValueError(f"block digest of {head['warc-record-id']} differs")
    cut = block.find(b"\r\n\r\n")
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", block[: cut + 2])[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    payload = block[cut + 4 :] if head["warc-type"] == "response" else None
    if payload is not None and (len(payload) != stated or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest or length")
    key = lambda x: None if x is None or x.endswith(":null>") else int(x[len("<urn:page:") : -1])
    url = head.get("warc-target-uri")
    url = url if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    return key(head["warc-record-id"]), head["warc-type"], key(head.get("warc-refers-to")), url, payload, stated, digest


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class Archive(InputPartition):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes files of its own; only those of attempts that Spark commits move into place."""

    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "2024-01-01T00:00:00Z")
        self.roll, self.level = int(options.get("roll_bytes", 64 << 20)), int(options.get("level", 6))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/_tmp", recursive=True)
        stem, names, out, size = uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for key, kind, refers, url, payload, length, digest in zip(*batch.columns, strict=True):
                if out is None or size >= self.roll:
                    if out:
                        out.close()
                    names.append(f"{stem}-{len(names):05d}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/_tmp/{names[-1]}", compression=None), 0
                record = encode_record(key.as_py(), kind.as_py(), refers.as_py(), url.as_py(), payload.as_py() or b"", length.as_py(), digest.as_py(), self.date)
                deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = deflate.compress(record) + deflate.flush()
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                fs.move(f"{root}/_tmp/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/_tmp").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_tmp")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.schema = options["path"], to_arrow_schema(schema)

    def partitions(self) -> list[Archive]:
        fs, root = _fs(self.path)
        files = fs.get_file_info(pafs.FileSelector(root)) if fs.get_file_info(root).type == pafs.FileType.Directory else []
        return [Archive(x.path) for x in sorted(files, key=lambda x: x.path) if x.path.endswith(".warc.gz")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there are none
            return
        fs, _ = _fs(self.path)
        rows, held = [], 0
        with fs.open_input_stream(partition.path, compression=None) as stream:
            for data in members(iter(lambda: stream.read(CHUNK), b"")):
                rows.append(decode_record(data))
                held += len(data)
                if held >= 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class WarcSource(DataSource):
    """`df.write.format("warc").mode("append").save(path)` and `spark.read.format("warc").load(path)`, rows as in SCHEMA.

    Options of the writer: date (of all records), roll_bytes (size at which a task begins its next file), level (of
    compression). Files are read by pyarrow's file systems, so the path may be on any store that these know.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", ws: Workspace | None = None) -> None:
    """Writes one record per row of pages under path.

    Of rows with equal payloads of at least min_bytes, those with the smallest key are responses and the others revisit
    it; shorter payloads are all responses. A null payload is empty, a null url leaves its header out. A row with a null
    key revisits where a row with a key has the same payload, and is a response else; repeated rows that hold the smallest
    key are responses, all of them. An empty table writes no archive. Only payloads that perhaps have a double are
    shuffled, by their digest; groups of doubles are split where they are large.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    ws = ws or Workspace(spark, "warc")
    base = pages.select(F.col(f"`{key_col}`").cast("bigint").alias("record_key"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("sha", F.sha1("payload"))
    groups = base.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha").agg(F.min("record_key").alias("first_key"), F.count("*").alias("n"))
    groups = ws.save(groups.filter("n > 1"), "doubles").select("sha", "first_key")
    flagged = KeyFilter(groups, ["sha"]).flag(base, "perhaps")
    alone = flagged.filter("not perhaps").withColumn("first_key", F.lit(None).cast("bigint"))
    shared = flagged.filter("perhaps").join(groups, "sha", "left")
    rows = alone.unionByName(shared)
    revisit = F.col("first_key").isNotNull() & ~F.col("first_key").eqNullSafe(F.col("record_key"))
    rows = rows.select(
        "record_key", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_key")).alias("refers_to"), "url",
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", F.col("sha").alias("payload_digest"),
    )
    rows.withColumn("payload_digest", _base32(F.col("payload_digest"))).write.format("warc").mode("append").save(path)


def _base32(hex_col):
    """Upper-case base32 of a 40-digit hexadecimal string: eight groups of 20 bits, four letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(hex_col, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(alphabet, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record under path, verified; see SCHEMA. Revisits have no payload but its full length and digest."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)
