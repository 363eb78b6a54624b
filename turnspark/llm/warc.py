"""WARC archives as a Python data source: one gzip member per record, headers first, payload on demand."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from turnspark.llm.tables import keyed, shared_path, stored
from turnspark.shipping import ship_package

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
MANIFEST = "_files.json"
PART_BYTES = 64 << 20  # archive bytes of a read partition; a file is never split
HEAD = 4096
#: Fixed value: the profile of a revisit record with an identical payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_column(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, from five hexadecimal digits to four characters at a time."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def member(block: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` tells its own and its content's length, so readers can skip it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(block) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(block))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    """A header value on one line."""
    return " ".join((url or "").split())


@dataclass
class _Written(WriterCommitMessage):
    name: str


@dataclass
class _Files(InputPartition):
    paths: list


class _Writer(DataSourceArrowWriter):
    """Writes each task's records to a file of its own; only files named at commit count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")], b"")))
            for batch in iterator:
                for row in batch.to_pylist():
                    kind = row["record_type"]
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{row['page_id']}>")]
                    headers += [("WARC-Target-URI", _clean(row["url"]))] if row["url"] is not None else []
                    headers += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"]))]
                    if kind == "revisit":
                        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
                    out.write(member(record(headers, row["payload"] or b"" if kind == "response" else b"")))
        return _Written(name)

    def commit(self, messages: list) -> None:
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps([m.name for m in messages if m is not None]).encode())

    def abort(self, messages: list) -> None:
        files, root = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None:
                files.delete_file(f"{root}/{message.name}")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def _page(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


class _Reader(DataSourceReader):
    """Plans files into partitions; a record's headers decide whether its payload is inflated at all."""

    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.names, self.verify, self.wanted = path, schema.names, verify, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            held = isinstance(one, (EqualTo, In)) and len(one.attribute) == 1 and one.attribute[0] in ("record_type", "page_id", "url", "payload_digest")
            if held:
                values = ({one.value} if isinstance(one, EqualTo) else set(one.value)) - {None}  # nothing equals null
                name = one.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield one

    def partitions(self) -> list[InputPartition]:
        files, root = pafs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as given:
            names = json.loads(given.read())
        out, held, size = [], [], 0
        for info in files.get_file_info([f"{root}/{n}" for n in sorted(names)]):
            if held and size + info.size > PART_BYTES:
                out.append(_Files(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return out + ([_Files(held)] if held else [])

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with files.open_input_file(path) as stream:
                yield from self._records(stream, stream.size())

    def _records(self, stream, size: int) -> Iterator[tuple]:
        at = 0
        while at < size:
            stream.seek(at)
            start = stream.read(min(HEAD, size - at))
            if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
                raise ValueError(f"no record with a length field at byte {at}")
            total, _ = struct.unpack("<II", start[16:24])
            inflate = zlib.decompressobj(-15)
            text = inflate.decompress(start[24:])
            used = len(start)
            while b"\r\n\r\n" not in text and used < total:
                more = stream.read(min(HEAD, total - used))
                used += len(more)
                text += inflate.decompress(more)
            head, _, body = text.partition(b"\r\n\r\n")
            headers = _headers(head)
            found = {
                "record_type": headers.get("WARC-Type"), "page_id": _page(headers.get("WARC-Record-ID")),
                "url": headers.get("WARC-Target-URI"), "refers_to": _page(headers.get("WARC-Refers-To")),
                "payload_digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                "payload_bytes": int(headers.get("X-Payload-Length", "0")), "payload": None,
            }
            if found["record_type"] != "warcinfo" and all(found[k] in v for k, v in self.wanted.items()):
                if found["record_type"] == "response" and (self.verify or "payload" in self.names):
                    rest = stream.read(total - used) if used < total else b""
                    length = int(headers["Content-Length"])
                    payload = (body + inflate.decompress(rest))[:length]
                    if self.verify and (b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (found["payload_digest"], found["payload_bytes"]):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not fit its digest")
                    found["payload"] = payload
                yield tuple(found[n] for n in self.names)
            at += total


class WarcSource(DataSource):
    """Format ``warc``: ``path`` (a URI of a folder), ``verify`` (check payloads against their digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, self.options.get("verify", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A record for each row of ``page_id``, ``url``, ``html``: response, or revisit of the largest page_id with that payload.

    Payloads are the UTF-8 bytes of ``html`` (null: empty). Payloads shorter than ``least_bytes`` and, among repeated
    rows, every row of the largest page_id are responses. A page without id is a response, and
    its id reads back as null.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": digest_column(F.col("payload"))})
    same = stored(
        keyed(pages).select(
            F.col("row.page_id").cast("bigint").alias("page_id"),
            F.coalesce(F.col("row.html").cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload"),
        ).select("page_id", F.octet_length("payload").alias("size"), digest_column(F.col("payload")).alias("payload_digest"))
        .where(F.col("size") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"),
        "payloads",
    )
    both = rows.join(same, "payload_digest", "left")
    revisit = (F.col("largest") != F.col("page_id")) & F.col("page_id").isNotNull()
    return both.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"), "payload_bytes", "payload_digest",
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def write(found: DataFrame, path: str) -> None:
    """Write records (see ``records``) to an archive folder; an empty table gives an empty archive."""
    _registered(found.sparkSession)
    found.write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """Records of an archive. Filters on record_type, page_id, url and payload_digest are tested on
    the headers; payloads are only inflated for records that pass, and only if asked for."""
    schema = ", ".join(c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns)
    return _registered(spark).read.format("warc").schema(schema).option("path", path).option("verify", str(verify).lower()).load()


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to a new archive in the shared folder and read the records back, payloads checked."""
    path = shared_path(pages.sparkSession, "warc")
    write(records(pages, least_bytes), path)
    columns = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return read(pages.sparkSession, path, columns, verify=True)
