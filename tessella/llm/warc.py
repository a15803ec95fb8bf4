"""WARC archives as a Spark data source, `format("warc")`.

Reading plans one partition for each archive file. A record's header is parsed first; record-type and header predicates
(`record_type`, `record_id`, `target_uri`, `payload_digest`, `refers_to`, `page_id`) are pushed down and judged on it;
a record that fails them is stepped over, and its payload is not decoded. Archives hold each record in a gzip member of
its own; the member's length is in the gzip header's extra field (`sl`), so stepping over a record needs no inflating
beyond its header. Members without that field are inflated to find their end. Payloads are decoded only if asked for.

Writing takes rows of (page_id, url, payload, record_type, refers_to, digest in hex, size): every task writes a
file of its own under a name with a random part, then the commit lists the files that count, so that a task that is run
again or lost leaves nothing that a reader sees.

Files are opened through pyarrow's file systems, by the URI of the shared folder.

Defined results: a null payload counts as empty; a null page id is written as an empty field and read back as null; of
equal payloads the smallest page id is the response (null ids last; of rows repeated in id each is a response); an empty
table writes no records and reads back as none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm._common import hot_keys, salted_join, shared_path, stored, table

SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, page_id long, "
    "refers_to string, payload binary"
)
#: Bytes of a member that are inflated at first for its header.
HEAD = 2048
#: Records of one written or read batch, and bytes of payload in it.
BATCH_ROWS, BATCH_BYTES = 2000, 8_000_000
#: Repeated digests that may be broadcast (about 60 bytes each).
BROADCAST_DIGESTS = 500_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | str | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def open_folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def packed(header: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member that says its own length."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in header.items()), f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = 10 + 2 + 8 + len(body) + len(tail)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 8) + b"sl" + struct.pack("<HI", 4, size) + body + tail


def parsed(head: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields, and where the block starts; None while the header isn't whole."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def row_of(header: dict[str, str]) -> dict:
    """The columns that a record's header alone gives."""
    row = {k: header.get(v.lower()) for k, v in FIELDS.items()}
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    length, page = header.get("x-payload-length"), header.get("x-page-id")
    return row | {"payload_bytes": int(length) if length else None, "page_id": int(page) if page else None}


def records(f, wanted, decode: bool) -> Iterator[dict]:
    """Rows of the wanted records of an open archive; `wanted` judges the header's columns."""
    while True:
        start = f.tell()
        fixed = f.read(12)
        if len(fixed) < 12:
            return
        if fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        size = None
        if fixed[3] & 4:
            extra = f.read(struct.unpack("<H", fixed[10:12])[0])
            if extra[:2] == b"sl":
                size = struct.unpack("<I", extra[4:8])[0]
        if size is None:
            f.seek(start)
            inflate = zlib.decompressobj(31)
        else:
            inflate = zlib.decompressobj(-15)
        head, found = b"", None
        while found is None:
            chunk = f.read(HEAD)
            head += inflate.decompress(chunk, 0)
            found = parsed(head)
            if not chunk and found is None:
                raise ValueError(f"cut record at byte {start}")
        header, at = found
        row = row_of(header)
        take = wanted(row)
        need = at + int(header.get("content-length", 0))
        if take and decode:
            while len(head) < need and (chunk := f.read(1 << 16)):
                head += inflate.decompress(chunk)
            block = head[at:need]
            row["payload"] = None
            if row["record_type"] == "response":  # its length and digest are taken from what was read
                row["payload"] = block.partition(b"\r\n\r\n")[2]
                row["payload_bytes"], row["payload_digest"] = len(row["payload"]), base32_digest(row["payload"])
        else:
            row["payload"] = None
        if size is not None:
            f.seek(start + size)
        else:
            while not inflate.eof and (chunk := f.read(1 << 16)):
                inflate.decompress(chunk)
            f.seek(f.tell() - len(inflate.unused_data))
        if take:
            yield row


@dataclass
class Archive(ds.InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WarcReader(ds.DataSourceReader):
    def __init__(self, folder: str, schema: StructType, decode: bool):
        self.folder, self.schema, self.decode = folder, schema, decode
        self.equal: list[tuple[str, set]] = []
        self.present: list[tuple[str, bool]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        """Takes equality, membership and null tests on header columns; gives back the others."""
        known = {*FIELDS, "page_id", "payload_bytes"}
        for x in filters:
            name = x.attribute[0] if getattr(x, "attribute", None) and len(x.attribute) == 1 else None
            if name in known and isinstance(x, ds.EqualTo):
                self.equal.append((name, {x.value}))
            elif name in known and isinstance(x, ds.In):
                self.equal.append((name, {*x.value} - {None}))
            elif name in known and isinstance(x, ds.IsNotNull | ds.IsNull):
                self.present.append((name, isinstance(x, ds.IsNotNull)))
            else:
                yield x

    def partitions(self) -> list[ds.InputPartition]:
        fs, folder = open_folder(self.folder)
        with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
            return [Archive(x) for x in json.loads(f.read())] or [Archive("")]

    def wanted(self, row: dict) -> bool:
        return all(row[k] in v for k, v in self.equal) and all((row[k] is not None) == v for k, v in self.present)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if not partition.path:
            return
        fs, folder = open_folder(self.folder)
        rows, size = [], 0
        with fs.open_input_file(f"{folder}/{partition.path}") as f:
            for row in records(f, self.wanted, self.decode):
                rows.append(row)
                size += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = open_folder(self.folder)
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        some = False
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    some = True
                    payload, page = r["payload"] or b"", "" if r["page_id"] is None else r["page_id"]
                    header = {
                        "WARC-Type": r["record_type"], "WARC-Record-ID": record_id(page), "WARC-Date": "1970-01-01T00:00:00Z",
                        "WARC-Target-URI": (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A"),
                        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(r['digest'])).decode()}", "X-Payload-Length": str(r["size"]), "X-Page-Id": str(page),
                        "Content-Type": "application/http; msgtype=response",
                    }
                    if r["record_type"] == "revisit":
                        header |= {"WARC-Refers-To": record_id(r["refers_to"]), "WARC-Profile": PROFILE}
                        out.write(packed(header, HTTP))
                    else:
                        out.write(packed(header, HTTP + payload))
        return Written([name] if some else [])

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = open_folder(self.folder)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = open_folder(self.folder)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{folder}/{x}")


class WarcSource(ds.DataSource):
    """Options: path; payload ("false" leaves payloads undecoded)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("payload", "true") != "false")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archived(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Rows to write: which records are responses, and which revisit one with an equal payload of min_bytes or more.

    Only digests that are repeated need a second look. Few enough are broadcast, so that payloads stay where they are; more
    are joined by digest, with the rows of a digest that very many pages share dealt out to many tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    first = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stored(first.filter("n > 1"), "repeated-digests")
    counts = first.agg(F.count("*").alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if counts.digests <= BROADCAST_DIGESTS:
        rows = rows.join(F.broadcast(first.select("digest", "first")), "digest", "left")
    else:
        rows = salted_join(rows, first.select("digest", "first"), ["digest"], hot_keys(first, ["digest"], "n", counts.rows), "left")
    again = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"), "digest", "size",
    )


def write_warc(pages: DataFrame, path: str, *, min_bytes: int = 0) -> None:
    register(pages.sparkSession)
    archived(pages, min_bytes=min_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to", "page:(-?[0-9]+)", 1).try_cast("long").alias("refers_to"),
    )


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
digits AS (
  SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS v,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc
  FROM q
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr(abc, ((v[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM digits
"""
