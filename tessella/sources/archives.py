"""Zip archives as a Spark data source, `format("zipped")`: rows are members (archive, name, size, payload).

Reading plans partitions over archives: one up to PART_BYTES is one partition, which nothing but its task opens; of a larger
one the directory is read first, and its members are dealt into partitions of that size. `payload` set to "false" leaves
members packed. Names that would leave the folder that an archive is unpacked to (absolute ones, drives, backslashes, `..`, links) are
refused, and with them the archive.

Writing takes (name, payload). Every task writes an archive of its own under a name with a random part; the commit then notes
those that count under the next number, so that readers see all of a job's members or none, whatever is tried again or lost.
An append notes the archives of before too.

Defined results: folders in an archive are no members; a null payload is an empty member; a null name is refused; an empty table
writes no archive and reads back as no rows; a folder without a note is all its *.zip files; names that are repeated stay so.
"""

from __future__ import annotations

import json
import stat
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.operators.sequence import numbered

SCHEMA = "archive string, name string, size long, payload binary"
#: Packed bytes of a partition, and rows and bytes of a batch.
PART_BYTES, BATCH_ROWS, BATCH_BYTES = 64_000_000, 2000, 8_000_000
#: Members that are packed already.
PACKED = (".jpg", ".jpeg", ".png", ".heic", ".mp4", ".mov", ".zip", ".gz", ".parquet")
NOTE = "_members-"
#: Lines of a report's member.
REPORT_LINES = 10_000


def refused(name: str | None, mode: int = 0) -> bool:
    """Whether a member's name or kind could lead out of the folder that it is unpacked to."""
    if not name or "\\" in name or "\0" in name or name.startswith("/") or name[1:2] == ":":
        return True
    return any(part in ("..", ".", "") for part in name.rstrip("/").split("/")) or stat.S_ISLNK(mode)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Seekable:
    """An open file for zipfile, which takes a place that is none for an error of the system."""

    def __init__(self, f: pa.NativeFile):
        self.f, self.read, self.tell, self.seekable = f, f.read, f.tell, f.seekable

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.f.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def noted(fs: pafs.FileSystem, folder: str) -> tuple[int, list[str]]:
    """The last note's number and archives; -1 if there is none."""
    files = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    notes = sorted(f.base_name for f in files if f.base_name.startswith(NOTE))
    if not notes:
        return -1, sorted(f.base_name for f in files if f.base_name.endswith(".zip"))
    with fs.open_input_file(f"{folder}/{notes[-1]}") as f:
        return int(notes[-1].removeprefix(NOTE)), json.loads(f.read())


def members(z: zipfile.ZipFile, archive: str) -> list[zipfile.ZipInfo]:
    """An archive's files; an error if one of its entries is hostile."""
    for m in z.infolist():
        if refused(m.filename, m.external_attr >> 16):
            raise ValueError(f"{archive}: refused for its member {m.filename!r}")
    return [m for m in z.infolist() if not m.is_dir()]


class Part(ds.InputPartition):
    """Members from one place to another of an archive; all if `to` is None."""

    def __init__(self, archive: str, from_: int = 0, to: int | None = None):
        super().__init__(archive)
        self.archive, self.from_, self.to = archive, from_, to


class ZipReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType, payload: bool, part_bytes: int):
        self.path, self.schema, self.payload, self.part_bytes = path, schema, payload, part_bytes

    def partitions(self) -> list[Part]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [""] if info.type == pafs.FileType.File else noted(fs, root)[1]
        parts = []
        for name in names:
            path = f"{root}/{name}" if name else root
            if (fs.get_file_info(path).size or 0) <= self.part_bytes:
                parts.append(Part(path))
                continue
            with fs.open_input_file(path) as f, zipfile.ZipFile(Seekable(f)) as z:
                start, size, own = 0, 0, members(z, path)
                for i, m in enumerate(own):
                    if i > start and size + m.compress_size > self.part_bytes:
                        parts.append(Part(path, start, i))
                        start, size = i, 0
                    size += m.compress_size
                parts.append(Part(path, start, len(own)))
        return parts or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.archive:
            return
        fs, schema, rows, size = opened(self.path)[0], to_arrow_schema(self.schema), [], 0
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(Seekable(f)) as z:
            for m in members(z, partition.archive)[partition.from_ : partition.to]:
                rows.append({"archive": partition.archive.rsplit("/", 1)[-1], "name": m.filename, "size": m.file_size, "payload": z.read(m) if self.payload else None})
                size += m.file_size if self.payload else 0
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(ds.WriterCommitMessage):
    archives: list[str]


class ZipWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        name, some = f"part-{uuid.uuid4().hex}.zip", False
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in iterator:
                for member, payload in zip(batch.column("name"), batch.column("payload"), strict=True):
                    if refused(member := member.as_py()) or member.endswith("/"):
                        raise ValueError(f"no name for a member: {member!r}")
                    info = zipfile.ZipInfo(member)
                    info.compress_type = zipfile.ZIP_STORED if member.lower().endswith(PACKED) else zipfile.ZIP_DEFLATED
                    z.writestr(info, payload.as_py() or b"")
                    some = True
        if not some:
            fs.delete_file(f"{folder}/{name}")
        return Written([name] if some else [])

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        fs.create_dir(folder, recursive=True)
        nth, before = noted(fs, folder)
        own = [x for m in messages if m for x in m.archives]
        # Without a note, every archive in the folder is listed: those of this job too.
        before = [] if self.overwrite else [x for x in before if x not in own and (nth >= 0 or not x.startswith("part-"))]
        with fs.open_output_stream(f"{folder}/{NOTE}{nth + 1:010d}", compression=None) as out:
            out.write(json.dumps([*before, *own]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = opened(self.path)
        for m in messages:
            for x in m.archives if m else ():
                fs.delete_file(f"{folder}/{x}")


class ZipSource(ds.DataSource):
    """Options: path; payload; part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zipped"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options["path"], schema, self.options.get("payload", "true") != "false", int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], overwrite)


def write_zipped(rows: DataFrame, path: str, mode: str = "append") -> None:
    """(name, payload) of rows as members of archives in a folder."""
    rows.sparkSession.dataSource.register(ZipSource)
    rows.select("name", F.col("payload").cast("binary").alias("payload")).write.format("zipped").mode(mode).save(path)


def read_zipped(spark: SparkSession, path: str, *, payload: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zipped").option("payload", str(payload).lower()).option("part_bytes", str(part_bytes)).load(path)


def report_members(events: DataFrame, summary: DataFrame, order: list[str]) -> DataFrame:
    """(name, payload) of a report: events as JSON lines in the order of columns that are unique together, so many lines to a member,
    and the summary's rows."""
    lines = numbered(events.select(*order, F.to_json(F.struct(*events.columns)).alias("line")), *order, name="nth")
    packs = lines.groupBy(F.floor(F.col("nth") / REPORT_LINES).alias("k")).agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("rows"))
    text = F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    first = packs.select(F.format_string("events-%05d.jsonl", "k").alias("name"), text.cast("binary").alias("payload"))
    each = F.to_json(F.struct(*summary.columns))
    whole = summary.agg(F.array_join(F.array_sort(F.collect_list(each)), "\n").alias("t"))  # a row for each kind of event
    return first.unionByName(whole.select(F.lit("summary.jsonl").alias("name"), F.col("t").cast("binary").alias("payload")))
