"""Files as rows: recursive scans, their accounting, and logs and snapshots that are read back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators.changes import pair_raw

# File kinds by suffix.
STANDARD = [".jpg", ".jpeg", ".png", ".heic", ".heif", ".hif", ".avif", ".tif", ".tiff", ".webp"]
RAW = [
    ".arw", ".cr2", ".cr3", ".nef", ".dng", ".raf", ".orf", ".rw2", ".pef", ".3fr", ".fff", ".iiq", ".x3f", ".srw", ".erf", ".mrw", ".kdc",
    ".dcr", ".nrw", ".sr2", ".srf", ".mos", ".mef", ".rwl", ".crw", ".ori",
]
VIDEO = [".mp4", ".mov", ".m4v", ".mts", ".m2ts", ".avi", ".mxf", ".mpg", ".mpeg", ".mkv", ".webm", ".3gp"]
# Offset and length of the packets of a transport stream.
STRIDES = [(0, 188), (4, 192), (4, 188)]
# Folders that are not looked into.
PRUNED = ["node_modules", "__pycache__", "venv", "site-packages"]
PACKAGES = [".app", ".photoslibrary", ".lrdata", ".bundle"]
SAMPLE_BYTES = 200


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(rel, size, mtime) of every file under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return files.select(_rel(root).alias("rel"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"))


def _rel(root: str) -> Column:
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), F.lit("^" + _quoted(root) + "/?"), F.lit(""))


def _quoted(root: str) -> str:
    import re

    return re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/").replace("\\", "\\\\").replace(".", r"\.").replace("+", r"\+")


def off_disk(rel: Column) -> Column:
    """Whether a path from the root of a whole disk is left out: all but people's folders and in those the library; of a
    photo library all but its originals."""
    people = rel.startswith("Users/") & ~rel.rlike("^Users/[^/]+/Library/")
    return ~people | rel.rlike("(?i)[.]photoslibrary/(?!originals/)")


def skip_reason(rel: Column, size: Column, disk: bool = False) -> Column:
    """Why a file is no item; null for items. disk: paths are from the root of a whole disk."""
    hidden = rel.rlike(r"(^|/)\.[^/]")
    packages = [x for x in PACKAGES if not (disk and x == ".photoslibrary")]
    pruned = rel.rlike(f"(^|/)({'|'.join(PRUNED)})/") | F.lower(rel).rlike(f"({'|'.join(x.replace('.', '[.]') for x in packages)})/")
    pruned = pruned | off_disk(rel) if disk else pruned
    known = S.suffix(rel).isin(*STANDARD, *RAW, *VIDEO)
    return F.when(hidden, "hidden").when(pruned, "not looked into").when(~known, "another kind of file").when(size == 0, "empty")


def scan(spark: SparkSession, root: str, disk: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, skipped): files with their RAW sibling; and for each reason the number left out with three examples. Of files
    named .mts, which is not only a clip's suffix, the first bytes have to be those of a transport stream. Spark lists no empty files, so these are in neither."""
    files = listed(spark, root).withColumn("why", skip_reason(F.col("rel"), F.col("size"), disk))
    files = files.join(sniffed(spark, root), "rel", "left")
    files = files.withColumn("why", F.coalesce("why", F.when(~F.col("clip"), "not a clip"))).drop("clip")
    own = files.filter("why IS NULL").drop("why").withColumns({"is_raw": S.suffix(F.col("rel")).isin(*RAW), "is_video": S.suffix(F.col("rel")).isin(*VIDEO)})
    return pair_raw(own), skipped(files.filter("why IS NOT NULL"))


def sniffed(spark: SparkSession, root: str) -> DataFrame:
    """(rel, clip) of files named .mts, by their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][tT][sS]").load(root).select("path", "length")
    return read_ends(files, SAMPLE_BYTES).select(_rel(root).alias("rel"), transport_stream(F.col("head")).alias("clip"))


def skipped(files: DataFrame) -> DataFrame:
    """(why, n, examples): the examples are the first three by path; only those leave a task."""
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("why").orderBy("rel"))
    first = files.select("why", "rel").withColumn("_r", nth).filter("_r <= 3").groupBy("why").agg(F.array_sort(F.collect_list("rel")).alias("examples"))
    return files.groupBy("why").agg(F.count("*").alias("n")).join(first, "why")


def transport_stream(content: Column) -> Column:
    """Whether the first bytes have sync bytes a packet apart, in one of three layouts."""
    head = F.hex(F.substring(content, 1, SAMPLE_BYTES))
    at = lambda i: F.substring(head, 2 * i + 1, 2) == "47"
    return F.coalesce(reduce(lambda a, b: a | b, [at(start) & at(start + step) for start, step in STRIDES]), F.lit(False))


def content_keys(spark: SparkSession, root: str) -> DataFrame:
    """(rel, qhash) by size, first and last bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return read_ends(files).select(_rel(root).alias("rel"), F.sha1(F.concat(F.col("length").cast("string").cast("binary"), "head", "tail")).alias("qhash"))


def read_ends(files: DataFrame, chunk: int = 65536) -> DataFrame:
    """(path, length, head, tail): the first bytes of files, and those of their last that are not among them. No more of a
    file is read, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            ends: list[tuple[bytes, bytes]] = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                local = path.startswith("file:")
                store, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    head, tail = f.read(chunk), b""
                    if size > chunk:
                        f.seek(max(size - chunk, chunk))
                        tail = f.read(chunk)
                ends.append((head, tail))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in ([h for h, _ in ends], [t for _, t in ends]))], names=["path", "length", "head", "tail"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, head binary, tail binary")


def recent_folders(files: DataFrame, now: float, within: float = 60.0, n: int = 3, depth: int = 4, last: str | None = None) -> DataFrame:
    """Folders, at most so deep, with an image written in the last seconds: the one used last first, then newest first. A
    camera's clock may be some seconds ahead; empty files don't count."""
    rel, t = F.col("rel"), F.col("mtime")
    image = S.suffix(rel).isin(*STANDARD, *RAW) & (F.size(F.split(rel, "/")) <= depth + 1)
    new = files.filter(image & (t >= now - within) & (t <= now + 5))
    new = new.filter("size > 0") if "size" in files.columns else new
    found = new.groupBy(S.parent(rel).alias("dir")).agg(F.count("*").alias("n"), F.max("mtime").alias("newest"))
    return found.orderBy(*([F.col("dir") != last] if last is not None else []), F.desc("newest"), "dir").limit(n)


def photo_count(files: DataFrame) -> DataFrame:
    """One row, n: images by folder and name, so that a RAW and its standard file are one."""
    own = files.filter(S.suffix(F.col("rel")).isin(*STANDARD, *RAW))
    return own.agg(F.countDistinct(S.parent(F.col("rel")), F.lower(S.stem(F.col("rel")))).alias("n"))


def cities(spark: SparkSession, path: str) -> DataFrame:
    """(name, country, lat, lon) of a JSON city list {scale, places: [[name, country, lat, lon]]} with scaled numbers; a scale of
    none or 0 is 1. Places of another shape are left out."""
    lists = spark.read.schema("scale double, places array<array<string>>").option("multiLine", "true").json(path)
    scale = F.coalesce(F.nullif("scale", F.lit(0.0)), F.lit(1.0)).alias("scale")
    at = lambda i: F.get("p", F.lit(i))
    rows = lists.select(scale, F.explode("places").alias("p")).select(at(0).alias("name"), at(1).alias("country"), *[(at(i).try_cast("double") / F.col("scale")).alias(n) for i, n in ((2, "lat"), (3, "lon"))])
    return rows.filter("lat IS NOT NULL AND lon IS NOT NULL")


def usage_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Rotated JSON-lines logs; lines that do not parse are skipped."""
    schema = "ts string, session string, ev string, q string, ms double, seconds double, error string, route string, filters map<string, string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths))


def snapshot(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a project snapshot written by sinks.write_snapshot()."""
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def sidecar_facts(xml: Column) -> Column:
    """Struct(gamma, camera, capture_fps, format_fps) of a camera's XML sidecar; null fields where it has none."""
    text = lambda p: F.nullif(F.regexp_extract(xml, p, 1), F.lit(""))
    return F.struct(
        text(r'CaptureGammaEquation"\s+value="([^"]*)"').alias("gamma"), text(r'modelName="([^"]*)"').alias("camera"),
        S.fraction(text(r'captureFps="([\d./]+)')).alias("capture_fps"), S.fraction(text(r'formatFps="([\d./]+)')).alias("format_fps"),
    )
