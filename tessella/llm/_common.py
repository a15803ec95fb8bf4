"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of ASCII letters and digits and of any character beyond ASCII; only A-Z is folded.
#: On UTF-8 bytes that is one table: word bytes map to their folded self, all others to a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD_REGEX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(raw: bytes | None) -> list[bytes]:
    """Folded words of a UTF-8 text; none for null."""
    return raw.translate(WORD_TABLE).split() if raw else []


def values(column: pa.Array) -> Iterator:
    """Python values of a column, one at a time: a batch of texts is not copied as a whole."""
    return (x.as_py() for x in column)


def portions(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text in a column; a longer text is a slice by itself."""
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if len(batch) > start:
        yield batch.slice(start)


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is set in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"/tmp/spark-tessella-{uuid.uuid4().hex}")
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get()
    return where.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(*columns: Column) -> Column:
    """A 128-bit key of the columns' values; nulls count as a value of their own."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


#: A key is hot if more than one in HOT_SHARE of the rows have it, so at most HOT_SHARE keys are; their rows go to SALTS tasks.
HOT_SHARE, SALTS = 256, 64
#: No key of so many rows is hot.
LEAST_HOT = 1000


def hot_keys(counts: DataFrame, on: list[str], n: str, total: int, share: int = HOT_SHARE) -> DataFrame:
    """Of (on, n), the keys with more than 1 / share of `total` rows. They are `share` at most, which bounds a broadcast."""
    return counts.filter(F.col(n) > max(total / share, LEAST_HOT)).select(*on)


def may_be_hot(total: int) -> bool:
    """Whether any key of so many rows can be hot, by hot_keys()."""
    return total > LEAST_HOT


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined to right, with the left rows of hot keys dealt out to `salts` tasks and the right ones copied to each.

    hot: keys, of a bounded number, as it is broadcast. Keys that are null stay null on the left. how: inner or left.
    """
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0)
    own = left.join(marked, on, "left").withColumn("_salt", spread).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = right.join(marked, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return own.join(other, [*on, "_salt"], how).drop("_salt")
