"""Structured Streaming operators for frames as they arrive.

Nothing is dropped for being late: there is no event-time watermark, but where a rule has a time limit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PRODUCT_JOIN, MODEL_JOIN, MODEL_OPEN = 0.89, 0.55, 0.40
PAIR_SECONDS = 2
RECENT = 9


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deduplicated(frames: DataFrame) -> DataFrame:
    """The first write of each (rel, size, mtime); the same file seen again is not counted twice."""
    return frames.dropDuplicates(["rel", "size", "mtime"])


def paired(frames: DataFrame, seconds: int = PAIR_SECONDS, late: str | None = None) -> DataFrame:
    """RAW frames with the standard file of the same folder and stem that arrives within some seconds, else alone.

    frames: at (timestamp), dir, stem, rel, is_raw. A RAW waits for its partner until nothing earlier is expected: `late`
    says how far behind the newest frame others may come (the limit itself by default), then it goes on alone.
    """
    late = late or f"{seconds} seconds"
    raw = frames.filter("is_raw").withWatermark("at", late).alias("r")
    std = frames.filter("NOT is_raw").withWatermark("at", late).alias("s")
    near = F.expr(f"r.dir = s.dir AND r.stem = s.stem AND s.at BETWEEN r.at - INTERVAL {seconds} SECONDS AND r.at + INTERVAL {seconds} SECONDS")
    return raw.join(std, near, "left_outer").select(F.col("r.rel").alias("raw"), F.col("s.rel").alias("standard"), F.col("r.at").alias("at"))


def assign_leaders(key: str, frames: DataFrame, join_at: float = PRODUCT_JOIN) -> DataFrame:
    """Online leader clustering by key of (key, seq, soft, vector): (key, seq, leader, opened).

    Centroids are running sums. A frame joins the nearest leader at the threshold (a soft one joins the nearest anyway),
    else opens a new one; soft frames never move a centroid.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = [np.array(x, float) for x in state.get[0]] if state.exists else []
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            v = np.asarray(r.vector, float)
            v = v / max(float(np.linalg.norm(v)), 1e-12)
            sims = [float(s @ v) / max(float(np.linalg.norm(s)), 1e-12) for s in sums]
            best = int(np.argmax(sims)) if sims else -1
            opened = best < 0 or (sims[best] < join_at and not r.soft)
            if opened:
                sums.append(v.copy())
                best = len(sums) - 1
            elif not r.soft:
                sums[best] = sums[best] + v
            out.append((k[0], r.seq, best, opened))
        state.update(([s.tolist() for s in sums],))
        yield pd.DataFrame(out, columns=[key, "seq", "leader", "opened"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, seq long, leader int, opened boolean", "sums array<array<double>>", "append", GroupStateTimeout.NoTimeout
    )


def alerts(frames: DataFrame) -> DataFrame:
    """(product, seq, drop, alert) of (product, seq, level, setting, strobe): light against the median of up to nine recent
    frames with the same setting, three at least. The state of a product and setting is those nine levels, so products that
    have many frames are spread over their settings."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            drop = None
            if len(own) >= 3 and (m := float(np.median(own))) >= 0.02:
                drop = float(np.log2(m / max(r.level, 1e-4)))
            alert = None if drop is None else "flash_miss" if r.strobe and drop >= 1.5 else "dark" if drop >= 1 else None
            out.append((k[0], r.seq, drop, alert))
            own = [*own, r.level][-RECENT:]
        state.update((own,))
        yield pd.DataFrame(out, columns=["product", "seq", "drop", "alert"])

    return frames.groupBy("product", "setting").applyInPandasWithState(
        step, "product string, seq long, drop double, alert string", "levels array<double>", "append", GroupStateTimeout.NoTimeout
    )


def tagged(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """frames (seq, at) with the tag in force when they arrived: the latest of (at, tag) not after them. Tags of a shoot are
    few; each holds until the next one."""
    from pyspark.sql.window import Window

    upto = F.lead("at").over(Window.orderBy("at"))
    spans = tags.select(F.col("at").alias("_from"), upto.alias("_to"), "tag")
    inside = (F.col("at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))
    return frames.join(F.broadcast(spans), inside, "left").drop("_from", "_to")


#: Operators with several kinds of state need this store; it is asked for while such a stream starts. Of states before the last, which a
#: restart goes on from, few are kept: each may be as large as all windows are.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.minBatchesToRetain": "3",
}


@contextmanager
def rich_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, written to a table; a restart goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def delivered(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """As drained(), by batches: each is a folder of its own that is written anew if the batch is tried again, so that rows arrive
    once even where a run ends between writing and noting it."""

    def put(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={nth}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).select(*stream.columns)
