"""Frames and tags as two streams that are late for each other: which tag was in force when a frame arrived.

A row stands for a frame's folder and stem. Its RAW and its standard file may come in either order and in different batches: the
later one takes over the row or hangs on to it, and the row keeps the id of the file that arrived first. Its product is that of
the latest tag not after that arrival. Whatever comes late (a tag for frames that are through, the first file of a
pair after the second) makes a new version of the rows that it concerns, so that the last versions are what all events in the
order of their time would give. Versions are appended (live.delivered() writes each batch once), and the last of a key counts.

State is kept for frames within `keep` of the watermark, and tags that can still concern them; both go by a timer of event time.
A shoot's frames are dealt out over lanes by their stem, to each of which its tags are copied: a shoot of any size is many tasks'.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Lanes of a shoot, and chunks of a lane's rows. A chunk is one value of the state, as a call for every row would take longer than all else.
LANES, CHUNKS = 16, 64
ROW = "raw_at long, raw_id long, raw string, std_at long, std_id long, standard string, version int, id long, rel string, sibling string, product string"
FIELDS = [c.split()[0] for c in ROW.split(", ")]
RAW_AT, STD_AT = FIELDS.index("raw_at"), FIELDS.index("std_at")
OUT = "dir string, stem string, version int, id long, rel string, sibling string, product string"


def asof(tags: list[tuple[int, int, str | None]], at: int) -> str | None:
    """The product of the last of the tags (at, seq, product), which are in order, that is not after a time."""
    i = bisect_right(tags, at, key=lambda t: t[0])
    return tags[i - 1][2] if i else None


def arrival(row: dict) -> tuple[int, int, str]:
    """When the first of a row's files arrived, its id and path."""
    return min((row[f"{k}_at"], row[f"{k}_id"], row[name]) for k, name in (("raw", "raw"), ("std", "standard")) if row[f"{k}_at"] is not None)


def updated(row: dict, tags: list) -> bool:
    """Works out what a row says; whether that is anything new, which is another version."""
    at, first, _ = arrival(row)
    says = {
        "id": first, "rel": row["standard"] if row["standard"] is not None else row["raw"],
        "sibling": row["raw"] if row["standard"] is not None else None, "product": asof(tags, at),
    }
    if row["version"] >= 0 and all(row[k] == v for k, v in says.items()):
        return False
    row |= says | {"version": row["version"] + 1}
    return True


def chunk_of(own: tuple[str, str]) -> int:
    return zlib.crc32(repr(own).encode()) % CHUNKS


class Tagging(StatefulProcessor):
    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk int", "rows binary")
        self.tags = handle.getValueState("packed_tags", "tags binary")

    def known_tags(self) -> list:
        return pickle.loads(self.tags.get()[0]) if self.tags.exists() else []

    def chunk(self, nth: int) -> dict:
        """(dir, stem) -> row of a chunk, a row as a tuple of FIELDS."""
        return pickle.loads(self.chunks.getValue((nth,))[0]) if self.chunks.containsKey((nth,)) else {}

    def held_rows(self, wanted: dict, tags: list, late: set) -> dict:
        """The rows that are wanted, and those that a late tag is in force for: it holds until the next one, so rows that arrived
        meanwhile are another's now. With late tags that is one pass over the rows, however many tags they are."""
        if not self.chunks.exists():
            return {}
        ats, out = [t[0] for t in tags], {}
        for nth in range(CHUNKS) if late else {chunk_of(own) for own in wanted}:
            for own, held in self.chunk(nth).items():
                raw_at, std_at = held[RAW_AT], held[STD_AT]
                i = late and bisect_right(ats, std_at if raw_at is None else raw_at if std_at is None else min(raw_at, std_at))
                if (i and tags[i - 1][:2] in late) or own in wanted:
                    out[own] = dict(zip(FIELDS, held, strict=True))
        return out

    def put_rows(self, rows: dict) -> None:
        by: dict[int, dict] = {}
        for own, row in rows.items():
            by.setdefault(chunk_of(own), {})[own] = tuple(row[c] for c in FIELDS)
        for nth, new in by.items():
            self.chunks.updateValue((nth,), (pickle.dumps(self.chunk(nth) | new),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late, files, newest = [], {}, 0
        for part in rows:
            for r in part[["at_us", "seq", "is_tag", "product", "dir", "stem", "rel", "is_raw", "id"]].itertuples(index=False):
                newest = max(newest, int(r.at_us))
                if r.is_tag:
                    late.append((int(r.at_us), int(r.seq), None if r.product is None or r.product != r.product else r.product))
                else:
                    files.setdefault((r.dir, r.stem), []).append((r.is_raw, (int(r.at_us), int(r.id), r.rel)))
        tags = sorted(self.known_tags() + late, key=lambda t: t[:2])
        touched = self.held_rows(files, tags, {t[:2] for t in late})
        if late:
            self.tags.update((pickle.dumps(tags),))
        moved = set()
        for own, arrived in files.items():
            row = touched.setdefault(own, dict.fromkeys(FIELDS) | {"version": -1})
            for is_raw, file in arrived:
                kind, name = ("raw", "raw") if is_raw else ("std", "standard")
                if row[f"{kind}_at"] is None or file < (row[f"{kind}_at"], row[f"{kind}_id"], row[name]):
                    row[f"{kind}_at"], row[f"{kind}_id"], row[name] = file
                    moved.add(own)
        changed = {own for own, row in touched.items() if updated(row, tags)}
        self.put_rows({own: touched[own] for own in changed | moved})
        out = [(key[0], *own, *(row[c] for c in FIELDS[6:])) for own, row in touched.items() if own in changed]
        if newest:
            self.handle.registerTimer((newest + self.keep_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["shoot", *[c.split()[0] for c in OUT.split(", ")]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What is older than is kept goes: rows, and tags that a later one replaced before that."""
        until = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep_us
        for nth in range(CHUNKS) if self.chunks.exists() else ():
            rows = self.chunk(nth)
            young = {own: held for own, held in rows.items() if arrival(dict(zip(FIELDS, held, strict=True)))[0] >= until}
            if rows and not young:
                self.chunks.removeKey((nth,))
            elif len(young) < len(rows):
                self.chunks.updateValue((nth,), (pickle.dumps(young),))
        tags = self.known_tags()
        first = bisect_right(tags, until, key=lambda t: t[0])
        if first > 1:
            self.tags.update((pickle.dumps(tags[first - 1 :]),))
        return iter(())

    def close(self) -> None:
        pass


def tagged(frames: DataFrame, tags: DataFrame, *, late: str = "1 hour", keep_s: int = 24 * 3600, lanes: int = LANES) -> DataFrame:
    """Versions of rows (shoot, dir, stem) from the streams frames (shoot, at, dir, stem, rel, is_raw, id) and tags (shoot, at, seq,
    product); a null product ends the tag in force. Of tags at one time the one of the largest seq holds.

    late: how far behind the newest event another may be; what is later still is dropped, as a stream with a watermark does.
    """
    none = lambda kind: F.lit(None).cast(kind)
    lane = F.pmod(F.xxhash64("dir", "stem"), F.lit(lanes)).cast("int")
    own = frames.select("shoot", lane.alias("lane"), "at", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("is_tag"), none("string").alias("product"), "dir", "stem", "rel", "is_raw", "id")
    every = tags.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(
        "shoot", "lane", "at", "seq", F.lit(True).alias("is_tag"), "product", *[none("string").alias(c) for c in ("dir", "stem", "rel")], F.lit(False).alias("is_raw"), F.lit(0).cast("long").alias("id")
    )
    events = own.unionByName(every).withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    kind = frames.schema["shoot"].dataType.simpleString()
    return events.groupBy("shoot", "lane").transformWithStateInPandas(Tagging(keep_s * 1_000_000), f"shoot {kind}, {OUT}", "Append", "EventTime")


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each row."""
    last = Window.partitionBy("shoot", "dir", "stem").orderBy(F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "version")
