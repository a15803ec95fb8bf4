"""People on set, told apart as frames arrive: leaders that open under one similarity, are joined from another, and wait between.

A face joins the model with the nearest running centroid from JOIN on, and opens a model under OPEN. In between, and if it is
soft, it is nobody's for now: it waits, and is tried again after every batch, as centroids move. It may join then, though it never
opens a model; if nothing comes of it in `wait_s` of event time, a timer lets it go without one. A typed name is taken as it
stands, and its first sharp frame takes over a model at JOIN that has no name yet, so nobody becomes two.

State of a shoot: its models, one entry each (name, size, sum of faces), and the frames that wait.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JOIN, OPEN = 0.55, 0.40
OUT = "seq long, id long, model long, name string, into long, how string"
NAMES = [c.split()[0] for c in OUT.split(", ")]


@dataclass
class Model:
    name: str
    auto: bool
    n: int
    sum: np.ndarray


@dataclass
class Set:
    """Models by number, and waiting frames by (seq, id): (face, soft, deadline). changed: the models that are not as they were."""

    models: dict[int, Model] = field(default_factory=dict)
    waiting: dict[tuple[int, int], tuple[np.ndarray, bool, int]] = field(default_factory=dict)
    opened: int = 0
    changed: set[int] = field(default_factory=set)
    #: Unit centroids of the models that have one, row by row, and their numbers; None if they are to be gathered anew.
    units: np.ndarray | None = None
    rows: list[int] = field(default_factory=list)

    def nearest(self, face: np.ndarray | None) -> tuple[int | None, float]:
        if self.units is None:
            self.rows = [k for k, m in self.models.items() if m.n and np.linalg.norm(m.sum)]
            self.units = np.array([self.models[k].sum / np.linalg.norm(self.models[k].sum) for k in self.rows])
        if face is None or not self.rows:
            return None, -1.0
        sims = self.units @ face
        best = int(sims.argmax())
        return self.rows[best], float(sims[best])

    def open(self, name: str | None) -> int:
        auto = name is None
        if auto:
            taken, k = {m.name for m in self.models.values()}, 1 + sum(m.auto for m in self.models.values())
            while f"model {k}" in taken:
                k += 1
            name = f"model {k}"
        self.opened += 1
        self.models[self.opened] = Model(name, auto, 0, np.zeros(0))
        self.changed.add(self.opened)
        return self.opened

    def teach(self, k: int, face: np.ndarray) -> None:
        m = self.models[k]
        m.sum = m.sum + face if m.n else face.copy()
        m.n += 1
        self.changed.add(k)
        if self.units is not None and k in self.rows and np.linalg.norm(m.sum):
            self.units[self.rows.index(k)] = m.sum / np.linalg.norm(m.sum)
        else:
            self.units = None

    def arrive(self, seq: int, i: int, typed: str | None, face: np.ndarray | None, soft: bool, deadline: int) -> list[tuple]:
        """What follows of a frame, as rows of OUT."""
        near, sim = self.nearest(face)
        teaches = face is not None and not soft
        out = []
        if typed:
            k = next((k for k, m in self.models.items() if m.name == typed), None)
            unnamed = near is not None and self.models[near].auto and re.fullmatch(r"model \d+", self.models[near].name)
            if (k is None or not self.models[k].n) and teaches and sim >= JOIN and unnamed:
                if k is None:
                    k, self.models[near].name, self.models[near].auto = near, typed, False
                    self.changed.add(near)
                    out.append((seq, None, near, typed, None, "named"))
                else:
                    gone = self.models.pop(near)
                    self.models[k].sum, self.models[k].n, self.units = gone.sum, gone.n, None
                    self.changed.add(k)
                    out.append((seq, None, near, None, k, "merged"))
            elif k is None:
                k = self.open(typed)
                out.append((seq, None, k, typed, None, "named"))
        elif face is None:
            return [(seq, i, None, None, None, "never")]
        elif sim >= JOIN:
            k = near
        elif soft or sim >= OPEN:
            self.waiting[seq, i] = (face, soft, deadline)
            return []
        else:
            k = self.open(None)
            out.append((seq, None, k, self.models[k].name, None, "named"))
        if teaches:
            self.teach(k, face)
        return [*out, (seq, i, k, None, None, "arrived")]

    def settle(self) -> list[tuple]:
        """The waiting frames that a model is near enough to by now, in order, until none is."""
        out, more = [], True
        while more:
            more = False
            for own in sorted(self.waiting):
                face, soft, _ = self.waiting[own]
                near, sim = self.nearest(face)
                if sim >= JOIN:
                    del self.waiting[own]
                    if not soft:
                        self.teach(near, face)
                        more = True
                    out.append((*own, near, None, None, "later"))
        return out

    def let_go(self, until: int) -> list[tuple]:
        gone = sorted(k for k, (_, _, deadline) in self.waiting.items() if deadline <= until)
        for k in gone:
            del self.waiting[k]
        return [(*k, None, None, None, "never") for k in gone]


class Casting(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.models = handle.getMapState("models", "model long", "name string, auto boolean, n long, sum array<double>")
        self.waiting = handle.getMapState("waiting", "seq long, id long", "face array<double>, soft boolean, deadline long")
        self.opened = handle.getValueState("opened", "n long")

    def load(self) -> Set:
        models = {int(k[0]): Model(v[0], bool(v[1]), int(v[2]), np.array(v[3], float)) for k, v in self.models.iterator()} if self.models.exists() else {}
        waiting = {(int(k[0]), int(k[1])): (np.array(v[0], float), bool(v[1]), int(v[2])) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        return Set(dict(sorted(models.items())), waiting, int(self.opened.get()[0]) if self.opened.exists() else 0)

    def save(self, now: Set, models: set, waiting: set) -> None:
        for k in models - now.models.keys():
            self.models.removeKey((k,))
        for k in waiting - now.waiting.keys():
            self.waiting.removeKey(k)
        for k in now.changed & now.models.keys():
            m = now.models[k]
            self.models.updateValue((k,), (m.name, m.auto, m.n, m.sum.tolist()))
        for k in now.waiting.keys() - waiting:
            face, soft, deadline = now.waiting[k]
            self.waiting.updateValue(k, (face.tolist(), soft, deadline))
            self.handle.registerTimer(deadline)
        self.opened.update((now.opened,))

    def handed(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=NAMES).astype({"seq": "Int64", "id": "Int64", "model": "Int64", "into": "Int64"})
            yield frame.assign(shoot=key[0])[["shoot", *NAMES]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = self.load(), []
        models, waiting = set(now.models), set(now.waiting)
        for r in pd.concat(list(rows)).sort_values(["seq", "id"]).itertuples():  # of one trigger
            face = np.asarray(r.face, float) if r.face is not None else None
            face = face / max(float(np.linalg.norm(face)), 1e-12) if face is not None else None
            typed = r.typed if isinstance(r.typed, str) and r.typed else None
            out += now.arrive(int(r.seq), int(r.id), typed, face, bool(r.soft), int(r.at_ms) + self.wait_ms)
        out += now.settle()
        self.save(now, models, waiting)
        yield from self.handed(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.load()
        models, waiting = set(now.models), set(now.waiting)
        out = now.let_go(timerValues.getCurrentWatermarkInMs())
        self.save(now, models, waiting)
        yield from self.handed(key, out)

    def close(self) -> None:
        pass


def cast(frames: DataFrame, *, wait_s: int = 600, late: str = "1 minute") -> DataFrame:
    """What follows of frames (shoot, seq, id, at, typed, face, soft), in the order of seq within a batch: rows (shoot, seq, id,
    model, name, into, how). how: arrived, later and never are frames and the model that they are in, or none; named gives a
    model its name, merged makes it another's."""
    kind = frames.schema["shoot"].dataType.simpleString()
    rows = frames.select("shoot", "seq", "id", "typed", F.col("face").cast("array<double>").alias("face"), "soft", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", late)
    return rows.groupBy("shoot").transformWithStateInPandas(Casting(wait_s * 1000), f"shoot {kind}, {OUT}", "Append", "EventTime")


def told(rows: DataFrame) -> DataFrame:
    """(shoot, id, model, name) of the frames in a model, by what became of it: merged models are the one they went into."""
    merged = rows.filter("how = 'merged'").select("shoot", "model", "into")
    names = rows.filter("how = 'named'").groupBy("shoot", "model").agg(F.max_by("name", "seq").alias("name"))
    own = rows.filter("id IS NOT NULL AND model IS NOT NULL").select("shoot", "id", "model").join(merged, ["shoot", "model"], "left")
    own = own.select("shoot", "id", F.coalesce("into", "model").alias("model"))
    return own.join(names, ["shoot", "model"], "left").select("shoot", "id", "model", "name")
