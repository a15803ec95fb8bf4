"""Bursts and exposure brackets of a live shoot, over its last frames.

Each arriving frame joins a window of the shoot's last WINDOW frames, over which the rules of bursts and brackets are run anew.
What they say is carried onto the frames: a set goes by the smallest id it ever had in the window, and keeps it when that
frame has left the window, so a burst far longer than the window stays one. A set that is left with one frame is none.

State of a shoot: the window's frames, and for each set that still has frames there how many of its frames have left it (and
one of them, which is told if the set comes to an end). So state is bounded by the window, however long a shoot lasts, and
a restart goes on with the same ids.

A frame that comes or goes concerns the runs next to it only, as far as frames follow each other: the rules are run anew for these, and
all else in the window stays as it is. Shoots are dealt over lanes, and the shoots of a lane over chunks of its state, each of which is
one value: a call for every shoot and trigger would take longer than all else.
"""

from __future__ import annotations

import math
import pickle
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tessella.operators.sequence import BRACKET_GAP_S, BRACKET_MIN, BRACKET_SPAN, BRACKET_STEP, BURST_EV, BURST_GAP_S, framing_similarity

WINDOW = 32
#: Lanes that shoots are dealt over, and chunks of a lane's shoots.
LANES, CHUNKS = 128, 8
#: Changes handed on at once.
TOLD = 20_000
BURST_SIM, FRAMING = 0.9, 0.6
#: What the rules look at. t is in seconds; bright and ev as brightness() and ev100() give them; vector and field may be null.
FRAME = (
    "id long, dir string, rel string, kind string, t double, camera string, frame_no long, ev double, bright double, "
    "exposure_s double, exp_mode int, vector array<double>, field array<double>"
)
NAMES = [c.split()[0] for c in FRAME.split(", ")]


def likeness(a: list | None, b: list | None) -> float | None:
    """Cosine of two vectors; None if either is missing."""
    if a is None or b is None:
        return None
    x, y = np.asarray(a, float), np.asarray(b, float)
    return float(x @ y) / (float(np.linalg.norm(x) * np.linalg.norm(y)) or 1.0)


def framed_alike(a: dict, b: dict) -> bool:
    if a["field"] is None or b["field"] is None:
        return True
    square = lambda f: np.asarray(f, float).reshape(int(len(f) ** 0.5), -1)
    return framing_similarity(square(a["field"]), square(b["field"])) >= FRAMING


def neighbours(a: dict, b: dict) -> bool:
    return a["dir"] == b["dir"] and a["camera"] == b["camera"] and b["frame_no"] == a["frame_no"] + 1


def steps(a: dict, b: dict) -> bool:
    """Whether b may go on with a bracket whose last frame is a."""
    return (
        neighbours(a, b) and 0 <= b["t"] - a["t"] <= BRACKET_GAP_S + (a["exposure_s"] or 0.0)
        and a["bright"] is not None and b["bright"] is not None and abs(b["bright"] - a["bright"]) >= BRACKET_STEP
    )


def repeats(a: dict, b: dict) -> bool:
    """Whether b goes on with a burst whose last frame is a, if neither is in a bracket."""
    if not neighbours(a, b) or math.floor(b["t"]) - math.floor(a["t"]) > BURST_GAP_S:
        return False
    if a["ev"] is not None and b["ev"] is not None and abs(a["ev"] - b["ev"]) >= BURST_EV - 1e-6:
        return False
    alike = likeness(a["vector"], b["vector"])
    return alike is None or alike >= BURST_SIM


def linked(rule: Callable[[dict, dict], bool], a: dict, b: dict) -> bool:
    """What a rule says of two frames of which one follows the other: worked out once while they do, as frames don't change."""
    before, says = b.get(rule, (None, False))
    if before is not a:
        says = rule(a, b)
        b[rule] = (a, says)
    return says


def brackets(stills: list[dict]) -> list[list[tuple[dict, float]]]:
    """Sets of (frame, stops from the set's upper median) among stills in order."""
    runs: list[list[dict]] = []
    for f in stills:
        run = runs[-1] if runs else []
        follows = run and linked(steps, run[-1], f) and all(abs(f["bright"] - q["bright"]) >= BRACKET_STEP for q in run) and any(framed_alike(q, f) for q in run)
        if follows:
            run.append(f)
        else:
            runs.append([f])
    out = []
    for run in runs:
        if len(run) < 2:
            continue
        levels = sorted(f["bright"] or 0.0 for f in run)
        said = all(f["exp_mode"] == 2 for f in run)
        if (len(run) >= 2 and said) or (len(run) >= BRACKET_MIN and levels[-1] - levels[0] >= BRACKET_SPAN - 1e-6):
            middle = levels[len(levels) // 2]
            out.append([(f, round((f["bright"] or 0.0) - middle, 2)) for f in run])
    return out


def bursts(stills: list[dict], taken: set[int]) -> list[list[dict]]:
    """Runs of two stills and more, in order, of frames that are in no bracket (ids `taken`)."""

    runs: list[list[dict]] = []
    for f in stills:
        if runs and f["id"] not in taken and runs[-1][-1]["id"] not in taken and linked(repeats, runs[-1][-1], f):
            runs[-1].append(f)
        else:
            runs.append([f])
    return [r for r in runs if len(r) > 1]


class Shoot:
    """The window of one shoot, and its sets. outside: set -> (frames that have left the window, one of them)."""

    def __init__(self, frames: list[dict], outside: dict[tuple[str, int], tuple[int, int]]):
        self.frames, self.outside = frames, outside
        self.changes: list[tuple[int, str, int | None, float | None]] = []
        #: Frames that the rules look at, in order, with what orders them; ids that are in a bracket.
        self.stills = sorted((f for f in frames if is_still(f)), key=place)
        self.places = [place(f) for f in self.stills]
        self.taken = {f["id"] for f in frames if f["bracketed"]}

    def put(self, frame: dict, kind: str, set_id: int | None) -> None:
        frame[kind] = set_id
        self.changes.append((frame["id"], kind, set_id, frame["stops"] if kind == "bracket" and set_id is not None else None))

    def leave(self, frame: dict, kind: str) -> None:
        own = (kind, frame[kind])
        self.put(frame, kind, None)
        inside = [f for f in self.frames if f[kind] == own[1]]
        n, one = self.outside.get(own, (0, None))
        if len(inside) + n == 1:
            if inside:
                self.put(inside[0], kind, None)
            else:
                self.changes.append((one, kind, None, None))
        if len(inside) + n <= 1 or not inside:
            self.outside.pop(own, None)

    def join(self, run: list[dict], kind: str) -> None:
        have = [f[kind] for f in run if f[kind] is not None]
        set_id = min(have) if have else min(f["id"] for f in run)
        for f in run:
            if f[kind] != set_id:
                if f[kind] is not None:
                    self.leave(f, kind)
                self.put(f, kind, set_id)

    def slide(self) -> tuple[list[int], list[int]]:
        """The frames beyond the window leave it; they stay in their sets, of which those with no frame left here are done. Next to which stills
        one is gone that followed or was followed, by the rule of brackets and by that of bursts."""
        at: tuple[list[int], list[int]] = ([], [])
        while len(self.frames) > WINDOW:
            gone = self.frames.pop(0)
            if is_still(gone):
                k = bisect_left(self.places, place(gone))
                while self.stills[k] is not gone:
                    k += 1
                for own, follows in zip(at, (in_bracket, in_burst), strict=True):
                    if k or (len(self.stills) > 1 and follows(gone, self.stills[1])):
                        own += [k - 1, k]
                del self.stills[k], self.places[k]
            self.taken.discard(gone["id"])
            for rule in (steps, repeats):
                gone.pop(rule, None)  # else it would hold on to all frames before it
            for kind in ("burst", "bracket"):
                own = (kind, gone[kind])
                if gone[kind] is not None:
                    self.outside[own] = (self.outside.get(own, (0, None))[0] + 1, gone["id"])
                    if all(f[kind] != gone[kind] for f in self.frames):
                        del self.outside[own]
        return at

    def around(self, positions: list[int], follows: Callable[[dict, dict], bool]) -> Iterator[list[dict]]:
        """The stills of each range of two and more that follow each other, of which a position is in."""
        stills, n, end = self.stills, len(self.stills), 0
        for p in sorted(positions) if len(positions) > 1 else positions:
            if p < end or p >= n:
                continue
            lo, end = p, p + 1
            while lo > 0 and follows(stills[lo - 1], stills[lo]):
                lo -= 1
            while end < n and follows(stills[end - 1], stills[end]):
                end += 1
            if end - lo > 1 or stills[lo]["bracketed"]:
                yield stills[lo:end]

    def add(self, frame: dict) -> list[tuple[int, str, int | None, float | None]]:
        """What changed, in order: (id, kind, set or None, stops)."""
        self.changes = []
        frame = frame | {"burst": None, "bracket": None, "stops": None, "bracketed": False}
        self.frames.append(frame)
        at, moved = self.slide()
        if is_still(frame):
            own = place(frame)
            # As sorted() has it: frames of one place stay in the order of arrival.
            k = len(self.places) if not self.places or self.places[-1] <= own else bisect_right(self.places, own)
            self.stills.insert(k, frame)
            self.places.insert(k, own)
            here = [k] if k == len(self.places) - 1 else [k - 1, k, k + 1]
            at, moved = ([x + (x >= k) for x in xs] + here for xs in (at, moved))
        found = []
        for part in self.around(at, in_bracket):
            sets = brackets(part) if len(part) > 1 else []
            inside = {f["id"] for run in sets for f, _ in run}
            for f in part:
                if f["bracketed"] != (f["id"] in inside):
                    f["bracketed"] = not f["bracketed"]
                    (self.taken.add if f["bracketed"] else self.taken.discard)(f["id"])
                    k = bisect_left(self.places, place(f))
                    while self.stills[k] is not f:
                        k += 1
                    moved += [k - 1, k, k + 1]
            found += sets
        runs = [run for part in self.around(moved, in_burst) if len(part) > 1 for run in bursts(part, self.taken)]
        for run in found:
            stops = {f["id"]: (f, f["stops"]) for f, _ in run}
            for f, s in run:
                f["stops"] = s
            was = {f["id"]: f["bracket"] for f, _ in run}
            self.join([f for f, _ in run], "bracket")
            for i, (f, before) in stops.items():
                if f["stops"] != before and was[i] == f["bracket"]:
                    self.put(f, "bracket", f["bracket"])
        for run in runs:
            self.join(run, "burst")
        for run in found:
            for f, _ in run:
                if f["burst"] is not None:
                    self.leave(f, "burst")
        return self.changes


def in_bracket(a: dict, b: dict) -> bool:
    return linked(steps, a, b)


def in_burst(a: dict, b: dict) -> bool:
    return not a["bracketed"] and not b["bracketed"] and linked(repeats, a, b)


def is_still(f: dict) -> bool:
    return f["kind"] != "video" and f["t"] is not None and f["frame_no"] is not None


def place(f: dict) -> tuple[str, float, str]:
    return f["dir"], f["t"], f["rel"]


HELD = [*NAMES, "burst", "bracket", "stops", "bracketed"]


def packed(shoot: Shoot) -> tuple[list, dict]:
    """A shoot as columns, of which those without a value are left out, and its sets."""
    columns = [[f[c] for f in shoot.frames] for c in HELD]
    return [None if all(x is None for x in c) else c for c in columns], shoot.outside


def unpacked(held: tuple[list, dict]) -> Shoot:
    columns, outside = held
    n = len(columns[0])
    return Shoot([dict(zip(HELD, row, strict=True)) for row in zip(*([None] * n if c is None else c for c in columns), strict=True)], outside)


def plain_column(values: pd.Series, kind: str) -> list:
    """A column of FRAME as plain Python values, missing ones as None."""
    if kind == "array<double>":
        return [None if v is None or isinstance(v, float) else [float(x) for x in v] for v in values.tolist()]
    rows = values.tolist()
    if kind in ("long", "int"):
        return [None if v is None or v != v else int(v) for v in rows]
    return [None if v is None or v != v else v for v in rows]


def told(changes: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(changes, columns=["shoot", "seq", "nth", "id", "change", "set_id", "stops"]).astype({"set_id": "Int64", "stops": "Float64"})


class Runs(StatefulProcessor):
    """The frames of a lane's shoots in the order of seq -> the changes of their sets."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk int", "shoots binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["seq", "id"])  # of one trigger
        kinds = dict(c.split() for c in FRAME.split(", "))
        seqs, shoots = arrived["seq"].tolist(), arrived["shoot"].tolist()
        # Equal strings are one, so that a chunk holds each once.
        same: dict = {}
        columns = [[same.setdefault(v, v) for v in c] if kinds[n] == "string" and n != "rel" else c for n, c in ((n, plain_column(arrived[n], kinds[n])) for n in NAMES)]
        chunks: dict[int, list] = {}
        for shoot, seq, *frame in zip(shoots, seqs, *columns, strict=True):
            chunks.setdefault(zlib.crc32(repr(shoot).encode()) % CHUNKS, []).append((shoot, int(seq), dict(zip(NAMES, frame, strict=True))))
        known = {k[0] for k in self.chunks.keys()} if self.chunks.exists() else set()
        out: list[tuple] = []
        for nth, frames in chunks.items():
            held = pickle.loads(self.chunks.getValue((nth,))[0]) if nth in known else {}
            live: dict = {}
            for shoot, seq, frame in frames:
                if shoot not in live:
                    live[shoot] = unpacked(held[shoot]) if shoot in held else Shoot([], {})
                out += [(shoot, seq, k, *change) for k, change in enumerate(live[shoot].add(frame))]
            self.chunks.updateValue((nth,), (pickle.dumps(held | {shoot: packed(x) for shoot, x in live.items()}, protocol=5),))
            if len(out) >= TOLD:
                yield told(out)
                out = []
        yield told(out)

    def close(self) -> None:
        pass


def live_runs(frames: DataFrame, lanes: int = LANES) -> DataFrame:
    """(shoot, seq, nth, id, change, set_id, stops) of frames (shoot, seq and FRAME's columns): with each arrival `seq`, the frames
    whose set of a kind (`change`: burst or bracket) is another now; a null set_id means none. Arrival is the order of seq within a
    trigger and of triggers, so nothing is late. lanes: as many as a restart has to keep."""
    kind = frames.schema["shoot"].dataType.simpleString()
    out = f"shoot {kind}, seq long, nth int, id long, change string, set_id long, stops double"
    dealt = frames.withColumn("lane", F.pmod(F.xxhash64("shoot"), F.lit(lanes)).cast("int"))
    return dealt.groupBy("lane").transformWithStateInPandas(Runs(), out, "Append", "None")


def settled(changes: DataFrame) -> DataFrame:
    """(shoot, id, burst, bracket, stops): what a frame's last changes leave it in; frames in no set are left out."""
    last = Window.partitionBy("shoot", "id", "change").orderBy(F.desc("seq"), F.desc("nth"))
    rows = changes.withColumn("_r", F.row_number().over(last)).filter("_r = 1 AND set_id IS NOT NULL")
    one = lambda kind, c: F.max(F.when(F.col("change") == kind, F.col(c)))
    return rows.groupBy("shoot", "id").agg(one("burst", "set_id").alias("burst"), one("bracket", "set_id").alias("bracket"), one("bracket", "stops").alias("stops"))
