"""Backdrop and subject of many small pictures at once, held as array columns.

A picture is h x w pixels of some channels, row by row. Its backdrop is a plane over the picture's place in each channel, fitted to the
pixels of its border by least squares; border pixels that the subject covers are trimmed twice by their residual. What stands
off the plane, without specks, is the subject: its connected parts (touching corners count) of a least size.

A task works on Arrow batches as tensors of pictures of one shape: the equations of all of them are solved together, and parts grow in
all of them together, so no picture is a loop of its own. Nothing is shuffled.

Defined results: a picture that is null, of another length than h x w x channels, or holds null or non-finite numbers has no subject and
null figures; one that is all backdrop has `share` 0 and no parts; pictures smaller than three pixels a side are all border. Other columns
are passed through in `row`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distance from the backdrop from which a pixel is the subject's, least residual that is trimmed, and the share of residuals kept.
OFF, LEAST_TRIM, KEPT = 14.0, 4.0, 60.0
#: Least shares of a picture that a part and the subject have; fewest border pixels that a plane is fitted to.
PART_SHARE, SUBJECT_SHARE, FEWEST = 0.002, 0.005, 8
#: Numbers of a tensor.
AT_ONCE = 2_000_000


def border(h: int, w: int, ring: int) -> np.ndarray:
    edge = np.ones((h, w), bool)
    edge[ring : h - ring, ring : w - ring] = False
    return edge


def design(h: int, w: int) -> np.ndarray:
    """1, x / w and y / h of every pixel."""
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([np.ones(h * w), x.ravel() / w, y.ravel() / h], 1)


def planes(pictures: np.ndarray, ring: int, least_trim: float = LEAST_TRIM) -> np.ndarray:
    """Coefficients (n, 3, channels) of the backdrops of pictures (n, h, w, channels)."""
    n, h, w, c = pictures.shape
    edge = border(h, w, ring).ravel()
    a, y = design(h, w)[edge], pictures.reshape(n, h * w, c)[:, edge]
    keep = np.ones((n, len(a)), bool)
    coef = np.zeros((n, 3, c))
    open_ = np.arange(n)
    for _ in range(3):
        if not len(open_):
            break
        weight = keep[open_].astype(float)
        gram = np.einsum("nm,mi,mj->nij", weight, a, a)
        right = np.einsum("nm,mi,nmc->nic", weight, a, y[open_])
        # The pseudo-inverse, as least squares of a border that is cut down to one line has many solutions.
        coef[open_] = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ right
        off = np.sqrt(((a @ coef[open_] - y[open_]) ** 2).sum(-1))
        keep[open_] = off <= np.maximum(np.percentile(off, KEPT, axis=1), least_trim)[:, None]
        open_ = open_[keep[open_].sum(1) >= FEWEST]
    return coef


def shifted(m: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """Each picture moved by a step; what comes in is `fill`."""
    out = np.full_like(m, fill)
    h, w = m.shape[1:]
    out[:, max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = m[:, max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def without_specks(mask: np.ndarray) -> np.ndarray:
    """Opening by squares of two pixels: what no such square fits into goes."""
    inner = mask & shifted(mask, 0, -1, False) & shifted(mask, -1, 0, False) & shifted(mask, -1, -1, False)
    return inner | shifted(inner, 0, 1, False) | shifted(inner, 1, 0, False) | shifted(inner, 1, 1, False)


def parts(mask: np.ndarray) -> np.ndarray:
    """For each pixel of (n, h, w) masks the largest place in its connected part, from 1; 0 outside.

    Places spread to all eight neighbours, and along whole rows and columns of a part at once: a part takes as many steps as it has turns.
    """
    n, h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(1, h, w), 0)
    while True:
        before = label
        for axis in (1, 2):
            for turn in (slice(None), slice(None, None, -1)):
                label = run_max(label[(slice(None),) * axis + (turn,)], mask[(slice(None),) * axis + (turn,)], axis)[(slice(None),) * axis + (turn,)]
        around = np.maximum.reduce([shifted(label, dy, dx, 0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        label = np.where(mask, around, 0)
        if (label == before).all():
            return label


def run_max(label: np.ndarray, mask: np.ndarray, axis: int) -> np.ndarray:
    """The largest label so far in each run of the mask along an axis."""
    label, mask = np.moveaxis(label, axis, -1), np.moveaxis(mask, axis, -1)
    # Each run lies above all runs before it, so that a running maximum starts anew with it.
    run = np.cumsum(~mask, axis=-1)
    step = label.max(initial=0) + 1
    top = np.maximum.accumulate(label + run * step, axis=-1) - run * step
    return np.moveaxis(np.where(mask, top, 0), -1, axis)


def subjects(pictures: np.ndarray, ring: int, off: float = OFF, least_trim: float = LEAST_TRIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks (n, h, w) of the subjects, how many parts each has, and the backdrops' coefficients."""
    n, h, w, c = pictures.shape
    coef = planes(pictures, ring, least_trim)
    far = np.sqrt(((pictures.reshape(n, h * w, c) - design(h, w) @ coef) ** 2).sum(-1)).reshape(n, h, w)
    mask = without_specks(far > off)
    label = parts(mask)
    sizes = np.zeros((n, h * w + 1), np.int64)
    np.add.at(sizes, (np.arange(n)[:, None], label.reshape(n, -1)), 1)
    sizes[:, 0] = 0
    large = sizes >= max(1.0, PART_SHARE * h * w)
    mask = np.take_along_axis(large, label.reshape(n, -1), 1).reshape(n, h, w) & mask
    none = mask.mean(axis=(1, 2)) < SUBJECT_SHARE
    mask[none] = False
    return mask, np.where(none, 0, large.sum(1)), coef


def subject_masks(df: DataFrame, pixels: str, h: int, w: int, channels: int = 1, *, ring: int = 1, off: float = OFF, least_trim: float = LEAST_TRIM) -> DataFrame:
    """df's columns in a struct `row`, and of each picture: mask (row by row), share, parts, box (y0, y1, x0, x1, ends exclusive; null without
    a subject) and plane (1, x, y of each channel)."""
    size = h * w * channels
    packed = df.select(F.struct("*").alias("row"), F.col(pixels).cast("array<double>").alias("p"))
    out = "mask array<boolean>, share double, parts int, box array<int>, plane array<double>"
    empty = packed.select("row", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in out.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), max(1, AT_ONCE // size)):
                part = batch.slice(start, max(1, AT_ONCE // size))
                found = [x.as_py() for x in part.column(1)]
                sound = [i for i, v in enumerate(found) if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
                columns: list[list] = [[None] * len(found) for _ in range(5)]
                if sound:
                    tensor = np.array([found[i] for i in sound]).reshape(-1, h, w, channels)
                    mask, n, coef = subjects(tensor, ring, off, least_trim)
                    for k, i in enumerate(sound):
                        ys, xs = np.nonzero(mask[k])
                        box = [int(ys.min()), int(ys.max()) + 1, int(xs.min()), int(xs.max()) + 1] if len(ys) else None
                        for column, v in zip(columns, (mask[k].ravel().tolist(), float(mask[k].mean()), int(n[k]), box, coef[k].T.ravel().tolist()), strict=True):
                            column[i] = v
                kinds = [pa.list_(pa.bool_()), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["row", *[c.split()[0] for c in out.split(", ")]])

    return packed.mapInArrow(run, empty.schema)
