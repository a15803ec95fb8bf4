"""Measures of pictures and frame runs, as functions of arrays and as pandas UDFs over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILES = 8


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def laplacian_variance(gray: np.ndarray) -> float:
    g = gray.astype(float)
    inner = g[1:-1, 1:-1]
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * inner).var()) if min(g.shape) > 2 else 0.0


def sharpness_tiles(gray: np.ndarray, grid: int = TILES) -> tuple[float, float]:
    """90th percentile and maximum of the tiles' variance of the Laplacian."""
    rows, columns = np.array_split(np.arange(gray.shape[0]), grid), np.array_split(np.arange(gray.shape[1]), grid)
    v = [laplacian_variance(gray[r[0] : r[-1] + 1, c[0] : c[-1] + 1]) for r in rows for c in columns if len(r) and len(c)]
    return float(np.percentile(v, 90)), float(max(v))


def light_level(gray: np.ndarray) -> float:
    """Mean linear light, 0 to 1."""
    x = gray.astype(float) / 255
    return float(np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4).mean())


def clipped_share(gray: np.ndarray, top: int = 254) -> float:
    return float((gray >= top).mean())


def perceptual_hash(gray: np.ndarray, side: int = 32, keep: int = 8) -> int:
    """64 bits: signs of the low frequencies of a cosine transform against their median."""
    ys, xs = np.linspace(0, gray.shape[0] - 1, side).astype(int), np.linspace(0, gray.shape[1] - 1, side).astype(int)
    small = gray[np.ix_(ys, xs)].astype(float)
    k = np.arange(side)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:keep, None] / (2 * side))
    low = (basis @ small @ basis.T).ravel()
    return int(sum(1 << i for i, on in enumerate(low > np.median(low[1:])) if on))


def slog3_to_linear(code: np.ndarray) -> np.ndarray:
    """Scene light of S-Log3 code values from 0 to 1, by its published curve."""
    x = np.asarray(code, float) * 1023
    return np.where(x >= 171.2102946929, 10 ** ((x - 420) / 261.5) * (0.18 + 0.01) - 0.01, (x - 95) * 0.01125 / (171.2102946929 - 95))


def rec709(linear: np.ndarray) -> np.ndarray:
    x = np.clip(linear, 0, 1)
    return np.where(x < 0.018, 4.5 * x, 1.099 * x**0.45 - 0.099)


def flicker(frames: np.ndarray, fps: float, mains: tuple[int, ...] = (100, 120), snr: float = 8.0) -> dict:
    """kind, hz and strength of a lamp's flicker in a run of frames (n, h, w).

    A line at the alias of a lamp's frequency in the spectrum of the mean light, after a quadratic trend is removed and
    the run windowed, must stand out from its surroundings in most tiles as well.
    """
    f = np.asarray(frames, float)
    n = len(f)
    if n < 24 or not fps:
        return {"kind": "unknown", "hz": None, "strength": None}
    t = np.linspace(-1, 1, n)

    def spectrum(x: np.ndarray) -> np.ndarray:
        x = x - np.polyval(np.polyfit(t, x, 2), t)
        return np.abs(np.fft.rfft(x * np.hanning(n)))

    def stands_out(power: np.ndarray, at: int) -> float:
        around = np.r_[power[max(2, at - 12) : max(2, at - 2)], power[at + 3 : at + 13]]
        return float(power[max(0, at - 1) : at + 2].max() / (np.median(around) + 1e-9)) if len(around) else 0.0

    mean = f.mean(axis=(1, 2))
    whole = spectrum(mean)
    tiles = [spectrum(x.mean(axis=(1, 2))) for half in np.array_split(f, 3, axis=1) for x in np.array_split(half, 3, axis=2)]
    best = None
    for light in mains:
        alias = abs(light - round(light / fps) * fps)
        at = round(alias * n / fps)
        if 3 <= at < len(whole) - 1 and (s := stands_out(whole, at)) >= snr and sum(stands_out(x, at) >= snr / 2 for x in tiles) > len(tiles) / 2:
            strength = float(4 * whole[max(0, at - 1) : at + 2].max() / n / max(mean.mean(), 1e-9))
            if best is None or strength > best["strength"]:
                best = {"kind": f"mains {light // 2}", "hz": float(alias), "strength": strength}
    return best or {"kind": "none", "hz": None, "strength": None}


@F.pandas_udf(_struct("tile_p90", "tile_max", "level", "clipped"))
def measured(pixels: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Measures of grey pictures given as flat arrays with their height."""
    rows = []
    for p, h in zip(pixels, height, strict=True):
        g = np.asarray(p, float).reshape(int(h), -1)
        rows.append((*sharpness_tiles(g), light_level(g), clipped_share(g)))
    return pd.DataFrame(rows, columns=["tile_p90", "tile_max", "level", "clipped"])


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), *_struct("hz", "strength")]))
def flicker_of(frames: pd.Series, shape: pd.Series, fps: pd.Series) -> pd.DataFrame:
    """Verdicts on frame runs given as flat arrays with (n, h, w)."""
    return pd.DataFrame([flicker(np.asarray(f, float).reshape(*map(int, s)), r) for f, s, r in zip(frames, shape, fps, strict=True)], columns=["kind", "hz", "strength"])


def judge_takes(frames: pd.DataFrame, similarity: np.ndarray, retake: float = 0.78) -> pd.DataFrame:
    """(id, group, reason, keep) of a variant's frames (id, sharp, blown, crushed): retakes are grouped by framing; blown,
    crushed and soft frames are rejected in that order; of each group the best is kept."""
    from tessella.operators.cluster import average_linkage

    group = average_linkage(1 - similarity, 1 - retake)
    x = frames.assign(group=group)
    ref = x[(x.blown < 0.14) & (x.crushed < 0.12)].groupby("group")["sharp"].max()
    alone = x.groupby("group")["id"].transform("size") < 2
    high = float(np.percentile(x["sharp"], 75))
    base = np.where(alone, np.maximum(high, x["sharp"]), x["group"].map(ref).fillna(x["sharp"]))
    rel = x["sharp"] / np.maximum(base, 1e-9)
    x["score"] = np.minimum(rel, 1) - 0.5 * x["blown"] - 0.5 * x["crushed"]
    x["reason"] = np.select([x.blown >= 0.14, x.crushed >= 0.12, rel < 0.72], ["blown", "crushed", "soft"], "keep")
    order = x.sort_values(["score", "id"], ascending=[False, True])
    first = order[order.reason == "keep"].drop_duplicates("group")["id"]
    x.loc[(x.reason == "keep") & ~x["id"].isin(first), "reason"] = "retake"
    return x.assign(keep=x.reason == "keep")[["id", "group", "reason", "keep", "score"]]
