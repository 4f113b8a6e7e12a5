"""Long time series in blocks with a halo: filters and resampling that no task does for a whole series.

A series is rows of (keys, at, value), ``at`` a whole number of steps, one row a step; steps without a row count as 0. Blocks of steps
get the samples that their results need from the neighbours, so a recording of few channels spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError


def low_pass(cut: float, half: int) -> np.ndarray:
    """Windowed-sinc taps of 2 half + 1 steps that sum to 1; cut in cycles a step."""
    k = np.arange(-half, half + 1)
    taps = 2 * cut * np.sinc(2 * cut * k) * np.hamming(2 * half + 1)
    return taps / taps.sum()


def band_taps(low: float | None, high: float | None, width: float) -> np.ndarray:
    """Taps that pass from low to high, either of which may be None; the edges are ``width`` wide. All in cycles a step."""
    if any(c is not None and not 0 < c < 0.5 for c in (low, high)) or width <= 0 or (low is not None and high is not None and low >= high):
        raise InvalidParameterError("cut-offs must rise inside (0, 0.5) and the width be positive")
    half = math.ceil(3.3 / width / 2)
    taps = np.zeros(2 * half + 1) if high is not None else np.eye(1, 2 * half + 1, half)[0]
    if high is not None:
        taps = low_pass(high, half)
    return taps - low_pass(low, half) if low is not None else taps


def in_blocks(df: DataFrame, keys: list[str], at: str, value: str, size: int, halo: int) -> DataFrame:
    """(keys, at, value, first, last, block): each row in all blocks that need it; first and last are the series' own ends. Every block between
    them has a row without ``at`` besides."""
    names = [f"__k{i}" for i in range(len(keys))]
    ends = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    rows = df.select(*keys, F.col(at).cast("long").alias(at), F.col(value).cast("double").alias(value)).where(F.col(at).isNotNull()).join(ends, same).drop(*names)
    block = lambda c: F.floor(c / F.lit(size))
    rows = rows.withColumn("block", F.explode(F.sequence(block(F.col(at) - halo), block(F.col(at) + halo))))
    own = [F.col(n).alias(k) for k, n in zip(keys, names)]
    every = ends.where(F.col("first").isNotNull()).select(*own, F.lit(None).cast("long").alias(at), F.lit(None).cast("double").alias(value), "first", "last", F.explode(F.sequence(block(F.col("first")), block(F.col("last")))).alias("block"))
    return rows.unionByName(every)


def by_block(df: DataFrame, keys: list[str], at: str, value: str, size: int, halo: int, pad: str, make: Callable) -> DataFrame:
    """(keys, at, value) of each block by ``make(x, begin, at, first, last)``: x holds the steps from begin - halo to the block's end + halo.

    Before the first and after the last step a series goes on as its own odd reflection (``reflect``, 0 once that is used up) or as 0 (``zero``).
    """
    if pad not in ("reflect", "zero"):
        raise InvalidParameterError("pad must be reflect or zero")

    def f(key: tuple, t: pa.Table) -> pa.Table:
        begin = key[-1].as_py() * size
        first, last = t.column("first")[0].as_py(), t.column("last")[0].as_py()
        t = t.filter(t.column(at).is_valid()).combine_chunks()
        steps, values = t.column(at).to_numpy(), np.nan_to_num(t.column(value).to_numpy())
        x = np.zeros(size + 2 * halo)
        if first >= begin + size or last < begin:  # neighbours only
            return pa.table([*[pa.array([], k.type) for k in key[:-1]], pa.array([], pa.int64()), pa.array([], pa.float64())], [*keys, at, value])
        np.add.at(x, steps - begin + halo, values)
        if pad == "reflect":
            low = begin - halo
            for edge, outside in ((first, np.arange(max(low, first - halo), min(first, low + len(x)))), (last, np.arange(max(low, last + 1), min(last + halo + 1, low + len(x))))):
                mirror = 2 * edge - outside
                there = (mirror >= first) & (mirror <= last)
                x[outside[there] - low] = 2 * x[edge - low] - x[mirror[there] - low] if there.any() else 0
        own = np.unique(steps[(steps >= begin) & (steps < begin + size)])
        out_at, out = make(x, begin, own, first, last)
        columns = [pa.array([k.as_py()] * len(out), k.type) for k in key[:-1]]
        return pa.table([*columns, pa.array(out_at, pa.int64()), pa.array(out, pa.float64())], [*keys, at, value])

    rows = in_blocks(df, keys, at, value, size, halo)
    kinds = ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in df.select(*keys).schema.fields)
    return rows.groupBy(*keys, "block").applyInArrow(f, f"{kinds}{', ' if kinds else ''}`{at}` long, `{value}` double")


def filtered(df: DataFrame, keys: list[str], at: str, value: str, taps: np.ndarray, pad: str = "reflect", size: int = 1 << 14) -> DataFrame:
    """The series convolved with symmetric taps, without delay: overlap-save, a Fourier product a block. Null values count as 0."""
    halo = len(taps) // 2
    size = max(size, halo, 1)
    n = 1 << (size + 4 * halo).bit_length()
    spectrum = np.fft.rfft(taps, n)

    def make(x: np.ndarray, begin: int, own: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        y = np.fft.irfft(np.fft.rfft(x, n) * spectrum, n)[2 * halo : 2 * halo + size]
        return own, y[own - begin]

    return by_block(df, keys, at, value, size, halo, pad, make)


#: The four-term cosine window of least side lobes (-92 dB): fixed values.
COSINES = (0.35875, 0.48829, 0.14128, 0.01168)


def resampled(df: DataFrame, keys: list[str], at: str, value: str, up: int, down: int, lobes: int = 32, pad: str = "reflect", size: int = 1 << 14) -> DataFrame:
    """The series at steps of down/up of its own: sample j stands at step j · down / up, for all that lie between its first and last step.

    A windowed sinc of ``lobes`` zero crossings to each side, cut at the lower of the two Nyquist frequencies. Of a signal below 0.9 of
    that the result differs from a whole-series Fourier resampling by 1e-4 of its height at most, farther than 3 · lobes · max(1, down / up) steps
    from the ends; nearer, both are extrapolations of their own.
    """
    if up < 1 or down < 1 or lobes < 1:
        raise InvalidParameterError("up, down and lobes must be positive")
    cut = min(1.0, up / down)
    halo = math.ceil(lobes / cut) + 1
    size = max(size, halo)

    def make(x: np.ndarray, begin: int, own: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = max(begin, first) * up, min((begin + size) * up - 1, last * up)
        j = np.arange(-(-low // down), high // down + 1)
        place = j * down
        whole, phase = place // up, (place % up) / up
        offsets = np.arange(1 - halo, halo + 1)
        u = phase[:, None] - offsets
        angle = np.pi * np.clip(u * cut / lobes, -1, 1)
        window = sum(a * np.cos(k * angle) for k, a in enumerate(COSINES))
        return j, (x[np.minimum(whole[:, None] - begin + halo + offsets, len(x) - 1)] * cut * np.sinc(cut * u) * window).sum(axis=1)

    return by_block(df, keys, at, value, size, halo, pad, make)
