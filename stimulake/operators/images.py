"""Image arrays cropped, resized and scaled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError, StimulusError

#: Numbers that a step of the resizing holds at once.
HELD = 1 << 22


def centre(size: int, kept: int) -> int:
    """Where a stretch of ``kept`` in the middle of ``size`` begins; halves go to the even side."""
    return round((size - kept) / 2)


def taps(old: int, new: int, antialias: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each new pixel the old ones it takes and their weights, new by taps: a triangle around its middle, as wide as the step if that is
    more than a pixel, cut at the edges and scaled to sum to 1."""
    step = old / new
    wide = max(step, 1.0) if antialias else 1.0
    middle = (np.arange(new) + 0.5) * step
    first = np.maximum(np.floor(middle - wide + 0.5).astype(int), 0)
    last = np.minimum(np.floor(middle + wide + 0.5).astype(int), old)
    at = first[:, None] + np.arange(max(1, (last - first).max()))
    w = np.maximum(1 - np.abs((at + 0.5 - middle[:, None]) / wide), 0) * (at < last[:, None])
    if not antialias:  # between the two nearest pixels, the edge one repeated
        place = np.clip(middle - 0.5, 0, old - 1)
        at = np.minimum(np.floor(place).astype(int)[:, None] + np.arange(2), old - 1)
        w = np.column_stack([1 - place % 1, place % 1])
    return np.minimum(at, old - 1), w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, antialias: bool = True) -> np.ndarray:
    """Rows by columns by channels to another size: along columns, then along rows, a block of new rows after the other."""
    (rows, row_weights), (columns, column_weights) = taps(image.shape[0], height, antialias), taps(image.shape[1], width, antialias)
    out = np.empty((height, width, image.shape[2]))
    block = max(1, HELD // max(1, rows.shape[1] * width * image.shape[2]))
    for begin in range(0, height, block):
        own = rows[begin : begin + block]
        low, high = own.min(), own.max() + 1
        part = image[low:high].astype(float)
        along = sum(part[:, columns[:, t]] * column_weights[:, t, None] for t in range(columns.shape[1]))
        out[begin : begin + block] = sum(along[own[:, t] - low] * row_weights[begin : begin + block, t, None, None] for t in range(own.shape[1]))
    return out


def prepared(df: DataFrame, keys: list[str], data: str, height: str, width: str, channels: int, size: int | tuple[int, int], crop: bool = True, antialias: bool = True, divide: float = 255.0, mean: tuple[float, ...] = (), scale: tuple[float, ...] = ()) -> DataFrame:
    """(keys, values): images as arrays, channel after channel, row by row.

    An image is an array of height by width by channels. Its middle square is cut out (if ``crop``), resized to ``size`` (one number or rows and
    columns), divided, and each channel's mean is taken off and its scale divided by. Images with a null, of no size, or whose numbers don't
    fit their size are an error naming them, as a model would have no answer; rows without an image are left out.
    """
    out_height, out_width = (size, size) if isinstance(size, int) else size
    if min(out_height, out_width, channels) < 1 or any(len(v) not in (0, channels) for v in (mean, scale)):
        raise InvalidParameterError("sizes must be positive and means and scales be given for each channel")
    shift, unit = np.array(mean or [0.0] * channels), np.array(scale or [1.0] * channels)
    chosen = df.select(*keys, height, width, data).where(F.col(data).isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            for i in range(b.num_rows):
                h, w, raw = b.column(n - 3)[i].as_py(), b.column(n - 2)[i].as_py(), b.column(n - 1).slice(i, 1).flatten()
                if not h or not w or len(raw) != h * w * channels or raw.null_count:
                    raise StimulusError(f"image {[b.column(c)[i].as_py() for c in range(n - 3)]} is not {h} by {w} by {channels} numbers")
                image = raw.to_numpy(zero_copy_only=False).reshape(h, w, channels)
                if crop:
                    side = min(h, w)
                    top, left = centre(h, side), centre(w, side)
                    image = image[top : top + side, left : left + side]
                done = (resize(image, out_height, out_width, antialias) / divide - shift) / unit
                values = pa.ListArray.from_arrays(pa.array([0, done.size], pa.int32()), pa.array(done.transpose(2, 0, 1).ravel()))
                yield pa.record_batch([*[b.column(c).slice(i, 1) for c in range(n - 3)], values], [*keys, "values"])

    return chosen.mapInArrow(f, f"{kinds}{', ' if kinds else ''}values array<double>")
