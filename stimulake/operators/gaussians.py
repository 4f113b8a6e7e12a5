"""Fits of a turned Gaussian to maps, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import batches_of, doubles

#: What a fit that fails gives as parameters and as errors: fixed values.
FAILED = (0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)
#: Maps that take their steps together; steps before a fit counts as failed.
TOGETHER, STEPS = 256, 400
#: Share of the cost below which a step's gain counts as none.
TOLERANCE = 1e-10


def surface(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives of maps with parameters (log amplitude, x0, y0, log width along and across, turn, offset), a row a map."""
    a, x0, y0, sx, sy, turn, offset = (v[:, None] for v in p.T)
    dx, dy = x - x0, y - y0
    c, s = np.cos(turn), np.sin(turn)
    along, across = c * dx - s * dy, s * dx + c * dy
    u, v = np.exp(-2 * sx) / 2, np.exp(-2 * sy) / 2
    e = np.exp(a - u * along**2 - v * across**2)
    slope_x, slope_y = 2 * (u * along * c + v * across * s), 2 * (v * across * c - u * along * s)
    return offset + e, np.stack([e, e * slope_x, e * slope_y, 2 * u * e * along**2, 2 * v * e * across**2, 2 * e * along * across * (u - v), np.ones_like(e)], axis=-1)


def first_guess(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The greatest value, and centre and spread of what exceeds the mean."""
    w = np.maximum(z - z.mean(axis=1, keepdims=True), 0)
    total = w.sum(axis=1)
    x0, y0 = (w * x).sum(axis=1) / total, (w * y).sum(axis=1) / total
    sx = np.sqrt((w * (x - x0[:, None]) ** 2).sum(axis=1) / total)
    sy = np.sqrt((w * (y - y0[:, None]) ** 2).sum(axis=1) / total)
    return np.column_stack([z.max(axis=1), x0, y0, np.log(sx), np.log(sy), np.zeros(len(z)), np.zeros(len(z))])


def fit_batch(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, their standard errors and the root of the squared residuals' sum of each map, by damped least squares.

    Each map has a damping of its own and leaves the batch when it has converged; one that doesn't within STEPS steps has failed.
    """
    n, m = z.shape
    with np.errstate(all="ignore"):
        p = first_guess(z, x, y)
        damping, done, failed = np.full(n, 1e-3), np.zeros(n, bool), ~np.isfinite(p).all(axis=1)
        value, _ = surface(p, x, y)
        cost = ((z - value) ** 2).sum(axis=1)
        failed |= ~np.isfinite(cost)
        for _ in range(STEPS):
            at = np.flatnonzero(~done & ~failed)
            if not len(at):
                break
            value, slope = surface(p[at], x, y)
            residual = z[at] - value
            square = np.einsum("bmi,bmj->bij", slope, slope)
            right = np.einsum("bmi,bm->bi", slope, residual)
            diagonal = np.maximum(np.einsum("bii->bi", square), 1e-12)
            lead = square.copy()
            lead[:, range(7), range(7)] += damping[at, None] * diagonal
            step = np.full((len(at), 7), np.nan)
            solvable = np.isfinite(lead).all(axis=(1, 2)) & np.isfinite(right).all(axis=1)
            try:
                step[solvable] = np.linalg.solve(lead[solvable], right[solvable][:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                for i in np.flatnonzero(solvable):
                    step[i] = np.linalg.lstsq(lead[i], right[i], rcond=None)[0]
            trial = p[at] + step
            after = ((z[at] - surface(trial, x, y)[0]) ** 2).sum(axis=1)
            better = np.isfinite(after) & (after <= cost[at])
            small = np.abs(step).max(axis=1) < 1e-8 * (1 + np.abs(p[at]).max(axis=1))
            # As usual: both what a step gains and what it promises are small beside the cost, or the step is small.
            promised = (step * (right + damping[at, None] * diagonal * step)).sum(axis=1)
            done[at[better & ((np.maximum(cost[at] - after, promised) <= TOLERANCE * cost[at]) | small)]] = True
            done[at[cost[at] <= 1e-28 * (z[at] ** 2).sum(axis=1)]] = True
            p[at[better]], cost[at[better]] = trial[better], after[better]
            damping[at] = np.where(better, np.maximum(damping[at] * 0.3, 1e-12), damping[at] * 5)
            done[at[~better & (damping[at] > 1e12)]] = True  # no direction leads down
        failed |= ~done
        _, slope = surface(p, x, y)
        square = np.einsum("bmi,bmj->bij", slope, slope)
        error = np.full((n, 7), np.inf)
        for i in np.flatnonzero(~failed):
            if np.isfinite(square[i]).all() and np.linalg.cond(square[i]) < 1e15 and m > 7:
                error[i] = np.sqrt(np.diag(np.linalg.inv(square[i])) * cost[i] / (m - 7))
    p[failed], error[failed] = FAILED, FAILED
    return p, error, np.where(failed, -1.0, np.sqrt(cost))


def fit_maps(df: DataFrame, keys: list[str], x: str, rows: int, columns: int) -> DataFrame:
    """(keys, params, errors, residual): a turned Gaussian for each map, given row by row, one wide and high and centred; y points up.

    params are log amplitude, centre x and y, log widths, turn and offset; errors their standard errors (infinite where the map doesn't
    determine them); residual the root of the squared residuals' sum. A fit that fails (no spread, no convergence) gives the fixed values
    FAILED and a residual of -1. Maps with a null or of another size fail too. Each map is fitted by itself, so batches don't matter.
    """
    gx, gy = np.meshgrid(np.linspace(-0.5, 0.5, columns), np.linspace(-0.5, 0.5, rows)[::-1])
    gx, gy = gx.ravel(), gy.ravel()
    schema = df.select(*keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, TOGETHER):
                part = b.slice(begin, TOGETHER)
                maps = part.column(part.num_columns - 1)
                whole = (maps.value_lengths().to_numpy(zero_copy_only=False) == len(gx)).nonzero()[0]
                z = doubles(maps.take(pa.array(whole)), len(gx))
                p, e, r = np.tile(FAILED, (part.num_rows, 1)), np.tile(FAILED, (part.num_rows, 1)), np.full(part.num_rows, -1.0)
                if len(whole):
                    p[whole], e[whole], r[whole] = fit_batch(z, gx, gy)
                yield pa.record_batch([*[part.column(i) for i in range(part.num_columns - 1)], batches_of(p), batches_of(e), pa.array(r)], [*keys, "params", "errors", "residual"])

    return df.select(*keys, x).mapInArrow(f, f"{kinds}{', ' if kinds else ''}params array<double>, errors array<double>, residual double")
