"""Search over receptive-field candidates and ridge penalties per unit, and predictions by each unit's own best.

The maps are read once: tasks pool them through every candidate and add up Gram blocks, keyed by candidate and block of units. Executors solve
each candidate's Gram block for all penalties from one symmetric decomposition; of each unit only the losses travel to find its best, then the winners' weights are solved
again. Candidates times pixels are the search's own configuration and are sent to tasks once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameterError
from .blocks import HELD, batches_of, doubles, summed
from .fields import gaussian_mass_stack, weight_arrays
from .written import written

#: Units of a block, and numbers that candidates times pixels may have.
UNITS, CONFIGURATION = 1024, 1 << 27


def field_weights(spark: SparkSession, candidates: DataFrame, sides: list[int], aperture: float) -> list[np.ndarray]:
    """For each map size the pixels' masses of all candidates (model, x, y, sigma), in order of model: candidates by pixels."""
    found = candidates.orderBy("model").collect()
    if [r["model"] for r in found] != list(range(len(found))):
        raise InvalidParameterError("models must be numbered from 0")
    if len(found) * sum(s * s for s in sides) > CONFIGURATION:
        raise InvalidParameterError("too many candidates times pixels for one search; split the candidates")
    rfs = [(float(r["x"]), float(r["y"]), float(r["sigma"])) for r in found]
    return [np.array(weight_arrays(gaussian_mass_stack(spark, s, rfs, aperture))) for s in sides]


def pooled(a: np.ndarray, weights: list[np.ndarray], layers: list[tuple[int, int]], model: int) -> np.ndarray:
    """Features of one candidate: rows by channels of all layers, whose maps stand one after the other in a row."""
    out, at = [], 0
    for w, (channels, side) in zip(weights, layers):
        n = channels * side * side
        out.append(a[:, at : at + n].reshape(len(a), channels, side * side) @ w[model])
        at += n
    return np.hstack(out)


def gram_blocks(df: DataFrame, x: str, y: str, held: str, weights: list[np.ndarray], layers: list[tuple[int, int]], nonlinearity=None) -> DataFrame:
    """(model, ublock, m): sums over rows of z zᵀ for training and held-out rows, of z yᵀ for both, and of y² for held-out rows, z being a 1
    and the pooled features; y in blocks of UNITS. Candidates whose sums don't fit a task together are summed in another reading."""
    p = 1 + sum(c for c, _ in layers)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def rows_of(models: range):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for (model, block), m in sums.items():
                    yield pa.record_batch([pa.array([model], pa.int64()), pa.array([block], pa.int64()), pa.array([m.tobytes()], pa.binary())], ["model", "ublock", "m"])
                sums.clear()

            for b in batches:
                if not b.num_rows:
                    continue
                a, v, out_rows = doubles(b.column(0)), doubles(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for model in models:
                    f = pooled(a, shared.value, layers, model)
                    z = np.hstack([np.ones((len(a), 1)), nonlinearity(f) if nonlinearity else f])
                    train, test = z[~out_rows], z[out_rows]
                    grams = [(train.T @ train).ravel(), (test.T @ test).ravel()]
                    for s in range(0, v.shape[1], UNITS):
                        own, rest = v[~out_rows, s : s + UNITS], v[out_rows, s : s + UNITS]
                        m = np.concatenate([*grams, (train.T @ own).ravel(), (test.T @ rest).ravel(), (rest * rest).sum(axis=0)])
                        key = (model, s // UNITS)
                        sums[key] = sums[key] + m if key in sums else m
                if sum(m.nbytes for m in sums.values()) > 2 * HELD:
                    yield from out()
            yield from out()

        return rows

    together = max(1, HELD // (8 * (2 * p * p + 2 * p * UNITS)))
    n = len(weights[0])
    chosen = df.select(x, y, F.col(held).cast("boolean").alias(held)).dropna()
    return summed(reduce(DataFrame.unionByName, [chosen.mapInArrow(rows_of(range(k, min(n, k + together))), "model long, ublock long, m binary") for k in range(0, n, together)]), ["model", "ublock"])


def solved(sums: DataFrame, p: int, penalties: list[float], zscore: bool, full: bool) -> DataFrame:
    """(unit, model, penalty, loss) of each unit's best penalty for each candidate, the earliest among equals; ``full`` adds the weights."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model, block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                m = np.frombuffer(raw.as_py())
                units = (len(m) - 2 * p * p) // (2 * p + 1)
                g, h, gy, hy, yy = (part.reshape(p, -1) if i < 4 else part for i, part in enumerate(np.split(m, np.cumsum([p * p, p * p, p * units, p * units]))))
                n = g[0, 0] + h[0, 0]
                mean = (g[0, 1:] + h[0, 1:]) / n
                sd = np.sqrt(np.maximum((np.diag(g) + np.diag(h))[1:] / n - mean * mean, 0)) + 1e-6
                t = np.eye(p)
                if zscore:  # from features to their z-scores over all rows
                    t[0, 1:], t[range(1, p), range(1, p)] = -mean / sd, 1 / sd
                g, h, gy, hy = t.T @ g @ t, t.T @ h @ t, t.T @ gy, t.T @ hy
                losses, betas = [], []
                values, vectors = np.linalg.eigh(g)  # once for all penalties
                turned = vectors.T @ gy
                for penalty in penalties:
                    d = values + penalty
                    there = d > 1e-13 * np.abs(d).max()  # without a penalty features may depend on each other
                    beta = vectors[:, there] @ (turned[there] / d[there, None])
                    losses.append(yy - 2 * (beta * hy).sum(axis=0) + (beta * (h @ beta)).sum(axis=0))
                    betas.append(beta)
                losses = np.array(losses)
                best = losses.argmin(axis=0)
                columns = [pa.array(np.arange(units) + block * UNITS), pa.array(np.full(units, model)), pa.array(np.array(penalties)[best]), pa.array(losses.min(axis=0))]
                if full:
                    w = np.array(betas)[best, :, np.arange(units)]
                    repeat = lambda v: batches_of(np.broadcast_to(v, (units, p - 1)))
                    columns += [batches_of(w[:, 1:]), pa.array(w[:, 0]), *([repeat(mean), repeat(sd)] if zscore else [repeat(np.zeros(p - 1)), repeat(np.ones(p - 1))])]
                yield pa.record_batch(columns, NAMES[: len(columns)])

    return sums.select("model", "ublock", "m").mapInArrow(rows, KINDS if full else KINDS.split(", coef")[0])


KINDS = "unit long, model long, penalty double, loss double, coef array<double>, intercept double, mean array<double>, sd array<double>"
NAMES = [x.split()[0] for x in KINDS.split(", ")]


def search(df: DataFrame, x: str, y: str, held: str, weights: list[np.ndarray], layers: list[tuple[int, int]], penalties: list[float], zscore: bool = True, nonlinearity=None) -> DataFrame:
    """Each unit's best candidate: unit, model, penalty, loss, coef, intercept, mean, sd.

    x holds a row's maps, layers of (channels, side); y its responses, one a unit; rows with ``held`` choose, the others train. Features are
    z-scored over all rows (deviation plus 1e-6), a 1 stands in front, and the penalty holds for it too. The loss is the squared error over
    held-out rows; of equal losses the first penalty and the first candidate win. A nonlinearity takes the pooled features, rows by features.
    Rows with a null array or a null ``held`` don't count; a table without rows gives no units.
    """
    p = 1 + sum(c for c, _ in layers)
    sums = written(gram_blocks(df, x, y, held, weights, layers, nonlinearity), "grams")
    best = solved(sums, p, penalties, zscore, False).groupBy("unit").agg(F.min(F.struct("loss", "model")).alias("b")).select("unit", F.col("b.model").alias("model"))
    best = written(best, "best")
    wanted = best.select("model", F.floor(F.col("unit") / UNITS).alias("ublock")).distinct()
    return solved(sums.join(wanted, ["model", "ublock"], "left_semi"), p, penalties, zscore, True).join(best, ["unit", "model"]).select(*NAMES)


def predict(df: DataFrame, keys: list[str], x: str, models: DataFrame, weights: list[np.ndarray], layers: list[tuple[int, int]], nonlinearity=None, rows_together: int = 512) -> DataFrame:
    """(keys, unit, value): each unit from its own candidate's features, z-score and weights, as ``search`` gives them.

    Units of a candidate share a block, a candidate of many units has several; blocks of rows meet blocks of units once, as in a product.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)
    own = models.groupBy("model").agg(F.count("*").alias("n"))
    total, n_rows = models.count(), df.count()
    share = F.pmod(F.xxhash64("unit"), F.ceil(F.col("n") / UNITS))
    right = models.join(own, "model").withColumn("ublock", F.pmod(F.xxhash64("model", share), F.lit(max(1, -(-total // UNITS)))))
    row_blocks, unit_blocks = max(1, -(-n_rows // rows_together)), max(1, -(-total // UNITS))
    right = right.select("ublock", "unit", "model", "coef", "intercept", "mean", "sd", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rblock"))
    left = df.select(*keys, x).where(F.col(x).isNotNull()).withColumn("rblock", F.pmod(F.xxhash64(*keys), F.lit(row_blocks))).withColumn("ublock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(unit_blocks - 1).cast("long"))))
    names = [*keys, "unit", "value"]

    def rows(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        parts = [pa.table([*[a.column(k).slice(0, 0) for k in range(len(keys))], b.column("unit").slice(0, 0), pa.array([], pa.float64())], names)]
        if a.num_rows and b.num_rows:
            maps, column = doubles(pa.concat_arrays(a.column(x).chunks)), lambda t, c: pa.concat_arrays(t.column(c).chunks)
            model = b.column("model").to_numpy()
            for m in np.unique(model):
                u = b.filter(pa.array(model == m))
                f = pooled(maps, shared.value, layers, m)
                f = nonlinearity(f) if nonlinearity else f
                z = (f - doubles(column(u, "mean"))[0]) / doubles(column(u, "sd"))[0]
                value = z @ doubles(column(u, "coef")).T + u.column("intercept").to_numpy()
                at = pa.array(np.repeat(np.arange(len(maps)), u.num_rows))
                parts.append(pa.table([*[a.column(k).take(at) for k in range(len(keys))], pa.chunked_array([column(u, "unit").take(pa.array(np.tile(np.arange(u.num_rows), len(maps))))]), pa.array(value.ravel())], names))
        return pa.concat_tables(parts)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return left.groupBy("rblock", "ublock").cogroup(right.groupBy("rblock", "ublock")).applyInArrow(rows, f"{kinds}, unit long, value double")
