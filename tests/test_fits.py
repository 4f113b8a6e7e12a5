"""Block products, components, least squares and the field search against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimulake.errors import InvalidParameterError
from stimulake.operators import blocks, candidates, linalg, wide
from stimulake.operators.fields import gaussian_mass_stack, weight_arrays


def rows_of(spark, a, name="x", parts=5):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"stim long, {name} array<double>").repartition(parts)


@pytest.mark.parametrize("columns,size", [(4096, None), (4096, 7), (16, None), (16, 7)])
def test_product_in_any_blocks(spark, columns, size):
    rng = np.random.default_rng(1)
    a, w = rng.normal(size=(101, 50)), rng.normal(size=(30, 50))
    got = np.full((101, 30), np.nan)
    rows = rows_of(spark, a).unionByName(spark.createDataFrame([(999, None)], "stim long, x array<double>"))
    for r in blocks.product(rows, ["stim"], "x", rows_of(spark, w, "w").withColumnRenamed("stim", "unit"), columns, size).collect():
        got[r["stim"], r["units"]] = r["values"]
    assert np.allclose(got, a @ w.T, rtol=0, atol=1e-12)


def test_product_edges(spark):
    weights = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [0.5, 0.0])], "unit string, w array<double>")
    rows = spark.createDataFrame([(None, [1.0, 1.0]), (None, [1.0, 1.0]), (3, [2.0, 0.0])], "k long, x array<double>")
    assert sorted(map(str, blocks.product(rows, ["k"], "x", weights).collect())) == sorted(
        map(str, [*[r for r in spark.createDataFrame([(None, 0, ["a", "b"], [0.5, 3.0]), (None, 0, ["a", "b"], [0.5, 3.0]), (3, 0, ["a", "b"], [1.0, 2.0])], "k long, ublock long, units array<string>, values array<double>").collect()]])
    )
    assert blocks.product(rows.limit(0), ["k"], "x", weights).count() == 0
    assert blocks.product(rows, ["k"], "x", weights.limit(0)).count() == 0
    with pytest.raises(Exception, match="same length"):
        blocks.product(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k long, x array<double>"), ["k"], "x", weights).collect()


def test_triangles_and_outer_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(90, 6)), rng.normal(size=(90, 3))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "x array<double>, y array<double>").repartition(7)
    r = blocks.r_factor(df, ["x", "y"], ones=True)
    whole = np.column_stack([np.ones(90), a, b])
    assert np.allclose(r.T @ r, whole.T @ whole)
    sums = {r["j"]: np.frombuffer(r["m"]).reshape(-1, 3) for r in blocks.outer_sums(df, "x", "y", columns=4).collect()}
    assert np.allclose(np.vstack([sums[0], sums[1]]), a.T @ b)


@pytest.mark.parametrize("standardise", [False, True])
def test_components_against_svd(spark, standardise):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 8)) * [9, 7, 5, 4, 3, 2, 1.5, 1] @ rng.normal(size=(8, 120)) + 0.01 * rng.normal(size=(300, 120)) + 50 * rng.normal(size=120)
    a[:, 5] = 7.0  # constant
    df = rows_of(spark, a)
    c = wide.components(df, ["stim"], "x", 4, standardise=standardise)
    sd = a.std(axis=0)
    z = (a - a.mean(axis=0)) / (np.where(sd > 0, sd, 1) if standardise else 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    vt = vt[:4] * np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)])[:, None]
    got = np.array([r["scores"] for r in c.scores(df, "x", ["stim"]).orderBy("stim").collect()])
    assert np.allclose(got, z @ vt.T, atol=1e-6 * s[0]) and np.allclose(c.variances, s[:4] ** 2 / 300) and np.allclose(c.shares, s[:4] ** 2 / (s**2).sum())


def test_components_in_column_blocks(spark, monkeypatch):
    """Wider than a block, fewer rows than columns, and fewer than asked for."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 9000))
    df = rows_of(spark, a, parts=3)
    c = wide.components(df, ["stim"], "x", 40)
    z = a - a.mean(axis=0)
    s = np.linalg.svd(z, compute_uv=False)
    assert len(c.variances) == 11 and np.allclose(c.variances, s[:11] ** 2 / 12)
    got = np.array([r["scores"] for r in c.scores(df, "x", ["stim"]).orderBy("stim").collect()])
    assert np.allclose(got @ got.T, z @ z.T, atol=1e-6)
    assert wide.components(df.limit(0), ["stim"], "x", 3).variances.size == 0


def test_least_squares_of_nearly_dependent_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    x[:, 5] = x[:, 4] + 1e-6 * rng.normal(size=200)
    y = x[:, :5] @ rng.normal(size=(5, 7)) + 1e-3 * rng.normal(size=(200, 7))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    design = np.column_stack([np.ones(200), x])
    expect = np.linalg.lstsq(design, y, rcond=None)[0]
    got = linalg.ols(df, "x", "y")
    normal = np.linalg.solve(design.T @ design, design.T @ y)
    error = np.abs(got - expect).max()
    assert error < 1e-8 * np.abs(expect).max() and error < np.abs(normal - expect).max() / 100
    p = np.diag([0, *[3.0] * 6])
    assert np.allclose(linalg.ols(df, "x", "y", penalty=3.0), np.linalg.solve(design.T @ design + p, design.T @ y))
    same = df.withColumn("x", F.concat("x", F.slice("x", 1, 1)))  # a column twice: the solution of least norm
    assert np.allclose(linalg.ols(same, "x", "y"), np.linalg.lstsq(np.column_stack([design, x[:, :1]]), y, rcond=1e-13)[0], atol=1e-6)
    assert wide.least_squares(df.limit(0), "x", "y").count() == 0
    with pytest.raises(Exception, match="too many"):
        linalg.gram(spark.createDataFrame([([0.0] * 5000,)], "x array<double>"), "x")


def loop_search(x, y, held, weights, layers, penalties, zscore):
    best = [(np.inf,)] * y.shape[1]
    for m in range(len(weights[0])):
        f = candidates.pooled(x, weights, layers, m)
        mean, sd = (f.mean(axis=0), f.std(axis=0) + 1e-6) if zscore else (np.zeros(f.shape[1]), np.ones(f.shape[1]))
        z = np.column_stack([np.ones(len(x)), (f - mean) / sd])
        for p in penalties:
            beta = np.linalg.solve(z[~held].T @ z[~held] + p * np.eye(z.shape[1]), z[~held].T @ y[~held])
            loss = ((y[held] - z[held] @ beta) ** 2).sum(axis=0)
            for u in np.flatnonzero(loss < [b[0] for b in best]):
                best[u] = (loss[u], m, p, beta[:, u], z @ beta[:, u])
    return best


@pytest.mark.parametrize("zscore", [True, False])
def test_field_search_and_predictions(spark, monkeypatch, zscore):
    rng = np.random.default_rng(6)
    layers, n = [(2, 5), (3, 2)], 80
    x, held = rng.normal(size=(n, 62)) + 3, np.arange(n) % 4 == 0
    fields = [(float(a), float(b), float(s)) for a, b, s in zip(rng.uniform(-3, 3, 6), rng.uniform(-3, 3, 6), rng.uniform(0.3, 3, 6))]
    fields.append(fields[2])  # the same again: the first wins
    y = np.column_stack([candidates.pooled(x, [np.array(weight_arrays(gaussian_mass_stack(spark, s, fields, 8.0))) for s in (5, 2)], layers, m) @ rng.normal(size=5) for m in (0, 2, 2, 4)]) + 0.1 * rng.normal(size=(n, 4))
    listed = spark.createDataFrame([(i, *f) for i, f in enumerate(fields)], "model long, x double, y double, sigma double")
    weights = candidates.field_weights(spark, listed, [5, 2], 8.0)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist(), bool(h)) for i, (a, b, h) in enumerate(zip(x, y, held))] + [(-1, None, [0.0] * 4, True)], "stim long, x array<double>, y array<double>, held boolean").repartition(3)
    expect = loop_search(x, y, held, weights, layers, [0.01, 1.0, 50.0], zscore)
    monkeypatch.setattr(candidates, "UNITS", 3)
    monkeypatch.setattr(candidates, "HELD", 2000)  # one candidate a reading
    models = candidates.search(df, "x", "y", "held", weights, layers, [0.01, 1.0, 50.0], zscore).collect()
    assert len(models) == 4
    for r in models:
        loss, model, penalty, beta, _ = expect[r["unit"]]
        assert (r["model"], r["penalty"]) == (model, penalty) and np.isclose(r["loss"], loss) and np.allclose([r["intercept"], *r["coef"]], beta)
    table = spark.createDataFrame(models, candidates.KINDS)
    got = {(r["stim"], r["unit"]): r["value"] for r in candidates.predict(df, ["stim"], "x", table, weights, layers, rows_together=30).collect()}
    assert len(got) == n * 4 and all(np.isclose(v, expect[u][4][i]) for (i, u), v in got.items())
    assert candidates.search(df.limit(0), "x", "y", "held", weights, layers, [1.0]).count() == 0
    with pytest.raises(InvalidParameterError):
        candidates.field_weights(spark, listed.where("model > 0"), [5], 8.0)


def test_rows_of_wide_features_are_not_shuffled(spark):
    """A small basis goes to the rows, and predictions of few units are made where the rows are."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((60, 2)) @ rng.standard_normal((2, 4200)) + 0.01 * rng.standard_normal((60, 4200))
    w = rng.standard_normal((3, 4200))
    rows, weights = rows_of(spark, a, "x"), rows_of(spark, w, "w").withColumnRenamed("stim", "unit")
    p = blocks.product(rows, ["stim"], "x", weights)
    assert "hashpartitioning" not in p._jdf.queryExecution().executedPlan().toString()
    for r in p.collect():
        assert r["units"] == [0, 1, 2] and np.allclose(r["values"], w @ a[r["stim"]])
    asked = []
    own, wide.product = wide.product, lambda *args, **kw: asked.append(args[0].columns) or blocks.product(*args, **kw)
    try:
        found = wide.components(rows, ["stim"], "x", 2)
    finally:
        wide.product = own
    assert len(asked) == 1  # the last projection alone
    assert np.allclose(found.variances, np.linalg.svd(a - a.mean(axis=0))[1][:2] ** 2 / 60)
