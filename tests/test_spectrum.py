"""Leading eigenpairs of wide features against dense ones."""

from __future__ import annotations

import numpy as np
import pytest

from furrow.operators.blocks import cross_kernel
from furrow.operators.spectrum import spectrum


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, x array<double>")


def dense(x, centred=True):
    x = x - x.mean(0) if centred else x
    values, vectors = np.linalg.eigh(x @ x.T / x.shape[1])
    return values[::-1], vectors[:, ::-1]


def test_wide_features_against_dense(spark):
    """20 000 features, no p x p matrix: values, residuals, train scores and scores of new rows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)) * np.linspace(4, 1, 12) @ rng.standard_normal((12, 20_000)) + rng.standard_normal((300, 20_000)) + 2
    train, new = x[:260], x[260:]
    found = spectrum(table(spark, train), "id", "x", components=6)
    values, vectors = dense(train)
    assert found.values == pytest.approx(values[:6], rel=1e-9)
    assert (found.residuals < 1e-6 * values[0]).all() and not found.whole
    z = np.array([r["z"] for r in found.train().orderBy("id").collect()])
    assert z @ z.T == pytest.approx((vectors[:, :6] * values[:6]) @ vectors[:, :6].T, abs=1e-6 * values[0])
    # The kernel times each vector is its value times the vector.
    v, c = z / np.sqrt(found.values), train - train.mean(0)
    assert np.linalg.norm(c @ (c.T @ v) / 20_000 - v * found.values, axis=0) == pytest.approx(np.zeros(6), abs=1e-6 * values[0])
    cross = np.array([r["z"] for r in found.project(table(spark, new, range(260, 300)), "x").orderBy("id").collect()])
    k = (new - train.mean(0)) @ c.T / 20_000
    assert cross == pytest.approx(k @ v / np.sqrt(found.values), abs=1e-6 * np.sqrt(values[0]))


def test_cross_scores_are_those_of_the_cross_kernel(spark):
    rng = np.random.default_rng(4)
    train, new = rng.standard_normal((40, 7)), rng.standard_normal((9, 7))
    a, b = table(spark, train), table(spark, new, range(100, 109))
    found = spectrum(a, "id", "x", components=3)
    k = np.zeros((9, 40))
    for r in cross_kernel(b, a, "id", [("x", "linear", None)], centred=True).collect():
        k[r["i"] - 100, r["j"]] = r["k"]
    z = np.array([r["z"] for r in found.train().orderBy("id").collect()])
    got = np.array([r["z"] for r in found.project(b, "x").orderBy("id").collect()])
    assert got == pytest.approx(k @ z / found.values, abs=1e-8)
    # Train rows as new ones have their own scores.
    assert np.array([r["z"] for r in found.project(a, "x").orderBy("id").collect()]) == pytest.approx(z, abs=1e-8)


def test_rank_is_found_and_held_to(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((50, 4)) @ rng.standard_normal((4, 30))
    found = spectrum(table(spark, x), "id", "x", most=20)
    assert found.whole and found.values == pytest.approx(dense(x)[0][:4])
    with pytest.raises(ValueError, match="5 components wanted, the kernel has 4"):
        spectrum(table(spark, x), "id", "x", components=5)
    with pytest.raises(ValueError, match="either"):
        spectrum(table(spark, x), "id", "x")
    assert spectrum(table(spark, x), "id", "x", components=4, centred=False).values == pytest.approx(dense(x, False)[0][:4])


def test_flat_spectrum_of_several_row_blocks(spark):
    """Values that lie close together need several rounds; the start block alone has none of them."""
    x = np.random.default_rng(6).standard_normal((300, 150))
    found = spectrum(table(spark, x), "id", "x", components=5, extra=35)
    assert found.values == pytest.approx(dense(x)[0][:5], rel=1e-8)


def test_odd_rows(spark):
    x = np.random.default_rng(7).standard_normal((20, 6))
    whole = table(spark, x)
    odd = spark.createDataFrame(
        [(None, [9.0] * 6), (90, None), (91, [1.0, 2.0]), (92, [1.0] * 5 + [None]), (93, [1.0] * 5 + [float("nan")]), (94, [])], "id long, x array<double>"
    )
    assert spectrum(whole.unionByName(odd), "id", "x", most=6).values == pytest.approx(dense(x)[0][:6])
    twice = spectrum(whole.unionByName(whole), "id", "x", most=6)
    assert twice.values == pytest.approx(dense(np.vstack([x, x]))[0][:6]) and twice.train().count() == 40
    flat = spectrum(table(spark, np.ones((8, 3))), "id", "x", most=2)
    assert len(flat.values) == 0 and {tuple(r["z"]) for r in flat.train().collect()} == {()}
    empty = spectrum(whole.limit(0), "id", "x", most=2)
    assert len(empty.values) == 0 and empty.train().count() == 0 and empty.whole


def test_relationship_features_are_those_of_the_relationship(spark):
    """On the query's own dosages: z z' is the best approximation of the relationship by five components."""
    from furrow.operators import kernels
    from furrow.plans.catalog import QUERIES
    from furrow.plans.kernels import dosages
    from furrow.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    g = {(r["i"], r["j"]): r["k"] for r in kernels.symmetric(kernels.relationship(dosages(Tables(spark, folder)), "id", "d")).collect()}
    ids = sorted({i for i, _ in g})
    values, vectors = np.linalg.eigh(np.array([[g[i, j] for j in ids] for i in ids]))
    best = (vectors[:, -5:] * values[-5:]) @ vectors[:, -5:].T
    z = {r["id"]: r["z"] for r in QUERIES["n05_relationship_features"](spark, folder).collect()}
    z = np.array([z[i] for i in ids])
    assert z @ z.T == pytest.approx(best, abs=1e-6 * values[-1])
