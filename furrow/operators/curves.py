"""Functional principal components of sparse curves by conditional expectation.

A curve's values are summed by grid cell first, so that its pairs of values are
products of at most ``GRID`` sums, however many points it has (pairs of equal times
are taken out by the sums of equal times). Means and cross products of all curves
are aggregated with map-side sums, a row for each pair of grid cells and channel.
What is left for one task is a matrix of the grid's size for each channel:
smoothing, with bandwidths by generalised cross-validation, and an eigendecomposition.
Scores are one small solve for each curve, in parallel over curves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.sources.files import landed

GRID = 20
#: Bandwidths in cells, among which generalised cross-validation chooses.
WIDTHS = (0.75, 1.0, 1.5, 2.25, 3.4, 5.0)
MODEL = (
    "mu array<double>, phi array<array<double>>, lam array<double>, fve array<double>, sigma2 double, lo double, hi double, "
    "mean_width double, surface_width double"
)


def _smooth(centers: np.ndarray, values: np.ndarray, weights: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
    """Local-linear fit at each point with Gaussian weights."""
    out = np.empty(len(at))
    for k, x in enumerate(at):
        d = centers - x
        w = weights * np.exp(-0.5 * (d / width) ** 2)
        s0, s1, s2 = w.sum(), (w * d).sum(), (w * d * d).sum()
        t0, t1 = (w * values).sum(), (w * d * values).sum()
        det = s0 * s2 - s1 * s1
        out[k] = (s2 * t0 - s1 * t1) / det if det > 1e-12 * max(s0 * s2, 1e-300) else t0 / max(s0, 1e-300)
    return out


def _smooth_surface(values: np.ndarray, weights: np.ndarray, width: float) -> np.ndarray:
    """Gaussian-weighted means in both directions; cells without pairs are filled from their neighbours."""
    at = np.arange(len(values))
    k = np.exp(-0.5 * ((at[:, None] - at[None, :]) / width) ** 2)
    return (k @ (values * weights) @ k.T) / np.maximum(k @ weights @ k.T, 1e-300)


def mean_width(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
    """The bandwidth with the least generalised cross-validation score of the values around the smoothed mean."""
    at, best = np.arange(len(n), dtype=float), (np.inf, WIDTHS[-1])
    means, units = np.where(n > 0, s / np.maximum(n, 1), 0), np.eye(len(n))
    for h in WIDTHS:
        fit = _smooth(at, means, n, at, h)
        own = sum(_smooth(at, units[i], n, at[i : i + 1], h)[0] for i in np.flatnonzero(n))
        room = 1 - own / max(n.sum(), 1)
        if room > 0:
            best = min(best, (float((q - 2 * fit * s + n * fit * fit).sum()) / room**2, h))
    return best[1]


def surface_width(values: np.ndarray, weights: np.ndarray) -> float:
    """The same for the cells of the covariance surface."""
    cells, best, at = weights > 0, (np.inf, WIDTHS[-1]), np.arange(len(values))
    for h in WIDTHS:
        k = np.exp(-0.5 * ((at[:, None] - at[None, :]) / h) ** 2)
        room = 1 - (weights / np.maximum(k @ weights @ k.T, 1e-300))[cells].sum() / max(cells.sum(), 1)
        if room > 1e-6:
            best = min(best, (float((weights * (values - _smooth_surface(values, weights, h)) ** 2)[cells].sum()) / room**2, h))
    return best[1]


def _fit(channel: pd.DataFrame, most: int, share: float, width: float | None, by: list[str]) -> pd.DataFrame:
    g = GRID
    one, two = channel[channel["j"] < 0], channel[channel["j"] >= 0]
    n, s, q = np.zeros(g), np.zeros(g), np.zeros(g)
    i = one["i"].to_numpy(int)
    n[i], s[i], q[i] = one["n"], one["s"], one["q"]
    lo, hi = float(one["lo"].min()), float(one["hi"].max())
    at = np.arange(g, dtype=float)
    of_mean = width or mean_width(n, s, q)
    mu = _smooth(at, np.where(n > 0, s / np.maximum(n, 1), 0), n, at, of_mean)
    pn, ps = np.zeros((g, g)), np.zeros((g, g))
    a, b = two["i"].to_numpy(int), two["j"].to_numpy(int)
    pn[a, b] = two["n"]
    # Sum of (y - mu_i)(z - mu_j) from the sums of y z, y and z.
    ps[a, b] = two["q"].to_numpy() - two["s"].to_numpy() * mu[b] - two["s2"].to_numpy() * mu[a] + two["n"].to_numpy() * mu[a] * mu[b]
    raw = ps / np.maximum(pn, 1)
    of_surface = width or surface_width(raw, pn)
    cov = _smooth_surface(raw, pn, of_surface)
    cov = (cov + cov.T) / 2
    variance = _smooth(at, np.where(n > 0, q / np.maximum(n, 1) - 2 * mu * s / np.maximum(n, 1) + mu * mu, 0), n, at, of_mean)
    sigma2 = float(max(np.mean(variance - np.diag(cov)), 1e-6 * max(variance.mean(), 1e-12)))
    step = (hi - lo) / g if hi > lo else 1.0
    values, vectors = np.linalg.eigh(cov * step)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order] / np.sqrt(step)
    good = values > 1e-10 * max(values[0], 1e-300)
    values, vectors = values[good], vectors[:, good]
    fve = np.cumsum(values) / values.sum() if len(values) else values
    k = min(most, int(np.searchsorted(fve, share) + 1), len(values))
    signs = np.where(vectors[:, :k].sum(0) < 0, -1.0, 1.0)
    row = {c: channel[c].iloc[0] for c in by}
    return pd.DataFrame([row | {"mu": mu.tolist(), "phi": (vectors[:, :k] * signs).T.tolist(), "lam": values[:k].tolist(), "fve": fve[:k].tolist(), "sigma2": sigma2, "lo": lo, "hi": hi, "mean_width": of_mean, "surface_width": of_surface}])


def cell(t: str, lo: str, hi: str):
    return F.least(F.floor((F.col(t) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-12)) * GRID), F.lit(GRID - 1)).cast("int")


def fit(curves: DataFrame, channel: str, curve: str, t: str, y: str, most: int = 4, share: float = 0.99, width: float | None = None) -> DataFrame:
    """One model row for each channel: mean, eigenfunctions on the grid, eigenvalues, explained shares, noise, domain, bandwidths.

    Bandwidths (in cells) are chosen by cross-validation unless one is given. Points without a finite value are left out.
    """
    clean = curves.where(F.col(y).isNotNull() & ~F.isnan(y)).select(F.col(channel).alias("c"), F.col(curve).alias("id"), F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"))
    domain = clean.groupBy("c").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cells = clean.join(F.broadcast(domain), "c").withColumn("i", cell("t", "lo", "hi"))
    single = cells.groupBy("c", "i").agg(
        F.lit(-1).alias("j"), F.count("*").alias("n"), F.sum("y").alias("s"), F.lit(0.0).alias("s2"), F.sum(F.col("y") * F.col("y")).alias("q"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    times = cells.groupBy("c", "id", "i", "t").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s"))
    product = lambda x, y: F.sum(F.col(x) * F.col(y)).alias(x + y)
    sums = times.groupBy("c", "id", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), product("n", "n"), product("n", "s"), product("s", "s"))
    points = sums.groupBy("c", "id").agg(F.collect_list(F.struct("i", "n", "s", "nn", "ns", "ss")).alias("p"))
    pairs = points.select("c", F.explode("p").alias("a"), "p").select("c", "a", F.explode("p").alias("b"))
    same = F.col("a.i") == F.col("b.i")
    less = lambda c: F.when(same, F.col(c)).otherwise(0.0)
    double = pairs.groupBy("c", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(
        F.sum(F.col("a.n") * F.col("b.n") - less("a.nn")).cast("long").alias("n"), F.sum(F.col("a.s") * F.col("b.n") - less("a.ns")).alias("s"),
        F.sum(F.col("a.n") * F.col("b.s") - less("a.ns")).alias("s2"), F.sum(F.col("a.s") * F.col("b.s") - less("a.ss")).alias("q"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")).where("n > 0")
    stats = single.unionByName(double).withColumnRenamed("c", channel)
    kind = dict(curves.dtypes)[channel]
    return stats.groupBy(channel).applyInPandas(lambda pdf: _fit(pdf, most, share, width, [channel]), f"{channel} {kind}, {MODEL}")


def _scores(rows: pd.DataFrame) -> pd.Series:
    out = []
    for t, y, mu, phi, lam, s2, lo, hi in rows.itertuples(index=False):
        t, y, mu, phi, lam = (np.asarray(x, float) if not isinstance(x, float) else x for x in (t, y, mu, np.vstack(phi) if len(phi) else np.zeros((0, GRID)), lam))
        if not len(t) or not len(lam):
            out.append([0.0] * len(lam))
            continue
        at = np.clip((t - lo) / max(hi - lo, 1e-12) * GRID - 0.5, 0, GRID - 1)
        grid = np.arange(GRID)
        p = np.stack([np.interp(at, grid, f) for f in phi], axis=1)
        sigma = (p * lam) @ p.T + s2 * np.eye(len(t))
        out.append((lam * (p.T @ np.linalg.solve(sigma, y - np.interp(at, grid, mu)))).tolist())
    return pd.Series(out)


def scores(curves: DataFrame, model: DataFrame, channel: str, curve: str, t: str, y: str) -> DataFrame:
    """(channel, curve, xi): conditional expectations; points outside the model's domain are left out first.

    Serves training and held-out curves alike. The model has a row for each channel.
    """
    model = landed(model)
    inside = curves.join(F.broadcast(model.select(channel, "lo", "hi")), channel).where(F.col(t).between(F.col("lo"), F.col("hi")) & F.col(y).isNotNull() & ~F.isnan(y))
    lists = inside.groupBy(channel, curve).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")))).alias("p"))
    solve = F.pandas_udf(_scores, "array<double>")
    row = F.struct(F.col("p.t").alias("t"), F.col("p.y").alias("y"), "mu", "phi", "lam", "sigma2", "lo", "hi")
    return lists.join(F.broadcast(model), channel).select(channel, curve, solve(row).alias("xi"))
