"""Estimators from sufficient statistics: Spark sums over the rows, numpy solves what no longer grows with them.

Every group (an environment, a label, a channel) may hold any number of rows: what
reaches one task is a matrix of the group's factor levels or features. Random
draws are seeded from the group's key, so retries and other partitionings give
the same numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.exprs import dot
from furrow.operators.timeseries import hash_ranked
from furrow.sources.files import landed


def group_seed(*key) -> int:
    return zlib.crc32("|".join(map(str, key)).encode())


# Mixed models of factors


def mixed_model(wtw: np.ndarray, wty: np.ndarray, yty: float, n: float, sizes: Sequence[int], rounds: int = 60) -> dict:
    """EM-REML of y = fixed factor + random factors + error from the cross counts of all levels, their sums of y, and y'y.

    ``sizes`` are the numbers of levels, the fixed factor first.
    """
    ends = np.cumsum([0, *sizes])
    p = ends[1]
    spread = max(yty - wty[:p].sum() ** 2 / n, 0.0) / n
    ve = spread / 2 or 1.0
    vs = [ve / len(sizes) for _ in sizes[1:]]
    for _ in range(rounds):
        c = wtw.copy()
        for (a, b), v in zip(zip(ends[1:], ends[2:], strict=False), vs, strict=True):
            c[range(a, b), range(a, b)] += ve / max(v, 1e-12)
        inverse = np.linalg.pinv(c, hermitian=True)
        solution = inverse @ wty
        new = []
        for a, b in zip(ends[1:], ends[2:], strict=False):
            u = solution[a:b]
            new.append(float((u @ u + ve * np.trace(inverse[a:b, a:b])) / (b - a)))
        ve_new = float((yty - solution @ wty) / max(n - p, 1))
        done = abs(ve_new - ve) < 1e-8 * max(ve, 1e-12)
        vs, ve = new, max(ve_new, 1e-12)
        if done:
            break
    # The residual sum of squares at the conditional fit, from the same sums.
    rss = max(float(yty - 2 * solution @ wty + solution @ wtw @ solution), 0.0)
    return {"effects": solution[:p], "components": vs, "error": ve, "rss": rss, "n": n}


def cross_counts(df: DataFrame, by: str, factors: Sequence[str], y: str) -> DataFrame:
    """(by, a, b, la, lb, n, s, q): for each two factors a <= b, rows, sum and sum of squares of y at each pair of their levels.

    One pass with map-side sums. Rows without y or without a level are left out. The
    result grows with the pairs of levels, not with the rows.
    """
    names = [F.col(f).cast("string") for f in factors]
    cells = F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), names[i].alias("la"), names[j].alias("lb")) for i, j in combinations_with_replacement(range(len(factors)), 2)))
    known = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))
    for f in factors:
        known &= F.col(f).isNotNull()
    value = F.col(y).cast("double").alias("y")
    return (
        df.where(known).select(by, value, F.explode(cells).alias("c")).groupBy(by, "c.a", "c.b", "c.la", "c.lb")
        .agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    )


def solve_counts(cells: pd.DataFrame, k: int) -> tuple[list[list[str]], float, dict]:
    """(levels of each factor, mean of y, mixed_model) from one group's cross counts; y is centred before it is squared away."""
    own = cells[cells["a"] == cells["b"]]
    levels = [sorted(own.loc[own["a"] == i, "la"]) for i in range(k)]
    at = {(i, level): n for n, (i, level) in enumerate((i, level) for i in range(k) for level in levels[i])}
    wtw, wty = np.zeros((len(at), len(at))), np.zeros(len(at))
    first = own[own["a"] == 0]
    n, total = float(first["n"].sum()), float(first["s"].sum())
    mean = total / n
    for a, b, la, lb, count, s in cells[["a", "b", "la", "lb", "n", "s"]].itertuples(index=False):
        i, j = at[a, la], at[b, lb]
        wtw[i, j] = wtw[j, i] = count
        if i == j:
            wty[i] = s - mean * count
    yty = max(float(first["q"].sum()) - n * mean * mean, 0.0)
    return levels, mean, mixed_model(wtw, wty, yty, n, [len(x) for x in levels])


def blues(df: DataFrame, by: str, genotype: str, factors: Sequence[str], y: str) -> DataFrame:
    """(by, genotype, blue): genotype means adjusted for random factors, one model for each group."""
    kinds = dict(df.dtypes)

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        levels, mean, m = solve_counts(cells, 1 + len(factors))
        return pd.DataFrame({by: cells[by].iloc[0], "level": levels[0], "blue": m["effects"] + mean})

    solved = cross_counts(df, by, [genotype, *factors], y).groupBy(by).applyInPandas(fit, f"{by} {kinds[by]}, level string, blue double")
    return solved.select(by, F.col("level").cast(kinds[genotype]).alias(genotype), "blue")


def variance_components(df: DataFrame, by: str, factors: Sequence[str], y: str, replicate: str | None = None) -> DataFrame:
    """(by, grp, vcov, sdcor, percent, rmse, r_squared, heritability): all factors random, and the residual.

    rmse is of the residuals given the random effects, r_squared the conditional share (all
    random variance over the total, as the fixed part is the mean alone). heritability is the
    first factor's variance over itself plus the residual's by the number of levels of
    ``replicate`` (one of factors; by default the last) that have a response. All
    follow from the counts and sums of levels, without another pass over the rows.
    """
    kinds, at = dict(df.dtypes), 1 + (factors.index(replicate) if replicate else len(factors) - 1)

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        levels, _, m = solve_counts(cells, 1 + len(factors))
        v = np.array([*m["components"], m["error"]])
        return pd.DataFrame({
            by: cells[by].iloc[0], "grp": [*factors, "residual"], "vcov": v, "sdcor": np.sqrt(v), "percent": 100 * v / v.sum(), "rmse": np.sqrt(m["rss"] / m["n"]),
            "r_squared": v[:-1].sum() / v.sum(), "heritability": v[0] / (v[0] + v[-1] / len(levels[at])),
        })

    counts = cross_counts(df.withColumn("_all", F.lit("all")), by, ["_all", *factors], y)
    return counts.groupBy(by).applyInPandas(fit, f"{by} {kinds[by]}, grp string, vcov double, sdcor double, percent double, rmse double, r_squared double, heritability double")


# Cross products of features


def cross_products(df: DataFrame, features: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, i, row): cross-product matrices of the features, summed by task over Arrow batches and then by row.

    Grows with the number of features squared and the number of groups, not with the rows.
    """
    kinds = dict(df.dtypes)
    keys = pa.schema([(c, pa.string()) for c in by])

    def partial(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            groups = pd.DataFrame({c: batch.column(k).to_pandas() for k, c in enumerate(by)}) if by else None
            index = groups.groupby(list(by), dropna=False).indices if by else {(): slice(None)}
            for key, at in index.items():
                key = key if isinstance(key, tuple) else (key,)
                totals[key] = x[at].T @ x[at] + totals.get(key, 0)
        for key, total in totals.items():
            columns = [pa.array([None if k != k else k] * len(total), pa.string()) for k in key]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                schema=pa.schema([*keys, ("i", pa.int32()), ("row", pa.list_(pa.float64()))]),
            )

    told = "".join(f"{c} string, " for c in by)
    parts = df.select(*(F.col(c).cast("string").alias(c) for c in by), features.alias("_x")).mapInArrow(partial, f"{told}i int, row array<double>")
    cells = parts.select(*by, "i", F.posexplode("row").alias("j", "v")).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy(*by, "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row"))
    return rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in by), "i", "row")


def doubles(array: str) -> Column:
    return F.transform(array, lambda v: v.cast("double"))


def gram(df: DataFrame, features: str) -> DataFrame:
    """(i, row): the features' cross-product matrix."""
    return cross_products(df, doubles(features))


def matrix(rows: DataFrame) -> np.ndarray:
    """A cross-product matrix on the driver; its size is that of the features squared."""
    return np.array([r["row"] for r in rows.orderBy("i").collect()])


def eigen(df: DataFrame, features: str, most: int | None = None, relative: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(values, directions) of the rows' linear kernel, from the features' Gram matrix: only that matrix reaches the driver."""
    values, vectors = np.linalg.eigh(matrix(gram(df, features)))
    order = np.argsort(values)[::-1][:most]
    keep = values[order] > relative * max(values[order[0]], 1e-300)
    return values[order][keep], vectors[:, order][:, keep]


def eigen_projection(df: DataFrame, features: str, entity: str, most: int) -> DataFrame:
    """(entity, z): V sqrt(D) of the rows' kernel X X' / p, as inner products with the Gram matrix's directions."""
    values, vectors = eigen(df, features, most)
    p = len(vectors)
    columns = [F.array(*(F.lit(float(x)) for x in v / np.sqrt(p))) for v in vectors.T]
    dots = [F.aggregate(F.zip_with(features, c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) for c in columns]
    return df.select(entity, F.array(*dots).alias("z"))


# Kernel regression in feature space. Groups without any response have no predictions.


def centred(s: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) from cross products whose first feature is 1."""
    n = float(s[0, 0])
    means = s[0, 1:] / max(n, 1)
    return n, means, s[1:, 1:] - n * np.outer(means, means)


def reml_ratio(values: np.ndarray, b: np.ndarray, yy: float, n: float) -> tuple[float, float, float]:
    """(ratio of error to kernel variance, kernel variance, log-likelihood) that restricted likelihood prefers.

    For y = mean + Z u + e with Z'Z's eigenvalues, the products b of its directions with y, and y'y, all centred.
    """
    share = b * b / np.maximum(values, 1e-300)
    rest, df = max(yy - share.sum(), 0.0), n - 1

    def likelihood(log_ratio: float) -> tuple[float, float]:
        ratio = np.exp(log_ratio)
        v = max(float((share / (values + ratio)).sum() + rest / ratio) / df, 1e-300)
        return -0.5 * (df * np.log(v) + np.log(values + ratio).sum() + (df - len(values)) * log_ratio), v

    grid = np.linspace(-12, 16, 57)
    best = grid[np.argmax([likelihood(g)[0] for g in grid])]
    lo, hi = best - 0.5, best + 0.5
    for _ in range(40):  # the likelihood has one top between neighbours of the grid
        a, b_ = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b_) if likelihood(a)[0] > likelihood(b_)[0] else (a, hi)
    top, v = likelihood((lo + hi) / 2)
    return float(np.exp((lo + hi) / 2)), v, float(top)


def ridge(s: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(intercept, coefficients, log-likelihood) by REML, from cross products of (1, features, y) over the rows with y.

    The same predictions as kriging with the features' linear kernel and a GLS intercept, at the cost of the features alone.
    """
    n, means, c = centred(s)
    if n < 3 or c[-1, -1] <= 0:
        return float(means[-1]) if n else float("nan"), np.zeros(len(means) - 1), -np.inf
    values, vectors = np.linalg.eigh(c[:-1, :-1])
    keep = values > 1e-10 * max(values[-1], 1e-300)
    values, vectors = values[keep], vectors[:, keep]
    b = vectors.T @ c[:-1, -1]
    ratio, _, top = reml_ratio(values, b, float(c[-1, -1]), n)
    u = vectors @ (b / (values + ratio))
    return float(means[-1] - means[:-1] @ u), u, top


def gibbs(s: np.ndarray, kernels: Sequence[np.ndarray], seed: int, n_iter: int = 10_000, burn: int = 1_000) -> tuple[float, np.ndarray]:
    """(intercept, coefficients): posterior means of several kernels' features under scaled inverse chi-square variances.

    ``kernels`` are the features' numbers of each kernel. Rows without y have no say, so
    they need not be drawn. The chain needs the cross products alone.
    """
    n, means, cross = centred(s)
    kept = np.concatenate([np.asarray(k, int) for k in kernels])
    owner = np.repeat(np.arange(len(kernels)), [len(k) for k in kernels])
    coefficients = np.zeros(len(means) - 1)
    if n < 3 or cross[-1, -1] <= 0:
        return float(means[-1]) if n else float("nan"), coefficients
    xtx, xty, yy = cross[np.ix_(kept, kept)], cross[kept, -1], float(cross[-1, -1])
    rng, vy, df = np.random.default_rng(seed), yy / (n - 1), 5.0
    spread = np.array([max(np.trace(xtx[np.ix_(owner == k, owner == k)]) / n, 1e-12) for k in range(len(kernels))])
    prior = 0.5 * vy / len(kernels) * (df + 2) / spread
    sizes, se = np.bincount(owner), 0.5 * vy
    # Each kernel in the basis of its own directions, where its draw is a vector of independent ones.
    spans = [slice(int(b - n_), int(b)) for n_, b in zip(sizes, np.cumsum(sizes), strict=True)]
    basis = np.zeros_like(xtx)
    for span in spans:
        basis[span, span] = np.linalg.eigh(xtx[span, span])[1]
    m, c = basis.T @ xtx @ basis, basis.T @ xty
    own = np.maximum(np.diag(m), 0)
    blocks = [(k, span, m[span], c[span], own[span]) for k, span in enumerate(spans)]
    noise = rng.normal(size=(n_iter, len(kept)))
    of_kernels, of_error = rng.chisquare(sizes + df, (n_iter, len(sizes))), rng.chisquare(n - 1 + df, n_iter)
    su, u, total = prior / (df + 2), np.zeros(len(kept)), np.zeros(len(kept))
    for step in range(n_iter):
        for k, span, rows, products, mine in blocks:
            precision = mine + se / su[k]
            u[span] = (products - rows @ u + mine * u[span]) / precision + noise[step, span] * np.sqrt(se / precision)
            su[k] = (u[span] @ u[span] + prior[k]) / of_kernels[step, k]
        e = max(yy - 2 * u @ c + u @ (m @ u), 0.0)
        se = (e + 0.5 * vy * (df + 2)) / of_error[step]
        if step >= burn:
            total += u
    total = basis @ total
    coefficients[kept] = total / max(n_iter - burn, 1)
    return float(means[-1] - means[:-1] @ coefficients), coefficients


def standardised(df: DataFrame, by: str, features: str, out: str) -> DataFrame:
    """df with each feature standardised within its group and divided by the root of their number; no spread counts as 1."""
    cells = df.select(by, F.posexplode(doubles(features)).alias("p", "v")).groupBy(by, "p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    cell = F.struct("p", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s"))
    stats = cells.groupBy(by).agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    z = F.zip_with(doubles(features), "_c", lambda v, c: (v - c["m"]) / (c["s"] * F.sqrt(F.size("_c"))))
    return df.join(stats, by).withColumn(out, z).drop("_c")


def _solved(df: DataFrame, by: str, z: Column, y: str, solve, kind: str) -> DataFrame:
    """One solve for each group, from the cross products of (1, z, y) over its rows with y."""
    value = F.col(y).cast("double")
    seen = df.where(value.isNotNull() & ~F.isnan(value))
    return cross_products(seen, F.concat(F.array(F.lit(1.0)), z, F.array(value)), [by]).groupBy(by).applyInPandas(
        lambda rows: solve(np.array(rows.sort_values("i")["row"].tolist()), rows[by].iloc[0]), f"{by} {dict(df.dtypes)[by]}, {kind}"
    )


#: Widths of the radial kernels that gp_predictions tries, in units of the features' spread, and how many random features stand for one.
RBF_WIDTHS = (0.5, 1.0, 2.0)
RBF_FEATURES = 256


def rbf_features(x: np.ndarray, width: float, seed: int = 17) -> np.ndarray:
    """Random Fourier features: their inner products are the radial kernel of the rows, up to an error that falls with their number."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(x.shape[1], RBF_FEATURES)), rng.uniform(0, 2 * np.pi, RBF_FEATURES)
    return np.sqrt(2 / RBF_FEATURES) * np.cos(x @ w / width + b)


def blup_predictions(df: DataFrame, by: str, entity: str, features: str, y: str) -> DataFrame:
    """(by, entity, predicted): REML variance components, GLS intercept and kriging with the linear kernel, in feature space."""

    def solve(s: np.ndarray, key) -> pd.DataFrame:
        mean, u, _ = ridge(s)
        return pd.DataFrame({by: [key], "mean": [mean], "u": [u.tolist()]})

    scaled = landed(standardised(df.select(by, entity, features, y), by, features, "z"))
    models = _solved(scaled, by, F.col("z"), y, solve, "mean double, u array<double>")
    return scaled.join(models, by).select(by, entity, (F.col("mean") + dot("z", "u")).alias("predicted"))


def gp_predictions(df: DataFrame, by: str, entity: str, features: str, y: str) -> DataFrame:
    """(by, entity, kernel, predicted): Gaussian processes with noise; each group takes the kernel of the highest likelihood.

    Tried are the dot product and radial kernels of several widths, each with variance and noise by likelihood.
    """
    scaled = landed(standardised(df.select(by, entity, features, y), by, features, "z"))

    def radial(width: float):
        def made(z: pa.Array) -> pa.Array:
            if not len(z):
                return pa.array([], pa.list_(pa.float64()))
            x = z.flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1)
            return pa.array(list(rbf_features(x, width)), pa.list_(pa.float64()))

        return F.arrow_udf(made, "array<double>")(F.col("z"))

    kernels = {"dot": F.col("z")} | {f"rbf {w}": radial(w) for w in RBF_WIDTHS}
    fitted = None
    for name, z in kernels.items():

        def solve(s: np.ndarray, key, name=name) -> pd.DataFrame:
            mean, u, top = ridge(s)
            return pd.DataFrame({by: [key], "kernel": [name], "top": [top], "mean": [mean], "u": [u.tolist()]})

        one = _solved(scaled.withColumn("_k", z), by, F.col("_k"), y, solve, "kernel string, top double, mean double, u array<double>")
        fitted = one if fitted is None else fitted.unionByName(one)
    best = landed(fitted.groupBy(by).agg(F.max_by(F.struct("kernel", "mean", "u"), F.struct("top", "kernel")).alias("m")).select(by, "m.*"))
    met = scaled.join(best, by)
    parts = [met.where(F.col("kernel") == name).select(by, entity, "kernel", "mean", "u", z.alias("_k")) for name, z in kernels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(by, entity, "kernel", (F.col("mean") + dot("_k", "u")).alias("predicted"))


def gibbs_predictions(df: DataFrame, by: str, entity: str, kernels: dict[str, Column], models: dict[str, Sequence[str]], y: str, n_iter: int = 10_000, burn: int = 1_000) -> DataFrame:
    """(by, entity, model, predicted): Bayesian regression on several kernels, each given by its features; a model is a list of kernels."""
    sized = df.select(by, entity, y, *(z.alias(name) for name, z in kernels.items()))
    together = landed(standardised(sized.withColumn("_x", F.concat(*kernels)), by, "_x", "z").select(by, entity, y, "z", *(F.size(k).alias(f"n_{k}") for k in kernels)))
    sizes = together.agg(*(F.max(f"n_{k}") for k in kernels)).first()
    ends = np.cumsum([0, *(n or 0 for n in sizes)])
    spans = {k: np.arange(a, b) for k, a, b in zip(kernels, ends, ends[1:], strict=False)}

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        key, model = rows[by].iloc[0], rows["model"].iloc[0]
        mean, u = gibbs(np.array(rows.sort_values("i")["row"].tolist()), [spans[p] for p in models[model]], group_seed(key, model), n_iter, burn)
        return pd.DataFrame({by: [key], "model": [model], "mean": [mean], "u": [u.tolist()]})

    value = F.col(y).cast("double")
    seen = together.where(value.isNotNull() & ~F.isnan(value))
    sums = cross_products(seen, F.concat(F.array(F.lit(1.0)), F.col("z"), F.array(value)), [by])
    # Chains are long and their input is small: dealt out by group and model, they fill the cores.
    each = sums.withColumn("model", F.explode(F.array(*map(F.lit, models)))).repartition(sums.sparkSession.sparkContext.defaultParallelism * 2, by, "model")
    solved = each.groupBy(by, "model").applyInPandas(solve, f"{by} {dict(df.dtypes)[by]}, model string, mean double, u array<double>")
    solved = landed(solved)
    return together.join(solved, by).select(by, entity, "model", (F.col("mean") + dot("z", "u")).alias("predicted"))


# Genome scans


class Scan:
    """A mixed-model scan from cross products of (1, dosages, responses): each chromosome's loci under a kinship of all others.

    Everything a marker's test needs under V = K + ratio I is a product a'V^-1 b of
    dosages and responses, and follows from the cross products of the loci. So
    entities may be any number; the matrix grows with the loci.
    """

    def __init__(self, s: np.ndarray, chromosomes: np.ndarray, n_traits: int):
        self.n, self.means, self.c = centred(s)
        self.chromosomes, self.loci, self.n_traits = chromosomes, len(chromosomes), n_traits
        self.parts = {}
        for name in np.unique(chromosomes):
            other = np.flatnonzero(chromosomes != name)
            values, vectors = np.linalg.eigh(self.c[np.ix_(other, other)])
            keep = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
            self.parts[name] = (other, values[keep], vectors[:, keep])

    def products(self, name, ratio: float, a: np.ndarray, b: np.ndarray, ab: np.ndarray) -> np.ndarray:
        """a'V^-1 b from the products a'Z and b'Z with all loci, and a'b."""
        other, values, vectors = self.parts[name]
        return ab - ((a[:, other] @ vectors) / (values + ratio)) @ (b[:, other] @ vectors).T

    def ratio(self, name, zy: np.ndarray, yy: float) -> float:
        other, values, vectors = self.parts[name]
        return reml_ratio(values, vectors.T @ zy[other], yy, self.n)[0] if len(values) else 1.0

    def lods(self, zy: np.ndarray, yy: float, ratios: dict) -> np.ndarray:
        """LOD of each locus (rows of zy: responses)."""
        out, zz = np.zeros((len(zy), self.loci)), self.c[: self.loci, : self.loci]
        for name, ratio in ratios.items():
            mine = np.flatnonzero(self.chromosomes == name)
            other, values, vectors = self.parts[name]
            dd = np.diag(zz)[mine] - (((zz[np.ix_(mine, other)] @ vectors) ** 2) / (values + ratio)).sum(1)
            dy = self.products(name, ratio, zz[mine], zy, zy[:, mine].T)
            null = yy - (((zy[:, other] @ vectors) ** 2) / (values + ratio)).sum(1)
            explained = np.where(dd > 1e-9 * np.maximum(np.diag(zz)[mine], 1e-300), dy.T**2 / np.maximum(dd, 1e-300), 0) / np.maximum(null, 1e-300)[:, None]
            out[:, mine] = -self.n / 2 * np.log10(np.clip(1 - explained, 1e-12, 1))
        return out

    def trait(self, t: int) -> tuple[np.ndarray, float, dict]:
        at = self.loci + t
        zy, yy = self.c[: self.loci, at], float(self.c[at, at])
        return zy, yy, {name: self.ratio(name, zy, yy) for name in self.parts}


def complete(genotypes: DataFrame, dosage: str, responses: Sequence[str]) -> DataFrame:
    """The entities that have all dosages and responses."""
    whole = F.forall(dosage, lambda v: v.isNotNull())
    for r in responses:
        whole &= F.col(r).isNotNull() & ~F.isnan(F.col(r).cast("double"))
    return genotypes.where(whole)


def scan_products(genotypes: DataFrame, dosage: str, responses: Sequence[str]) -> np.ndarray:
    """Cross products of (1, dosages, responses) over the entities that have all of them: one pass, loci squared on the driver."""
    known = F.array(*(F.col(r).cast("double") for r in responses))
    return matrix(cross_products(complete(genotypes, dosage, responses), F.concat(F.array(F.lit(1.0)), doubles(dosage), known)))


def genome_scan(genotypes: DataFrame, dosage: str, responses: Sequence[str], chromosomes: Sequence) -> tuple[Scan, DataFrame]:
    """(the scan, (trait, chr, locus, lod)): linear mixed model with leave-one-chromosome-out kinship, variance ratio by REML without the marker."""
    scan = Scan(scan_products(genotypes, dosage, responses), np.asarray(chromosomes), len(responses))
    rows = []
    for t, name in enumerate(responses):
        zy, yy, ratios = scan.trait(t)
        for locus, lod in enumerate(scan.lods(zy[None, :], yy, ratios)[0]):
            rows.append((name, str(scan.chromosomes[locus]), locus, float(lod)))
    return scan, genotypes.sparkSession.createDataFrame(rows, "trait string, chr string, locus int, lod double")


#: Entities whose permuted responses meet in one group, at most; values that a task deals at a time.
DEALT, SLAB = 2048, 1 << 19


def places(perm: int, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a permutation of 0 ... n - 1 puts each of at, from its number alone: no sort, and no other place is needed.

    Eight rounds of a Feistel network keyed by MD5 of seed, permutation and round; what falls
    outside is put through again until it is inside.
    """
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.md5(f"{seed}|{perm}|{k}".encode()).digest()[:8], "little")) for k in range(8)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for key in keys:
            x = right ^ key
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
        return (left << half) | right

    out = once(at.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def permuted(traits: DataFrame, entity: str, times: int, seed: int) -> DataFrame:
    """(entity, trait, perm, y): responses dealt anew among the entities of a trait, which are numbered in hash order."""
    kinds = dict(traits.dtypes)
    numbered = landed(hash_ranked(traits.select("trait", entity, F.col("y").cast("double").alias("y")), seed, entity, "_at", "_n", by=["trait"]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = (batch.column(k).to_numpy() for k in (1, 2))
            for perm in range(times):
                to = np.empty_like(at)
                for n in np.unique(sizes):
                    to[sizes == n] = places(perm, at[sizes == n] - 1, int(n), seed) + 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(at), perm)), pa.array(to), batch.column(3)], ["trait", "perm", "_at", "y"])

    dealt = numbered.select("trait", "_at", "_n", "y").mapInArrow(deal, f"trait {kinds['trait']}, perm long, _at long, y double")
    return dealt.join(numbered.select("trait", "_at", entity), ["trait", "_at"]).select(entity, "trait", "perm", "y")


def permutation_lods(genotypes: DataFrame, entity: str, dosage: str, responses: Sequence[str], chromosomes: Sequence, times: int = 1000, seed: int = 3) -> DataFrame:
    """(trait, perm, lod): the largest LOD of each permutation of a response, kinship and variance ratio as in the unpermuted scan.

    Responses are dealt as ``permuted`` deals them. Each goes once for each permutation to the group of at most DEALT
    entities where its new one is, packed in arrays; the products with the loci are made there and summed by task.
    Loci times permutations of them reach the driver, whatever the entities.
    """
    scan, _ = genome_scan(genotypes, dosage, responses, chromosomes)
    n, traits, loci = int(scan.n), len(responses), scan.loci
    known = complete(genotypes, dosage, responses).select(entity, doubles(dosage).alias("_d"), F.array(*(F.col(r).cast("double") for r in responses)).alias("_y"))
    numbered = landed(hash_ranked(known, seed, entity, "_at", "_n").select((F.col("_at") - 1).alias("_at"), "_d", "_y"))
    held = max(1, min(DEALT, -(-n // 32)))
    groups = max(1, -(-n // held))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, y = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, traits)
            step = max(1, SLAB // len(at))
            for first in range(0, times, step):
                perms = np.arange(first, min(first + step, times))
                to = np.concatenate([places(int(p), at, n, seed) for p in perms])
                order = np.argsort(to // held, kind="stable")
                ends = np.searchsorted(to[order] // held, np.arange(groups + 1)).astype(np.int32)
                cells = (np.repeat(perms, len(at)) * held + to % held)[order].astype(np.int32)
                values = np.tile(y, (len(perms), 1))[order].ravel()
                lists = [pa.ListArray.from_arrays(pa.array(ends * k), pa.array(v)) for k, v in ((1, cells), (traits, values))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups)), *lists], ["group", "cells", "ys"])

    def products(owners: pa.Table, sent: pa.Table) -> pa.Table:
        y, d = np.zeros((times * held, traits)), np.zeros((held, loci))
        d[owners["_at"].to_numpy() % held] = owners["_d"].combine_chunks().flatten().to_numpy().reshape(-1, loci)
        y[sent["cells"].combine_chunks().flatten().to_numpy()] = sent["ys"].combine_chunks().flatten().to_numpy().reshape(-1, traits)
        found = [(y[:, t].reshape(times, held) @ d).T for t in range(traits)]
        return pa.table({
            "trait": pa.array(np.repeat(np.arange(traits), loci)), "i": pa.array(np.tile(np.arange(loci), traits)),
            "row": pa.array(np.concatenate(found).tolist(), pa.list_(pa.float64())),
        })

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((traits * loci, times))
        for batch in batches:
            at = batch.column(0).to_numpy() * loci + batch.column(1).to_numpy()
            np.add.at(total, at, batch.column(2).flatten().to_numpy().reshape(-1, times))
        if total.any():
            at = np.arange(traits * loci)
            yield pa.RecordBatch.from_arrays([pa.array(at // loci), pa.array(at % loci), pa.array(total.tolist(), pa.list_(pa.float64()))], ["trait", "i", "row"])

    tasks = min(groups, 400)
    sent = numbered.select("_at", "_y").mapInArrow(deal, "group long, cells array<int>, ys array<double>").repartition(tasks, "group").groupBy("group")
    owners = numbered.select(F.floor(F.col("_at") / held).alias("group"), "_at", "_d").repartition(tasks, "group").groupBy("group")
    rows_of = "trait long, i long, row array<double>"
    parts = owners.cogroup(sent).applyInArrow(products, rows_of).mapInArrow(partial, rows_of)
    sums = parts.select("trait", "i", F.posexplode("row").alias("j", "v")).groupBy("trait", "i", "j").agg(F.sum("v").alias("v"))
    got = sums.groupBy("trait", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row")).collect()
    found = np.zeros((traits, loci, times))
    for r in got:
        found[r["trait"], r["i"]] = r["row"]
    rows = []
    for t, name in enumerate(responses):
        _, yy, ratios = scan.trait(t)
        zy = found[t] - scan.n * np.outer(scan.means[:loci], np.full(times, scan.means[loci + t]))
        rows += [(name, k, float(lod)) for k, lod in enumerate(scan.lods(zy.T, yy, ratios).max(1))]
    return genotypes.sparkSession.createDataFrame(rows, "trait string, perm int, lod double")


def blups_at(genotypes: DataFrame, dosage: str, response: str, t: int, locus: int, scan: Scan) -> list[tuple[int, float]]:
    """(class, effect): best linear unbiased predictions of the dosage classes at one locus, beside the kinship of the other chromosomes."""
    d = F.get(dosage, F.lit(locus)).cast("int")
    w = F.array(*((d == k).cast("double") for k in (0, 1, 2)))
    s = matrix(cross_products(genotypes, F.concat(F.array(F.lit(1.0)), w, doubles(dosage), F.array(F.col(response).cast("double")))))
    _, _, c = centred(s)
    zy, yy, ratios = scan.trait(t)
    name = scan.chromosomes[locus]
    wz = c[:3, 3 : 3 + scan.loci]
    ww = scan.products(name, ratios[name], wz, wz, c[:3, :3])
    wy = scan.products(name, ratios[name], wz, zy[None, :], c[:3, -1:])[:, 0]
    rest = float(scan.products(name, ratios[name], zy[None, :], zy[None, :], np.array([[yy]]))[0, 0])
    values, vectors = np.linalg.eigh(ww)
    keep = values > 1e-10 * max(values[-1], 1e-300)
    values, vectors = values[keep], vectors[:, keep]
    b = vectors.T @ wy
    ratio, _, _ = reml_ratio(values, b, rest, scan.n)
    return list(zip((0, 1, 2), (vectors @ (b / (values + ratio))).tolist(), strict=True))


def state_probabilities(df: DataFrame, entity: str, observed: str, error: float = 0.02, change: float = 0.05) -> DataFrame:
    """(entity, locus, p1, call): forward-backward over a two-state chain along each entity's loci; null observations say nothing.

    Works along the loci for all entities of a batch at once.
    """
    kinds = dict(df.dtypes)
    step = np.array([[1 - change, change], [change, 1 - change]])

    def chain(batches):
        for pdf in batches:
            sizes = pdf[observed].map(len)
            for n, mine in pdf.groupby(sizes):
                if not n:
                    continue
                seen = np.array([[np.nan if o is None else o for o in seq] for seq in mine[observed]], float)
                emit = np.where(np.isnan(seen)[..., None], 0.5, np.where((seen == 0)[..., None], [1 - error, error], [error, 1 - error]))
                f, b = np.empty_like(emit), np.ones_like(emit)
                for i in range(n):
                    f[:, i] = emit[:, i] * (f[:, i - 1] @ step if i else 0.5)
                    f[:, i] /= f[:, i].sum(1, keepdims=True)
                for i in range(n - 2, -1, -1):
                    b[:, i] = (emit[:, i + 1] * b[:, i + 1]) @ step.T
                    b[:, i] /= b[:, i].sum(1, keepdims=True)
                p = f * b
                p1 = (p[..., 1] / p.sum(2)).ravel()
                yield pd.DataFrame({entity: np.repeat(mine[entity].to_numpy(), n), "locus": np.tile(np.arange(n), len(mine)), "p1": p1, "call": (p1 > 0.5).astype(int)})

    return df.select(entity, observed).mapInPandas(chain, f"{entity} {kinds[entity]}, locus int, p1 double, call int")
