"""Scores of predictions: by group, by label, pooled, paired, and through levels of a hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import exprs as X


def mode(df: DataFrame, by: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value of each group; among equals the least. Counts first, so no group is gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    least_first = F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))
    return counts.groupBy(*by).agg(F.min(least_first)["v"].alias(out))


def correlation_with_status(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """N, N complete, r and why there is none: pairs aren't deleted, so a missing value means no r."""
    complete = X.is_finite(x) & X.is_finite(y)
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(complete).alias("n_complete"), F.stddev_samp(x).alias("_sx"), F.stddev_samp(y).alias("_sy"), X.correlation(x, y).alias("_r"),
    )
    status = (
        F.when(F.col("n_complete") < F.col("n"), "missing").when(F.col("n") < least, "insufficient")
        .when((F.col("_sx") == 0) | (F.col("_sy") == 0), "zero variance").otherwise("ok")
    )
    return sums.withColumn("status", status).withColumn("cor", F.when(F.col("status") == "ok", F.col("_r"))).drop("_sx", "_sy", "_r")


def average_rank(by: Sequence[str], value: str) -> Column:
    """Rank within by, ties sharing the mean of theirs."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


#: Steps of a binary search among 63 bounds of intervals, and the interval of nulls.
STEPS = (32, 16, 8, 4, 2, 1)
NULLS = 2 * sum(STEPS) + 1


def with_number_below(df: DataFrame, value: str, bounds: Column, out: str) -> DataFrame:
    """How many of the sorted bounds are less than a value. A step of the search is a column of its own, as subqueries can't stand in lambdas."""
    df = df.withColumn(out, F.lit(0))
    for step in STEPS:
        df = df.withColumn(out, F.col(out) + F.when(F.get(bounds, F.col(out) + step - 1) < F.col(value), step).otherwise(0))
    return df


def ranked_by_interval(df: DataFrame, by: Sequence[str], order: Sequence[str], bounds: Column, interval: str, rank: str, average: bool) -> DataFrame:
    """The interval of each row in the order, and its rank among the rows of its group in that interval.

    Intervals keep the order, so a rank in the group is the rank in the interval and the
    number of rows in those below. Interval 2k lies above k bounds of the first column; a value that
    reaches over two bounds has 2k+1 to itself, which the next column divides. If none is left to
    divide, all rows of it are equal: with average they get 0 and stay with the part of the table they come from.
    """
    out = df.withColumns({interval: F.lit(0), "_equal": F.lit(True)})
    for c in order:
        fills = (F.get(bounds[c], F.col("_at")) == F.col(c)) & (F.get(bounds[c], F.col("_at") + 1) == F.col(c))
        out = with_number_below(out, c, bounds[c], "_at")
        out = out.withColumn("_at", F.when(F.col(c).isNull(), NULLS).otherwise(2 * F.col("_at") + F.coalesce(fills, F.lit(False)).cast("int")))
        out = out.withColumns({interval: F.col(interval) * (NULLS + 1) + F.when(F.col("_equal"), F.col("_at")).otherwise(0), "_equal": F.col("_equal") & (F.col("_at") % 2 == 1)})
    part = F.when(F.col("_equal"), F.spark_partition_id()).otherwise(-1) if average else F.lit(-1)
    w = Window.partitionBy(*by, interval, "_part").orderBy(*map(F.asc_nulls_last, order))
    mean = F.when(F.col("_equal"), 0.0).otherwise((F.rank().over(w) + F.count("*").over(w)) / 2.0)
    return out.withColumn("_part", part).withColumn(rank, mean if average else F.row_number().over(w).cast("double")).drop("_at", "_equal", "_part")


def rank_correlation(df: DataFrame, by: Sequence[str], x: Sequence[str], y: Sequence[str], average: bool) -> DataFrame:
    """Correlation of the ranks in the orders x and y, null if either is constant; no task sorts a whole group.

    Rows are ranked in intervals of about a 64th of all rows, and sums over pairs of intervals
    are moved by the rows below them. Bounds are approximate quantiles, the ranks are exact.
    """
    columns = list(dict.fromkeys([*x, *y]))
    shares = [k / (sum(STEPS) + 1) for k in range(1, sum(STEPS) + 1)]
    bounds = df.agg(F.struct(*(F.percentile_approx(c, shares, 1000).alias(c) for c in columns)).alias("bounds")).scalar()
    ranked = ranked_by_interval(df.select(*by, *columns), by, x, bounds, "_x", "_rx", average)
    ranked = ranked_by_interval(ranked.select(*by, *y, "_x", "_rx"), by, y, bounds, "_y", "_ry", average)
    rx, ry = F.col("_rx"), F.col("_ry")
    cells = ranked.groupBy(*by, "_x", "_y").agg(
        F.count("*").alias("n"), F.sum(rx).alias("x"), F.sum(ry).alias("y"), F.sum(rx * rx).alias("xx"), F.sum(ry * ry).alias("yy"), F.sum(rx * ry).alias("xy"),
    )
    group, n = Window.partitionBy(*by), F.col("n")

    def shift(interval: str, ranks: str) -> Column:
        """What lies between a rank in an interval and the rank in the group, less the group's mean rank."""
        here = F.sum(n).over(Window.partitionBy(*by, interval))
        below = F.sum(n).over(group.orderBy(interval)) - here
        return below + F.when(F.col(ranks) == 0, (here + 1) / 2.0).otherwise(0.0) - (F.sum(n).over(group) + 1) / 2.0

    sx, sy = F.col("_sx"), F.col("_sy")
    sums = cells.withColumns({"_sx": shift("_x", "x"), "_sy": shift("_y", "y")}).groupBy(*by).agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(n * sx * sx + 2 * sx * F.col("x") + F.col("xx")).alias("xx"),
        F.sum(n * sy * sy + 2 * sy * F.col("y") + F.col("yy")).alias("yy"),
        F.sum(n * sx * sy + sx * F.col("y") + sy * F.col("x") + F.col("xy")).alias("xy"),
    )
    # Ranks that differ have a sum of squares of n(n-1)/4 at least; what is less comes from rounding.
    least = n * (n - 1) / 8
    varies = (n > 1) & (F.col("xx") > least) & (F.col("yy") > least)
    return sums.select(*by, F.when(varies, F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))).alias("rho"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return rank_correlation(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, [x], [y], average=True)


def spearman_ordinal(df: DataFrame, by: Sequence[str], x: str, y: str, key: str) -> DataFrame:
    """Of equal values that with the lesser key comes first; 0 for a constant, which only a single row has."""
    return rank_correlation(df, by, [x, key], [y, key], average=False).withColumn("rho", F.coalesce("rho", F.lit(0.0)))


def hierarchical_mean(df: DataFrame, by: Sequence[str], levels: Sequence[str], value: str) -> DataFrame:
    """Means of means, innermost level first; then mean, sd and number of the outermost level's values."""
    out = df
    for depth in range(len(levels), 0, -1):
        out = out.groupBy(*by, *levels[:depth]).agg(F.avg(value).alias(value))
    return out.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


MOMENTS = ("m_n", "m_a", "m_p", "m_aa", "m_pp", "m_ap", "m_dd")


def moments(actual: str, predicted: str) -> list[Column]:
    """n, means, centred sums of squares and products, and squared differences over complete pairs, from which n, r and RMSE follow.

    They add up over groups, so one aggregation at the finest level serves all
    coarser ones: the rows are scanned and shuffled once however many poolings there
    are. Centred sums keep their digits where means are large beside the spread.
    """
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    a, p = F.when(both, F.col(actual).cast("double")), F.when(both, F.col(predicted).cast("double"))
    n = F.count(a)
    found = (n, F.avg(a), F.avg(p), n * F.var_pop(a), n * F.var_pop(p), n * F.covar_pop(a, p), F.sum((a - p) * (a - p)))
    return [c.alias(name) for name, c in zip(MOMENTS, found, strict=True)]


def added_up(fine: DataFrame, *by: str) -> DataFrame:
    """The moments of coarser groups: each finer group adds its own spread and that of its mean around the common one."""
    w, n = Window.partitionBy(*by), F.col("m_n")
    mean = {c: F.try_divide(F.sum(n * F.col(c)).over(w), F.sum(n).over(w)) for c in ("m_a", "m_p")}
    off = fine.withColumns({f"_{c}": m for c, m in mean.items()})
    da, dp = F.col("m_a") - F.col("_m_a"), F.col("m_p") - F.col("_m_p")
    return off.groupBy(*by).agg(
        F.sum("m_n").alias("m_n"), F.first("_m_a").alias("m_a"), F.first("_m_p").alias("m_p"), F.sum(F.col("m_aa") + n * da * da).alias("m_aa"),
        F.sum(F.col("m_pp") + n * dp * dp).alias("m_pp"), F.sum(F.col("m_ap") + n * da * dp).alias("m_ap"), F.sum("m_dd").alias("m_dd"),
    )


def from_moments() -> list[Column]:
    """n, r (null without variance) and e (RMSE)."""
    n, va, vp = F.col("m_n"), F.col("m_aa"), F.col("m_pp")
    # A spread that only rounding of the means keeps from zero counts as none.
    varies = (va > 1e-24 * n * F.col("m_a") * F.col("m_a")) & (vp > 1e-24 * n * F.col("m_p") * F.col("m_p"))
    r = F.when(varies, F.try_divide(F.col("m_ap"), F.sqrt(va) * F.sqrt(vp)))
    return [n.alias("n"), r.alias("r"), F.sqrt(F.try_divide("m_dd", "m_n")).alias("e")]


def score_by_label(df: DataFrame, label: str, block: str, actual: str, predicted: str) -> DataFrame:
    """n, rmse and Pearson's r of each label, and its block correlations pooled."""
    fine = df.groupBy(label, block).agg(*moments(actual, predicted))
    pooled = fine.select(label, *from_moments()).groupBy(label).agg(X.pooled_correlation_strict("r", "n").alias("r_w"), X.blocks_used("r", "n").alias("blocks"))
    flat = added_up(fine, label).select(label, *from_moments()).withColumnsRenamed({"r": "pearson", "e": "rmse"})
    return flat.join(pooled, label, "left")


def paired_summary(df: DataFrame, by: Sequence[str], ours: str, theirs: str) -> DataFrame:
    """Mean difference, in percent of theirs, share of wins (smaller is better) and paired t."""
    d = F.col(ours) - F.col(theirs)
    t = F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d)))
    return df.groupBy(*by).agg(
        F.avg(d).alias("diff"), (100 * F.try_divide(F.avg(d), F.avg(theirs))).alias("percent"), F.avg(F.when(d < 0, 1.0).otherwise(0.0)).alias("wins"), t.alias("t")
    )
