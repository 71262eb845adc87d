"""Operators on ordered rows within groups: fills, interpolation, outlier filters, cumulative axes, draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import col, hash_order


def ordered(by: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str, propagate_null: bool = True) -> DataFrame:
    """Row-wise cumulative sum; with propagate_null every sum after a null is null."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(w)
    if propagate_null:
        total = F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), total)
    return df.withColumn(out, total)


def fill_both_ways(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value before, else the first after."""
    w = ordered(by, order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(before, after))


def interpolate(df: DataFrame, by: Sequence[str], at: str, value: str, out: str) -> DataFrame:
    """Linear between the neighbouring known values, clamped at both ends; null in groups without any."""
    w = ordered(by, [at])
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    spans = df.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_n", F.first(known, ignorenulls=True).over(ahead))
    t0, v0, t1, v1 = F.col("_p.t"), F.col("_p.v"), F.col("_n.t"), F.col("_n.v")
    blend = v0 + (v1 - v0) * F.try_divide(F.col(at).cast("double") - t0, t1 - t0)
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(F.coalesce(blend, v0, v1))
    return spans.withColumn(out, filled).drop("_p", "_n")


def hampel(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, k: int, t0: float, out: str) -> DataFrame:
    """Interior values further than t0 scaled MADs from the median of their 2k+1 neighbours become null."""
    w = ordered(by, order).rowsBetween(-k, k)
    near = df.withColumn("_near", F.collect_list(value).over(w)).withColumn("_rows", F.count(F.lit(1)).over(w))
    middle = F.element_at(F.array_sort("_near"), k + 1)
    spread = F.element_at(F.array_sort(F.transform("_near", lambda x: F.abs(x - middle))), k + 1) * 1.4826
    whole = (F.size("_near") == 2 * k + 1) & (F.col("_rows") == 2 * k + 1)
    return near.withColumn(out, F.when(whole & (F.abs(F.col(value) - middle) > t0 * spread), F.lit(None)).otherwise(F.col(value))).drop("_near", "_rows")


def as_of(grid: DataFrame, targets: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """Each target's value on the grid: exact, else blended between the neighbours, clamped at the ends.

    A union of both sides and two windows, so one shuffle by group and no range join.
    """
    both = grid.select(*by, F.col(at), F.col(value).alias("_v"), F.lit(0).alias("_target")).unionByName(
        targets.select(*by, F.col(at), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_target")).distinct()
    )
    w = ordered(by, [at, "_target"])
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col("_v").alias("v")))
    near = both.withColumns(
        {
            "_p": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_n": F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).where("_target = 1")
    part = F.try_divide(F.col(at).cast("double") - F.col("_p.t"), F.col("_n.t") - F.col("_p.t"))
    blend = F.when(F.col("_p.t") == F.col(at).cast("double"), F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * part)
    return near.select(*by, at, F.coalesce(blend, F.col("_p.v"), F.col("_n.v")).alias(value))


def collapse_axis(df: DataFrame, by: Sequence[str], day: str, step: str, values: Sequence[str], digits: int = 6) -> DataFrame:
    """Days with equal cumulative sums become one: values are averaged, the first day stays, sums start over from the averages."""
    summed = running_sum(df, by, [day], step, "_upto", propagate_null=False)
    merged = summed.groupBy(*by, F.round("_upto", digits).alias("_key")).agg(
        F.min(day).alias(day), F.avg(step).alias(step), *(F.avg(v).alias(v) for v in values)
    )
    return running_sum(merged, by, [day], step, "axis", propagate_null=False).drop("_key")


def draw(df: DataFrame, k: int | Column, seed: int | str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """k rows of each group, by the order of a hash of seed and key: the same on every run and partitioning."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, *key), *map(col, key))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def hash_ranked(df: DataFrame, seed: int | str, key: str, rank: str = "rank", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """df with each row's place in the order of a hash of seed and key, within by, and the number of rows.

    Rows are ranked within the 4096 prefixes of the hash, and the counts of the
    prefixes before are added: no task ranks all rows, and what is broadcast has
    at most 4096 rows.
    """
    prefixed = df.withColumn("_h", hash_order(seed, key)).withColumn("_q", F.substring("_h", 1, 3))
    every = Window.partitionBy(*by or [F.lit(0)])
    before = prefixed.groupBy(*by, "_q").agg(F.count("*").alias("_c")).select(
        *by, "_q",
        F.coalesce(F.sum("_c").over(every.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(every).alias(n),
    )
    within = F.row_number().over(Window.partitionBy(*by, "_q").orderBy("_h", key))
    ranked = prefixed.withColumn("_r", within).join(F.broadcast(before), [*by, "_q"])
    return ranked.withColumn(rank, F.col("_before") + F.col("_r")).drop("_h", "_q", "_r", "_before")


def folds(df: DataFrame, k: int, seed: int | str, key: str, out: str = "fold") -> DataFrame:
    """Folds of ceil(n/k) keys each in hash order; the last ones may stay smaller or empty."""
    ranked = hash_ranked(df, seed, key, "_rank", "_n")
    size = F.ceil(F.col("_n") / F.lit(float(k)))
    return ranked.withColumn(out, F.floor((F.col("_rank") - 1) / size).cast("int") + 1).drop("_rank", "_n")
