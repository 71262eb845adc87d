"""Relational preparation: filters, checked joins, set algebra, reshaping. DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.exprs import col


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in the columns."""
    return df.dropna(subset=list(columns))


def not_in(column: str, values: Sequence) -> Column:
    """Negated membership that keeps nulls, as in R; SQL's NOT IN drops them."""
    return ~F.col(column).isin(list(values)) | F.col(column).isNull()


def null_outside_windows(df: DataFrame, rules: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """value becomes null where at lies outside its key's window in rules (key, low, high); a null limit is open.

    Rules are a configuration table of a row for each key; its size is what the planner decides the join by.
    """
    joined = df.join(rules, key, "left")
    outside = (F.col(at) < F.col("low")) | (F.col(at) > F.col("high"))
    return joined.withColumn(value, F.when(F.coalesce(outside, F.lit(False)), F.lit(None)).otherwise(F.col(value))).drop("low", "high")


def update_where(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    """Sets column where condition holds; raises, when run, if no row matches."""
    found = df.where(condition).limit(1).agg(F.count("*").alias("_found"))
    new = F.when(condition, value).otherwise(F.col(column))
    none = F.raise_error(F.lit("no rows matched")).cast(dict(df.dtypes)[column])
    return df.join(F.broadcast(found), F.lit(True)).withColumn(column, F.when(F.col("_found") == 0, none).otherwise(new)).drop("_found")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, others converted, what doesn't convert null."""
    return df.select(
        *(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)
    )


def select_rows(df: DataFrame, filters: Sequence[Mapping[str, Sequence]], expand: str | None = None) -> DataFrame:
    """Rows that meet all filters; with expand, all rows that share its value with one of them."""
    met = df
    for conditions in filters:
        for column, values in conditions.items():
            met = met.where(F.col(column).isin(list(values)))
    return met if expand is None else df.join(met.select(expand).distinct(), expand, "left_semi")


def covered_by(df: DataFrame, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key is found in each of the other tables."""
    for other, key in others:
        df = df.join(other.select(key).distinct(), key, "left_semi")
    return df


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that has to match every row: an unmatched key raises when the row is read."""
    found = right.withColumn("_found", F.lit(True))
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no match for "), key)).cast("boolean")).otherwise(F.lit(True))
    return left.join(found, list(keys), "left").where(checked).drop("_found")


def prefer(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """In groups that have a flagged row, only flagged rows; all rows elsewhere."""
    w = Window.partitionBy(*by)
    return df.withColumn("_any", F.max(F.col(flag).cast("int")).over(w)).where((F.col("_any") == 0) | F.col(flag)).drop("_any")


def update_from(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """left with column taken from right where right has it."""
    new = right.select(*keys, F.col(column).alias("_new"))
    return left.join(new, list(keys), "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def overlapping(points: DataFrame, intervals: DataFrame, start: str, end: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with start <= high and end >= low, by an equi-join on bins of the given width, each pair once."""

    def bins(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))

    left, right = points.withColumn("_bin", bins(start, end)), intervals.withColumn("_bin", bins(low, high))
    first = F.greatest(F.floor(F.col(start) / width), F.floor(F.col(low) / width))
    return left.join(right, "_bin").where((F.col(start) <= F.col(high)) & (F.col(end) >= F.col(low)) & (F.col("_bin") == first)).drop("_bin")


def present_everywhere(df: DataFrame, entity: str, place: str) -> DataFrame:
    """Entities found in every place; a null entity counts for no entity, but its place counts."""
    places = df.select(place).where(F.col(place).isNotNull()).distinct().agg(F.count("*").alias("_places"))
    seen = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count_distinct(place).alias("_seen"))
    return seen.join(F.broadcast(places), F.col("_seen") == F.col("_places")).select(entity)


def scatter(universe: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every row of the universe with its prediction or null; a key predicted twice raises."""
    once = predictions.groupBy(key).agg(
        *(F.first(c).alias(c) for c in predictions.columns if c != key), F.count("*").alias("_times")
    )
    ok = F.when(F.col("_times") > 1, F.raise_error(F.lit("predicted twice")).cast("boolean")).otherwise(F.lit(True))
    return universe.join(once.where(ok).drop("_times"), key, "left")


def densify(df: DataFrame, by: str, at: str, grid: DataFrame) -> DataFrame:
    """Each by with each point of the grid, null where df has no row. The grid is small by design: a day or time axis."""
    return df.select(by).distinct().join(F.broadcast(grid.select(at).distinct()), F.lit(True)).join(df, [by, at], "left")


def pad(df: DataFrame, by: str, order: str, value: str, fill: float = 0.0) -> DataFrame:
    """(by, padded, mask): each group's values in order, filled up to the longest group's length."""
    lists = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))
    longest = lists.agg(F.max(F.size("_l")).alias("_n"))
    n = F.size("_l")
    out = lists.join(F.broadcast(longest), F.lit(True))
    return out.select(
        by,
        F.concat(F.transform("_l", lambda x: x[value]), F.array_repeat(F.lit(fill), F.col("_n") - n)).alias("padded"),
        F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.col("_n") - n)).alias("mask"),
    )


def one_hot(column: str | Column, vocabulary: Sequence[str]) -> Column:
    """Array of 0 and 1 over the vocabulary; an unseen value raises."""
    c = col(column)
    return F.when(c.isin(list(vocabulary)), F.transform(F.array(*map(F.lit, vocabulary)), lambda v: (v == c).cast("int"))).otherwise(
        F.raise_error(F.concat(F.lit("unseen value "), c)).cast("array<int>")
    )
