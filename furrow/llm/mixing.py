"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target in words. A document belongs to the mix as many times as
its source's target holds whole copies of the source, and once more if its hash
lies under the source's threshold for the rest. The thresholds are found without
sorting documents: words are summed by source and hash bucket, a running sum over
a source's few thousand buckets finds the one in which the rest runs out, and
only that bucket is split into finer ones. Three such levels leave a handful of
documents in the last bucket. The driver sees nothing of it: histograms are
aggregated with map-side partial sums, so that a source with a third of all
rows is no more work for one task than any other.

The hash is the MD5 of the document's id. Documents that share an id stand or
fall together. A threshold lies after the document whose inclusion brings the
source closest to its target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.shared import BROADCAST_BYTES, free_name, settle

WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
#: Hex digits of the hash that each level of refinement reads; the last level reads all the rest.
DIGITS = (3, 3, 26)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """df with, under each name, the sum of the column over the rows before each row in order.

    Rows are dealt by ranges of the order; each range sums its own and starts from
    what the ranges before it hold. So no task has all rows: only the ranges' totals,
    one row each, meet in one place.
    """
    part = free_name(df, "part")
    dealt = settle(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    held = totals.select(part, *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{part}_{name}") for name in sums))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {name: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{part}_{name}") for name, c in sums.items()}
    return dealt.join(F.broadcast(held), part).withColumns(added).drop(part, *(f"{part}_{name}" for name in sums))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): weight and target of each source, null last.

    Water-filling in closed form: targets are ``weight * level`` but at most
    ``most`` times the source's size. With the sources in the order in which they
    reach their cap, the level is what is left after the first k caps over the
    weight that is left, at the first k where the next source stays under its cap.
    """
    by_name = F.col("source").asc_nulls_last()
    named = prefix_sums(sizes, [by_name], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double")
    caps = named.withColumns({"weight": weight, "cap": most * F.col("source_size").cast("double")}).withColumn("full", F.col("cap") / F.col("weight"))
    left = settle(prefix_sums(caps.drop("place"), [F.col("full").asc(), by_name], {"capped": F.col("cap"), "weighed": F.col("weight")}))
    all_of = left.agg(F.sum("source_size").cast("double").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    level = (F.col("all_sizes") - F.col("capped")) / (F.col("all_weights") - F.col("weighed"))
    first = (
        left.join(F.broadcast(all_of), F.lit(True)).where(level * F.col("weight") <= F.col("cap"))
        .agg(F.min(F.struct("full", level.alias("level")))["level"].alias("level"))
    )
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return left.join(F.broadcast(first), F.lit(True)).select("source", "source_size", "weight", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """From (source, size, hash) and targets: whole copies of each source, and the hash up to which one more is taken.

    The result's source is called of_source. ``bound`` is null where no document is taken once more.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    budgets = targets.where("source_size > 0").select(
        F.col("source").alias("of_source"),
        whole.alias("copies"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
    )
    edges = budgets.where("rest > 0").select("of_source", F.lit("").alias("prefix"), "rest")
    run = Window.partitionBy("of_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    before, read = F.col("upto") - F.col("words"), 0
    for digits in DIGITS:
        prefix = F.substring("hash", 1, read)
        summed = (
            sized.join(hinted(edges), F.col("source").eqNullSafe(F.col("of_source")) & (prefix == F.col("prefix")))
            .groupBy("of_source", "prefix", "rest", F.substring("hash", 1, read + digits).alias("bucket"))
            .agg(F.sum("size").cast("double").alias("words"))
            .withColumn("upto", F.sum("words").over(run))
        )
        read += digits
        if read < sum(DIGITS):
            # The bucket in which the rest runs out; a source has a few thousand buckets at each level.
            edge = summed.where((before < F.col("rest")) & (F.col("upto") >= F.col("rest")))
            edges = settle(edge.select("of_source", F.col("bucket").alias("prefix"), (F.col("rest") - before).alias("rest")))
    # A document stays if at least half of it fits. If none does, all hashes with the prefix lie above the bound.
    fits = before + F.col("words") / 2 <= F.col("rest")
    ends = summed.groupBy("of_source").agg(F.coalesce(F.max(F.when(fits, F.col("bucket"))), F.max("prefix")).alias("bound"))
    ends = ends.select(F.col("of_source").alias("bound_of"), "bound")
    return budgets.join(ends, F.col("of_source").eqNullSafe(F.col("bound_of")), "left").select("of_source", "copies", "bound")


def hinted(per_source: DataFrame) -> DataFrame:
    """Broadcast if its rows, measured as JSON, are few bytes; else left to a shuffle join, whose skew Spark splits."""
    size = per_source.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(per_source) if size <= BROADCAST_BYTES else per_source


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with size, source_size, target (both of its source), copies and taken (= copies * size).

    A null text has size 0. A null source is a source of its own, last in order. A
    source whose texts are all empty has target 0. A document of size 0 takes
    nothing whatever its copies, which follow its hash. Null ids share one hash.
    Repeated rows stand or fall together. Texts of any length count whole. An empty
    table gives an empty mix.
    Columns of docs called like the added ones are replaced.
    """
    hashed = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    sized = settle(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hashed.alias("hash")))
    targets = settle(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    bounds = thresholds(sized, targets)
    plan = targets.join(bounds, F.col("source").eqNullSafe(F.col("of_source")), "left").select(
        F.col("source").alias("of_source"), "source_size", "target", F.coalesce("copies", F.lit(0)).alias("whole"), "bound"
    )
    found = free_name(docs, "mix")
    plan = plan.select(F.struct("*").alias(found))
    once_more = F.coalesce(hashed <= F.col(f"{found}.bound"), F.lit(False)).cast("long")
    copies = F.least(F.col(f"{found}.whole") + once_more, F.lit(most))
    return (
        docs.join(hinted(settle(plan)), F.col(source).eqNullSafe(F.col(f"{found}.of_source")), "left")
        .withColumns(
            {
                "size": n_words(F.col(text)),
                "source_size": F.col(f"{found}.source_size"),
                "target": F.col(f"{found}.target"),
                "copies": copies,
            }
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(found)
    )
