"""Kernels over entities in long form (i, j, k), and genomic relationships; pairs are made in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.blocks import kernel, linked, shape


def pair_kernel(df: DataFrame, entity: str, features: str, kind: str = "linear", gamma: float | None = None, within: str | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, k), i <= j: linear (dot product over the number of features), dot, rbf, laplace or match; within restricts pairs to equal values of a column, digits rounds."""
    return kernel(df, entity, [(features, kind, gamma)], within=within, digits=digits)


def symmetric(kernel: DataFrame) -> DataFrame:
    """Both triangles."""
    return kernel.unionByName(kernel.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))


def centered(kernel: DataFrame) -> DataFrame:
    """Double-centred: minus row and column means, plus the grand mean. The kernel holds both triangles."""
    rows = kernel.groupBy("i").agg(F.avg("k").alias("_ri"))
    columns = rows.select(F.col("i").alias("j"), F.col("_ri").alias("_rj"))
    grand = rows.agg(F.avg("_ri").alias("_g"))
    return kernel.join(rows, "i").join(columns, "j").join(F.broadcast(grand), F.lit(True)).select(
        "i", "j", (F.col("k") - F.col("_ri") - F.col("_rj") + F.col("_g")).alias("k")
    )


def expand_kernel(kernel: DataFrame, rows: DataFrame, row: str, entity: str) -> DataFrame:
    """An entity kernel (both triangles) between observations: each pair of rows takes its entities' value."""
    a = rows.select(F.col(row).alias("i"), F.col(entity).alias("_ei"))
    b = rows.select(F.col(row).alias("j"), F.col(entity).alias("_ej"))
    k = kernel.select(F.col("i").alias("_ei"), F.col("j").alias("_ej"), "k")
    return a.join(k, "_ei").join(b, "_ej").select("i", "j", "k")


def scaled_features(df: DataFrame, entity: str, features: str, by: str | None = None, fit: Column | None = None) -> DataFrame:
    """Each feature standardised (ddof 1) within by, or by the rows that fit selects; no spread counts as 1, non-finite as 0."""
    long = df.select(entity, *([by] if by else []), *([fit.alias("_fit")] if fit is not None else []), F.posexplode(features).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    keys = ["pos", *([by] if by else [])]
    source = long if fit is None else long.where("_fit")
    stats = source.groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    z = F.coalesce((F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0), F.lit(0.0))
    return long.join(stats, keys).groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", z.alias("z")))), lambda x: x["z"]).alias("z"))


def allele_frequencies(dosages: DataFrame, entity: str, array: str) -> DataFrame:
    """(locus, p, n) from arrays of 0, 1, 2."""
    return dosages.select(F.posexplode(array).alias("locus", "d")).groupBy("locus").agg((F.avg("d") / 2).alias("p"), F.count("d").alias("n"))


def relationship(dosages: DataFrame, entity: str, array: str, kind: str = "additive", digits: int | None = None) -> DataFrame:
    """Genomic relationship (i, j, k), i <= j.

    additive: centred dosages over 2 * sum(p q). dominance: heterozygote codes over
    4 * sum(p^2 q^2). Monomorphic loci contribute nothing; without any other
    locus all relationships are 0.
    """
    p = allele_frequencies(dosages, entity, array)
    ps = p.agg(F.transform(F.array_sort(F.collect_list(F.struct("locus", "p"))), lambda x: x["p"]).alias("_p"))
    coded = dosages.select(entity, array).join(F.broadcast(ps), F.lit(True))
    if kind == "additive":
        z = F.zip_with(array, "_p", lambda d, q: d.cast("double") - 2 * q)
        unit = lambda q: 2 * q * (1 - q)
    else:
        z = F.zip_with(array, "_p", lambda d, q: F.when(d == 0, -2 * q * q).when(d == 1, 2 * q * (1 - q)).otherwise(-2 * (1 - q) * (1 - q)))
        unit = lambda q: 4 * q * q * (1 - q) * (1 - q)
    scale = F.aggregate("_p", F.lit(0.0), lambda s, q: s + unit(q))
    # The scale is shared out between both sides; without a locus that varies all is 0.
    root = F.coalesce(F.try_divide(F.lit(1.0), F.sqrt(scale)), F.lit(0.0))
    coded = coded.select(entity, F.transform(z, lambda v: v * root).alias("_z"))
    return kernel(coded, entity, [("_z", "dot", None)], shape=shape(dosages, entity, [array]), digits=digits).withColumn("k", F.coalesce("k", F.lit(0.0)))


def near_identical(dosages: DataFrame, entity: str, array: str, above: float = 0.95) -> DataFrame:
    """Entities that match another one at more than the given share of loci; both of a pair are listed."""
    return linked(dosages.select(entity, F.col(array).alias("_d")), entity, ("_d", "match", None), above)


#: Taxa of one block of a wide genotype table.
TAXA = 256


def wide_genotypes(dosages: DataFrame, taxon: Column, array: str) -> DataFrame:
    """(block, taxa, locus, dosages): loci as rows and taxa as columns, as HapMap files hold them, cut into blocks of at most TAXA taxa.

    Each block has its own header of taxa, so neither a row nor the plan grows with their number.
    """
    dealt = dosages.select(taxon.alias("taxon"), F.col(array).alias("_d"), F.floor(F.monotonically_increasing_id() / TAXA).alias("block"))
    block = dealt.groupBy("block").agg(F.collect_list(F.struct("taxon", "_d")).alias("_b"))
    loci = F.sequence(F.lit(0), F.array_max(F.transform("_b", lambda e: F.size(e["_d"]))) - 1)
    rows = block.where(F.exists("_b", lambda e: F.size(e["_d"]) > 0)).select("block", "_b", F.explode(loci).alias("locus"))
    held = F.filter("_b", lambda e: F.size(e["_d"]) > F.col("locus"))
    return rows.select("block", F.transform(held, lambda e: e["taxon"]).alias("taxa"), "locus", F.transform(held, lambda e: F.get(e["_d"], F.col("locus"))).alias("dosages"))


def long_genotypes(wide: DataFrame) -> DataFrame:
    """(locus, taxon, dosage) of all columns of a wide genotype table."""
    cells = wide.select("locus", F.explode(F.arrays_zip("taxa", "dosages")).alias("c"))
    return cells.select("locus", F.col("c.taxa").alias("taxon"), F.col("c.dosages").alias("dosage"))


def peaks(scan: DataFrame, by: list[str], pos: str, lod: str, threshold: float, drop: float) -> DataFrame:
    """Each group's highest position above threshold, with the contiguous support around it that stays within drop of the peak."""
    w = Window.partitionBy(*by)
    best = F.max_by(F.col(pos), F.struct(F.col(lod), -F.col(pos))).over(w)
    marked = scan.withColumns({"_peak": best, "_top": F.max(lod).over(w)}).where(F.col("_top") > threshold)
    out = F.col(lod) < F.col("_top") - drop
    lo_break = F.max(F.when(out & (F.col(pos) < F.col("_peak")), F.col(pos))).over(w)
    hi_break = F.min(F.when(out & (F.col(pos) > F.col("_peak")), F.col(pos))).over(w)
    inside = marked.withColumns({"_lo": lo_break, "_hi": hi_break}).where(
        (F.col("_lo").isNull() | (F.col(pos) > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col(pos) < F.col("_hi")))
    )
    return inside.groupBy(*by).agg(F.first("_peak").alias("pos"), F.first("_top").alias("lod"), F.min(pos).alias("ci_lo"), F.max(pos).alias("ci_hi"))
