"""Iterative and stochastic estimators, files, registries; those that SQL can express have a twin."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import days_between, rounded
from furrow.operators import curves as CU
from furrow.operators import kernels as K
from furrow.operators import models as M
from furrow.operators import registry as E
from furrow.operators import spectrum as SP
from furrow.operators.timeseries import hash_ranked
from furrow.plans.kernels import dosages, vectors
from furrow.plans.registry import Tables, query
from furrow.sources import files as FS


def curves(t: Tables) -> DataFrame:
    at = days_between("ts", F.lit("2024-01-01").cast("timestamp"))
    return t("events", "event_type", "user_id", "ts", "value").select("event_type", "user_id", at.alias("t"), F.col("value").alias("y"))


def _model(df: DataFrame) -> DataFrame:
    return CU.fit(df, "event_type", "user_id", "t", "y")


@query()
def f01_sparse_fpca(t: Tables) -> DataFrame:
    return _model(curves(t))


@query()
def f02_conditional_scores(t: Tables) -> DataFrame:
    return CU.scores(curves(t), _model(curves(t)), "event_type", "user_id", "t", "y")


@query()
def f04_projected_scores(t: Tables) -> DataFrame:
    """Held-out curves under a model of the others."""
    train, held = curves(t).where("user_id % 5 != 0"), curves(t).where("user_id % 5 = 0")
    return CU.scores(held, _model(train), "event_type", "user_id", "t", "y")


@query()
def f06_channel_batch(t: Tables) -> DataFrame:
    found = CU.scores(curves(t), _model(curves(t)), "event_type", "user_id", "t", "y")
    return found.select("event_type", "user_id", F.posexplode("xi").alias("component", "score"))


def _plots(t: Tables) -> DataFrame:
    return t("events", "event_type", "user_id", "ts", "value").select(
        "event_type", (F.col("user_id") % 40).alias("genotype"), F.dayofweek("ts").alias("range"), F.pmod(F.col("user_id"), F.lit(7)).alias("rep"), "value")


@query()
def f08_blues(t: Tables) -> DataFrame:
    return M.blues(_plots(t), "event_type", "genotype", ["range", "rep"], "value")


@query()
def f09_variance_components(t: Tables) -> DataFrame:
    return M.variance_components(_plots(t), "event_type", ["genotype", "range", "rep"], "value")


@query()
def f10_principal_components(t: Tables) -> DataFrame:
    x = vectors(t)
    return M.eigen_projection(K.scaled_features(x, "id", "embedding"), "z", "id", 3)


@query()
def l04_kernel_eigen(t: Tables) -> DataFrame:
    """The centred kernel's largest values, with the residual that bounds each one's error."""
    found = SP.spectrum(vectors(t), "id", "embedding", most=10)
    rows = [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(found.values, found.residuals, strict=True))]
    return t.spark.createDataFrame(rows, "component int, value double, residual double")


@query()
def l06_eigen_projection(t: Tables) -> DataFrame:
    """Scores under the kernel of all environments but one: V sqrt(D) of its rows, K V / sqrt(D) of those of the environment left out."""
    train, new = vectors(t).where("label != 0"), vectors(t).where("label = 0 OR label IS NULL")
    found = SP.spectrum(train, "id", "embedding", most=10)
    return found.train().withColumn("train", F.lit(True)).unionByName(found.project(new, "embedding").withColumn("train", F.lit(False)))


@query()
def n05_relationship_features(t: Tables) -> DataFrame:
    """V sqrt(D) of the additive relationship: the centred dosages' kernel over 2 * sum(p q) instead of the number of loci."""
    found = SP.spectrum(dosages(t), "id", "d", most=5)
    scale = K.allele_frequencies(dosages(t), "id", "d").agg(F.sqrt(F.try_divide(F.count("*"), F.sum(2 * F.col("p") * (1 - F.col("p"))))).alias("_s"))
    return found.train().join(F.broadcast(scale), F.lit(True)).select("id", F.transform("z", lambda v: v * F.col("_s")).alias("z"))


@query()
def n10_genotype_probabilities(t: Tables) -> DataFrame:
    observed = F.transform("d", lambda v: F.when(v != 1, (v / 2).cast("int")))
    return M.state_probabilities(dosages(t).withColumn("o", observed), "id", "o")


#: Four chromosomes of 16 loci.
CHROMOSOMES = [f"chr{i // 16 + 1}" for i in range(64)]
RESPONSES = ["t0", "t1"]


def _cross(t: Tables) -> DataFrame:
    """Entities with dosages and two responses."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    responses = vectors(t).select("id", e(0).alias("t0"), (e(1) + e(2)).alias("t1"))
    return dosages(t).select("id", "d").join(responses, "id")


def _genome(t: Tables) -> tuple[M.Scan, DataFrame]:
    return M.genome_scan(_cross(t), "d", RESPONSES, CHROMOSOMES)


@query()
def n11_genome_scan(t: Tables) -> DataFrame:
    return _genome(t)[1]


@query()
def n12_permutation_threshold(t: Tables) -> DataFrame:
    """95 % quantile of the largest LOD under 1000 permuted responses."""
    top = M.permutation_lods(_cross(t), "id", "d", RESPONSES, CHROMOSOMES, times=1000, seed=3)
    return top.groupBy(F.col("trait").alias("phenotype")).agg(F.percentile("lod", F.lit(0.95)).alias("threshold"), F.count("*").alias("permutations"))


@query()
def n15_blup_at_peaks(t: Tables) -> DataFrame:
    """Effects of the dosage classes at each trait's best locus."""
    cross = _cross(t)
    scan, lods = M.genome_scan(cross, "d", RESPONSES, CHROMOSOMES)
    best = {r["trait"]: r["locus"] for r in lods.groupBy("trait").agg(F.max_by("locus", F.struct("lod", -F.col("locus"))).alias("locus")).collect()}
    rows = [(name, best[name], d, effect) for k, name in enumerate(RESPONSES) for d, effect in M.blups_at(cross, "d", name, k, best[name], scan)]
    return t.spark.createDataFrame(rows, "trait string, locus int, d int, blup double")


def _responses(t: Tables) -> DataFrame:
    y = F.when(F.col("id") % 4 != 0, F.get("embedding", F.lit(0)).cast("double") * 2 + F.get("embedding", F.lit(5)).cast("double"))
    return vectors(t).withColumn("y", y)


@query()
def x02_gaussian_process(t: Tables) -> DataFrame:
    return M.gp_predictions(_responses(t), "label", "id", "embedding", "y")


#: Fixed choice: every set of the three kernels, without and with the interaction of genotype and phenotype.
MODELS = {
    f"M{i}": terms
    for i, terms in enumerate(
        ([*main, *extra] for extra in ([], ["gp"]) for main in (["g"], ["p"], ["w"], ["g", "p"], ["g", "w"], ["p", "w"], ["g", "p", "w"])), 1
    )
}


@query()
def x03_bayesian_kernel(t: Tables) -> DataFrame:
    """14 models of up to four kernels, 10000 draws each with 1000 of burn-in."""
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    g, p = part(1, 4), part(17, 4)
    kernels = {"g": part(1, 16), "p": part(17, 16), "w": part(33, 16), "gp": F.flatten(F.transform(g, lambda a: F.transform(p, lambda b: a * b)))}
    return M.gibbs_predictions(_responses(t), "label", "id", kernels, MODELS, "y")


@query()
def x04_kernel_blup(t: Tables) -> DataFrame:
    return M.blup_predictions(_responses(t), "label", "id", "embedding", "y")


@query("""WITH t AS (SELECT task, 4 * exp(CAST('0x' || md5(CAST(task AS VARCHAR))[1:6] AS BIGINT) / 16777216.0 * ln(16)) AS size FROM range(20) r(task)),
  k AS (SELECT task, floor(size + 1e-9) AS size, c_custkey, row_number() OVER (PARTITION BY task ORDER BY md5(task || '|' || c_custkey), c_custkey) AS rank FROM t, customer)
  SELECT task, c_custkey, CASE WHEN rank <= size THEN 'context' ELSE 'query' END AS part FROM k WHERE rank <= 2 * size""")
def x06_task_sampler(t: Tables) -> DataFrame:
    """Context and query rows of 20 tasks, disjoint, sizes drawn log-uniformly by hash."""
    tasks = t.spark.range(20).withColumnRenamed("id", "task")
    key = F.md5(F.concat_ws("|", F.col("task").cast("string"), F.col("c_custkey").cast("string")))
    n = t("customer", "c_custkey").count()
    # A task draws 128 rows at most: those under a hash threshold that leaves ten times as many stand for all in the ranking.
    share = min(1.0, 1280 / max(n, 1))
    under = F.conv(F.substring(key, 1, 7), 16, 10).cast("double") < share * 16.0**7
    rows = t("customer", "c_custkey").join(F.broadcast(tasks), F.lit(True)).where(under)
    rank = F.row_number().over(Window.partitionBy("task").orderBy(key, "c_custkey"))
    u = F.conv(F.substring(F.md5(F.col("task").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    size = F.floor(4 * F.exp(u * F.log(F.lit(16.0))) + 1e-9)
    ranked = rows.withColumns({"rank": rank, "size": size}).where(F.col("rank") <= 2 * F.col("size"))
    return ranked.select("task", "c_custkey", F.when(F.col("rank") <= F.col("size"), "context").otherwise("query").alias("part"))


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS points, CAST(count(value) AS BIGINT) AS seen, round(min(t), 6) AS first, round(max(t), 6) AS last, round(sum(value), 4) AS total FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS t FROM events) GROUP BY 1, 2""")
def x11_view_assembly(t: Tables) -> DataFrame:
    """Each sample's channel as coordinates, values and mask, and what the view holds."""
    point = F.struct("t", "y")
    views = curves(t).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(point)).alias("p")).select(
        "user_id", "event_type", F.col("p.t").alias("coords"), F.col("p.y").alias("channel"), F.transform("p", lambda x: x["y"].isNotNull()).alias("mask"))
    total = F.aggregate("channel", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return views.select(
        "user_id", "event_type", F.size("coords").cast("long").alias("points"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("seen"),
        rounded(F.array_min("coords")).alias("first"), rounded(F.array_max("coords")).alias("last"), rounded(total, 4).alias("total"))


@query()
def c20_effective_rank(t: Tables) -> DataFrame:
    rows = []
    for fold in range(1, 6):
        values, _ = M.eigen(vectors(t).where(F.pmod(F.xxhash64("id"), F.lit(5)) != fold - 1), "embedding")
        rows.append((fold, len(values)))
    return t.spark.createDataFrame(rows, "fold int, rank int")


@query()
def t05_content_order(t: Tables) -> DataFrame:
    df = t("part")
    key = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.select("p_partkey", key.alias("content")).orderBy("content", "p_partkey")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p12_columns_by_type(t: Tables) -> DataFrame:
    """Numeric columns without a missing value, by one pass of counts."""
    df = t("lineitem")
    numeric = [c for c, kind in df.dtypes if kind in ("int", "bigint", "double", "float")]
    missing = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in numeric)).first()
    return df.select(*(c for c in numeric if missing[c] == 0))


@query("""SELECT * EXCLUDE (l_tax) FROM lineitem""")
def p14_channel_selectors(t: Tables) -> DataFrame:
    return t("lineitem").select(*E.resolve_channels(["l_*", "-l_tax", "vi:l_quantity"], t("lineitem").columns))


@query("SELECT * FROM (VALUES ('LINE', 'l_linenumber'), ('LINE', 'l_linestatus'), ('l_quantity', 'l_quantity')) v(wanted, found)")
def m18_column_matching(t: Tables) -> DataFrame:
    """Columns of a table's schema by exact name and by prefix, whatever their case."""
    found = E.match_columns([("l_line", "prefix"), ("L_QUANTITY", "exact")], t("lineitem").columns)
    names = {"l_line": "LINE", "L_QUANTITY": "l_quantity"}
    return t.spark.createDataFrame([(names[k], v) for k, vs in found.items() for v in vs], "wanted string, found string")


@query("""SELECT asked, arg_min(n_name, struct_pack(d := levenshtein(asked, n_name), n := n_name)) AS suggestion
          FROM (VALUES ('GERMNY'), ('FRANC'), ('JAPN')) a(asked), nation GROUP BY 1""")
def m25_close_match(t: Tables) -> DataFrame:
    """The nearest known name for each unknown one; the names asked for are few by nature."""
    wanted = t.spark.createDataFrame([("GERMNY",), ("FRANC",), ("JAPN",)], "asked string")
    pairs = wanted.join(F.broadcast(t("nation", "n_name")), F.lit(True)).withColumn("d", F.levenshtein("asked", "n_name"))
    return pairs.groupBy("asked").agg(F.min_by("n_name", F.struct("d", "n_name")).alias("suggestion"))


@query("""SELECT * FROM (VALUES ('fine', NULL), ('foreign', 'cv_0_00 has no stream CV2'), ('metrics', 'unknown metrics accuracy'),
          ('monitors', '2 monitors; wanted 1'), ('scheme', 'unknown scheme cv_9')) v(config, problem)""")
def v08_configuration_gates(t: Tables) -> DataFrame:
    """Experiments' settings from JSON files, and what a gate refuses them for."""
    stream = lambda name, monitor=False: {"name": name, "monitor": monitor}
    configs = {
        "fine": {"scheme": "cv_2_1", "streams": [stream("CV1", True), stream("CV2")], "metrics": ["rmse"]},
        "foreign": {"scheme": "cv_0_00", "streams": [stream("CV00", True), stream("CV2")], "metrics": ["rmse"]},
        "metrics": {"scheme": "cv_0_00", "streams": [stream("CV0", True)], "metrics": ["rmse", "accuracy"]},
        "monitors": {"scheme": "cv_2_1", "streams": [stream("CV1", True), stream("CV2", True)], "metrics": []},
        "scheme": {"scheme": "cv_9", "streams": [stream("CV1", True)], "metrics": []},
    }
    with FS.scratch(t.spark) as folder:
        rows = [(name, json.dumps(config)) for name, config in configs.items()]
        t.spark.createDataFrame(rows, "config string, value string").write.partitionBy("config").text(f"{folder}/settings")
        read = t.spark.read.text(f"{folder}/settings").collect()
    return t.spark.createDataFrame([(r["config"], E.problem(json.loads(r["value"]))) for r in read], "config string, problem string")


@query("""SELECT event_id, user_id, CASE WHEN isfinite(value) THEN value END AS value, round((CASE WHEN isfinite(value) THEN value END - avg(CASE WHEN isfinite(value) THEN value END) OVER w) / nullif(stddev_samp(CASE WHEN isfinite(value) THEN value END) OVER w, 0), 6) + 0.0 AS score FROM events WINDOW w AS (PARTITION BY user_id)""")
def e01_processor_registry(t: Tables) -> DataFrame:
    scored = E.apply_processors(t("events", "event_id", "user_id", "value"), ["finite_values", "group_scores"])
    return scored.withColumn("score", rounded("score"))


@query("""SELECT 'metrics' AS kind, unnest(['bias', 'log_density', 'pearson', 'rmse']) AS name,
          round(unnest([avg(p - a), avg(-0.5 * ln(2 * pi()) - 0.5 * (a - p) * (a - p)), corr(a, p), sqrt(avg((a - p) * (a - p)))]), 4) AS value
          FROM (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_linenumber AS DOUBLE) AS p FROM lineitem)""")
def e02_registries(t: Tables) -> DataFrame:
    """Every registered metric, found by name and computed in one pass."""
    df = t("lineitem", "l_quantity", "l_linenumber").select(F.col("l_quantity").cast("double").alias("a"), F.col("l_linenumber").cast("double").alias("p"))
    names = sorted(E.REGISTRIES["metrics"])
    wide = df.agg(*(rounded(E.find("metrics", name)("a", "p"), 4).alias(name) for name in names))
    return wide.unpivot([], names, "name", "value").select(F.lit("metrics").alias("kind"), "name", "value")


@F.udtf(returnType="term string, estimate double")
class LineFit:
    """From a group's moments, a row for each term of its regression line."""

    def eval(self, n: int, sx: float, sy: float, sxx: float, sxy: float, syy: float):
        mx, my = sx / n, sy / n
        xx, xy, yy = sxx - n * mx * mx, sxy - n * mx * my, syy - n * my * my
        slope = xy / xx if xx > 0 else 0.0
        yield "slope", slope
        yield "intercept", my - slope * mx
        yield "r2", xy * xy / (xx * yy) if xx > 0 and yy > 0 else 0.0


@query("""WITH g AS (SELECT event_type, regr_slope(value, user_id % 10) AS s, regr_intercept(value, user_id % 10) AS i, regr_r2(value, user_id % 10) AS r FROM events GROUP BY 1)
          SELECT event_type, unnest(['slope', 'intercept', 'r2']) AS term, round(unnest([s, i, r]), 5) + 0.0 AS estimate FROM g""")
def e04_table_function(t: Tables) -> DataFrame:
    """A table function over groups: one model for each, several rows out. It takes the group's moments, so groups may be of any size."""
    x, y = (F.col("user_id") % 10).cast("double"), F.col("value")
    known = t("events", "event_type", "user_id", "value").where(x.isNotNull() & y.isNotNull())
    sums = known.groupBy("event_type").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}.items()))
    made = LineFit(*(F.col(c).outer() for c in ("n", "sx", "sy", "sxx", "sxy", "syy")))
    return sums.lateralJoin(made).select("event_type", "term", rounded("estimate", 5).alias("estimate"))


@query("""SELECT c_custkey, CAST(floor((r - 1) / 16) AS BIGINT) AS batch, CAST(floor((r - 1) / 16) % 8 AS BIGINT) AS shard FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('1|' || c_custkey)) AS r FROM customer)""")
def e06_sharded_batches(t: Tables) -> DataFrame:
    """Batch ids dealt over eight shards by batch number."""
    batch = F.floor((F.col("rank") - 1) / 16)
    return hash_ranked(t("customer", "c_custkey"), 1, "c_custkey").select("c_custkey", batch.alias("batch"), F.pmod(batch, F.lit(8)).alias("shard"))


@query("""SELECT column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type FROM (SELECT column_name, column_type AS data_type FROM (DESCRIBE lineitem))""")
def s03_schema_probe(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in t("lineitem").schema], "name string, type string")


@query("""SELECT *, 'nation_' || (n_nationkey % 3) || '.csv' AS origin FROM nation""")
def s04_directory_scan(t: Tables) -> DataFrame:
    with FS.scratch(t.spark) as folder:
        for part in (0, 1, 2):
            FS.write_csv(t("nation").where(F.col("n_nationkey") % 3 == part), f"{folder}/nation_{part}.csv")
        return FS.landed(FS.read_directory(t.spark, folder, "nation_*.csv", t("nation").schema, expected=3))


@query("""SELECT user_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS t, value AS y FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value IS NULL OR isnan(value))""")
def s06_sample_table(t: Tables) -> DataFrame:
    """Samples whose every channel value is finite and whose time never repeats."""
    points = curves(t)
    checks = points.groupBy("user_id").agg((F.count_if(F.col("y").isNull() | F.isnan("y")) > 0).alias("bad"), F.count("*").alias("points"))
    return points.join(checks.where("bad"), "user_id", "left_anti").select("user_id", "event_type", "t", "y")


@query("""SELECT *, unnest(['json', 'csv']) AS format FROM region""")
def s07_format_dispatch(t: Tables) -> DataFrame:
    with FS.scratch(t.spark) as folder:
        t("region").write.json(f"{folder}/r.json")
        FS.write_csv(t("region"), f"{folder}/r.csv")
        both = [FS.read_any(t.spark, f"{folder}/r.{kind}", t("region").schema).withColumn("format", F.lit(kind)) for kind in ("json", "csv")]
        return FS.landed(both[0].unionByName(both[1]))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS position, s_name AS sample FROM supplier")
def s09_vcf_samples(t: Tables) -> DataFrame:
    """Samples of a written VCF file: one for each supplier."""
    with FS.scratch(t.spark) as folder:
        names = [r[0] for r in t("supplier").orderBy("s_suppkey").select("s_name").collect()]
        fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
        lines = ["##fileformat=VCFv4.2", "\t".join([*fixed, *names]), "\t".join(["1", "5", ".", "A", "C", ".", ".", ".", "GT", *["0/1"] * len(names)])]
        t.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/x.vcf")
        return FS.landed(FS.vcf_samples(t.spark, f"{folder}/x.vcf"))


@query("""SELECT CAST(i - 1 AS INTEGER) AS locus, 'taxon' || vec_id AS taxon, CASE WHEN CAST(embedding[i] AS DOUBLE) < -0.05 THEN 0 WHEN CAST(embedding[i] AS DOUBLE) < 0.05 THEN 1 ELSE 2 END AS dosage FROM embeddings, range(1, 65) r(i)""")
def s10_wide_genotypes(t: Tables) -> DataFrame:
    return K.long_genotypes(K.wide_genotypes(dosages(t), F.concat(F.lit("taxon"), "id"), "d"))


@query("""SELECT vec_id AS id, list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END), 'string_agg', '') AS dosage FROM embeddings""")
def s11_dosage_table(t: Tables) -> DataFrame:
    packed = dosages(t).select("id", F.transform("d", lambda v: v.cast("byte")).alias("d"))
    return packed.select("id", F.array_join(F.transform("d", lambda v: v.cast("string")), "").alias("dosage"))


@query("""SELECT vec_id AS id, label, round(sum(CAST(embedding[i] AS DOUBLE)), 5) + 0.0 AS total FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2""")
def s14_serialized_objects(t: Tables) -> DataFrame:
    with FS.scratch(t.spark) as folder:
        vectors(t).write.parquet(f"{folder}/v")
        total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
        return FS.landed(t.spark.read.parquet(f"{folder}/v").select("id", "label", rounded(total, 5).alias("total")))


@query("""SELECT '{"geno":"g.csv","pheno":"patched.csv","alleles":["A","B"]}' AS json""")
def s15_cross_definition(t: Tables) -> DataFrame:
    """A definition file is read, patched, written and read again."""
    kind = "geno string, pheno string, alleles array<string>"
    with FS.scratch(t.spark) as folder:
        text = '{\n  "geno": "g.csv",\n  "pheno": "p.csv",\n  "alleles": ["A", "B"]\n}'
        t.spark.createDataFrame([(text,)], "value string").write.text(f"{folder}/cross.json")
        patched = FS.read_definition(t.spark, f"{folder}/cross.json", kind).withColumn("pheno", F.lit("patched.csv"))
        patched.select(F.to_json(F.struct("geno", "pheno", "alleles")).alias("value")).write.text(f"{folder}/patched.json")
        return FS.landed(t.spark.read.text(f"{folder}/patched.json").select(F.col("value").alias("json")))


@query("SELECT * FROM (VALUES ('seeds', '10'), ('folds', '4'), ('base', '10.0')) v(key, value)")
def s16_configuration(t: Tables) -> DataFrame:
    """Settings from a file over defaults; the environment goes before both."""
    with FS.scratch(t.spark) as folder:
        t.spark.createDataFrame([("# folds of the second campaign",), ("folds: 4  # not 5",)], "value string").write.text(f"{folder}/settings.yaml")
        found = FS.read_settings(t.spark, f"{folder}/settings.yaml", {"seeds": "10", "folds": "5", "base": "10.0"})
    return t.spark.createDataFrame(list(found.items()), "key string, value string")


@query("""SELECT * FROM nation""")
def s20_first_existing(t: Tables) -> DataFrame:
    path = FS.first_existing(t.spark, [f"{t.folder}/absent.parquet", f"{t.folder}/nation.parquet"])
    return t.spark.read.parquet(path)


@query("""SELECT CAST(n_nationkey AS INTEGER) AS job, 'M1' AS model, CAST(n_regionkey AS INTEGER) AS grp FROM nation""")
def s22_job_list(t: Tables) -> DataFrame:
    with FS.scratch(t.spark) as folder:
        t("nation").select("n_nationkey", F.lit("M1").alias("m"), "n_regionkey").write.csv(f"{folder}/jobs", sep=" ")
        return FS.landed(t.spark.read.csv(f"{folder}/jobs", sep=" ", schema="job int, model string, grp int"))


@query("""SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer""")
def k01_csv_sink(t: Tables) -> DataFrame:
    with FS.scratch(t.spark) as folder:
        df = t("customer", "c_custkey", "c_mktsegment").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
        FS.write_csv(df, f"{folder}/c.csv")
        return FS.landed(FS.read_any(t.spark, f"{folder}/c.csv", df.schema))


@query("""SELECT * FROM nation""")
def k02_tsv_sink(t: Tables) -> DataFrame:
    with FS.scratch(t.spark) as folder:
        FS.write_csv(t("nation"), f"{folder}/n.tsv", sep="\t")
        return FS.landed(t.spark.read.csv(f"{folder}/n.tsv", sep="\t", header=True, schema=t("nation").schema))


@query()
def k05_manifest(t: Tables) -> DataFrame:
    return FS.manifest(t.spark, [f"{t.folder}/nation.parquet", f"{t.folder}/region.parquet"])


@query("""SELECT n_nationkey, sha256(n_nationkey || '|' || n_name) AS key FROM nation""")
def k06_content_key(t: Tables) -> DataFrame:
    return t("nation").select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256).alias("key"))


@query("""SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS epoch, loss FROM (SELECT date_trunc('month', o_orderdate) AS m, round(avg(o_totalprice), 2) AS loss FROM orders GROUP BY 1 ORDER BY 1 LIMIT 3)""")
def k09_training_curve(t: Tables) -> DataFrame:
    """A curve that grows by one line with each epoch, read as it stands after three."""
    month = F.date_trunc("month", "o_orderdate")
    points = t("orders", "o_orderdate", "o_totalprice").groupBy(month.alias("m")).agg(F.round(F.avg("o_totalprice"), 2).alias("loss")).orderBy("m").limit(3).collect()
    with FS.scratch(t.spark) as folder:
        for epoch, p in enumerate(points):
            t.spark.createDataFrame([(epoch, p["loss"])], "epoch int, loss double").write.mode("append").json(f"{folder}/curve")
        return FS.landed(t.spark.read.json(f"{folder}/curve", schema="epoch int, loss double"))


@query()
def n16_compiled_results(t: Tables) -> DataFrame:
    """All tasks' results with those that are absent named."""
    scan = _genome(t)[1].select("trait", "chr", "locus", rounded("lod").alias("lod"))
    wanted = t.spark.createDataFrame([("t0",), ("t1",), ("t2",)], "trait string")
    return wanted.join(scan, "trait", "left").withColumn("status", F.when(F.col("lod").isNull(), "missing").otherwise("ok"))


@query("SELECT * FROM (VALUES ('nation.parquet', 'ok'), ('region.parquet', 'changed'), ('absent.parquet', 'missing'), ('supplier.parquet', 'unlisted')) v(path, status)")
def v06_manifest_check(t: Tables) -> DataFrame:
    """Files against a stored manifest, in which one checksum isn't theirs, one file is no more and one is lacking."""
    path = lambda name: f"{t.folder}/{name}.parquet"
    with FS.scratch(t.spark) as folder:
        known = FS.manifest(t.spark, [path("nation"), path("region")]).select("path", "size", "sha256")
        known = known.withColumn("sha256", F.when(F.col("path") == "region.parquet", F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
        gone = t.spark.createDataFrame([("absent.parquet", 1, "x")], known.schema)
        FS.write_csv(known.unionByName(gone), f"{folder}/manifest.csv")
        stored = FS.read_any(t.spark, f"{folder}/manifest.csv", known.schema)
        return FS.landed(FS.check_manifest(t.spark, stored, [path("nation"), path("region"), path("supplier")]))