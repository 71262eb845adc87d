"""Queries of curves, kernels and genomic relationships on the embeddings table (entity = vector, environment = label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.exprs import correlation, rounded
from furrow.operators import blocks as B
from furrow.operators import kernels as K
from furrow.operators import relational as R
from furrow.plans.registry import Tables, query

_X = "x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
#: Dosages 0, 1, 2 from fixed cuts of the coordinates.
_D = "d AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CASE WHEN v < -0.05 THEN 0 WHEN v < 0.05 THEN 1 ELSE 2 END) AS d, label FROM embeddings)"
_DL = _D + ", l AS (SELECT id, i - 1 AS locus, d[i] AS d FROM d, range(1, 65) r(i)), f AS (SELECT locus, avg(d) / 2 AS p FROM l GROUP BY 1)"


def vectors(t: Tables) -> DataFrame:
    return t("embeddings", "vec_id", "embedding", "label").withColumnRenamed("vec_id", "id")


def dosages(t: Tables) -> DataFrame:
    cut = lambda v: F.when(v.cast("double") < -0.05, 0).when(v.cast("double") < 0.05, 1).otherwise(2)
    return vectors(t).select("id", F.transform("embedding", cut).alias("d"), "label")


def out(k: DataFrame, digits: int = 6) -> DataFrame:
    return k.select("i", "j", rounded("k", digits).alias("k"))


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS kept FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS t FROM events)
          WHERE t BETWEEN 5 AND 20 AND isfinite(value) GROUP BY 1, 2""")
def f03_clip_to_domain(t: Tables) -> DataFrame:
    from furrow.functions.exprs import days_between, is_finite

    at = days_between("ts", F.lit("2024-01-01").cast("timestamp"))
    return t("events", "user_id", "event_type", "ts", "value").where(at.between(5, 20) & is_finite("value")).groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


@query(f"""WITH {_X}, m AS (SELECT i AS pos, avg(e[i]) AS mu FROM x, range(1, 65) r(i) GROUP BY 1)
          SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(mu + 0.5 * e[1] * sin(pos) + 0.25 * e[2] * cos(pos), 6) + 0.0 AS y FROM x, m""")
def f05_predicted_curves(t: Tables) -> DataFrame:
    mean = vectors(t).select(F.posexplode("embedding").alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mu"))
    basis = mean.select("pos", "mu", F.explode(F.array(
        F.struct(F.lit(0).alias("c"), (0.5 * F.sin(F.col("pos") + 1)).alias("phi")), F.struct(F.lit(1).alias("c"), (0.25 * F.cos(F.col("pos") + 1)).alias("phi")))).alias("b"))
    scores = vectors(t).select("id", F.posexplode(F.slice("embedding", 1, 2)).alias("c", "xi"))
    joined = scores.join(basis, F.col("c") == F.col("b.c"))
    return joined.groupBy("id", "pos").agg(rounded(F.first("mu") + F.sum(F.col("xi").cast("double") * F.col("b.phi"))).alias("y"))


@query(f"WITH {_X} SELECT id, CAST(i - 1 AS INTEGER) AS pos, round(e[i], 6) + 0.0 AS score FROM x, range(1, 6) r(i)")
def f07_first_scores(t: Tables) -> DataFrame:
    return vectors(t).select("id", F.posexplode(F.slice("embedding", 1, 5)).alias("pos", "v")).select("id", "pos", rounded(F.col("v").cast("double")).alias("score"))


@query(f"WITH {_X} SELECT a.id AS i, b.id AS j, round(list_dot_product(a.e, b.e) / 64, 6) + 0.0 AS k FROM x a JOIN x b ON a.id <= b.id")
def l01_linear_kernel(t: Tables) -> DataFrame:
    return K.pair_kernel(vectors(t), "id", "embedding", digits=6)


@query(f"WITH {_X} SELECT a.id AS i, b.id AS j, round(exp(-pow(list_distance(a.e, b.e), 2) / 64), 6) AS k FROM x a JOIN x b ON a.id <= b.id")
def l02_rbf_kernel(t: Tables) -> DataFrame:
    return K.pair_kernel(vectors(t), "id", "embedding", kind="rbf", digits=6)


_FULL = f"WITH {_X}, k AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.e, b.e) / 64 AS k FROM x a, x b)"


@query(_FULL + """, r AS (SELECT i, avg(k) AS m FROM k GROUP BY 1), g AS (SELECT avg(m) AS g FROM r)
          SELECT k.i, k.j, round(k.k - a.m - b.m + g.g, 6) + 0.0 AS k FROM k JOIN r a ON a.i = k.i JOIN r b ON b.i = k.j, g""")
def l03_centred_kernel(t: Tables) -> DataFrame:
    return B.kernel(vectors(t), "id", [("embedding", "linear", None)], centred=True, digits=6)


@query("SELECT label AS fold, CAST(least(max(rn), 20) AS INTEGER) AS used, max(rn) >= 20 AS enough FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS rn FROM embeddings) GROUP BY 1")
def l05_component_slice(t: Tables) -> DataFrame:
    ranked = t("embeddings", "vec_id", "label").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return ranked.groupBy(F.col("label").alias("fold")).agg(F.least(F.max("rn"), F.lit(20)).alias("used"), (F.max("rn") >= 20).alias("enough"))


@query(_FULL + " SELECT k.i, k.j, round(k.k * exp(-abs(k.i - k.j) / 10.0), 6) + 0.0 AS k FROM k WHERE k.i <= k.j")
def l07_hadamard_kernel(t: Tables) -> DataFrame:
    placed = vectors(t).withColumn("at", F.array("id"))
    return B.kernel(placed, "id", [("embedding", "linear", None), ("at", "laplace", 0.1)], digits=6)


@query(f"WITH {_X} SELECT a.id AS i, b.id AS j, CAST(a.label = b.label AS INTEGER) AS k FROM x a JOIN x b ON a.id <= b.id")
def l08_environment_identity(t: Tables) -> DataFrame:
    return B.kernel(vectors(t).withColumn("env", F.array("label")), "id", [("env", "match", None)]).withColumn("k", F.col("k").cast("int"))


_SCALED = f"""WITH {_X}, l AS (SELECT id, label, i AS pos, e[i] AS v FROM x, range(1, 65) r(i)),
  z AS (SELECT id, pos, coalesce((v - avg(v) OVER w) / CASE WHEN stddev_samp(v) OVER w > 0 THEN stddev_samp(v) OVER w ELSE 1 END, 0) AS z FROM l WINDOW w AS (PARTITION BY label, pos)),
  zz AS (SELECT id, list(z ORDER BY pos) AS z FROM z GROUP BY 1)"""


@query(_SCALED + " SELECT a.id AS i, b.id AS j, round(list_dot_product(a.z, b.z) / 64, 6) + 0.0 AS k FROM zz a JOIN zz b ON a.id <= b.id")
def l09_phenomic_kernel(t: Tables) -> DataFrame:
    return K.pair_kernel(K.scaled_features(vectors(t), "id", "embedding", by="label"), "id", "z", digits=6)


_ENV = f"""WITH {_X}, l AS (SELECT label AS env, i AS pos, avg(e[i]) AS v FROM x, range(1, 65) r(i) GROUP BY 1, 2),
  s AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS s FROM l {{fit}} GROUP BY 1),
  z AS (SELECT env, list((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY pos) AS z FROM l JOIN s USING (pos) GROUP BY 1),
  k AS (SELECT a.env AS i, b.env AS j, list_dot_product(a.z, b.z) / 64 AS k FROM z a, z b)"""


def _environments(t: Tables) -> DataFrame:
    means = vectors(t).select(F.col("label").alias("env"), F.posexplode("embedding").alias("pos", "v")).groupBy("env", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("env").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v"))


@query(_ENV.format(fit="WHERE env <> 3") + " SELECT a.id AS i, b.id AS j, round(k, 5) + 0.0 AS k FROM x a JOIN k ON a.label = k.i JOIN x b ON b.label = k.j WHERE a.id <= b.id")
def l10_weather_kernel(t: Tables) -> DataFrame:
    """Each observation takes its environment's scaled values, so that pairs are made once, in blocks, and not joined."""
    z = K.scaled_features(_environments(t), "env", "v", fit=F.col("env") != 3)
    return B.kernel(vectors(t).select("id", F.col("label").alias("env")).join(z, "env"), "id", [("z", "linear", None)], digits=5)


@query(_ENV.format(fit="") + " SELECT i, j, round(k, 5) + 0.0 AS k FROM k WHERE i <= j")
def l11_enviromic_kernel(t: Tables) -> DataFrame:
    return out(K.pair_kernel(K.scaled_features(_environments(t), "env", "v"), "env", "z"), 5)


@query("""SELECT event_type AS env, CAST(count(DISTINCT user_id % 3) AS BIGINT) AS layouts, CAST(count(DISTINCT user_id % 3) AS BIGINT) <= 1 AS consistent,
          round(max(value) FILTER (user_id % 3 = 0), 6) AS s0, round(max(value) FILTER (user_id % 3 = 1), 6) AS s1 FROM events GROUP BY 1""")
def l12_score_alignment(t: Tables) -> DataFrame:
    g = F.col("user_id") % 3
    return t("events", "event_type", "user_id", "value").groupBy(F.col("event_type").alias("env")).agg(
        F.count_distinct(g).alias("layouts"), (F.count_distinct(g) <= 1).alias("consistent"),
        rounded(F.max(F.when(g == 0, F.col("value")))).alias("s0"), rounded(F.max(F.when(g == 1, F.col("value")))).alias("s1"))


@query(f"""WITH {_X}, l AS (SELECT label, i - 1 AS pos, e[i] AS v FROM x, range(1, 65) r(i))
          SELECT 'all' AS scope, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS m, round(stddev_samp(v), 6) AS s FROM l GROUP BY pos
          UNION ALL SELECT 'train', CAST(pos AS INTEGER), round(avg(v), 6) + 0.0, round(stddev_samp(v), 6) FROM l WHERE label <> 3 GROUP BY pos""")
def l13_fit_scope(t: Tables) -> DataFrame:
    """Each coordinate's scaling fitted on all rows and on the training rows."""
    x = vectors(t).select("label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    stats = lambda df, scope: df.groupBy("pos").agg(rounded(F.avg("v")).alias("m"), rounded(F.stddev_samp("v")).alias("s")).select(F.lit(scope).alias("scope"), "pos", "m", "s")
    return stats(x, "all").unionByName(stats(x.where("label != 3"), "train"))


@query("""WITH m AS (SELECT * FROM (VALUES ('M1', 'E'), ('M2', 'E'), ('M2', 'G'), ('M3', 'E'), ('M3', 'P'), ('M4', 'E'), ('M4', 'G'), ('M4', 'P'), ('M4', 'W')) v(model, term))
          SELECT model, bool_or(term = 'G') AS g, bool_or(term = 'P') AS p, bool_or(term = 'W') AS w, CAST(count(*) AS BIGINT) AS terms FROM m WHERE term <> 'E' GROUP BY 1""")
def l14_model_membership(t: Tables) -> DataFrame:
    rows = [("M1", "E"), ("M2", "E"), ("M2", "G"), ("M3", "E"), ("M3", "P"), ("M4", "E"), ("M4", "G"), ("M4", "P"), ("M4", "W")]
    members = t.spark.createDataFrame(rows, "model string, term string")
    left = members.join(t.spark.createDataFrame([("E",)], "term string"), "term", "left_anti")
    flags = [F.bool_or(F.col("term") == x).alias(x.lower()) for x in ("G", "P", "W")]
    return left.groupBy("model").agg(*flags, F.count("*").alias("terms"))


@query(f"""WITH {_DL}, s AS (SELECT locus, avg(d) / 2 AS p, count(d) AS n FROM l GROUP BY 1)
          SELECT CAST(locus AS INTEGER) AS locus, round(least(p, 1 - p), 6) AS maf FROM s WHERE least(p, 1 - p) >= 0.3 AND n = (SELECT count(*) FROM d)""")
def n01_locus_filter(t: Tables) -> DataFrame:
    """Loci without a missing dosage whose rarer allele is frequent enough."""
    freq = K.allele_frequencies(dosages(t), "id", "d")
    entities = F.broadcast(dosages(t).agg(F.count("*").alias("entities")))
    maf = F.least("p", 1 - F.col("p"))
    return freq.join(entities, F.col("n") == F.col("entities")).where(maf >= 0.3).select("locus", rounded(maf).alias("maf"))


@query(f"WITH {_D} SELECT CAST(count(*) FILTER (v NOT IN (0, 1, 2) OR v IS NULL) AS BIGINT) AS bad, CAST(count(*) AS BIGINT) AS cells FROM (SELECT unnest(list_concat(d, [7])) AS v FROM d)")
def n02_dosage_validation(t: Tables) -> DataFrame:
    cells = dosages(t).select(F.explode(F.concat("d", F.array(F.lit(7)))).alias("v"))
    return cells.agg(F.count_if(~F.col("v").isin(0, 1, 2) | F.col("v").isNull()).alias("bad"), F.count("*").alias("cells"))


@query(f"""WITH {_DL} SELECT a.id AS i, b.id AS j, round(sum((a.d - 2 * p) * (b.d - 2 * p)) / (SELECT sum(2 * p * (1 - p)) FROM f), 6) + 0.0 AS k
          FROM l a JOIN l b ON a.locus = b.locus AND a.id <= b.id JOIN f ON f.locus = a.locus GROUP BY 1, 2""")
def n03_additive_relationship(t: Tables) -> DataFrame:
    return K.relationship(dosages(t), "id", "d", digits=6)


@query(f"""WITH {_DL}, w AS (SELECT id, l.locus, CASE d WHEN 0 THEN -2 * p * p WHEN 1 THEN 2 * p * (1 - p) ELSE -2 * (1 - p) * (1 - p) END AS w FROM l JOIN f USING (locus))
          SELECT a.id AS i, b.id AS j, round(sum(a.w * b.w) / (SELECT sum(4 * p * p * (1 - p) * (1 - p)) FROM f), 6) + 0.0 AS k FROM w a JOIN w b ON a.locus = b.locus AND a.id <= b.id GROUP BY 1, 2""")
def n04_dominance_relationship(t: Tables) -> DataFrame:
    return K.relationship(dosages(t), "id", "d", kind="dominance", digits=6)


_LD = f"WITH {_DL}, q AS (SELECT a.locus AS i, b.locus AS j, covar_pop(a.d, b.d) AS c, stddev_pop(a.d) AS s, stddev_pop(b.d) AS r FROM l a JOIN l b ON a.id = b.id AND a.locus >= b.locus WHERE a.locus BETWEEN 10 AND 25 AND b.locus BETWEEN 10 AND 25 GROUP BY 1, 2)"


def _ld(t: Tables) -> DataFrame:
    tall = dosages(t).select("id", F.posexplode("d").alias("locus", "d")).where(F.col("locus").between(10, 25))
    a = tall.select("id", F.col("locus").alias("i"), F.col("d").alias("a"))
    b = tall.select("id", F.col("locus").alias("j"), F.col("d").alias("b"))
    r = correlation("a", "b")
    return a.join(b, "id").where("j <= i").groupBy("i", "j").agg(rounded(r * r).alias("r2"))


@query(_LD + " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN s > 0 AND r > 0 THEN round(pow(c / (s * r), 2), 6) END AS r2 FROM q")
def n06_linkage(t: Tables) -> DataFrame:
    return _ld(t)


@query(_LD + " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(pow(c / (s * r), 2), 6) AS r2 FROM q WHERE i > j AND s > 0 AND r > 0")
def n07_lower_triangle(t: Tables) -> DataFrame:
    return _ld(t).where("j < i AND r2 IS NOT NULL")


@query(f"""WITH {_D}, p AS (SELECT a.id AS i, b.id AS j FROM d a JOIN d b ON a.id < b.id WHERE len(list_filter(list_zip(a.d, b.d), lambda z: z[1] = z[2])) / 64.0 > 0.5)
          SELECT DISTINCT id FROM (SELECT i AS id FROM p UNION ALL SELECT j FROM p)""")
def n08_near_identical(t: Tables) -> DataFrame:
    return K.near_identical(dosages(t), "id", "d", above=0.5)


@query(f"""WITH {_D}, c AS (SELECT id, len(list_filter(range(2, 65), lambda i: d[i] <> d[i - 1])) AS n FROM d)
          SELECT id, CAST(n AS BIGINT) AS crossovers, n > CASE WHEN id % 100 < 20 THEN 38 ELSE 42 END AS flagged FROM c""")
def n09_crossovers(t: Tables) -> DataFrame:
    tall = dosages(t).select("id", F.posexplode("d").alias("locus", "d"))
    before = F.lag("d").over(Window.partitionBy("id").orderBy("locus"))
    counted = tall.withColumn("x", F.coalesce((F.col("d") != before).cast("int"), F.lit(0))).groupBy("id").agg(F.sum("x").alias("crossovers"))
    limit = F.when(F.col("id") % 100 < 20, 38).otherwise(42)
    return counted.select("id", "crossovers", (F.col("crossovers") > limit).alias("flagged"))


_SCAN = "s AS (SELECT event_type AS chr, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS pos, avg(value) AS lod FROM events GROUP BY 1, 2)"


def _scan(t: Tables) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return t("events", "event_type", "ts", "value").groupBy(F.col("event_type").alias("chr"), day.alias("pos")).agg(F.avg("value").alias("lod"))


@query(f"""WITH {_SCAN}, p AS (SELECT chr, max(lod) AS top, arg_max(pos, lod) AS peak FROM s GROUP BY 1 HAVING max(lod) > 20),
          b AS (SELECT s.chr, max(pos) FILTER (lod < top - 5 AND pos < peak) AS lo, min(pos) FILTER (lod < top - 5 AND pos > peak) AS hi FROM s JOIN p USING (chr) GROUP BY 1)
          SELECT s.chr, p.peak AS pos, round(top, 6) AS lod, min(s.pos) AS ci_lo, max(s.pos) AS ci_hi FROM s JOIN p USING (chr) JOIN b USING (chr)
          WHERE (lo IS NULL OR s.pos > lo) AND (hi IS NULL OR s.pos < hi) GROUP BY 1, 2, 3""")
def n13_peaks_with_support(t: Tables) -> DataFrame:
    return K.peaks(_scan(t), ["chr"], "pos", "lod", 20.0, 5.0).select("chr", "pos", rounded("lod").alias("lod"), "ci_lo", "ci_hi")


@query("""SELECT p_partkey, split_part(col, '_', 1) AS kind, split_part(col, '_', 2) AS trait, CAST(v AS DOUBLE) AS v FROM (
          SELECT p_partkey, CAST(p_size AS DOUBLE) AS lod_size, p_retailprice AS lod_price FROM part) UNPIVOT (v FOR col IN (lod_size, lod_price))""")
def n14_wide_to_long(t: Tables) -> DataFrame:
    wide = t("part").select("p_partkey", F.col("p_size").cast("double").alias("lod_size"), F.col("p_retailprice").alias("lod_price"))
    parts = F.split("col", "_")
    return wide.unpivot(["p_partkey"], ["lod_size", "lod_price"], "col", "v").select("p_partkey", parts[0].alias("kind"), parts[1].alias("trait"), "v")


@query("""SELECT n_name || '/' || c_mktsegment AS cross_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_distinct, CAST(count(*) FILTER (o.o_custkey IS NULL) AS BIGINT) AS missing
          FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey GROUP BY 1""")
def n17_cross_preparation(t: Tables) -> DataFrame:
    people = t("customer", "c_custkey", "c_nationkey", "c_mktsegment").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seen = t("orders", "o_custkey").distinct()
    return people.join(seen, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.concat_ws("/", "n_name", "c_mktsegment").alias("cross_id")).agg(
        F.count("*").alias("n"), F.count_distinct("c_custkey").alias("n_distinct"), F.count_if(F.col("o_custkey").isNull()).alias("missing"))


@query("""SELECT g, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS brands FROM part
          JOIN (SELECT n_nationkey AS g, 900 + 40.0 * n_nationkey AS lo, 960 + 50.0 * n_nationkey AS hi FROM nation) ON p_retailprice <= hi AND p_retailprice + p_size >= lo GROUP BY 1""")
def n18_interval_annotation(t: Tables) -> DataFrame:
    genes = t("nation").select(F.col("n_nationkey").alias("g"), (900 + 40.0 * F.col("n_nationkey")).alias("lo"), (960 + 50.0 * F.col("n_nationkey")).alias("hi"))
    parts = t("part", "p_brand", "p_retailprice", "p_size").withColumn("stop", F.col("p_retailprice") + F.col("p_size"))
    return R.overlapping(parts, genes, "p_retailprice", "stop", "lo", "hi", 50.0).groupBy("g").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), "; ").alias("brands"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL$') THEN 'S' WHEN regexp_matches(p_type, '^PROMO') THEN 'P' WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'B' ELSE 'other' END AS tester FROM part""")
def n19_tester_by_pattern(t: Tables) -> DataFrame:
    p = F.col("p_type")
    return t("part", "p_partkey", "p_type").select("p_partkey", F.when(p.rlike("STEEL$"), "S").when(p.rlike("^PROMO"), "P").when(p.rlike("BRASS|COPPER"), "B").otherwise("other").alias("tester"))
