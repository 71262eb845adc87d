"""Queries of cross-validation designs, audits, regressors' relational parts, and the flagship summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.functions.exprs import hash_order, rounded
from furrow.operators import relational as R
from furrow.operators import scoring as S
from furrow.operators import splits as C
from furrow.operators import timeseries as TS
from furrow.plans.registry import Tables, query
from furrow.plans.statistics import _DAILY, _GROUPS, _OBS, daily, groups, observations

#: Entity = customer, place = order priority.
_COMMON = """common AS (SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)),
  fold AS (SELECT c, CAST(floor((row_number() OVER (ORDER BY md5('11|' || c), c) - 1) / ceil(count(*) OVER () / 5.0)) AS INTEGER) + 1 AS fold FROM common)"""
_ROWS = f"WITH {_COMMON}, f AS (SELECT o_orderkey, o_custkey, o_orderpriority AS env, o_totalprice, fold FROM orders LEFT JOIN fold ON c = o_custkey)"


def orders(t: Tables) -> DataFrame:
    return t("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").withColumnRenamed("o_orderpriority", "env")


def folded(t: Tables) -> DataFrame:
    return C.with_fold(orders(t), C.entity_folds(orders(t), "o_custkey", "env", 5, 11), "o_custkey")


@query(f"WITH {_COMMON} SELECT c AS o_custkey FROM common")
def c01_common_entities(t: Tables) -> DataFrame:
    return R.present_everywhere(orders(t), "o_custkey", "env")


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY md5('1|' || c_custkey), c_custkey) - 1) / ceil(count(*) OVER () / 5.0)) AS INTEGER) + 1 AS fold FROM customer")
def c02_unbalanced_folds(t: Tables) -> DataFrame:
    return TS.folds(t("customer", "c_custkey"), 5, 1, "c_custkey")


@query(f"""WITH {_COMMON}, ext AS (SELECT c_custkey AS c, c_custkey % 5 + 1 AS fold FROM customer WHERE c_custkey % 7 <> 0)
  SELECT CAST(count(*) AS BIGINT) AS universe, CAST(count(e.c) AS BIGINT) AS covered, round(count(e.c) / count(*), 6) AS overlap, count(e.c) / count(*) >= 0.1 AS accepted, count(e.c) = count(*) AS strict FROM common k LEFT JOIN ext e ON e.c = k.c""")
def c03_import_folds(t: Tables) -> DataFrame:
    ext = t("customer", "c_custkey").where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("hit"))
    joined = R.present_everywhere(orders(t), "o_custkey", "env").join(ext, "o_custkey", "left")
    share = F.try_divide(F.count("hit"), F.count(F.lit(1)))
    return joined.agg(F.count(F.lit(1)).alias("universe"), F.count("hit").alias("covered"), rounded(share).alias("overlap"), (share >= 0.1).alias("accepted"), (F.count("hit") == F.count(F.lit(1))).alias("strict"))


@query(f"WITH {_COMMON} SELECT fold, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT c) AS BIGINT) AS repeated FROM fold GROUP BY 1")
def c04_fold_integrity(t: Tables) -> DataFrame:
    f = C.entity_folds(orders(t), "o_custkey", "env", 5, 11)
    return f.groupBy("fold").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("o_custkey")).alias("repeated"))


@query(_ROWS + " SELECT o_orderkey, CASE WHEN fold = 2 THEN 'PREDICT' WHEN fold IS NOT NULL THEN 'FIT' ELSE 'OBSERVE' END AS role, CASE WHEN fold = 2 THEN 'CV1' WHEN fold IS NOT NULL THEN 'CV2' END AS cv_label FROM f")
def c05_scheme_cv2_cv1(t: Tables) -> DataFrame:
    return C.scheme_cv2_cv1(folded(t), 2).select("o_orderkey", "role", "cv_label")


@query(_ROWS + " SELECT o_orderkey, CASE WHEN env = '2-HIGH' OR fold = 2 THEN 'PREDICT' WHEN fold IS NOT NULL THEN 'FIT' ELSE 'OBSERVE' END AS role, CASE WHEN env = '2-HIGH' AND fold = 2 THEN 'CV00' WHEN env = '2-HIGH' AND fold IS NOT NULL THEN 'CV0' END AS cv_label FROM f")
def c06_scheme_cv0_cv00(t: Tables) -> DataFrame:
    return C.scheme_cv0_cv00(folded(t), "env", "2-HIGH", 2).select("o_orderkey", "role", "cv_label")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'PREDICT' ELSE 'FIT' END AS role, CASE WHEN o_orderpriority = '5-LOW' THEN 'LOO' END AS cv_label FROM orders")
def c07_scheme_leave_one_out(t: Tables) -> DataFrame:
    return C.scheme_leave_one_out(orders(t), "env", "5-LOW").select("o_orderkey", "role", "cv_label")


@query("SELECT o_orderkey, fold, CASE WHEN fold = 3 THEN 'PREDICT' ELSE 'FIT' END AS role FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY md5('5|' || o_orderkey), o_orderkey) - 1) / ceil(count(*) OVER () / 5.0)) AS INTEGER) + 1 AS fold FROM orders)")
def c08_scheme_random(t: Tables) -> DataFrame:
    return C.scheme_random(t("orders", "o_orderkey"), "o_orderkey", 5, 5, 3).select("o_orderkey", "fold", "role")


@query("""SELECT 'Seed' || lpad(CAST(s AS VARCHAR), 2, '0') AS seed, f AS fold, n_name AS env, 'LOEO_' || n_name AS weather FROM range(1, 11) a(s), range(1, 6) b(f), nation
          UNION ALL SELECT 'Seed' || lpad(CAST(s AS VARCHAR), 2, '0'), f, NULL, 'ALL' FROM range(1, 11) a(s), range(1, 6) b(f)""")
def c09_split_jobs(t: Tables) -> DataFrame:
    s, f = t.spark.range(1, 11).withColumnRenamed("id", "s"), t.spark.range(1, 6).withColumnRenamed("id", "fold")
    base = s.join(F.broadcast(f), F.lit(True)).select(F.format_string("Seed%02d", "s").alias("seed"), "fold")
    away = base.join(F.broadcast(t("nation", "n_name")), F.lit(True)).select("seed", "fold", F.col("n_name").alias("env"), F.concat(F.lit("LOEO_"), "n_name").alias("weather"))
    return away.unionByName(base.select("seed", "fold", F.lit(None).cast("string").alias("env"), F.lit("ALL").alias("weather")))


@query(_ROWS + " SELECT o_orderkey, CASE WHEN coalesce(fold = 2, false) OR env = '2-HIGH' THEN NULL ELSE o_totalprice END AS y FROM f")
def c10_masked_response(t: Tables) -> DataFrame:
    hide = F.coalesce(F.col("fold") == 2, F.lit(False)) | (F.col("env") == "2-HIGH")
    return C.masked(folded(t), "o_totalprice", hide).select("o_orderkey", F.col("o_totalprice").alias("y"))


@query("""WITH u AS (SELECT c_custkey, CAST(('0x' || substring(md5('9|' || c_custkey), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u FROM customer)
          SELECT c_custkey, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split FROM u""")
def c11_ratio_split(t: Tables) -> DataFrame:
    return C.ratio_split(t("customer", "c_custkey"), "c_custkey", 0.2, 0.1, 9).select("c_custkey", "split")


@query("""WITH a AS (SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer) ORDER BY md5('1|' || c_nationkey), 1 LIMIT 3),
          b AS (SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT * FROM a)) ORDER BY md5('2|' || c_nationkey), 1 LIMIT 2)
          SELECT 'holdout' AS carve, c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM a) UNION ALL SELECT 'grouped', c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM b)""")
def c12_disjoint_carves(t: Tables) -> DataFrame:
    df = t("customer", "c_custkey", "c_nationkey")
    a = C.carve(df, None, "c_nationkey", 3, 1)
    b = C.carve(df, a, "c_nationkey", 2, 2)
    return a.select(F.lit("holdout").alias("carve"), "c_custkey").unionByName(b.select(F.lit("grouped").alias("carve"), "c_custkey"))


@query(_ROWS + " SELECT o_orderkey FROM f WHERE env = '2-HIGH' AND fold IS NOT NULL AND fold <> 2")
def c13_observe_selector(t: Tables) -> DataFrame:
    return C.scheme_cv0_cv00(folded(t), "env", "2-HIGH", 2).where("cv_label = 'CV0'").select("o_orderkey")


@query(_ROWS + """ SELECT o_orderkey, CASE WHEN fold = 2 THEN 'test' WHEN fold = 4 THEN 'val' WHEN fold IS NOT NULL THEN 'train' ELSE 'observe' END AS split, CASE WHEN fold = 2 THEN 'CV1' WHEN fold = 4 THEN NULL WHEN fold IS NOT NULL THEN 'CV2' END AS cv_label FROM f""")
def c14_roles_to_splits(t: Tables) -> DataFrame:
    df = C.scheme_cv2_cv1(folded(t), 2)
    carved = F.coalesce(F.col("fold") == 4, F.lit(False))
    split = F.when(F.col("role") == C.PREDICT, "test").when(carved, "val").when(F.col("role") == C.FIT, "train").otherwise("observe")
    return df.select("o_orderkey", split.alias("split"), F.when(~carved, F.col("cv_label")).alias("cv_label"))


@query(f"""WITH {_OBS} SELECT pri, CAST(count(*) FILTER (c_custkey % 2 = 0) AS BIGINT) AS n,
          round(sqrt(avg(pow(a - p, 2)) FILTER (c_custkey % 2 = 0)), 6) AS rmse, round(covar_pop(a, p) FILTER (c_custkey % 2 = 0) / (stddev_pop(a) FILTER (c_custkey % 2 = 0) * stddev_pop(p) FILTER (c_custkey % 2 = 0)), 6) AS cor FROM o GROUP BY 1""")
def c15_split_metrics(t: Tables) -> DataFrame:
    scored = F.col("c_custkey") % 2 == 0
    a, p = F.when(scored, F.col("a")), F.when(scored, F.col("p"))
    return observations(t).groupBy("pri").agg(F.count_if(scored).alias("n"), rounded(X.rmse(a, p)).alias("rmse"), rounded(X.correlation(a, p)).alias("cor"))


@query(f"""WITH {_OBS}, e AS (SELECT env, count(*) AS n, sqrt(avg(pow(a - p, 2))) AS e FROM o WHERE c_custkey % 3 = 0 GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS envs, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(n * e * e) / sum(n)), 6) AS rmse FROM e""")
def c16_left_out_scores(t: Tables) -> DataFrame:
    by_env = observations(t).where("c_custkey % 3 = 0").groupBy("env").agg(F.count("*").alias("n"), X.rmse("a", "p").alias("e"))
    return by_env.agg(F.count("*").alias("envs"), F.sum("n").alias("n"), rounded(X.pooled_rmse("e", "n")).alias("rmse"))


@query(_ROWS + " SELECT fold, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS entities, CAST(count(DISTINCT env) AS BIGINT) AS envs FROM f GROUP BY 1")
def c17_fold_statistics(t: Tables) -> DataFrame:
    return folded(t).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("entities"), F.count_distinct("env").alias("envs"))


@query("""WITH grid AS (SELECT c_custkey AS c, s FROM customer, (VALUES ('F'), ('O'), ('P')) v(s)), obs AS (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n, count(*) FILTER (o_totalprice < 20000) AS bad FROM orders GROUP BY 1, 2)
          SELECT g.c, g.s, CAST(coalesce(n, 0) AS BIGINT) AS rows, CAST(coalesce(bad, 0) AS BIGINT) AS errors, concat_ws('; ', CASE WHEN coalesce(n, 0) = 0 THEN 'missing' END, CASE WHEN n > 0 AND n < 3 THEN 'short' END, CASE WHEN bad > 0 THEN 'errors' END) AS reasons
          FROM grid g LEFT JOIN obs o ON o.c = g.c AND o.s = g.s""")
def c18_results_audit(t: Tables) -> DataFrame:
    statuses = t.spark.createDataFrame([("F",), ("O",), ("P",)], "s string")
    grid = t("customer", "c_custkey").select(F.col("c_custkey").alias("c")).join(F.broadcast(statuses), F.lit(True))
    observed = t("orders", "o_custkey", "o_orderstatus", "o_totalprice").select(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_totalprice") < 20000, "error").otherwise("ok").alias("status"))
    return C.coverage_audit(grid, observed, ["c", "s"], 3).select("c", "s", "rows", "errors", "reasons")


@query(_GROUPS + f""", k AS (SELECT pri AS model, c_custkey % 3 AS seed, env, count(*) AS n, covar_pop(a, p) / nullif(stddev_pop(a) * stddev_pop(p), 0) AS r, sqrt(avg(pow(a - p, 2))) AS e FROM o GROUP BY 1, 2, 3),
  s AS (SELECT model, seed, sum(r / v) / sum(1 / v) AS r_w, max(rm) AS rmse FROM (SELECT *, greatest((1 - r * r) / (n - 2), 2.220446049250313e-16) AS v, sqrt(sum(n * e * e) OVER w / sum(n) OVER w) AS rm FROM k WHERE n > 2 AND r IS NOT NULL WINDOW w AS (PARTITION BY model, seed)) GROUP BY 1, 2)
  SELECT 'kernel' AS method, model, round(avg(r_w), 6) AS correlation, round(stddev_samp(r_w), 6) AS correlation_sd, round(avg(rmse), 6) AS rmse, CAST(count(*) AS BIGINT) AS seeds FROM s GROUP BY 2
  UNION ALL SELECT 'loeo', pri, round(sum(r / v) / sum(1 / v), 6), NULL, round(sqrt(sum(n * e * e) / sum(n)), 6), NULL FROM (SELECT *, greatest((1 - r * r) / (n - 2), 2.220446049250313e-16) AS v FROM g WHERE n > 2 AND r IS NOT NULL) GROUP BY 2
  UNION ALL SELECT 'pooled', pri, round(covar_pop(a, p) / nullif(stddev_pop(a) * stddev_pop(p), 0), 6), NULL, round(sqrt(avg(pow(a - p, 2))), 6), NULL FROM o GROUP BY 2""")
def c19_final_summary(t: Tables) -> DataFrame:
    """Three sources with their own pooling, stacked: seeds of environment blocks, left-out environments, all rows.

    All of them come from the same moments by model, seed and environment.
    """
    o = observations(t).withColumnRenamed("pri", "model").withColumn("seed", F.col("c_custkey") % 3)
    fine = o.groupBy("model", "seed", "env").agg(*S.moments("a", "p"))
    usable = "n > 2 AND r IS NOT NULL"
    pooled = [X.pooled_correlation("r", "n").alias("correlation"), X.pooled_rmse("e", "n").alias("rmse")]
    seeds = fine.select("model", "seed", *S.from_moments()).where(usable).groupBy("model", "seed").agg(*pooled)
    kernel = seeds.groupBy("model").agg(
        F.avg("correlation").alias("correlation"), F.stddev_samp("correlation").alias("correlation_sd"), F.avg("rmse").alias("rmse"), F.count("*").alias("seeds"))
    places = S.added_up(fine, "model", "env").select("model", *S.from_moments())
    loeo = places.where(usable).groupBy("model").agg(*pooled)
    flat = S.added_up(fine, "model").select("model", *S.from_moments()).select("model", F.col("r").alias("correlation"), F.col("e").alias("rmse"))
    parts = [df.withColumn("method", F.lit(name)) for name, df in (("kernel", kernel), ("loeo", loeo), ("pooled", flat))]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.select("method", "model", *(rounded(c).alias(c) for c in ("correlation", "correlation_sd", "rmse")), "seeds")


@query("""SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'predict' ELSE 'inductive' END AS stream, p FROM customer LEFT JOIN (SELECT o_custkey, round(avg(o_totalprice), 6) AS p FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1) ON o_custkey = c_custkey""")
def c21_prediction_streams(t: Tables) -> DataFrame:
    p = t("orders", "o_custkey", "o_totalprice").where("o_custkey % 2 = 1").groupBy(F.col("o_custkey").alias("c_custkey")).agg(rounded(F.avg("o_totalprice")).alias("p"), F.lit("inductive").alias("stream"))
    return R.scatter(t("customer", "c_custkey"), p, "c_custkey").select("c_custkey", F.coalesce("stream", F.lit("predict")).alias("stream"), "p")


@query("SELECT seed, fold, CAST(count(*) AS BIGINT) AS n FROM (SELECT s AS seed, CAST(floor((row_number() OVER (PARTITION BY s ORDER BY md5(s || '|' || n_nationkey), n_nationkey) - 1) / ceil(count(*) OVER (PARTITION BY s) / 5.0)) AS INTEGER) + 1 AS fold FROM nation, range(1, 11) r(s)) GROUP BY 1, 2")
def c22_pinned_folds(t: Tables) -> DataFrame:
    w = Window.partitionBy("seed")
    grid = t("nation", "n_nationkey").join(F.broadcast(t.spark.range(1, 11).withColumnRenamed("id", "seed")), F.lit(True))
    h = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("n_nationkey").cast("string")))
    rank = F.row_number().over(w.orderBy(h, "n_nationkey"))
    fold = F.floor((rank - 1) / F.ceil(F.count("*").over(w) / 5.0)).cast("int") + 1
    return grid.select("seed", fold.alias("fold")).groupBy("seed", "fold").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(regr_slope(value, user_id), 6) + 0.0 AS slope, round(regr_intercept(value, user_id), 6) AS intercept FROM events GROUP BY 1")
def x01_least_squares(t: Tables) -> DataFrame:
    x = F.col("user_id").cast("double")
    return t("events", "event_type", "user_id", "value").groupBy("event_type").agg(rounded(F.regr_slope("value", x)).alias("slope"), rounded(F.regr_intercept("value", x)).alias("intercept"))


@query("SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5('ctx|' || c_custkey), 1 LIMIT 50) INTERSECT SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5('ctx|' || c_custkey) DESC, 1 DESC LIMIT 50))")
def x07_context_disjoint(t: Tables) -> DataFrame:
    h = hash_order("ctx", "c_custkey")
    context = t("customer", "c_custkey").orderBy(h, "c_custkey").limit(50)
    asked = t("customer", "c_custkey").orderBy(h.desc(), F.desc("c_custkey")).limit(50)
    return context.join(asked, "c_custkey", "left_semi").agg(F.count("*").alias("shared"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('aug|' || event_id), event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= greatest(3, round(0.4 * n))")
def x08_timepoint_dropout(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    df = t("events", "event_id", "user_id").withColumns({"rn": F.row_number().over(w.orderBy(hash_order("aug", "event_id"), "event_id")), "n": F.count("*").over(w)})
    return df.where(F.col("rn") <= F.greatest(F.lit(3.0), F.round(0.4 * F.col("n")))).select("event_id")


@query(f"""WITH {_DAILY}, l AS (SELECT env, list(v ORDER BY dap) AS l FROM daily GROUP BY 1) SELECT env, round(list_reduce(l, lambda m, x: 0.9 * m + 0.1 * x), 6) AS ema FROM l""")
def x09_moving_average_of_weights(t: Tables) -> DataFrame:
    lists = daily(t).groupBy("env").agg(F.transform(F.array_sort(F.collect_list(F.struct("dap", "v"))), lambda x: x["v"]).alias("l"))
    return lists.select("env", rounded(F.reduce(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), F.element_at("l", 1), lambda m, x: 0.9 * m + 0.1 * x)).alias("ema"))


@query(f"""WITH {_DAILY}, c AS (SELECT *, round(sum(gdd) OVER (PARTITION BY env ORDER BY dap ROWS UNBOUNDED PRECEDING), 6) AS k FROM daily) SELECT env, k AS at, round(avg(v), 6) AS v, CAST(count(*) AS BIGINT) AS merged FROM c GROUP BY 1, 2""")
def x10_axis_warp(t: Tables) -> DataFrame:
    warped = TS.running_sum(daily(t), ["env"], ["dap"], "gdd", "k", propagate_null=False)
    return warped.groupBy("env", rounded("k").alias("at")).agg(rounded(F.avg("v")).alias("v"), F.count("*").alias("merged"))


@query("""SELECT 'repeated keys' AS check, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS bad FROM lineitem UNION ALL
          SELECT 'discount range', CAST(count(*) FILTER (l_discount < 0.02 OR l_discount > 0.08) AS BIGINT) FROM lineitem UNION ALL SELECT 'not finite', CAST(count(*) FILTER (NOT isfinite(l_extendedprice)) AS BIGINT) FROM lineitem UNION ALL SELECT 'rows', CAST(count(*) AS BIGINT) FROM lineitem""")
def v01_table_checks(t: Tables) -> DataFrame:
    df = t("lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_extendedprice")
    keyed = df.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), F.count_if(~F.col("l_discount").between(0.02, 0.08)).alias("range"), F.count_if(~X.is_finite("l_extendedprice")).alias("odd"))
    sums = keyed.agg((F.sum("n") - F.count("*")).alias("repeated keys"), F.sum("range").alias("discount range"), F.sum("odd").alias("not finite"), F.sum("n").alias("rows"))
    return sums.unpivot([], list(sums.columns), "check", "bad")


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (abs(s - o_totalprice) > 1e-12 * abs(o_totalprice)) AS BIGINT) AS off FROM orders JOIN l ON l_orderkey = o_orderkey""")
def v02_parent_child_totals(t: Tables) -> DataFrame:
    child = t("lineitem", "l_orderkey", "l_extendedprice").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    off = F.abs(F.col("s") - F.col("o_totalprice")) > 1e-12 * F.abs(F.col("o_totalprice"))
    return t("orders", "o_orderkey", "o_totalprice").join(child, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("orders"), F.count_if(off).alias("off"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'absent' ELSE 'differs' END AS problem FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_nationkey = 7")
def v03_subset_of_full(t: Tables) -> DataFrame:
    full = t("customer", "c_custkey", "c_nationkey").where("c_custkey % 5 != 0")
    joined = t("orders", "o_orderkey", "o_custkey").join(full, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where("c_custkey IS NULL OR c_nationkey = 7").select("o_orderkey", F.when(F.col("c_custkey").isNull(), "absent").otherwise("differs").alias("problem"))


@query("SELECT user_id, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) > 1")
def v04_functional_dependency(t: Tables) -> DataFrame:
    return t("events", "user_id", "ts").groupBy("user_id").agg(F.count_distinct(F.col("ts").cast("date")).alias("days")).where("days > 1")


@query("SELECT p_brand, count(DISTINCT p_size) = 1 AS single, bool_and(starts_with(p_brand, 'Brand#')) AS agrees FROM part GROUP BY 1")
def v05_content_against_name(t: Tables) -> DataFrame:
    return t("part", "p_brand", "p_size").groupBy("p_brand").agg((F.count_distinct("p_size") == 1).alias("single"), F.bool_and(F.col("p_brand").startswith("Brand#")).alias("agrees"))


@query(_GROUPS + " SELECT round(sum(r / v) / sum(1 / v), 6) AS tiezzi, round(max(rm), 6) AS rmse, round(max(sm), 6) AS mean FROM (SELECT *, greatest((1 - r * r) / (n - 2), 2.220446049250313e-16) AS v, sqrt(sum(n * e * e) OVER () / sum(n) OVER ()) AS rm, avg(r) OVER () AS sm FROM g WHERE n > 2 AND r IS NOT NULL)")
def e03_expression_aggregates(t: Tables) -> DataFrame:
    return groups(t).where("n > 2 AND r IS NOT NULL").agg(rounded(X.pooled_correlation("r", "n")).alias("tiezzi"), rounded(X.pooled_rmse("e", "n")).alias("rmse"), rounded(X.safe_mean("r")).alias("mean"))
