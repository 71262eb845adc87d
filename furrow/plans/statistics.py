"""Queries of aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.functions.exprs import rounded
from furrow.operators import relational as R
from furrow.operators import scoring as S
from furrow.operators import timeseries as TS
from furrow.plans.registry import Tables, query

#: Actual against predicted by nation: extended price, and quantity times retail price.
_OBS = """o AS (SELECT n_name AS env, o_orderpriority AS pri, l_extendedprice / 1000.0 AS a, l_quantity * p_retailprice / 1000.0 AS p, c_custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def observations(t: Tables) -> DataFrame:
    return (
        t("lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
        .join(t("orders", "o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("part", "p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("n_name").alias("env"), F.col("o_orderpriority").alias("pri"), (F.col("l_extendedprice") / 1000.0).alias("a"), (F.col("l_quantity") * F.col("p_retailprice") / 1000.0).alias("p"), "c_custkey")
    )


_GROUPS = f"WITH {_OBS}, g AS (SELECT env, pri, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(p) > 0 THEN covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)) END AS r, sqrt(avg(pow(a - p, 2))) AS e FROM o GROUP BY 1, 2)"


def groups(t: Tables) -> DataFrame:
    return observations(t).groupBy("env", "pri").agg(F.count("*").alias("n"), X.correlation("a", "p").alias("r"), X.rmse("a", "p").alias("e"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def g01_count(t: Tables) -> DataFrame:
    return t("events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY 1")
def g02_distinct_count(t: Tables) -> DataFrame:
    return t("events", "event_type", "user_id").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))


@query("SELECT event_type, round(avg(CASE WHEN value > 20 THEN value END) FILTER (event_type <> 'view'), 6) AS m FROM events GROUP BY 1")
def g03_safe_mean(t: Tables) -> DataFrame:
    v = F.when(F.col("event_type") == "view", F.lit(float("nan"))).when(F.col("value") > 20, F.col("value"))
    return t("events", "event_type", "value").groupBy("event_type").agg(rounded(X.safe_mean(v)).alias("m"))


@query("SELECT event_type, round(median(value), 6) AS m FROM events GROUP BY 1")
def g04_median(t: Tables) -> DataFrame:
    return t("events", "event_type", "value").groupBy("event_type").agg(rounded(F.median("value")).alias("m"))


@query("SELECT user_id, round(stddev_samp(value), 6) AS s FROM events GROUP BY 1")
def g05_sample_sd(t: Tables) -> DataFrame:
    return t("events", "user_id", "value").groupBy("user_id").agg(rounded(F.stddev_samp("value")).alias("s"))


@query("SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def g06_mode(t: Tables) -> DataFrame:
    return S.mode(t("events", "user_id", "event_type"), ["user_id"], "event_type")


@query(_GROUPS + " SELECT env, pri, round(r, 6) AS r FROM g")
def g07_correlation(t: Tables) -> DataFrame:
    return groups(t).select("env", "pri", rounded("r").alias("r"))


@query("""WITH x AS (SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN 1.0 WHEN value > 10 THEN value END AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events),
  g AS (SELECT user_id, event_type, count(*) AS n, count(x) AS c, stddev_samp(x) AS sx, stddev_samp(y) AS sy, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM x GROUP BY 1, 2)
  SELECT user_id, event_type, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS n_complete, CASE WHEN c < n THEN 'missing' WHEN n < 3 THEN 'insufficient' WHEN sx = 0 OR sy = 0 THEN 'zero variance' ELSE 'ok' END AS status,
  CASE WHEN c = n AND n >= 3 AND sx > 0 AND sy > 0 THEN round(r, 6) END AS cor FROM g""")
def g08_correlation_status(t: Tables) -> DataFrame:
    x = F.when(F.col("event_type") == "click", 1.0).when(F.col("value") > 10, F.col("value"))
    df = t("events", "user_id", "event_type", "event_id", "value").withColumns({"x": x, "y": (F.col("event_id") % 97).cast("double")})
    return S.correlation_with_status(df, ["user_id", "event_type"], "x", "y").withColumn("cor", rounded("cor"))


@query("""SELECT event_type, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS r FROM (
          SELECT event_type, CASE WHEN value > 10 THEN value END AS x, CASE WHEN value > 10 THEN CAST(event_id % 97 AS DOUBLE) END AS y FROM events) GROUP BY 1""")
def g09_pairwise_complete(t: Tables) -> DataFrame:
    df = t("events", "event_type", "event_id", "value").withColumns({"x": F.when(F.col("value") > 10, F.col("value")), "y": (F.col("event_id") % 97).cast("double")})
    return df.groupBy("event_type").agg(rounded(X.correlation("x", "y")).alias("r"))


@query(f"""WITH {_OBS}, k AS (SELECT env, rank() OVER (PARTITION BY env ORDER BY a) + (count(*) OVER (PARTITION BY env, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY env ORDER BY p) + (count(*) OVER (PARTITION BY env, p) - 1) / 2.0 AS y FROM o)
          SELECT env, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS rho FROM k GROUP BY 1""")
def g10_spearman(t: Tables) -> DataFrame:
    return S.spearman(observations(t), ["env"], "a", "p").withColumn("rho", rounded("rho"))


@query("""WITH k AS (SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS DOUBLE) AS x, CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS DOUBLE) AS y FROM events)
          SELECT event_type, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) AS rho FROM k GROUP BY 1""")
def g11_spearman_ordinal(t: Tables) -> DataFrame:
    return S.spearman_ordinal(t("events", "event_type", "event_id", "value", "user_id"), ["event_type"], "value", "user_id", "event_id").withColumn("rho", rounded("rho"))


@query("""SELECT user_id, round(coalesce(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 0), 6) AS r
          FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE value END AS x, CAST(event_id % 89 AS DOUBLE) AS y FROM events) GROUP BY 1""")
def g12_correlation_or_zero(t: Tables) -> DataFrame:
    df = t("events", "user_id", "event_id", "value").withColumns({"x": F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(F.col("value")), "y": (F.col("event_id") % 89).cast("double")})
    return df.groupBy("user_id").agg(rounded(F.coalesce(X.correlation("x", "y"), F.lit(0.0))).alias("r"))


@query(_GROUPS + " SELECT env, pri, round(e, 6) AS rmse FROM g")
def g13_rmse(t: Tables) -> DataFrame:
    return groups(t).select("env", "pri", rounded("e").alias("rmse"))


@query(_GROUPS + " SELECT pri, round(sqrt(sum(n * e * e) / sum(n)), 6) AS rmse FROM g GROUP BY 1")
def g14_pooled_rmse(t: Tables) -> DataFrame:
    return groups(t).groupBy("pri").agg(rounded(X.pooled_rmse("e", "n")).alias("rmse"))


@query(_GROUPS + " SELECT pri, round(avg(e), 6) AS macro, round(sqrt(sum(n * e * e) / sum(n)), 6) AS pooled FROM g GROUP BY 1")
def g15_macro_rmse(t: Tables) -> DataFrame:
    return groups(t).groupBy("pri").agg(rounded(F.avg("e")).alias("macro"), rounded(X.pooled_rmse("e", "n")).alias("pooled"))


_TIEZZI = "sum(r / v) / sum(1 / v)"


@query(_GROUPS + f" SELECT pri, round({_TIEZZI}, 6) AS r_w FROM (SELECT *, greatest((1 - r * r) / (n - 2), 2.220446049250313e-16) AS v FROM g WHERE r IS NOT NULL AND n > 2) GROUP BY 1")
def g16_pooled_correlation(t: Tables) -> DataFrame:
    return groups(t).groupBy("pri").agg(rounded(X.pooled_correlation("r", "n")).alias("r_w"))


@query(_GROUPS + f" SELECT pri, round({_TIEZZI}, 6) AS r_w, CAST(count(*) AS BIGINT) AS blocks FROM (SELECT *, (1 - r * r) / (n - 2) AS v FROM g WHERE abs(r) < 1 AND n >= 3) GROUP BY 1")
def g17_pooled_correlation_strict(t: Tables) -> DataFrame:
    return groups(t).groupBy("pri").agg(rounded(X.pooled_correlation_strict("r", "n")).alias("r_w"), X.blocks_used("r", "n").alias("blocks"))


_HIER = f"""WITH {_OBS}, s AS (SELECT *, c_custkey % 3 AS seed, c_custkey % 5 AS fold FROM o),
  e AS (SELECT pri, seed, fold, env, avg(a - p) AS d FROM s GROUP BY 1, 2, 3, 4), f AS (SELECT pri, seed, fold, avg(d) AS d FROM e GROUP BY 1, 2, 3), k AS (SELECT pri, seed, avg(d) AS d FROM f GROUP BY 1, 2)"""


@query(_HIER + " SELECT pri, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, CAST(count(*) AS BIGINT) AS seeds FROM k GROUP BY 1")
def g18_hierarchical_mean(t: Tables) -> DataFrame:
    s = observations(t).select("pri", (F.col("c_custkey") % 3).alias("seed"), (F.col("c_custkey") % 5).alias("fold"), "env", (F.col("a") - F.col("p")).alias("d"))
    return S.hierarchical_mean(s, ["pri"], ["seed", "fold", "env"], "d").select("pri", rounded("mean").alias("mean"), rounded("sd").alias("sd"), F.col("n").alias("seeds"))


@query(f"""WITH {_OBS}, b AS (SELECT pri, env, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(p) > 0 THEN covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)) END AS r FROM o GROUP BY 1, 2),
  w AS (SELECT pri, sum(r / ((1 - r * r) / (n - 2))) / sum(1 / ((1 - r * r) / (n - 2))) AS r_w, count(*) AS k FROM b WHERE n >= 3 AND abs(r) < 1 GROUP BY 1)
  SELECT pri AS label, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg(pow(a - p, 2))), 6) AS rmse, round(covar_pop(a, p) / (stddev_pop(a) * stddev_pop(p)), 6) AS pearson, round(max(r_w), 6) AS r_w, CAST(max(k) AS BIGINT) AS blocks FROM o JOIN w USING (pri) GROUP BY 1""")
def g19_score_by_label(t: Tables) -> DataFrame:
    scored = S.score_by_label(observations(t).withColumnRenamed("pri", "label"), "label", "env", "a", "p")
    return scored.select("label", "n", rounded("rmse").alias("rmse"), rounded("pearson").alias("pearson"), rounded("r_w").alias("r_w"), "blocks")


@query("""SELECT coalesce(event_type, 'TOTAL') AS event_type, CAST(count(*) FILTER (value > 50) AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ROLLUP (event_type)""")
def g20_counts_with_total(t: Tables) -> DataFrame:
    rolled = t("events", "event_type", "value").rollup("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count("*").alias("n"), F.grouping("event_type").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("event_type")).alias("event_type"), "high", "n")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1")
def g21_first_value(t: Tables) -> DataFrame:
    return t("events", "user_id", "event_type", "ts", "event_id").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def g22_distinct_strings(t: Tables) -> DataFrame:
    return t("orders", "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"))


@query("SELECT event_type, round(avg(value), 6) AS v_mean, round(stddev_samp(value), 6) AS v_std, round(avg(user_id), 6) AS u_mean, round(stddev_samp(user_id), 6) AS u_std FROM events GROUP BY 1")
def g23_summary_vector(t: Tables) -> DataFrame:
    both = [f(c).alias(f"{c[0]}_{n}") for c in ("value", "user_id") for f, n in ((lambda x: rounded(F.avg(x)), "mean"), (lambda x: rounded(F.stddev_samp(x)), "std"))]
    return t("events", "event_type", "user_id", "value").groupBy("event_type").agg(*both)


@query("""SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 6) AS s, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS m,
          round(min(value) FILTER (event_type = 'click'), 6) AS lo, round(max(value) FILTER (event_type = 'click'), 6) AS hi, round(quantile_cont(value, 0.25) FILTER (event_type = 'click'), 6) AS q FROM events GROUP BY 1""")
def g24_masked_reductions(t: Tables) -> DataFrame:
    v = F.when(F.col("event_type") == "click", F.col("value"))
    return t("events", "user_id", "event_type", "value").groupBy("user_id").agg(
        rounded(F.coalesce(F.sum(v), F.lit(0.0))).alias("s"), rounded(F.coalesce(F.avg(v), F.lit(0.0))).alias("m"),
        rounded(F.min(v)).alias("lo"), rounded(F.max(v)).alias("hi"), rounded(F.percentile(v, F.lit(0.25))).alias("q"))


@query("""SELECT CAST(i - 1 AS INTEGER) AS locus, round(avg(CASE WHEN e < -0.05 THEN 0 WHEN e < 0.05 THEN 1 ELSE 2 END) / 2, 6) AS p FROM (SELECT i, CAST(embedding[i] AS DOUBLE) AS e FROM embeddings, range(1, 65) r(i)) GROUP BY 1""")
def g25_allele_frequency(t: Tables) -> DataFrame:
    from furrow.operators.kernels import allele_frequencies
    from furrow.plans.kernels import dosages

    return allele_frequencies(dosages(t), "id", "d").select("locus", rounded("p").alias("p"))


@query("""WITH v AS (SELECT event_type AS env, var_samp(value) AS total, var_samp(value) FILTER (user_id % 2 = 0) AS g FROM events GROUP BY 1)
          SELECT env, round(100 * g / (g + total), 2) AS percent, round(g / (g + total / 2), 3) AS heritability FROM v""")
def g26_heritability(t: Tables) -> DataFrame:
    v = t("events", "event_type", "user_id", "value").groupBy(F.col("event_type").alias("env")).agg(
        F.var_samp("value").alias("total"), F.var_samp(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("g"))
    return v.select("env", F.round(100 * F.try_divide("g", F.col("g") + F.col("total")), 2).alias("percent"), F.round(F.try_divide("g", F.col("g") + F.col("total") / 2), 3).alias("heritability"))


@query(_GROUPS + """, d AS (SELECT env, a.pri AS pri, a.e - b.e AS d, b.e AS base FROM g a JOIN g b USING (env) WHERE a.pri <> '5-LOW' AND b.pri = '5-LOW')
          SELECT pri, round(avg(d), 6) AS diff, round(100 * avg(d) / avg(base), 6) AS percent, round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 6) AS wins, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 5) AS t FROM d GROUP BY 1""")
def g27_paired_differences(t: Tables) -> DataFrame:
    g = groups(t)
    base = g.where("pri = '5-LOW'").select("env", F.col("e").alias("base"))
    return S.paired_summary(g.where("pri != '5-LOW'").join(base, "env"), ["pri"], "e", "base").select("pri", rounded("diff").alias("diff"), rounded("percent").alias("percent"), rounded("wins").alias("wins"), rounded("t", 5).alias("t"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY 1")
def g28_weighted_mean(t: Tables) -> DataFrame:
    return t("lineitem", "l_returnflag", "l_discount", "l_quantity").groupBy("l_returnflag").agg(rounded(X.weighted_mean("l_discount", "l_quantity")).alias("m"))


@query("SELECT event_type, round(avg(-0.5 * ln(2 * pi()) - ln(30.0) - 0.5 * pow((value - 50.0) / 30.0, 2)), 6) AS ll FROM events GROUP BY 1")
def g29_mean_log_density(t: Tables) -> DataFrame:
    return t("events", "event_type", "value").groupBy("event_type").agg(rounded(F.avg(X.normal_log_density("value", F.lit(50.0), F.lit(30.0)))).alias("ll"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
def g30_having(t: Tables) -> DataFrame:
    return t("orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 10")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def g31_relational_division(t: Tables) -> DataFrame:
    return R.present_everywhere(t("orders", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


@query(_GROUPS + """ SELECT env, CASE WHEN pri IN ('1-URGENT', '2-HIGH') THEN 'TOP' ELSE pri END AS model, round(avg(e), 6) AS e FROM g GROUP BY 1, 2""")
def g32_collapse_twins(t: Tables) -> DataFrame:
    g = groups(t)
    twin = F.col("pri").isin("1-URGENT", "2-HIGH")
    merged = g.where(twin).groupBy("env", F.lit("TOP").alias("model")).agg(F.avg("e").alias("e"))
    return merged.unionByName(g.where(~twin).select("env", F.col("pri").alias("model"), "e")).withColumn("e", rounded("e"))


@query("SELECT event_type, round(avg(value), 6) AS m, round(stddev_pop(value), 6) AS s FROM events GROUP BY 1")
def g34_population_summary(t: Tables) -> DataFrame:
    return t("events", "event_type", "value").groupBy("event_type").agg(rounded(F.avg("value")).alias("m"), rounded(F.stddev_pop("value")).alias("s"))


#: Daily means by type stand for weather; growing degrees are what lies over 45.
_DAILY = """daily AS (SELECT event_type AS env, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS dap, avg(value) AS v, greatest(avg(value) - 45, 0) AS gdd FROM events GROUP BY 1, 2)"""


def daily(t: Tables) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return t("events", "event_type", "ts", "value").groupBy(F.col("event_type").alias("env"), day.alias("dap")).agg(F.avg("value").alias("v")).withColumn("gdd", F.greatest(F.col("v") - 45, F.lit(0.0)))


@query(f"WITH {_DAILY} SELECT env, dap, round(CASE WHEN count(CASE WHEN dap <> 20 THEN gdd END) OVER w = count(*) OVER w THEN sum(gdd) OVER w END, 6) AS agdd FROM daily WINDOW w AS (PARTITION BY env ORDER BY dap ROWS UNBOUNDED PRECEDING)")
def w01_running_sum(t: Tables) -> DataFrame:
    df = daily(t).withColumn("gdd", F.when(F.col("dap") != 20, F.col("gdd")))
    return TS.running_sum(df, ["env"], ["dap"], "gdd", "agdd").select("env", "dap", rounded("agdd").alias("agdd"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rn FROM events")
def w02_row_number(t: Tables) -> DataFrame:
    return t("events", "event_id", "user_id", "value").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rn"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0 AS r FROM lineitem")
def w03_average_rank(t: Tables) -> DataFrame:
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", S.average_rank(["l_orderkey"], "l_quantity").alias("r"))


@query("SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders")
def w04_group_count(t: Tables) -> DataFrame:
    return t("orders", "o_orderkey", "o_custkey").select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))


@query(f"""WITH {_DAILY}, c AS (SELECT *, round(sum(gdd) OVER (PARTITION BY env ORDER BY dap ROWS UNBOUNDED PRECEDING), 6) AS k FROM daily),
          m AS (SELECT env, k, min(dap) AS dap, avg(gdd) AS gdd, avg(v) AS v FROM c GROUP BY 1, 2)
          SELECT env, dap, round(v, 6) AS v, round(sum(gdd) OVER (PARTITION BY env ORDER BY dap ROWS UNBOUNDED PRECEDING), 5) AS axis FROM m""")
def w05_collapsed_axis(t: Tables) -> DataFrame:
    out = TS.collapse_axis(daily(t), ["env"], "dap", "gdd", ["v"])
    return out.select("env", "dap", rounded("v").alias("v"), rounded("axis", 5).alias("axis"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0), 4) AS step FROM orders")
def w06_component_steps(t: Tables) -> DataFrame:
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t("orders", "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", rounded(F.col("o_totalprice") - F.coalesce(before, F.lit(0.0)), 4).alias("step"))


@query("""WITH x AS (SELECT event_id, user_id, ts, CASE WHEN value > 60 THEN value END AS v FROM events)
          SELECT event_id, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM x""")
def w07_fill_both_ways(t: Tables) -> DataFrame:
    x = t("events", "event_id", "user_id", "ts", "value").withColumn("v", F.when(F.col("value") > 60, F.col("value")))
    return TS.fill_both_ways(x, ["user_id"], ["ts", "event_id"], "v", "f").select("event_id", rounded("f").alias("v"))


@query(f"""WITH {_DAILY}, x AS (SELECT env, dap, CASE WHEN (dap * 7) % 5 <> 0 AND dap BETWEEN 2 AND 27 THEN v END AS v FROM daily),
  w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN dap END IGNORE NULLS) OVER a AS t0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN dap END IGNORE NULLS) OVER b AS t1, first_value(v IGNORE NULLS) OVER b AS v1 FROM x
        WINDOW a AS (PARTITION BY env ORDER BY dap ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY env ORDER BY dap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT env, dap, v IS NULL AS was_missing, round(CASE WHEN v IS NOT NULL THEN v WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (dap - t0) / (t1 - t0) END, 6) AS v FROM w""")
def w08_gap_interpolation(t: Tables) -> DataFrame:
    x = daily(t).withColumn("v", F.when(((F.col("dap") * 7) % 5 != 0) & F.col("dap").between(2, 27), F.col("v")))
    return TS.interpolate(x, ["env"], "dap", "v", "f").select("env", "dap", F.col("v").isNull().alias("was_missing"), rounded("f").alias("v"))


@query("""WITH w AS (SELECT event_id, value AS v, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS l FROM events),
  m AS (SELECT *, list_sort(l)[7] AS med FROM w), s AS (SELECT *, 1.4826 * list_sort(list_transform(l, lambda x: abs(x - med)))[7] AS mad FROM m)
  SELECT event_id, round(CASE WHEN len(l) = 13 AND abs(v - med) > mad THEN NULL ELSE v END, 6) AS v FROM s""")
def w09_hampel_filter(t: Tables) -> DataFrame:
    df = t("events", "event_id", "user_id", "ts", "value")
    return TS.hampel(df, ["user_id"], ["ts", "event_id"], "value", 6, 1.0, "v").select("event_id", rounded("v").alias("v"))


@query("""SELECT event_id, CASE WHEN value <= quantile_cont(value, 0.05) OVER w THEN 'Low' WHEN value >= quantile_cont(value, 0.95) OVER w THEN 'High' ELSE 'Middle' END AS tail FROM events WINDOW w AS (PARTITION BY event_type)""")
def w10_quantile_tails(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type")
    low, high = F.percentile("value", F.lit(0.05)).over(w), F.percentile("value", F.lit(0.95)).over(w)
    return t("events", "event_id", "event_type", "value").select("event_id", F.when(F.col("value") <= low, "Low").when(F.col("value") >= high, "High").otherwise("Middle").alias("tail"))


@query("""SELECT event_type, 'min' AS kind, arg_min(event_id, (value, event_id)) AS event_id FROM events GROUP BY 1 UNION ALL SELECT event_type, 'max', arg_min(event_id, (-value, event_id)) FROM events GROUP BY 1""")
def w11_extremes(t: Tables) -> DataFrame:
    df = t("events", "event_id", "event_type", "value")
    pick = lambda kind, order: df.groupBy("event_type").agg(F.lit(kind).alias("kind"), F.min_by("event_id", F.struct(order.alias("o"), "event_id")).alias("event_id"))
    return pick("min", F.col("value")).unionByName(pick("max", -F.col("value")))


@query("""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn <= least(10, n // 2) OR rn > n - least(10, n // 2)""")
def w12_both_tails(t: Tables) -> DataFrame:
    by = Window.partitionBy("event_type")
    df = t("events", "event_id", "event_type", "value").withColumns({"rn": F.row_number().over(by.orderBy("value", "event_id")), "n": F.count("*").over(by)})
    k = F.least(F.lit(10), F.floor(F.col("n") / 2))
    return df.where((F.col("rn") <= k) | (F.col("rn") > F.col("n") - k)).select("event_type", "event_id")


@query("""SELECT event_id, round(coalesce((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END, 0), 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY user_id)""")
def w13_group_z_score(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id")
    return t("events", "event_id", "user_id", "value").select("event_id", rounded(X.z_score("value", F.avg("value").over(w), F.stddev_samp("value").over(w))).alias("z"))


@query("""SELECT event_id, round((value - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0 AS z FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE user_id % 4 <> 0)""")
def w14_fit_subset_z_score(t: Tables) -> DataFrame:
    df = t("events", "event_id", "user_id", "value")
    stats = df.where("user_id % 4 != 0").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return df.join(F.broadcast(stats), F.lit(True)).select("event_id", rounded(X.z_score("value", "m", "s")).alias("z"))


@query("SELECT user_id, arg_min(round(value, 6), event_id) AS v FROM events GROUP BY 1")
def w15_first_occurrence(t: Tables) -> DataFrame:
    return t("events", "user_id", "event_id", "value").groupBy("user_id").agg(F.min_by(rounded("value"), "event_id").alias("v"))


@query("""WITH s AS (SELECT stddev_samp(value) AS s FROM events) SELECT event_id, CASE WHEN value > 2 * s THEN NULL ELSE round(value, 6) END AS v, value > 2 * s AS removed FROM events, s""")
def w16_tail_outliers(t: Tables) -> DataFrame:
    df = t("events", "event_id", "value")
    s = df.agg(F.stddev_samp("value").alias("s"))
    over = F.col("value") > 2 * F.col("s")
    return df.join(F.broadcast(s), F.lit(True)).select("event_id", F.when(~over, rounded("value")).alias("v"), over.alias("removed"))
