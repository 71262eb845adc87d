"""Queries of scans, sinks, filters, joins, sorts, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.exprs import composite_key, finite_or_null, is_finite, rounded
from furrow.operators import relational as R
from furrow.operators import timeseries as TS
from furrow.plans.registry import Tables, query


@query("SELECT * FROM nation")
def s01_full_scan(t: Tables) -> DataFrame:
    return t("nation")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def s02_projected_scan(t: Tables) -> DataFrame:
    return t("orders", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)$', 1) AS prefix,
          CAST(regexp_extract(c_name, '^([A-Za-z]+)#0*([0-9]+)$', 2) AS BIGINT) AS number FROM customer
          WHERE regexp_matches(c_name, '^([A-Za-z]+)#0*([0-9]+)$')""")
def s05_keys_from_names(t: Tables) -> DataFrame:
    pattern = r"^([A-Za-z]+)#0*([0-9]+)$"
    named = t("customer", "c_custkey", "c_name").where(F.col("c_name").rlike(pattern))
    return named.select(
        "c_custkey",
        F.regexp_extract("c_name", pattern, 1).alias("prefix"),
        F.regexp_extract("c_name", pattern, 2).cast("long").alias("number"),
    )


@query("SELECT DISTINCT o_custkey FROM orders")
def s12_key_index(t: Tables) -> DataFrame:
    return t("orders", "o_custkey").distinct()


@query("""SELECT event_type, CAST(d AS BIGINT) AS day, round(coalesce(last_value(v IGNORE NULLS) OVER w1, first_value(v IGNORE NULLS) OVER w2), 6) AS value
          FROM (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, avg(CASE WHEN value < 90 THEN value END) AS v
                FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL)
          WINDOW w1 AS (PARTITION BY event_type ORDER BY d ROWS UNBOUNDED PRECEDING),
                 w2 AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def s13_daily_series_scan(t: Tables) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    kept = t("events", "event_type", "ts", "value").where(F.col("event_type").isin("click", "view", "purchase"))
    daily = kept.groupBy("event_type", day.alias("day")).agg(F.avg(F.when(F.col("value") < 90, F.col("value"))).alias("v"))
    return TS.fill_both_ways(daily, ["event_type"], ["day"], "v", "value").select("event_type", "day", rounded("value").alias("value"))


@query("""SELECT event_id, 'k' AS metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def s21_metric_maps(t: Tables) -> DataFrame:
    parsed = F.from_json("props", T.MapType(T.StringType(), T.DoubleType()))
    return t("events", "event_id", "props").select("event_id", F.explode(parsed).alias("metric", "value"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus AS role, 'CV' || o_orderstatus AS cv_label, round(o_totalprice, 6) AS actual, round(q.p, 6) AS predicted
          FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1) q ON l_orderkey = o_orderkey WHERE q.p IS NOT NULL""")
def k03_predictions_sink(t: Tables) -> DataFrame:
    predicted = t("lineitem", "l_orderkey", "l_extendedprice").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("p"))
    return (
        t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        .join(predicted, F.col("l_orderkey") == F.col("o_orderkey"))
        .where(F.col("p").isNotNull())
        .select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("role"), F.concat(F.lit("CV"), "o_orderstatus").alias("cv_label"),
                rounded("o_totalprice").alias("actual"), rounded("p").alias("predicted"))
    )


@query("""SELECT o_orderstatus AS label, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS n_urgent, CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS BIGINT) AS n_low,
          round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS mean_urgent, round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 4) AS mean_low
          FROM orders GROUP BY 1""")
def k04_wide_metrics(t: Tables) -> DataFrame:
    wide = t("orders", "o_orderstatus", "o_orderpriority", "o_totalprice").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 4).alias("mean"))
    names = {"1-URGENT_n": "n_urgent", "5-LOW_n": "n_low", "1-URGENT_mean": "mean_urgent", "5-LOW_mean": "mean_low", "o_orderstatus": "label"}
    return wide.withColumnsRenamed(names).fillna(0, ["n_urgent", "n_low"])


@query("""SELECT c_custkey, s FROM customer, (VALUES ('F'), ('O'), ('P')) v(s)
          WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = s)""")
def k07_restart_list(t: Tables) -> DataFrame:
    statuses = t.spark.createDataFrame([("F",), ("O",), ("P",)], "s string")
    grid = t("customer", "c_custkey").join(F.broadcast(statuses), F.lit(True))
    done = t("orders", "o_custkey", "o_orderstatus").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("s"))
    return grid.join(done, ["c_custkey", "s"], "left_anti")


@query("SELECT n_name AS env, n_nationkey AS env_id, n_regionkey AS \"region.key\" FROM nation")
def p01_rename_relocate(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_name").alias("env"), F.col("n_nationkey").alias("env_id"), F.col("n_regionkey").alias("region.key"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(CAST(l_orderkey AS VARCHAR), 'NA') || '.' || coalesce(nullif(l_returnflag, 'N'), 'NA') AS k FROM lineitem""")
def p02_composite_key(t: Tables) -> DataFrame:
    flag = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag").select("l_orderkey", "l_linenumber", composite_key("l_orderkey", flag).alias("k"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def p03_membership(t: Tables) -> DataFrame:
    return t("customer", "c_custkey", "c_mktsegment").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) WHERE s NOT IN ('MACHINERY') OR s IS NULL")
def p04_negated_membership(t: Tables) -> DataFrame:
    some = t("customer", "c_custkey", "c_mktsegment").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"))
    return some.where(R.not_in("s", ["MACHINERY"])).select("c_custkey")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN value > 20 THEN value END AS a, nullif(event_type, 'view') AS b FROM events) WHERE a IS NOT NULL AND b IS NOT NULL")
def p05_complete_cases(t: Tables) -> DataFrame:
    some = t("events", "event_id", "value", "event_type").select("event_id", F.when(F.col("value") > 20, F.col("value")).alias("a"), F.nullif("event_type", F.lit("view")).alias("b"))
    return R.complete(some, ["a", "b"]).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 2))")
def p06_two_set_exclusion(t: Tables) -> DataFrame:
    df = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return df.where(~(F.col("l_returnflag").isin("A", "R") & F.col("l_linenumber").isin(1, 2))).select("l_orderkey", "l_linenumber")


@query("""SELECT event_id, round(d, 6) AS dap FROM (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-05 12:00:00')) / 86400000000.0 AS d FROM events) WHERE d BETWEEN 0 AND 10""")
def p07_closed_range(t: Tables) -> DataFrame:
    from furrow.functions.exprs import days_between

    d = days_between("ts", F.lit("2024-01-05 12:00:00").cast("timestamp"))
    df = t("events", "event_id", "ts").withColumn("d", d)
    return df.where(is_finite("d") & F.col("d").between(0, 10)).select("event_id", rounded("d").alias("dap"))


@query("""SELECT event_id, CASE WHEN isfinite(x) THEN round(x, 6) END AS x FROM (
          SELECT event_id, CASE WHEN value < 10 THEN 'NaN'::DOUBLE WHEN value > 90 THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events)""")
def p08_finite_or_null(t: Tables) -> DataFrame:
    x = F.when(F.col("value") < 10, F.lit(float("nan"))).when(F.col("value") > 90, F.lit(float("inf"))).otherwise(F.col("value"))
    return t("events", "event_id", "value").select("event_id", rounded(finite_or_null(x)).alias("x"))


@query("""SELECT event_id, event_type, CASE WHEN d < coalesce(lo, d) OR d > coalesce(hi, d) THEN NULL ELSE value END AS value
          FROM (SELECT *, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events)
          LEFT JOIN (VALUES ('click', 5, 20), ('view', NULL, 15), ('purchase', 10, NULL)) v(et, lo, hi) ON event_type = et""")
def p09_rule_windows(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("click", 5, 20), ("view", None, 15), ("purchase", 10, None)], "event_type string, low int, high int")
    df = t("events", "event_id", "event_type", "ts", "value").withColumn("d", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    return R.null_outside_windows(df, rules, "event_type", "d", "value").select("event_id", "event_type", "value")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN replace(o_orderpriority, '-', '_') ELSE o_orderpriority END AS priority,
          CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey END AS cust FROM orders""")
def p10_conditional_update(t: Tables) -> DataFrame:
    df = t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"))
    hit = F.col("o_orderstatus") == "P"
    return df.select(
        "o_orderkey", F.when(hit, F.replace("priority", F.lit("-"), F.lit("_"))).otherwise(F.col("priority")).alias("priority"),
        F.when(hit, F.col("cust") + 1).otherwise(F.col("cust")).alias("cust"),
    )


@query("SELECT p_partkey, regexp_matches(p_name, 'e.*r') AS matched, starts_with(p_brand, 'Brand#1') AS prefixed, contains(p_type, 'STEEL') AS held FROM part")
def p11_text_predicates(t: Tables) -> DataFrame:
    return t("part", "p_partkey", "p_name", "p_brand", "p_type").select(
        "p_partkey", F.col("p_name").rlike("e.*r").alias("matched"), F.col("p_brand").startswith("Brand#1").alias("prefixed"), F.col("p_type").contains("STEEL").alias("held"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, TRY_CAST(p_type AS DOUBLE) AS p_type, CAST(NULL AS DOUBLE) AS extra, CAST(p_size AS DOUBLE) AS p_size FROM part")
def p13_schema_alignment(t: Tables) -> DataFrame:
    schema = T.StructType([T.StructField("p_partkey", T.StringType()), T.StructField("p_type", T.DoubleType()), T.StructField("extra", T.DoubleType()), T.StructField("p_size", T.DoubleType())])
    return R.align(t("part", "p_partkey", "p_type", "p_size"), schema)


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F') AND o_orderpriority IN ('1-URGENT') AND o_shippriority_dummy IS NULL)""".replace(" AND o_shippriority_dummy IS NULL", ""))
def p15_filter_list_expand(t: Tables) -> DataFrame:
    df = t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return R.select_rows(df, [{"o_orderstatus": ["F"]}, {"o_orderpriority": ["1-URGENT"]}], expand="o_custkey").select("o_orderkey")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')")
def p16_channel_subset(t: Tables) -> DataFrame:
    return t("events", "event_id", "event_type", "value").where(F.col("event_type").isin("click", "purchase"))


@query("SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)) WHERE rn % 2 = 1")
def p17_alternate_thinning(t: Tables) -> DataFrame:
    days = t("events", "ts").select(F.col("ts").cast("date").alias("d")).distinct()
    return days.withColumn("rn", F.row_number().over(Window.orderBy("d"))).where("rn % 2 = 1").select("d")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 7")
def p18_head_of_groups(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return t("events", "event_id", "event_type", "ts").withColumn("rn", F.row_number().over(w)).where("rn <= 7").select("event_id", "event_type")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""")
def p19_coverage_mask(t: Tables) -> DataFrame:
    orders = t("orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    events = t("events", "user_id").withColumnRenamed("user_id", "c_custkey")
    return R.covered_by(t("customer", "c_custkey"), (orders, "c_custkey"), (events, "c_custkey"))


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey AND s_nationkey % 2 = 0")
def j01_left_join(t: Tables) -> DataFrame:
    s = t("supplier").where("s_acctbal > 0 AND s_nationkey % 2 = 0").select("s_suppkey", "s_name")
    return t("lineitem", "l_orderkey", "l_linenumber", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j02_full_match_lookup(t: Tables) -> DataFrame:
    regions = t("region").withColumnRenamed("r_regionkey", "n_regionkey")
    return R.lookup(t("nation"), regions, ["n_regionkey"]).select("n_name", "r_name")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN s_name ELSE p_name END AS name FROM lineitem
          LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""")
def j03_branch_dependent_key(t: Tables) -> DataFrame:
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_partkey")
    names = t("supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")).unionByName(
        t("part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name")))
    a = F.col("l_returnflag") == "A"
    keyed = lines.withColumns({"kind": F.when(a, "s").otherwise("p"), "k": F.when(a, F.col("l_suppkey")).otherwise(F.col("l_partkey"))})
    return keyed.join(names, ["kind", "k"], "left").select("l_orderkey", "l_linenumber", "name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j04_inner_join(t: Tables) -> DataFrame:
    return t("orders", "o_orderkey", "o_custkey").join(t("customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT k, a.n AS n_customers, b.n AS n_suppliers, c.n AS n_names FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) a
          FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 3 GROUP BY 1) b USING (k)
          FULL JOIN (SELECT n_nationkey AS k, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1) c USING (k)""")
def j05_full_outer_chain(t: Tables) -> DataFrame:
    a = t("customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = t("supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    c = t("nation").where("n_nationkey % 2 = 0").groupBy(F.col("n_nationkey").alias("k")).agg(F.count("*").alias("n_names"))
    return a.join(b, "k", "full").join(c, "k", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j06_semi_join(t: Tables) -> DataFrame:
    big = t("orders", "o_custkey", "o_totalprice").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer", "c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j07_anti_join(t: Tables) -> DataFrame:
    return R.unmatched(t("customer", "c_custkey"), t("orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT o.ord, n_name FROM (VALUES (0, 7), (1, 3), (2, 21), (3, 0)) o(ord, k) LEFT JOIN nation ON k = n_nationkey")
def j08_positional_lookup(t: Tables) -> DataFrame:
    order = t.spark.createDataFrame([(0, 7), (1, 3), (2, 21), (3, 0)], "ord int, k int")
    return order.join(t("nation"), F.col("k") == F.col("n_nationkey"), "left").select("ord", "n_name").orderBy("ord")


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey")
def j09_update_join(t: Tables) -> DataFrame:
    new = t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    return R.update_from(t("customer", "c_custkey", "c_nationkey", "c_mktsegment"), new, ["c_nationkey"], "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("SELECT n_name, d, coalesce(n, 0) AS n FROM nation CROSS JOIN range(3) r(d) LEFT JOIN (SELECT c_nationkey, c_custkey % 3 AS m, count(*) AS n FROM customer GROUP BY 1, 2) ON c_nationkey = n_nationkey AND m = d")
def j10_cross_grid(t: Tables) -> DataFrame:
    grid = t("nation", "n_nationkey", "n_name").join(F.broadcast(t.spark.range(3).withColumnRenamed("id", "d")), F.lit(True))
    counts = t("customer", "c_nationkey", "c_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey"), (F.col("c_custkey") % 3).alias("d")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["n_nationkey", "d"], "left").select("n_name", "d", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, field FROM events, (VALUES ('click', 'f1'), ('click', 'f2'), ('view', 'f3')) v(k, field) WHERE event_type = k")
def j11_shared_record(t: Tables) -> DataFrame:
    fields = t.spark.createDataFrame([("click", "f1"), ("click", "f2"), ("view", "f3")], "event_type string, field string")
    return t("events", "event_id", "event_type").join(fields, "event_type").select("event_id", "field")


@query("""SELECT p_partkey, g FROM part JOIN (SELECT n_nationkey AS g, 900 + 40.0 * n_nationkey AS lo, 960 + 50.0 * n_nationkey AS hi FROM nation)
          ON p_retailprice <= hi AND p_retailprice + p_size >= lo""")
def j12_interval_overlap(t: Tables) -> DataFrame:
    genes = t("nation").select(F.col("n_nationkey").alias("g"), (900 + 40.0 * F.col("n_nationkey")).alias("lo"), (960 + 50.0 * F.col("n_nationkey")).alias("hi"))
    parts = t("part", "p_partkey", "p_retailprice", "p_size").withColumn("stop", F.col("p_retailprice") + F.col("p_size"))
    return R.overlapping(parts, genes, "p_retailprice", "stop", "lo", "hi", 50.0).select("p_partkey", "g")


_AS_OF = """WITH grid AS (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS h, avg(value) AS v FROM events GROUP BY ALL),
  targets AS (SELECT DISTINCT event_type, user_id * 13 % 800 - 20 AS h FROM events),
  u AS (SELECT event_type, h, v, 0 AS o FROM grid UNION ALL SELECT event_type, h, NULL, 1 FROM targets),
  w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER a AS h0, last_value(v IGNORE NULLS) OVER a AS v0,
        first_value(CASE WHEN v IS NOT NULL THEN h END IGNORE NULLS) OVER b AS h1, first_value(v IGNORE NULLS) OVER b AS v1 FROM u
        WINDOW a AS (PARTITION BY event_type ORDER BY h, o ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY event_type ORDER BY h, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  looked AS (SELECT event_type, h, CASE WHEN h0 = h THEN v0 WHEN h0 IS NULL THEN v1 WHEN h1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (h - h0) / (h1 - h0) END AS v FROM w WHERE o = 1)
"""


def _looked_up(t: Tables) -> DataFrame:
    hours = (F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600
    grid = t("events", "event_type", "ts", "value").groupBy("event_type", hours.cast("long").alias("h")).agg(F.avg("value").alias("v"))
    targets = t("events", "event_type", "user_id").select("event_type", (F.col("user_id") * 13 % 800 - 20).alias("h"))
    return TS.as_of(grid, targets, ["event_type"], "h", "v")


@query(_AS_OF + "SELECT event_type, h, round(v, 6) AS v FROM looked")
def j13_as_of_interpolated(t: Tables) -> DataFrame:
    return _looked_up(t).select("event_type", "h", rounded("v").alias("v"))


@query(_AS_OF + "SELECT h, round(max(v) FILTER (event_type = 'click'), 6) AS click, round(max(v) FILTER (event_type = 'view'), 6) AS view FROM looked GROUP BY h")
def j14_weather_widening(t: Tables) -> DataFrame:
    wide = _looked_up(t).groupBy("h").pivot("event_type", ["click", "view"]).agg(F.max("v"))
    return wide.select("h", rounded("click").alias("click"), rounded("view").alias("view"))


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def j15_entity_features(t: Tables) -> DataFrame:
    entity = t("customer", "c_custkey", "c_nationkey").join(t("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    features = entity.select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return R.lookup(t("orders", "o_orderkey", "o_custkey"), features, ["o_custkey"]).select("o_orderkey", "n_name")


@query("SELECT a.c_custkey, b.r_name FROM (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS k FROM customer) a JOIN (SELECT nullif(r_regionkey, 0) AS k, r_name FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def j16_null_safe_join(t: Tables) -> DataFrame:
    a = t("customer", "c_custkey", "c_nationkey").select("c_custkey", F.nullif(F.col("c_nationkey") % 5, F.lit(0)).alias("k"))
    b = t("region").select(F.nullif("r_regionkey", F.lit(0)).alias("rk"), "r_name")
    return a.join(b, F.col("k").eqNullSafe(F.col("rk"))).select("c_custkey", "r_name")


_PAIRS = """WITH x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"""


@query(_PAIRS + " SELECT a.id AS i, b.id AS j, round(list_dot_product(a.e, b.e), 6) + 0.0 AS k FROM x a JOIN x b ON a.id <= b.id AND a.label = b.label")
def j17_all_pairs(t: Tables) -> DataFrame:
    from furrow.operators.kernels import pair_kernel

    return pair_kernel(t("embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", kind="dot", within="label", digits=6)


_PAIRED = """WITH m AS (SELECT o_orderpriority AS model, c_nationkey AS fold, avg(o_totalprice) AS r, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) """


def _metrics(t: Tables) -> DataFrame:
    joined = t("orders", "o_orderpriority", "o_custkey", "o_totalprice").join(t("customer", "c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("model"), F.col("c_nationkey").alias("fold")).agg(F.avg("o_totalprice").alias("r"), F.count("*").alias("n"))


@query(_PAIRED + "SELECT a.fold, round(a.r - b.r, 4) AS diff, a.n = b.n AS same_n FROM m a JOIN m b USING (fold) WHERE a.model = '1-URGENT' AND b.model = '5-LOW'")
def j18_paired_comparison(t: Tables) -> DataFrame:
    a = _metrics(t).where("model = '1-URGENT'").select("fold", F.col("r").alias("ra"), F.col("n").alias("na"))
    b = _metrics(t).where("model = '5-LOW'").select("fold", F.col("r").alias("rb"), F.col("n").alias("nb"))
    return a.join(b, "fold").select("fold", rounded(F.col("ra") - F.col("rb"), 4).alias("diff"), (F.col("na") == F.col("nb")).alias("same_n"))


@query(_PAIRED + "SELECT a.model AS t_model, b.model AS f_model, CAST(count(*) AS BIGINT) AS n, round(avg(a.r - b.r), 4) AS diff FROM m a JOIN m b USING (fold) WHERE a.model IN ('1-URGENT', '2-HIGH') AND b.model NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def j19_cross_model(t: Tables) -> DataFrame:
    ours = F.col("model").isin("1-URGENT", "2-HIGH")
    a = _metrics(t).where(ours).select("fold", F.col("model").alias("t_model"), F.col("r").alias("ra"))
    b = _metrics(t).where(~ours).select("fold", F.col("model").alias("f_model"), F.col("r").alias("rb"))
    return a.join(b, "fold").groupBy("t_model", "f_model").agg(F.count("*").alias("n"), rounded(F.avg(F.col("ra") - F.col("rb")), 4).alias("diff"))


@query("SELECT c_custkey, p FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 6) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def j20_scatter(t: Tables) -> DataFrame:
    predicted = t("orders", "o_custkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(rounded(F.max("o_totalprice")).alias("p"))
    return R.scatter(t("customer", "c_custkey"), predicted, "c_custkey")


@query("""SELECT user_id, round(avg(value), 6) AS v FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS a FROM events)
          WHERE a = 0 OR event_type = 'purchase' GROUP BY user_id""")
def j21_preferred_source(t: Tables) -> DataFrame:
    flagged = t("events", "user_id", "event_type", "value").withColumn("own", F.col("event_type") == "purchase")
    return R.prefer(flagged, ["user_id"], "own").groupBy("user_id").agg(rounded(F.avg("value")).alias("v"))


@query("SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN region ON c_nationkey = r_regionkey")
def j22_lookup_then_drop(t: Tables) -> DataFrame:
    df = t("orders", "o_orderkey", "o_custkey").join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return df.join(t("region"), F.col("c_nationkey") == F.col("r_regionkey"), "left").where(F.col("r_name").isNotNull()).select("o_orderkey", "r_name")


@query("SELECT event_type, user_id, event_id FROM events ORDER BY 1, 2, 3")
def t01_multi_key_sort(t: Tables) -> DataFrame:
    return t("events", "event_type", "user_id", "event_id").orderBy("event_type", "user_id", "event_id")


@query("SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def t02_byte_order_sort(t: Tables) -> DataFrame:
    return t("part", "p_name", "p_partkey").orderBy("p_name", "p_partkey")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 ORDER BY 2, 1 LIMIT 13")
def t03_least_populated(t: Tables) -> DataFrame:
    return t("customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy("n", "c_nationkey").limit(13)


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 20")
def t04_seeded_sample(t: Tables) -> DataFrame:
    from furrow.functions.exprs import hash_order

    return t("customer", "c_custkey").orderBy(hash_order(7, "c_custkey"), "c_custkey").limit(20)


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY md5('3|' || c_custkey), c_custkey) - 1) / 32) AS INTEGER) AS batch FROM customer")
def t06_batches(t: Tables) -> DataFrame:
    return TS.hash_ranked(t("customer", "c_custkey"), 3, "c_custkey").select("c_custkey", F.floor((F.col("rank") - 1) / 32).cast("int").alias("batch"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def u01_intersection(t: Tables) -> DataFrame:
    return t("orders", "o_custkey").withColumnRenamed("o_custkey", "k").intersect(t("events", "user_id").withColumnRenamed("user_id", "k"))


@query("SELECT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders) AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def u02_iterated_intersection(t: Tables) -> DataFrame:
    sets = [t("orders", "o_custkey"), t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")]
    out = t("events", "user_id")
    for s in sets:
        out = out.intersect(s)
    return out


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def u03_difference(t: Tables) -> DataFrame:
    return t("customer", "c_custkey").subtract(t("events", "user_id"))


@query("SELECT c_name AS name, c_acctbal AS bal, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_name, NULL, p_brand FROM part")
def u04_union_fill(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return c.unionByName(t("part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def u05_distinct(t: Tables) -> DataFrame:
    return t("lineitem", "l_returnflag", "l_linestatus").dropDuplicates()


@query("""SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS equal""")
def u06_set_equality(t: Tables) -> DataFrame:
    a, b = t("nation", "n_regionkey").withColumnRenamed("n_regionkey", "k"), t("region", "r_regionkey").withColumnRenamed("r_regionkey", "k")
    return a.subtract(b).unionByName(b.subtract(a)).agg((F.count("*") == 0).alias("equal"))


@query("""SELECT CAST(count(*) FILTER (a AND b) AS BIGINT) AS both, CAST(count(*) FILTER (a AND b IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS right_only,
          round(count(*) FILTER (a AND b) / count(*), 6) AS fraction
          FROM (SELECT DISTINCT c_custkey AS k, true AS a FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN (SELECT DISTINCT o_custkey AS k, true AS b FROM orders) USING (k)""")
def u07_overlap_fraction(t: Tables) -> DataFrame:
    a = t("customer", "c_custkey").where("c_custkey % 3 <> 0").distinct().select(F.col("c_custkey").alias("k"), F.lit(True).alias("a"))
    b = t("orders", "o_custkey").distinct().select(F.col("o_custkey").alias("k"), F.lit(True).alias("b"))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return a.join(b, "k", "full").agg(
        both.alias("both"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"),
        rounded(both / F.count(F.lit(1))).alias("fraction"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 AND value > 30")
def u08_filter_intersection(t: Tables) -> DataFrame:
    df = t("events", "event_id", "event_type", "user_id", "value")
    return df.where(F.col("event_type").isin("click", "view") & (F.col("user_id") % 2 == 0) & (F.col("value") > 30)).select("event_id")


@query("""SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click_mean, round(max(value) FILTER (event_type = 'click'), 6) AS click_max,
          round(avg(value) FILTER (event_type = 'view'), 6) AS view_mean, round(max(value) FILTER (event_type = 'view'), 6) AS view_max FROM events GROUP BY 1""")
def r01_pivot_wider(t: Tables) -> DataFrame:
    return t("events", "user_id", "event_type", "value").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(
        rounded(F.avg("value")).alias("mean"), rounded(F.max("value")).alias("max"))


@query("SELECT l_orderkey, l_linenumber, trait, v FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR trait IN (l_quantity, l_discount, l_tax))")
def r02_pivot_longer(t: Tables) -> DataFrame:
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "trait", "v")


@query("""SELECT u AS user_id, d AS day, v FROM (SELECT DISTINCT user_id AS u FROM events) CROSS JOIN range(30) r(d)
          LEFT JOIN (SELECT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, round(max(value), 6) AS v FROM events GROUP BY 1, 2) e ON e.user_id = u AND e.day = d""")
def r03_densify(t: Tables) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    daily = t("events", "user_id", "ts", "value").groupBy("user_id", day.alias("day")).agg(rounded(F.max("value")).alias("v"))
    return R.densify(daily, "user_id", "day", t.spark.range(30).withColumnRenamed("id", "day"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, range(1, 65) r(i) WHERE embedding[i] > 0")
def r04_array_to_tall(t: Tables) -> DataFrame:
    tall = t("embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return tall.where("v > 0").select("vec_id", "pos", rounded(F.col("v").cast("double")).alias("v"))


@query("""WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1), m AS (SELECT max(len(q)) AS n FROM l)
          SELECT l_orderkey, array_to_string(list_transform(range(1, n + 1), lambda i: CAST(CAST(CASE WHEN i <= len(q) THEN q[i] ELSE 0 END AS INTEGER) AS VARCHAR)), ',') AS padded, CAST(len(q) AS INTEGER) AS kept FROM l, m""")
def r05_pad_and_mask(t: Tables) -> DataFrame:
    out = R.pad(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber", "l_quantity")
    return out.select("l_orderkey", F.array_join(F.transform("padded", lambda x: x.cast("int").cast("string")), ",").alias("padded"), F.size(F.filter("mask", lambda m: m)).alias("kept"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS f, CAST(o_orderstatus = 'O' AS INTEGER) AS o, CAST(o_orderstatus = 'P' AS INTEGER) AS p FROM orders")
def r06_one_hot(t: Tables) -> DataFrame:
    hot = t("orders", "o_orderkey", "o_orderstatus").select("o_orderkey", R.one_hot("o_orderstatus", ["F", "O", "P"]).alias("h"))
    return hot.select("o_orderkey", F.get("h", F.lit(0)).alias("f"), F.get("h", F.lit(1)).alias("o"), F.get("h", F.lit(2)).alias("p"))


@query("""WITH k AS (SELECT a.r_regionkey AS i, b.r_regionkey AS j, a.r_regionkey * 10.0 + b.r_regionkey AS k FROM region a, region b)
          SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(k AS DOUBLE) AS k FROM nation a JOIN k ON a.n_regionkey = k.i JOIN nation b ON b.n_regionkey = k.j""")
def r07_design_expansion(t: Tables) -> DataFrame:
    from furrow.operators.kernels import expand_kernel

    r = t("region", "r_regionkey")
    pairs = r.select(F.col("r_regionkey").alias("i")).join(F.broadcast(r.select(F.col("r_regionkey").alias("j"))), F.lit(True))
    kernel = pairs.withColumn("k", F.col("i") * 10.0 + F.col("j"))
    return expand_kernel(kernel, t("nation", "n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'fit' ELSE 'rest' END AS block, CAST(row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_orderkey) AS INTEGER) AS pos FROM orders")
def r08_interleave_blocks(t: Tables) -> DataFrame:
    flagged = t("orders", "o_orderkey", "o_orderstatus").withColumn("block", F.when(F.col("o_orderstatus") == "F", "fit").otherwise("rest"))
    return flagged.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy("o_orderkey"))).select("o_orderkey", "block", "pos")


@query("""WITH b AS (SELECT event_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS dap, value AS agdd FROM events)
          SELECT event_id, 'dap' AS axis, dap AS at FROM b UNION ALL SELECT event_id, 'agdd', agdd FROM b""")
def r09_two_axes(t: Tables) -> DataFrame:
    dap = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    return t("events", "event_id", "ts", "value").select("event_id", dap.alias("dap"), F.col("value").alias("agdd")).unpivot(["event_id"], ["dap", "agdd"], "axis", "at")
