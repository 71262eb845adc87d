"""Queries of scalar functions: text, dates, arithmetic, arrays, JSON, hashes, transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.functions.exprs import rounded
from furrow.plans.registry import Tables, query


def part_pedigree(t: Tables) -> DataFrame:
    return t("part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.concat(F.lit(" "), "p_brand", F.lit("/"), "p_type").alias("pedigree"))


_PED = "(SELECT p_partkey, ' ' || p_brand || '/' || p_type AS pedigree FROM part)"


@query(f"SELECT p_partkey, lower(trim(split_part(pedigree, '/', 1))) AS female FROM {_PED}")
def m01_maternal_id(t: Tables) -> DataFrame:
    return part_pedigree(t).select("p_partkey", X.maternal_id("pedigree").alias("female"))


@query(f"SELECT p_partkey, regexp_extract(pedigree, '^([^/]+)/([^/]+)', 1) AS p1, regexp_extract(pedigree, '^([^/]+)/([^/]+)', 2) AS p2, nullif(regexp_extract(pedigree, '#([0-9]{{3}})', 1), '') AS three FROM {_PED}")
def m02_regex_capture(t: Tables) -> DataFrame:
    pattern = "^([^/]+)/([^/]+)"
    return part_pedigree(t).select(
        "p_partkey", F.regexp_extract("pedigree", pattern, 1).alias("p1"), F.regexp_extract("pedigree", pattern, 2).alias("p2"),
        F.nullif(F.regexp_extract("pedigree", "#([0-9]{3})", 1), F.lit("")).alias("three"))


@query("SELECT p_partkey, split_part(k, '.', 1) AS a, nullif(split_part(k, '.', 2), '') AS b FROM (SELECT p_partkey, p_brand || CASE WHEN p_size > 10 THEN '.' || p_size ELSE '' END AS k FROM part)")
def m03_delimiter_split(t: Tables) -> DataFrame:
    k = F.concat("p_brand", F.when(F.col("p_size") > 10, F.concat(F.lit("."), F.col("p_size").cast("string"))).otherwise(""))
    parts = F.split(k, r"\.")
    return t("part", "p_partkey", "p_brand", "p_size").select("p_partkey", F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"))


@query("SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_replace(p_type, '[A-Z]', '*') AS first_only FROM part")
def m04_replace(t: Tables) -> DataFrame:
    first = F.regexp_replace("p_type", "^([^A-Z]*)[A-Z]", "$1*")
    return t("part", "p_partkey", "p_type").select("p_partkey", F.regexp_replace("p_type", "[^A-Za-z0-9._-]", "_").alias("safe"), first.alias("first_only"))


@query("SELECT n_nationkey, 'Seed' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS tag FROM nation")
def m05_zero_padding(t: Tables) -> DataFrame:
    return t("nation", "n_nationkey").select("n_nationkey", F.format_string("Seed%02d", "n_nationkey").alias("tag"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day FROM events""")
def m06_multi_format_dates(t: Tables) -> DataFrame:
    third = F.col("event_id") % 3
    text = F.when(third == 0, F.date_format("ts", "yyyy-MM-dd")).when(third == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise("not a date")
    parsed = X.first_parsed(text, ["yyyy-MM-dd", "MM/dd/yyyy"])
    return t("events", "event_id", "ts").select("event_id", F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-31 17:00:00')) / 86400000000.0, 6) AS dap FROM events")
def m07_fractional_days(t: Tables) -> DataFrame:
    return t("events", "event_id", "ts").select("event_id", rounded(X.days_between("ts", F.lit("2023-12-31 17:00:00").cast("timestamp"))).alias("dap"))


@query("SELECT event_id, CAST(ts AS DATE) + CAST(user_id % 30 AS INTEGER) AS later FROM events")
def m08_date_plus_days(t: Tables) -> DataFrame:
    return t("events", "event_id", "ts", "user_id").select("event_id", F.date_add(F.col("ts").cast("date"), (F.col("user_id") % 30).cast("int")).alias("later"))


@query("SELECT event_id, round((value - 32) * 5 / 9, 6) + 0.0 AS celsius, round(value * 0.0673, 6) AS t_ha, round(CASE WHEN user_id % 2 = 0 THEN (value + user_id) / 2 ELSE value END, 6) AS middle FROM events")
def m09_unit_conversion(t: Tables) -> DataFrame:
    both = F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("double"))
    middle = (F.col("value") + F.coalesce(both, F.lit(0.0))) / (1 + both.isNotNull().cast("int"))
    return t("events", "event_id", "value", "user_id").select(
        "event_id", rounded((F.col("value") - 32) * 5 / 9).alias("celsius"), rounded(F.col("value") * 0.0673).alias("t_ha"), rounded(middle).alias("middle"))


@query("SELECT event_id, round(value / nullif(user_id % 5, 0), 6) AS ptr, round(value * (user_id % 5), 6) AS ptt FROM events")
def m10_ratio_features(t: Tables) -> DataFrame:
    g = F.col("user_id") % 5
    return t("events", "event_id", "value", "user_id").select("event_id", rounded(F.try_divide("value", g)).alias("ptr"), rounded(F.col("value") * g).alias("ptt"))


@query("SELECT event_id, round(greatest((least(value, 86) + least(value / 2, 86)) / 2 - 10, 0), 6) AS gdd FROM events")
def m11_growing_degrees(t: Tables) -> DataFrame:
    return t("events", "event_id", "value").select("event_id", rounded(X.growing_degrees("value", F.col("value") / 2, 86.0, 10.0)).alias("gdd"))


@query("SELECT p_partkey, round(sqrt(p_size * p_retailprice), 6) AS gsd FROM part")
def m12_geometric_mean(t: Tables) -> DataFrame:
    return t("part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", rounded(F.sqrt(F.col("p_size") * F.col("p_retailprice"))).alias("gsd"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 4, 1) AS half_up, round_even(l_quantity / 4, 1) AS half_even FROM lineitem")
def m13_rounding(t: Tables) -> DataFrame:
    q = F.col("l_quantity") / 4
    return t("lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", F.round(q, 1).alias("half_up"), F.bround(q, 1).alias("half_even"))


@query("SELECT o_orderkey, o_custkey - o_orderkey AS asi, abs(o_custkey - o_orderkey) AS asi_abs FROM orders")
def m14_intervals(t: Tables) -> DataFrame:
    d = F.col("o_custkey") - F.col("o_orderkey")
    return t("orders", "o_orderkey", "o_custkey").select("o_orderkey", d.alias("asi"), F.abs(d).alias("asi_abs"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS label FROM orders")
def m15_recode(t: Tables) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in {"F": "final", "O": "open", "P": "pending"}.items() for x in pair])
    found = F.try_element_at(labels, F.col("o_orderstatus"))
    known = F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown status "), "o_orderstatus")).cast("string")).otherwise(found)
    return t("orders", "o_orderkey", "o_orderstatus").select("o_orderkey", known.alias("label"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS flag FROM events")
def m16_flags(t: Tables) -> DataFrame:
    token = F.element_at(F.array(F.lit(" yes "), F.lit("T"), F.lit("0"), F.lit("maybe")), (F.col("event_id") % 4 + 1).cast("int"))
    return t("events", "event_id").select("event_id", X.parse_flag(token).alias("flag"))


@query("SELECT p_partkey, lower(p_name) AS p_name, p_brand, lower(p_type) AS p_type FROM part")
def m17_lower_case(t: Tables) -> DataFrame:
    df = t("part", "p_partkey", "p_name", "p_brand", "p_type")
    lowered = [c for c, kind in df.dtypes if kind == "string" and c != "p_brand"]
    return df.withColumns({c: F.lower(c) for c in lowered})


_KEY = "'KEY|' || o_custkey || '|' || o_orderkey"


@query(f"SELECT o_orderkey, list_reduce(list_prepend(104729::BIGINT, list_transform(string_split({_KEY}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (h * 31 + b) % 2147483646) + 1 AS seed FROM orders")
def m19_rolling_hash(t: Tables) -> DataFrame:
    key = F.concat_ws("|", F.lit("KEY"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return t("orders", "o_orderkey", "o_custkey").select("o_orderkey", X.rolling_hash(key).alias("seed"))


@query("SELECT n_name, 42 + CAST(list_sum(list_transform(string_split(n_name, ''), lambda c: ascii(c))) AS BIGINT) AS seed FROM nation")
def m20_char_sum_seed(t: Tables) -> DataFrame:
    total = F.aggregate(F.split("n_name", ""), F.lit(42).cast("long"), lambda s, c: s + F.ascii(c))
    return t("nation", "n_name").select("n_name", total.alias("seed"))


@query("""WITH l AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_quantity) AS q FROM lineitem GROUP BY 1)
          SELECT l_orderkey, q[1] AS least, q[len(q)] AS most, CAST(list_sum(list_transform(q, lambda x: x * x)) AS BIGINT) AS squares, CAST(len(list_concat(q, [0, 0])) AS INTEGER) AS longer FROM l""")
def m21_array_operations(t: Tables) -> DataFrame:
    lists = t("lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("q"))
    return lists.select(
        "l_orderkey", F.element_at("q", 1).alias("least"), F.element_at("q", -1).alias("most"),
        F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("squares"), F.size(F.concat("q", F.array_repeat(F.lit(0), 2))).alias("longer"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def m22_json_fields(t: Tables) -> DataFrame:
    return t("events", "event_id", "props").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT p_partkey, CAST(regexp_extract(m, '^S([0-9]+)_([0-9]+)$', 1) AS INTEGER) AS chr, CAST(regexp_extract(m, '^S([0-9]+)_([0-9]+)$', 2) AS BIGINT) AS bp FROM (SELECT p_partkey, 'S' || p_size || '_' || p_partkey * 100 AS m FROM part)")
def m23_marker_position(t: Tables) -> DataFrame:
    marker = F.concat(F.lit("S"), F.col("p_size").cast("string"), F.lit("_"), (F.col("p_partkey") * 100).cast("string"))
    pattern = "^S([0-9]+)_([0-9]+)$"
    return t("part", "p_partkey", "p_size").select("p_partkey", F.regexp_extract(marker, pattern, 1).cast("int").alias("chr"), F.regexp_extract(marker, pattern, 2).cast("long").alias("bp"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'unset') AS segment FROM customer")
def m24_null_coalesce(t: Tables) -> DataFrame:
    return t("customer", "c_custkey", "c_mktsegment").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("unset")).alias("segment"))


@query("""SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus, round(exp(least(x, 5)), 4) AS e, round((exp(2 * x) - 1) / (exp(2 * x) + 1), 6) AS tanh,
          greatest(x, 0) AS relu, abs(x) AS a, greatest(least(x, 1), -1) AS clamped, round((x + 3) * 0.5, 6) AS chained FROM (SELECT event_id, round((value - 50) / 10, 3) + 0.0 AS x FROM events)""")
def m26_parameter_transforms(t: Tables) -> DataFrame:
    x = F.col("x")
    return t("events", "event_id", "value").select("event_id", rounded((F.col("value") - 50) / 10, 3).alias("x")).select(
        "event_id", rounded(1 / (1 + F.exp(-x))).alias("sigmoid"), rounded(X.softplus(x)).alias("softplus"), rounded(F.exp(F.least(x, F.lit(5.0))), 4).alias("e"), rounded(F.tanh(x)).alias("tanh"),
        F.greatest(x, F.lit(0.0)).alias("relu"), F.abs(x).alias("a"), F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)).alias("clamped"), rounded((x + 3) * 0.5).alias("chained"))


@query("SELECT event_id, round(-0.5 * ln(2 * pi()) - ln(12.5) - 0.5 * pow((value - 40) / 12.5, 2), 6) AS lp FROM events")
def m27_normal_log_density(t: Tables) -> DataFrame:
    return t("events", "event_id", "value").select("event_id", rounded(X.normal_log_density("value", F.lit(40.0), F.lit(12.5))).alias("lp"))


@query("""SELECT o_orderkey, 'run' || CASE WHEN o_orderstatus <> 'O' THEN '_' || CASE o_orderstatus WHEN 'F' THEN 'final' ELSE o_orderstatus END ELSE '' END
          || CASE WHEN o_orderpriority <> '3-MEDIUM' THEN '_' || o_orderpriority ELSE '' END AS tag FROM orders""")
def m28_conditional_tags(t: Tables) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    label = F.coalesce(F.try_element_at(F.create_map(F.lit("F"), F.lit("final")), s), s)
    tag = F.concat(F.lit("run"), F.when(s != "O", F.concat(F.lit("_"), label)).otherwise(""), F.when(p != "3-MEDIUM", F.concat(F.lit("_"), p)).otherwise(""))
    return t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", tag.alias("tag"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'best' WHEN starts_with(p_type, 'S') THEN 'small' WHEN starts_with(p_type, 'PROMO') THEN 'last' ELSE 'other' END AS kind, substring(p_type, 1, 3) AS metric FROM part")
def m29_prefix_classes(t: Tables) -> DataFrame:
    p = F.col("p_type")
    kind = F.when(p.startswith("STANDARD"), "best").when(p.startswith("S"), "small").when(p.startswith("PROMO"), "last").otherwise("other")
    return t("part", "p_partkey", "p_type").select("p_partkey", kind.alias("kind"), F.substring("p_type", 1, 3).alias("metric"))


@query("""SELECT event_id, round(value, 6) AS loc, round(greatest(x, 0) + ln(1 + exp(-abs(x))) + 0.01, 6) AS hetero, round(exp(-0.5) + 0.01, 6) AS homo FROM (SELECT event_id, value, (user_id % 20 - 10) / 4.0 AS x FROM events)""")
def m30_distribution_heads(t: Tables) -> DataFrame:
    x = (F.col("user_id") % 20 - 10) / 4.0
    return t("events", "event_id", "value", "user_id").select(
        "event_id", rounded("value").alias("loc"), rounded(X.softplus(x) + 0.01).alias("hetero"), rounded(F.exp(F.lit(-0.5)) + 0.01).alias("homo"))
