"""Edge cases and invariants of the operators on tiny frames."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import exprs as X
from furrow.operators import blocks, curves, kernels, models, relational, scoring, splits, timeseries
from furrow.operators import registry
from furrow.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_guarded_correlation(spark):
    rows = [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", None, 9.0), ("line", 3.0, 6.0), ("null", None, None)]
    got = {r["g"]: r["r"] for r in frame(spark, rows, "g string, x double, y double").groupBy("g").agg(X.correlation("x", "y").alias("r")).collect()}
    assert got["one"] is None and got["flat"] is None and got["null"] is None and got["line"] == pytest.approx(1)


def test_correlation_status(spark):
    nan = float("nan")
    rows = [("ok", 1.0, 1.0), ("ok", 2.0, 1.5), ("ok", 3.0, 5.0), ("few", 1.0, 1.0), ("nan", 1.0, nan), ("nan", 2.0, 1.0), ("nan", 3.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    got = {r["g"]: (r["status"], r["cor"]) for r in scoring.correlation_with_status(frame(spark, rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got["ok"][0] == "ok" and got["few"] == ("insufficient", None) and got["nan"] == ("missing", None) and got["flat"] == ("zero variance", None)


def test_ranks_of_a_group_come_from_intervals(spark):
    rng = np.random.default_rng(14)
    groups = {
        "wide": (rng.lognormal(0, 9, 3000), rng.normal(1e9, 1, 3000)), "ties": (rng.integers(0, 40, 2000) * 1.0, rng.integers(0, 5, 2000) * 1.0),
        "heavy": (np.where(rng.random(2500) < 0.8, 7.0, rng.normal(7, 1, 2500)), np.where(rng.random(2500) < 0.7, -1.0, rng.normal(0, 1, 2500))),
        "nan": (np.array([1.0, math.nan, math.nan, -math.inf, 0.0, -0.0]), np.array([3.0, 1.0, 2.0, 5.0, 4.0, 4.0])), None: (np.arange(50.0), np.arange(50.0) ** 2),
        "flat": (np.full(900, 7.0), rng.normal(0, 1, 900)), "flat too": (rng.normal(0, 1, 300), np.full(300, 0.123)), "one": (np.array([7.0]), np.array([1.0])),
    }
    rows = [(g, float(a), float(b), i) for g, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y))]
    df = frame(spark, rows + [("heavy", None, 1.0, -1), ("heavy", 1.0, None, -2)], "g string, x double, y double, id long")

    def average(v):
        _, at, n = np.unique(v + 0.0, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2.0)[at]

    got = {r["g"]: r["rho"] for r in scoring.spearman(df, ["g"], "x", "y").collect()}
    assert got.keys() == groups.keys() and got["flat"] is None and got["flat too"] is None and got["one"] is None
    for g in ("wide", "ties", "heavy", "nan", None):
        assert got[g] == pytest.approx(np.corrcoef(average(groups[g][0]), average(groups[g][1]))[0, 1], abs=1e-12)
    ordinal = {r["g"]: r["rho"] for r in scoring.spearman_ordinal(df.where("id >= 0"), ["g"], "x", "y", "id").collect()}
    assert ordinal["one"] == 0 and ordinal.keys() == groups.keys()
    for g in groups.keys() - {"one"}:
        x, y = (np.argsort(np.argsort(v, kind="stable"), kind="stable") for v in groups[g])
        assert ordinal[g] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


def windows_of_ranks(df):
    return re.findall(r"Window \[(?:rank|row_number)\(.*?\], \[(.*?)\], \[", df._jdf.queryExecution().executedPlan().toString())


def test_no_rank_is_made_over_a_whole_group(spark):
    df = spark.range(5000).selectExpr("id % 1 AS g", "id * 7919 % 5003 AS x", "id * 31 % 977 AS y", "id")
    made = windows_of_ranks(scoring.spearman(df, ["g"], "x", "y"))
    assert len(made) == 2 and all("," in columns for columns in made)
    made = windows_of_ranks(scoring.spearman_ordinal(df, ["g"], "x", "y", "id"))
    assert len(made) == 2 and all("," in columns for columns in made)


def test_heavy_values_have_an_interval_of_their_own(spark):
    bounds = spark.range(1).selectExpr("named_struct('x', array(" + ", ".join(["5.0D"] * 50 + [f"{k}.0D" for k in range(6, 19)]) + ")) AS b").scalar()
    heavy = spark.range(0, 4000, 1, 4).selectExpr("'all' AS g", "IF(id % 10 > 0, 5.0D, id / 200.0D) AS x")
    got = scoring.ranked_by_interval(heavy, ["g"], ["x"], bounds, "i", "r", True).groupBy("i").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()
    assert {r["i"]: r["r"] for r in got}[1] == 0 and max(r["n"] for r in got if r["i"] != 1) <= 101


def test_pooled_correlations_differ_at_one(spark):
    df = frame(spark, [(1.0, 5), (0.5, 10), (0.2, 2), (None, 9)], "r double, n int")
    a, b, k = df.agg(X.pooled_correlation("r", "n"), X.pooled_correlation_strict("r", "n"), X.blocks_used("r", "n")).first()
    assert a == pytest.approx(1) and b == pytest.approx(0.5) and k == 1


def test_moments_add_up_to_the_statistics(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], i % 3, float(1e8 + rng.normal(50, 9)), float(1e8 + rng.normal(40, 5))) for i in range(90)] + [("c", 0, 1.0, 2.0), ("c", 1, 1.0, 3.0), ("c", 1, None, 3.0)]
    df = frame(spark, rows, "g string, b int, a double, p double")
    fine = df.groupBy("g", "b").agg(*scoring.moments("a", "p"))
    got = {r["g"]: (r["n"], r["r"], r["e"]) for r in scoring.added_up(fine, "g").select("g", *scoring.from_moments()).collect()}
    for g in "ab":
        x = np.array([r[2:] for r in rows if r[0] == g])
        assert got[g] == pytest.approx((45, np.corrcoef(x.T)[0, 1], np.sqrt(((x[:, 0] - x[:, 1]) ** 2).mean())))
    assert got["c"][0] == 2 and got["c"][1] is None


def test_mode_takes_the_least_of_equals(spark):
    df = frame(spark, [("a", 2.0), ("a", 1.0), ("a", 2.0), ("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    assert [(r["g"], r["mode"]) for r in scoring.mode(df, ["g"], "v").collect()] == [("a", 1.0)]


def test_fill_and_interpolate(spark):
    rows = [("a", t, v) for t, v in enumerate([None, 1.0, None, None, 4.0, None])] + [("b", 0, None)]
    df = frame(spark, rows, "g string, t int, v double")
    filled = {(r["g"], r["t"]): r["f"] for r in timeseries.fill_both_ways(df, ["g"], ["t"], "v", "f").collect()}
    assert [filled["a", t] for t in range(6)] == [1, 1, 1, 1, 4, 4] and filled["b", 0] is None
    lined = {(r["g"], r["t"]): r["f"] for r in timeseries.interpolate(df, ["g"], "t", "v", "f").collect()}
    assert [lined["a", t] for t in range(6)] == pytest.approx([1, 1, 2, 3, 4, 4]) and lined["b", 0] is None


def test_running_sum_stays_null_after_a_null(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0)], "g string, t int, v double")
    assert [r["s"] for r in timeseries.running_sum(df, ["g"], ["t"], "v", "s").orderBy("t").collect()] == [1, None, None]
    assert [r["s"] for r in timeseries.running_sum(df, ["g"], ["t"], "v", "s", propagate_null=False).orderBy("t").collect()] == [1, 1, 3]


def test_hampel_spares_edges_and_short_series(spark):
    rows = [("long", t, 100.0 if t in (0, 9) else float(t % 2)) for t in range(20)] + [("short", t, 100.0 if t == 2 else 0.0) for t in range(5)]
    got = {(r["g"], r["t"]): r["o"] for r in timeseries.hampel(frame(spark, rows, "g string, t int, v double"), ["g"], ["t"], "v", 6, 1.0, "o").collect()}
    assert got["long", 9] is None and got["long", 0] == 100 and got["short", 2] == 100


def test_as_of_is_exact_blended_and_clamped(spark):
    grid = frame(spark, [("a", 10, 1.0), ("a", 20, 3.0)], "g string, t int, v double")
    targets = frame(spark, [("a", t) for t in (5, 10, 15, 20, 30)], "g string, t int")
    assert [r["v"] for r in timeseries.as_of(grid, targets, ["g"], "t", "v").orderBy("t").collect()] == [1, 1, 2, 3, 3]


@pytest.mark.parametrize(("n", "sizes"), [(8, [2, 2, 2, 2]), (21, [5, 5, 5, 5, 1])])
def test_unbalanced_folds(spark, n, sizes):
    got = timeseries.folds(spark.range(n), 5, 1, "id").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == sizes


def test_ranks_by_prefix_are_ranks_by_hash(spark):
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    got = {r["id"]: (r["rank"], r["n"]) for r in timeseries.hash_ranked(spark.range(500), 3, "id").collect()}
    assert got == {i: (k + 1, 500) for k, i in enumerate(order)}
    roles = splits.scheme_random(spark.range(500), "id", 7, 3, 2).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in roles} == {"PREDICT": 72, "FIT": 428}


def test_presence_everywhere(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 1), (None, 3), ("a", 3)], "e string, p int")
    assert [r["e"] for r in relational.present_everywhere(df, "e", "p").collect()] == ["a"]


def test_checked_joins_raise(spark):
    left, right = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        relational.lookup(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="predicted twice"):
        relational.scatter(left, right.unionAll(right), "k").collect()
    with pytest.raises(Exception, match="no rows matched"):
        relational.update_where(left, F.col("k") > 5, "k", F.lit(1)).collect()
    with pytest.raises(Exception, match="unseen value z"):
        frame(spark, [("z",)], "v string").select(relational.one_hot("v", ["a"])).collect()


def test_overlaps_by_bins_are_those_of_a_theta_join(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(rng.uniform(0, 100, 60), rng.uniform(0, 20, 60), strict=True))]
    b = [(i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(rng.uniform(0, 100, 40), rng.uniform(0, 30, 40), strict=True))]
    got = relational.overlapping(frame(spark, a, "i int, s double, e double"), frame(spark, b, "j int, lo double, hi double"), "s", "e", "lo", "hi", 7.0)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, s, e in a for j, lo, hi in b if s <= hi and e >= lo)


def test_keys_and_parsing(spark):
    df = frame(spark, [("A/B ", "x"), (" a", None), ("", "z"), (None, "q")], "p string, k string")
    assert [r[0] for r in df.select(X.maternal_id("p")).collect()] == ["a", "a", "", None]
    assert [r[0] for r in df.select(X.composite_key("p", "k")).collect()] == ["A/B .x", " a.NA", ".z", "NA.q"]
    times = frame(spark, [("2020-05-01",), ("05/02/2020",), ("nonsense",)], "d string").select(X.first_parsed("d", ["yyyy-MM-dd", "MM/dd/yyyy"]).alias("t")).collect()
    assert [t["t"] and t["t"].day for t in times] == [1, 2, None]
    key = 104729
    for c in "KEY|1|2":
        key = (key * 31 + ord(c)) % 2147483646
    assert frame(spark, [("KEY|1|2",)], "k string").select(X.rolling_hash("k")).first()[0] == key + 1


def test_monomorphic_loci_count_for_nothing(spark):
    d = [[0, 2, 1], [0, 1, 2], [0, 2, 0]]
    df = frame(spark, list(enumerate(d)), "id int, d array<int>")
    x = np.array(d, float)
    p = x.mean(0) / 2
    z = x - 2 * p
    want = z @ z.T / (2 * p * (1 - p)).sum()
    for r in kernels.relationship(df, "id", "d").collect():
        assert r["k"] == pytest.approx(want[r["i"], r["j"]])
    flat = frame(spark, [(0, [0, 2]), (1, [0, 2])], "id int, d array<int>")
    assert {r["k"] for r in kernels.relationship(flat, "id", "d").collect()} == {0.0}


def test_wide_genotypes_are_cut_into_blocks(spark):
    rows = [(i, [(i + k) % 3 for k in range(4)]) for i in range(600)] + [(7, [2, 2, 2, 2]), (600, [1]), (601, []), (602, None), (603, [None, 1, 0, 2])]
    df = frame(spark, rows, "id int, d array<int>").repartition(2)
    wide = kernels.wide_genotypes(df, F.concat(F.lit("taxon"), "id"), "d").persist()
    assert wide.columns == ["block", "taxa", "locus", "dosages"] and wide.select(F.max(F.size("taxa"))).first()[0] <= kernels.TAXA
    got = Counter((r["locus"], r["taxon"], r["dosage"]) for r in kernels.long_genotypes(wide).collect())
    assert got == Counter((k, f"taxon{i}", v) for i, d in rows for k, v in enumerate(d or []))


def test_near_identical_leaves_the_border_out(spark):
    base = [0] * 20
    rows = [(0, base), (1, base), (2, [1] + base[1:]), (3, [2] * 20)]
    assert {r["id"] for r in kernels.near_identical(frame(spark, rows, "id int, d array<int>"), "id", "d", above=0.95).collect()} == {0, 1}


def test_kernels_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(12, 5))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id int, x array<double>")
    full = kernels.symmetric(kernels.pair_kernel(df, "id", "x"))
    k = x @ x.T / 5
    c = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    for r in kernels.centered(full).collect():
        assert r["k"] == pytest.approx(c[r["i"], r["j"]])
    values, vectors = models.eigen(df, "x", 5)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(x @ x.T))[::-1][:5])
    z = np.array([r["z"] for r in models.eigen_projection(df, "x", "id", 5).orderBy("id").collect()])
    assert z @ z.T == pytest.approx(k)


def test_kernels_by_blocks(spark):
    rng = np.random.default_rng(5)
    x, d = rng.normal(size=(41, 4)), rng.integers(0, 3, (41, 6))
    names = [f"v{i:02d}" for i in range(41)]
    df = frame(spark, [(n, a.tolist(), b.tolist(), i % 2) for i, (n, a, b) in enumerate(zip(names, x, d))], "id string, x array<double>, d array<int>, g int")
    squares = ((x[:, None] - x[None]) ** 2).sum(-1)
    same = (d[:, None] == d[None]).mean(-1)
    for factors, want in [
        ([("x", "dot", None)], x @ x.T), ([("x", "linear", None)], x @ x.T / 4), ([("x", "rbf", None)], np.exp(-squares / 4)),
        ([("x", "laplace", 0.5)], np.exp(-0.5 * np.abs(x[:, None] - x[None]).sum(-1))), ([("d", "match", None)], same),
        ([("x", "rbf", 0.3), ("d", "match", None), ("x", "dot", None)], np.exp(-0.3 * squares) * same * (x @ x.T)),
    ]:
        got = {(r["i"], r["j"]): r["k"] for r in blocks.kernel(df, "id", factors).collect()}
        assert len(got) == 41 * 42 // 2
        assert all(got[names[i], names[j]] == pytest.approx(want[i, j]) for i in range(41) for j in range(i, 41))
    got = blocks.kernel(df, "id", [("d", "match", None)], within="g", above=0.4).collect()
    assert {(r["i"], r["j"]) for r in got} == {(names[i], names[j]) for i in range(41) for j in range(i, 41, 2) if same[i, j] > 0.4}
    k = np.exp(-squares / 4)
    got = blocks.kernel(df, "id", [("x", "rbf", None)], centred=True).collect()
    want = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    assert len(got) == 41 * 41 and all(r["k"] == pytest.approx(want[names.index(r["i"]), names.index(r["j"])]) for r in got)
    # New rows against the 30 first, plain and centred with the means of these.
    first, c = k[:30, :30], k[30:, :30]
    for centred, want in [(False, c), (True, c - c.mean(1)[:, None] - first.mean(0) + first.mean())]:
        got = blocks.cross_kernel(df.where("id >= 'v30'"), df.where("id < 'v30'"), "id", [("x", "rbf", None)], centred=centred).collect()
        assert len(got) == 11 * 30 and all(r["k"] == pytest.approx(want[names.index(r["i"]) - 30, names.index(r["j"])]) for r in got)


def test_kernels_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [float("nan"), 1.0])]
    df = frame(spark, rows, "id int, x array<double>")
    got = Counter((r["i"], r["j"], str(r["k"])) for r in blocks.kernel(df, "id", [("x", "dot", None)]).collect())
    assert got[1, 1, "5.0"] == 4 and got[1, 2, "None"] == 2 and got[3, 3, "None"] == got[4, 4, "None"] == got[5, 5, "nan"] == 1
    assert sum(got.values()) == 4 + 2 * 4 + 10
    assert blocks.kernel(df.where("false"), "id", [("x", "dot", None)]).count() == 0
    assert blocks.kernel(df.where("id = 2"), "id", [("x", "rbf", None)], centred=True).where("k IS NULL").count() == 1



def test_rows_are_sent_to_the_blocks_of_their_own_group(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 10)
    x = np.random.default_rng(4).normal(size=(200, 3)).astype(np.float32)
    df = frame(spark, [(i, v.tolist(), i % 10) for i, v in enumerate(x)], "id int, x array<float>, g int")
    met, _, _ = blocks._paired(df, "id", [("x", "dot", None)], [], "g", None)
    assert met.count() == 200 * 2 and dict(met.dtypes)["_x0"] == "array<float>"
    got = {(r["i"], r["j"]): r["k"] for r in blocks.kernel(df, "id", [("x", "dot", None)], within="g", digits=3).collect()}
    assert set(got) == {(i, j) for i in range(200) for j in range(i, 200, 10)}
    k = x.astype(float) @ x.T.astype(float)
    assert all(abs(v - k[i, j]) < 0.000501 and v == round(v, 3) for (i, j), v in got.items())


def test_rounding_is_half_away_from_zero():
    assert blocks._rounded(np.array([0.125, -0.125, 2.5]), 2).tolist() == [0.13, -0.13, 2.5]
    assert np.signbit(blocks._rounded(np.array([-0.001]), 2)).tolist() == [False]


def test_one_centred_dot_product_is_made_once(spark):
    x = np.random.default_rng(9).normal(size=(30, 4)) + 5
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(30, None), (31, [1.0, None, 2.0, 3.0]), (32, [1.0])], "id int, x array<double>")
    found = blocks.kernel(df, "id", [("x", "linear", None)], centred=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1
    k = x @ x.T / 4
    want = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    got = {(r["i"], r["j"]): r["k"] for r in found.collect()}
    assert len(got) == 33 * 33 and all(got[i, j] == pytest.approx(want[i, j]) for i in range(30) for j in range(30))
    assert all((got[i, j] is None) == (i >= 30 or j >= 30) for i, j in got)


def bytes_of_a_row(df, path):
    import pyarrow.parquet as pq

    df.write.parquet(str(path))
    groups = [f.row_group(g) for f in (pq.ParquetFile(p).metadata for p in path.glob("*.parquet")) for g in range(f.num_row_groups)]
    n = sum(g.num_rows for g in groups)
    return n, {g.path_in_schema: sum(h.column(c).total_compressed_size for h in groups) / n for c, g in enumerate(groups[0].column(c) for c in range(3))}


def test_ids_and_mirrored_values_take_few_bytes_in_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 3)
    x = np.random.default_rng(21).normal(size=(3000, 8))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    n, width = bytes_of_a_row(blocks.kernel(df, "id", [("x", "linear", None)], digits=3), tmp_path / "half")
    assert n == 3000 * 3001 // 2 and width["i"] + width["j"] < 0.25
    n, width = bytes_of_a_row(blocks.kernel(df, "id", [("x", "linear", None)], centred=True, digits=4), tmp_path / "both")
    assert n == 3000 * 3000 and width["i"] + width["j"] < 0.25 and width["k"] < 1.5


def test_values_too_many_for_a_dictionary_take_fewer_bytes_in_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 2)
    x = np.random.default_rng(23).normal(size=(3000, 64)) / 8
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    n, width = bytes_of_a_row(blocks.kernel(df, "id", [("x", "dot", None)], digits=6), tmp_path / "k")
    assert n == 3000 * 3001 // 2 and sum(width.values()) < 7.5


@pytest.mark.parametrize("shape", [(23, 31), (4, 6), (1, 1)])
def test_pairs_leave_a_block_whole_in_any_order(monkeypatch, shape):
    for name, value in {"STRIP": 60, "CYCLE": 5, "PIECE": (2, 3), "SORTED": 100}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(22)
    n, m = shape
    k = rng.normal(size=shape)
    a, b, known = rng.permutation(n), rng.permutation(m) + n, rng.random(shape) < 0.9
    odd = np.where(rng.random(shape) < 0.3, rng.choice([0.0, -0.0, math.nan, math.inf, -math.inf, 1e18, 0.125], shape), k)
    cells = lambda parts: Counter((int(i), int(j), str(v + 0.0), bool(w)) for p in parts for i, j, v, w in zip(p[0], p[1], p[2], np.ones(len(p[2]), bool) if p[3] is None else p[3], strict=True))
    want = lambda v, w, keep: Counter((int(a[p]), int(b[q]), str(v[p, q] + 0.0), bool(w[p, q])) for p in range(n) for q in range(m) if keep[p, q])
    every, some = np.ones(shape, bool), rng.random(shape) < 0.6
    for wanted in (None, some):
        values = lambda at, of: (odd[at, of], known[at, of], None if wanted is None else wanted[at, of])
        keep = every if wanted is None else wanted
        assert cells(blocks._cycles(values, a, b, False, False)) == want(odd, known, keep)
        both = want(odd, known, keep)
        assert cells(blocks._cycles(values, a, b, False, True)) == both + Counter({(j, i, v, w): c for (i, j, v, w), c in both.items()})
        for v in (k, odd):
            values = lambda at, of: (v[at, of].copy(), None, None if wanted is None else wanted[at, of])
            with np.errstate(invalid="ignore"):
                assert cells(blocks._by_size(values, a, b, 2)) == want(blocks._rounded(v, 2), every, keep)
    order = np.concatenate([p[2] for p in blocks._by_size(lambda at, of: (k[at, of], None, None), a, b, 2)])
    top = int(np.argmax(order))
    assert (np.diff(order[: top + 1]) >= 0).all() and (np.diff(order[top + 1 :]) <= 0).all()


def test_links_beyond_the_own_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 6)
    rng = np.random.default_rng(12)
    d = rng.integers(0, 3, (60, 16))
    d[40], d[50] = d[3], np.where(np.arange(16) < 12, d[7], (d[7] + 1) % 3)
    rows = [(i, v.tolist()) for i, v in enumerate(d)] + [(9, d[9].tolist()), (60, None), (61, [1] * 3), (None, d[3].tolist())]
    same = (d[:, None] == d[None]).mean(-1)
    np.fill_diagonal(same, 0)
    for above in (0.5, 0.7, 0.75, 1.0):
        got = [r["id"] for r in kernels.near_identical(frame(spark, rows, "id int, d array<int>"), "id", "d", above=above).collect()]
        assert sorted(got) == np.flatnonzero((same > above).any(1)).tolist()
    assert blocks.linked(frame(spark, rows[:0], "id int, d array<int>"), "id", ("d", "match", None), 0.5).count() == 0


def test_mixed_model_finds_the_genotype_means(spark):
    rng = np.random.default_rng(3)
    rows = [("e", g, r, float(10 * g + 3 * (r % 4) + rng.normal(0, 0.1))) for g in range(4) for r in range(24)]
    got = {r["g"]: r["blue"] for r in models.blues(frame(spark, rows, "e string, g int, r int, y double"), "e", "g", ["r"], "y").collect()}
    assert [got[g] - got[0] for g in range(4)] == pytest.approx([0, 10, 20, 30], abs=0.2)


def dense_reml(y, design, zs, rounds=60):
    """EM-REML with the rows' own matrices."""
    x = design
    w = np.hstack([x, *zs])
    ends = np.cumsum([x.shape[1], *(z.shape[1] for z in zs)])
    y = y - y.mean()
    ve = np.var(y) / 2
    vs = [ve / (len(zs) + 1)] * len(zs)
    for _ in range(rounds):
        c = w.T @ w
        for (a, b), v in zip(zip(ends, ends[1:], strict=False), vs, strict=True):
            c[range(a, b), range(a, b)] += ve / v
        inverse = np.linalg.pinv(c)
        u = inverse @ w.T @ y
        vs = [(u[a:b] @ u[a:b] + ve * np.trace(inverse[a:b, a:b])) / (b - a) for a, b in zip(ends, ends[1:], strict=False)]
        new = (y @ y - u @ w.T @ y) / (len(y) - x.shape[1])
        if abs(new - ve) < 1e-8 * ve:
            break
        ve = new
    return u[: x.shape[1]], vs, new


def test_mixed_models_from_counts_are_those_of_the_rows(spark):
    rng = np.random.default_rng(13)
    rows = [(e, f"g{g}", f"r{rng.integers(6)}", int(rng.integers(4)), 1000.0 * e + 3 * g + rng.normal(0, 2)) for e in (1, 2) for g in range(5) for _ in range(30)]
    odd = [(1, None, "r1", 1, 5.0), (1, "g1", None, 1, 5.0), (2, "g1", "r1", None, 5.0), (2, "g1", "r1", 1, None), (2, "g1", "r1", 1, float("nan"))]
    df = frame(spark, rows + odd, "e int, g string, r string, s int, y double")
    got = {(r["e"], r["g"]): r["blue"] for r in models.blues(df, "e", "g", ["r", "s"], "y").collect()}
    found = models.variance_components(df, "e", ["g", "r", "s"], "y").collect()
    parts = {(r["e"], r["grp"]): r["vcov"] for r in found}
    for e in (1, 2):
        mine = [r for r in rows if r[0] == e]
        y = np.array([r[4] for r in mine])
        codes = [np.unique([str(r[k]) for r in mine], return_inverse=True)[1] for k in (1, 2, 3)]
        g, r, s = (np.eye(c.max() + 1)[c] for c in codes)
        effects, _, _ = dense_reml(y, g, [r, s])
        assert [got[e, f"g{k}"] for k in range(5)] == pytest.approx(effects + y.mean(), abs=1e-3)
        _, vs, ve = dense_reml(y, np.ones((len(y), 1)), [g, r, s])
        assert [parts[e, k] for k in ("g", "r", "s", "residual")] == pytest.approx([*vs, ve], rel=1e-2, abs=1e-3)
        # Dense residuals at these components: the error's variance times V^-1 (y - mean).
        vs, ve = [parts[e, k] for k in ("g", "r", "s")], parts[e, "residual"]
        inverse = np.linalg.inv(sum(v * z @ z.T for v, z in zip(vs, (g, r, s), strict=True)) + ve * np.eye(len(y)))
        rest = ve * inverse @ (y - (inverse @ y).sum() / inverse.sum())
        for row in (r for r in found if r["e"] == e):
            assert row["rmse"] == pytest.approx(np.sqrt((rest**2).mean()), rel=1e-3)
            assert row["r_squared"] == pytest.approx(sum(vs) / (sum(vs) + ve)) and row["heritability"] == pytest.approx(vs[0] / (vs[0] + ve / 4))
            assert row["sdcor"] ** 2 == pytest.approx(row["vcov"])
    assert models.blues(df.limit(0), "e", "g", ["r"], "y").count() == 0


def signal(spark, n=160):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 6))
    y = x[:, 0] * 3 + rng.normal(0, 0.3, n)
    rows = [("g", i, x[i].tolist(), None if i % 5 == 0 else float(y[i])) for i in range(n)] + [("none", 1000 + i, x[i].tolist(), None) for i in range(3)]
    return x, y, frame(spark, rows, "g string, i int, x array<double>, y double")


def test_kriging_in_feature_space_is_kriging(spark):
    x, y, df = signal(spark)
    got = {r["i"]: r["predicted"] for r in models.blup_predictions(df, "g", "i", "x", "y").collect()}
    z = (x - x.mean(0)) / x.std(0) / np.sqrt(6)
    seen = np.arange(len(y)) % 5 != 0
    k, one = z @ z.T, np.ones(seen.sum())

    def dense(ratio):
        v = k[np.ix_(seen, seen)] + ratio * np.eye(seen.sum())
        inverse = np.linalg.inv(v)
        mean = one @ inverse @ y[seen] / (one @ inverse @ one)
        e = y[seen] - mean
        q = e @ inverse @ e
        top = -0.5 * ((seen.sum() - 1) * np.log(q) + np.linalg.slogdet(v)[1] + np.log(one @ inverse @ one))
        return top, mean + k[:, seen] @ inverse @ e

    best = max((dense(np.exp(g)) for g in np.linspace(-12, 16, 281)), key=lambda r: r[0])[1]
    assert [got[i] for i in range(len(y))] == pytest.approx(best, abs=0.02)
    assert set(got) == set(range(len(y)))


def test_gaussian_processes_choose_their_kernel(spark):
    x, y, df = signal(spark)
    got = {r["i"]: r for r in models.gp_predictions(df.where("g = 'g'"), "g", "i", "x", "y").collect()}
    held = [i for i in range(len(y)) if i % 5 == 0]
    assert {r["kernel"] for r in got.values()} == {"dot"} and np.corrcoef([got[i]["predicted"] for i in held], y[held])[0, 1] > 0.97
    k = models.rbf_features(x / np.sqrt(6), 1.0)
    d = ((x[:, None] - x[None]) ** 2).sum(2) / 6
    assert np.abs(k @ k.T - np.exp(-d / 2)).mean() < 0.06


def test_gibbs_over_several_kernels(spark):
    x, y, df = signal(spark)
    kernels = {"a": F.slice("x", 1, 3), "b": F.slice("x", 4, 3)}
    got = models.gibbs_predictions(df.where("g = 'g'"), "g", "i", kernels, {"A": ["a"], "B": ["b"], "AB": ["a", "b"]}, "y", n_iter=400, burn=100).collect()
    held = [i for i in range(len(y)) if i % 5 == 0]
    r = {m: np.corrcoef([p["predicted"] for p in sorted(got, key=lambda p: p["i"]) if p["model"] == m and p["i"] in held], y[held])[0, 1] for m in ("A", "B", "AB")}
    assert r["A"] > 0.95 and r["AB"] > 0.95 and r["B"] < 0.6


def test_genome_scan_is_that_of_a_dense_solve(spark):
    rng = np.random.default_rng(8)
    n, chromosomes = 90, ["a"] * 5 + ["b"] * 7
    d = rng.integers(0, 3, (n, 12)).astype(float)
    y = d[:, 2] * 0.8 + d[:, 8] * 0.5 + rng.normal(0, 1, n)
    rows = [(i, [int(v) for v in d[i]], float(y[i])) for i in range(n)] + [(n, None, 1.0), (n + 1, [1] * 12, None)]
    df = frame(spark, rows, "id int, d array<int>, y double")
    scan, lods = models.genome_scan(df, "d", ["y"], chromosomes)
    got = {r["locus"]: r["lod"] for r in lods.collect()}
    _, _, ratios = scan.trait(0)
    one = np.ones((n, 1))
    for m, c in enumerate(chromosomes):
        z = d[:, [j for j, o in enumerate(chromosomes) if o != c]]
        z = z - z.mean(0)
        inverse = np.linalg.inv(z @ z.T + ratios[c] * np.eye(n))

        def rss(x):
            e = y - x @ np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
            return e @ inverse @ e

        assert got[m] == pytest.approx(n / 2 * np.log10(rss(one) / rss(np.hstack([one, d[:, [m]]]))), rel=1e-6)
    assert max(got, key=got.get) == 2
    perms = models.permutation_lods(df.where("id < 90"), "id", "d", ["y"], chromosomes, times=60, seed=5).collect()
    assert len(perms) == 60 and np.quantile([r["lod"] for r in perms], 0.95) < got[2]
    dealt = {(r["perm"], r["id"]): r["y"] for r in models.permuted(df.where("id < 90").select("id", F.lit("y").alias("trait"), "y"), "id", 2, 5).collect()}
    assert sorted(dealt[1, i] for i in range(n)) == pytest.approx(sorted(y))
    zy, yy = (d - d.mean(0)).T @ [dealt[1, i] for i in range(n)], float(((y - y.mean()) ** 2).sum())
    perms5 = {r["perm"]: r["lod"] for r in perms}
    assert perms5[1] == pytest.approx(scan.lods(zy[None, :], yy, ratios).max(), rel=1e-6)
    blups = dict(models.blups_at(df.where("id < 90"), "d", "y", 0, 2, scan))
    assert blups[0] < blups[1] < blups[2]


def test_permutations_need_no_sort(spark):
    for n in (1, 2, 90, 257, 1000):
        one, two = (models.places(k, np.arange(n), n, 3) for k in (0, 1))
        assert sorted(one) == sorted(two) == list(range(n)) and (n < 90 or (one != two).any())
        assert models.places(0, np.array([n - 1]), n, 3)[0] == one[-1]
    # Each place is taken about equally often by each of 7 rows.
    taken = np.zeros((7, 7))
    for k in range(7000):
        taken[np.arange(7), models.places(k, np.arange(7), 7, 3)] += 1
    assert ((taken - 1000) ** 2 / 1000).sum() < 75  # chi-squared with 36 degrees of freedom: exceeded with a chance of 0.0002
    rng = np.random.default_rng(1)
    d, y = rng.integers(0, 3, (300, 6)), rng.normal(size=(300, 2))
    rows = [(i, d[i].tolist(), *y[i].tolist()) for i in range(300)] + [(300, None, 1.0, 1.0), (301, [1] * 6, None, 1.0)]
    df = frame(spark, rows, "id int, d array<int>, a double, b double")
    lods = {(r["trait"], r["perm"]): r["lod"] for r in models.permutation_lods(df, "id", "d", ["a", "b"], list("xxxyyy"), times=5, seed=4).collect()}
    scan, _ = models.genome_scan(df, "d", ["a", "b"], list("xxxyyy"))
    tall = df.where("id < 300").unpivot(["id"], ["a", "b"], "trait", "y")
    dealt = {(r["trait"], r["perm"], r["id"]): r["y"] for r in models.permuted(tall, "id", 5, 4).collect()}
    for t, name in enumerate("ab"):
        _, yy, ratios = scan.trait(t)
        for k in range(5):
            zy = (d - d.mean(0)).T @ [dealt[name, k, i] for i in range(300)]
            assert lods[name, k] == pytest.approx(scan.lods(zy[None, :], yy, ratios).max(), rel=1e-6)


def test_principal_curves(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(80):
        xi = rng.normal(0, 2)
        for t in np.sort(rng.uniform(0, 10, 9)):
            rows.append(("c", i, float(t), float(t + xi * math.sin(t * math.pi / 10) + rng.normal(0, 0.1)), xi))
    df = frame(spark, rows, "c string, id int, t double, y double, xi double")
    model = curves.fit(df, "c", "id", "t", "y").cache()
    m = model.first()
    assert all(a >= b for a, b in zip(m["lam"], m["lam"][1:], strict=False)) and m["fve"][0] > 0.8 and m["sigma2"] > 0
    found = curves.scores(df.where("id < 40"), model, "c", "id", "t", "y").collect()
    truth = {r["id"]: r["xi"] for r in df.select("id", "xi").distinct().collect()}
    r = np.corrcoef([f["xi"][0] for f in found], [truth[f["id"]] for f in found])[0, 1]
    assert len(found) == 40 and abs(r) > 0.95


def test_states_are_smoothed(spark):
    got = models.state_probabilities(frame(spark, [(1, [0, 0, 1, 0, 0, 1, 1, 1, None, 1])], "id int, o array<int>"), "id", "o").orderBy("locus").collect()
    assert [r["call"] for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]


def test_peaks_keep_contiguous_support(spark):
    scan = frame(spark, [("a", p, v) for p, v in enumerate([1.0, 9.0, 3.0, 8.0, 10.0, 9.0, 2.0, 9.5])] + [("b", 0, 1.0)], "chr string, pos int, lod double")
    got = kernels.peaks(scan, ["chr"], "pos", "lod", 5.0, 5.0).collect()
    assert [(r["chr"], r["pos"], r["ci_lo"], r["ci_hi"]) for r in got] == [("a", 4, 3, 5)]


def test_files_and_settings(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        files.read_directory(spark, str(tmp_path), "*.csv", frame(spark, [], "a int").schema)
    with pytest.raises(KeyError):
        files.settings({"a": "1"}, {"b": "2"})
    monkeypatch.setenv("FURROW_A", "3")
    assert files.settings({"a": "1"}, {"a": "2"}) == {"a": "3"}
    with pytest.raises(KeyError):
        registry.resolve_channels(["zz*"], ["a"])
    assert registry.resolve_channels(["*", "-b"], ["a", "b", "c"]) == ["a", "c"]


def test_stream_and_batch_agree(spark, tmp_path):
    from furrow.streaming.events import windowed

    rows = [(f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", "ab"[i % 2], float(i)) for i in range(60)]
    df = frame(spark, rows, "ts string, kind string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    batch = windowed(df, "ts", "kind", "v")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", "kind", "v").writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, batch.collect()))
