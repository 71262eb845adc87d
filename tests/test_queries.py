"""Every registered query of the package against its DuckDB twin on the smallest tables; the rest has to give rows."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

from furrow.plans.catalog import FLAGSHIP, QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

#: Queries whose result is empty on these tables when all is well.
MAY_BE_EMPTY = {"j07_anti_join", "k07_restart_list", "n08_near_identical", "g30_having", "u03_difference", "j09_update_join", "v03_subset_of_full"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 5) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(str([plain(v) for v in r]) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got or name in MAY_BE_EMPTY
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(str([plain(r[i]) for i in at]) for r in result.fetchall())


def test_entry_gives_rows_of_a_stable_schema(spark):
    df = QUERIES[FLAGSHIP](spark, FOLDER)
    assert df.columns == ["method", "model", "correlation", "correlation_sd", "rmse", "seeds"] and df.count() > 0


def test_queries_without_a_twin_take_all_vectors(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    ids = {r["vec_id"] for r in table}
    assert len(ids) > 400
    assert {r["id"] for r in QUERIES["n10_genotype_probabilities"](spark, FOLDER).select("id").distinct().collect()} == ids
    assert QUERIES["s14_serialized_objects"](spark, FOLDER).count() == len(table)
    taxa = QUERIES["s10_wide_genotypes"](spark, FOLDER).groupBy("taxon").count().collect()
    assert {r["taxon"] for r in taxa} == {f"taxon{i}" for i in ids} and {r["count"] for r in taxa} == {64}


def test_observations_take_their_environments_kernel_in_blocks(spark):
    plan = QUERIES["l10_weather_kernel"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Join")
