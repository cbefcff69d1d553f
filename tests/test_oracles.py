"""Every registered query against its DuckDB SQL, on the tables of the smallest scale."""

import math

import duckdb
import pytest

from tideline import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", [*queries.ORACLES])
def test_oracle(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    assert got == expected


#: Queries that ``test_scoring_trees.py`` holds against more than their rows.
ELSEWHERE = ("boosted_by_fold", "tree_attributions", "attributed_subsets", "augmented_stacking")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and n not in ELSEWHERE])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1


def test_latest_run_reads_all_orders(spark, con):
    runs = queries._runs(spark, SF)
    assert runs.count() == con.sql("select count(*) from orders").fetchall()[0][0]
    assert {r.stage for r in runs.where("model = 'model_6'").select("stage").distinct().collect()} == {"baseline", "other"}
