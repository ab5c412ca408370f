"""Queries over all their rows and whole texts, against DuckDB or brute force: neither they nor their SQL cut anything."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, flow
from tidemark.plans import catalog, flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def whole(spark, duck, name, cut):
    """The query's rows equal those of its SQL, which makes no such cut."""
    assert cut not in catalog.SQL[name]
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["word_df", "rare_terms_rank"])
def test_whole_texts(spark, duck, name):
    whole(spark, duck, name, "[1:2000]")


def test_every_event_is_a_focus(spark, duck):
    whole(spark, duck, "context_window", " WHERE id % 997 = 0")


def test_every_event_chases(spark, duck):
    whole(spark, duck, "pointer_chase", " WHERE id % 50 = 0")


def test_every_line_is_tested(spark, duck):
    whole(spark, duck, "bh_fdr", " WHERE l_linenumber = 1")


def test_screener_reads_whole_texts(spark):
    rows = [(k, f"a{k % 20}", "same " * 500 + ("late" if k % 2 else "other"), k % 2) for k in range(200)]
    got = cluster.screener(spark.createDataFrame(rows, "id long, actor string, text string, label int"))
    low, high = (got.filter(F.col("label") == k).agg(F.avg("score")).first()[0] for k in (0, 1))
    assert high - low > 0.5


def test_cascades_of_all_features(spark):
    units, has, edges = (d.collect() for d in flows._flow(spark, SF))
    actor, at = {r["unit"]: r["actor"] for r in units}, {r["unit"]: (r["t"], r["unit"]) for r in units}
    wanted = []
    for f in {r["feature"] for r in has}:
        shown = {r["unit"] for r in has if r["feature"] == f}
        pairs = sorted({(r["u"], r["v"]) for r in edges if r["u"] in shown and r["v"] in shown}, key=lambda e: at[e[1]])
        depth, group = {}, {}
        for u, v in pairs:
            depth[v] = max(depth.get(v, 1), depth.setdefault(u, 1) + 1)
            one, two = (group.setdefault(x, {x}) for x in (u, v))
            if one is not two:
                one |= two
                group.update(dict.fromkeys(two, one))
        for g in {id(g): g for g in group.values()}.values():
            wanted.append((f, min(g), len(g), len({actor[x] for x in g}), max(depth[x] for x in g)))
    got = catalog.QUERIES["cascade_components"](spark, SF).select("feature", "cascade", "units", "actors", "depth").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_cascades_end_or_raise(spark):
    units = spark.createDataFrame([(k, "a") for k in range(3)], "unit long, actor string")
    has = units.select("unit", F.lit("f").alias("feature"))
    path = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    assert [tuple(r) for r in flow.cascades(units, has, path).collect()] == [("f", 0, 3, 1, 3)]
    with pytest.raises(RuntimeError):
        flow.cascades(units, has, path.union(spark.createDataFrame([(2, 0)], "u long, v long"))).count()
