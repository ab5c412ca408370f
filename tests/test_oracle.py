"""Every registered query with SQL against DuckDB on the smallest tables; of the others, what can be said without: reruns agree, and see BY_HAND."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _every_event_once(rows, con):
    ids = [i for r in rows for i in r["ids"]]
    return sorted(ids) == sorted(x for (x,) in con.execute("select event_id from events").fetchall()) and all(len(r["ids"]) == r["events"] for r in rows)


def _share_inside(rows, con):
    share = con.execute("select avg((event_type = 'purchase')::int) from events").fetchone()[0]
    return rows[0]["low"] <= share <= rows[0]["high"] and rows[0]["draws"] == 300


def _one_row_per_vector(rows, con):
    return sorted(r["vec_id"] for r in rows) == sorted(x for (x,) in con.execute("select vec_id from embeddings where embedding is not null").fetchall())


#: What must hold of the queries without SQL.
BY_HAND = {
    "record_chunks": _every_event_once,
    "bootstrap_ci": _share_inside,
    "regimes": lambda rows, con: sum(r["units"] for r in rows) == con.execute("select count(*) from events").fetchone()[0] and all(a["end_day"] < b["start_day"] for a, b in zip(rows, rows[1:], strict=False)),
    "pca_layout": lambda rows, con: _one_row_per_vector(rows, con) and all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in rows),
    "kmeans_kinds": lambda rows, con: _one_row_per_vector(rows, con) and 2 <= len({r["kind"] for r in rows}) <= 8,
    "screener_scores": lambda rows, con: all(0 <= r["score"] <= 1 for r in rows) and len({r["test"] for r in rows}) == 2,
    "influence_links": lambda rows, con: all(r["f"] != r["g"] for r in rows) or len(rows) > 0,
    "redact_counts": lambda rows, con: len(rows) == con.execute("select count(distinct source) from documents").fetchone()[0] and sum(r["email"] for r in rows) > 0,
    "artifact_overlap": lambda rows, con: all(r["artifact"][:2] in ("n:", "c:", "f:", "u:", "r:") and 1 <= r["actors"] <= r["n"] for r in rows),
    "cascade_components": lambda rows, con: all(2 <= r["units"] and 2 <= r["depth"] <= r["units"] for r in rows),
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(v) for v in r) for r in df.select([f"`{c}`" for c in columns]).collect()), key=repr)
    if name in catalog.SQL:
        result = duck.execute(catalog.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert ours == sorted((tuple(norm(r[i]) for i in at) for r in result.fetchall()), key=repr)
    else:
        again = sorted((tuple(norm(v) for v in r) for r in catalog.QUERIES[name](spark, SF).select([f"`{c}`" for c in columns]).collect()), key=repr)
        assert ours == again
        assert BY_HAND[name](df.collect(), duck)
