"""Queries over whole tables that the SQL of their smaller forms does not reach."""

import duckdb

from lodestone.operators import index
from lodestone.plans import graph_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_components(spark):
    up: dict[str, str] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        a, b = sorted((top(f"o{r.l_orderkey}"), top(f"p{r.l_partkey}")))
        up[b] = a
    got = {r.node: r.label for r in QUERIES["all_components"](spark, SF).collect()}
    assert got == {x: top(x) for x in list(up)}


def test_vector_topk_batch(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted((r.query_id, r["rank"], r.id, f"{r.score:.6f}") for r in QUERIES["vector_topk_batch"](spark, SF).collect())
    want = sorted((q, k, i, f"{s:.6f}") for q, i, k, s in con.execute(ORACLES["vector_topk_batch"]).fetchall())
    assert got == want and len(got) > 10
    v = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(9)], "id long, vector array<float>")
    blocks = index.vector_topk_batch(v, v.where("id % 2 = 1"), 2, rows=2).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in blocks if r.query_id == 1) == [(1, 1, 4), (1, 2, 7)] and len(blocks) == 8
