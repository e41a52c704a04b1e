"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

from lodestone.plans import analysis_queries, document_queries, envelope_queries, evidence_queries, formula_queries, graph_queries, ontology_queries, problem_queries, record_queries, state_queries, store_queries, stream_queries, table_queries, text_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: the recursive SQL of these is slow or their rows very many
SLOW = {"bibliographic_coupling", "vector_topk_batch"}


def rows(names, found):
    at = [names.index(c) for c in sorted(names)]
    told = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted("|".join(told(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns) and rows(got.columns, got.collect()) == rows(names, want.fetchall())
