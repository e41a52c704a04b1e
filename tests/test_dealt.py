"""Rows of a file of one row group are dealt to tasks before much is made of them, and read once."""

import pytest

from lodestone.plans import document_queries, envelope_queries, text_queries  # noqa: F401
from lodestone.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["source_works", "xml_documents", "latex_documents", "document_formulas"])
def test_rows_of_one_file_are_parsed_in_many_tasks(spark, name):
    got = QUERIES[name](spark, SF)
    sizes = got.select("p_partkey").rdd.glom().map(len).collect()
    assert len(sizes) == 4 and max(sizes) < sum(sizes) / 2


def test_tasks_grow_with_rows(spark):
    from lodestone.plans.lineage import dealt

    d = dealt(spark.range(100).coalesce(1), "id", each=10)
    assert d.rdd.getNumPartitions() == 11 and d.count() == 100


def test_an_entry_is_read_once(spark):
    plan = QUERIES["source_works", "xml_documents", "latex_documents", "document_formulas"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("from_xml(") == 1
