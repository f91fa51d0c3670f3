"""Queries whose tables are dealt to a number of tasks that follows their rows."""

import pytest

from tidemark import queries as core
from tidemark.operators import garbage, spread

from .test_queries import DATA, executed, same
from .test_ties import expected


@pytest.mark.parametrize("name", ["compact_result", "ts_encoding_choice"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    df = core.QUERIES[name](spark, DATA)
    plan = executed(df)
    assert "REPARTITION_BY_NUM" in plan and ", 12), REPARTITION_BY_NUM" in plan
    assert same(df.toPandas(), expected(DATA, name))


def test_pairs_of_files_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    df = core.gc_edge_weights(spark, DATA)
    assert executed(df).count("REPARTITION_BY_NUM") >= 4
    assert same(df.toPandas(), expected(DATA, "gc_edge_weights"))


def test_ends_of_edges_are_dealt(spark, monkeypatch):
    usual = core.gc_component(spark, DATA).collect()
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7), (2, 3, 0.1)], "i bigint, j bigint, weight double")
    kept = garbage.heaviest(edges, 1, 3)
    assert "hashpartitioning(file" in executed(kept) and ", 3), REPARTITION_BY_NUM" in executed(kept)
    assert sorted(map(tuple, kept.collect())) == [(1, 2, 0.5), (1, 3, 0.7)]
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    assert core.gc_component(spark, DATA).collect() == usual
