"""Every query of the core library against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidemark import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    a, b = a[sorted(a.columns)], b[sorted(b.columns)]
    plain = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    rows = lambda f: sorted(repr(tuple(map(plain, r))) for r in f.itertuples(index=False, name=None))
    return list(a.columns) == list(b.columns) and rows(a) == rows(b)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no data")
@pytest.mark.parametrize("name", core.QUERIES)
def test_query(spark, name):
    got = core.QUERIES[name](spark, DATA).toPandas()
    if name in core.ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert same(got, db.sql(core.ORACLES[name]).df())
    else:
        assert len(got)


def test_bounds_reach_the_scan(spark):
    plan = core.select_range_asc(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(event_type,error)" in plan and "TakeOrderedAndProject" in plan


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lww_dedup", "overlay_merge"])
def test_numbers_are_aggregated_by_hash_in_one_shuffle(spark, name):
    plan = executed(core.QUERIES[name](spark, DATA))
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("HashAggregate") == 2


def test_a_read_of_a_store_reaches_its_files(spark, tmp_path):
    from tidemark.operators.points import scan
    from tidemark.sources.store import PointStore

    store = PointStore(spark, str(tmp_path))
    store.append(core.value_points(spark, DATA))
    store.delete("error", 5, 6)
    plan = executed(scan(store.read(), "error", "value", "Float", 1, 2))
    assert "EqualTo(key,error)" in plan and "GreaterThanOrEqual(ts_ns,1)" in plan and "v_str" not in plan.split("ReadSchema")[1].split("\n")[0]
