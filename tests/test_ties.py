"""Queries against their SQL on tables that the smallest data does not show: equal times, large numbers."""

from pathlib import Path

import duckdb
import pytest

from tidemark import queries as core
from tidemark.model import POINTS
from tidemark.sources.store import PointStore

from .test_queries import same

BASE = 1_704_067_200_000_000


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of which every second one has the type and time of the one before."""
    folder = tmp_path_factory.mktemp("tied")
    rows = f"SELECT 4900 + i AS event_id, make_timestamp({BASE} + i // 2 * 3600000000) AS ts, i % 40 AS user_id, ['view', 'error', 'click'][1 + i // 2 % 3] AS event_type, i / 4 AS value, 'p' || i AS props FROM range(600) t(i)"
    duckdb.connect().sql(f"COPY ({rows}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def expected(folder: str, name: str):
    db = duckdb.connect()
    for table in ("events", "lineitem"):
        if Path(f"{folder}/{table}.parquet").exists():
            db.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return db.sql(core.ORACLES[name]).df()


def test_products_beyond_64_bits_wrap_around(spark, tmp_path):
    """231 * 4e16 is more than a signed number of 64 bits holds; blocks without such a number are as in SQL."""
    rows = f"SELECT i AS event_id, make_timestamp({BASE} + i * 1000000) AS ts, CASE WHEN i = 3 THEN 231 ELSE i % 9 END AS user_id, 'view' AS event_type, 0.0::DOUBLE AS value, '' AS props FROM range(60) t(i)"
    duckdb.connect().sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    told = {r["block"]: (r["n"], r["encoding"]) for r in core.int_encoding_choice(spark, str(tmp_path)).collect()}
    assert told[1] == (3, "raw") and sum(n for n, _ in told.values()) == 60


@pytest.mark.parametrize("name", ["compact_fast", "delete_then_rewrite", "point_fields", "point_lines", "store_round_trip", "stream_ingest"])
def test_events_of_one_time_stay_apart(spark, tied, name):
    assert same(core.QUERIES[name](spark, tied).toPandas(), expected(tied, name))


def test_a_store_of_every_write_stays_one(spark, tmp_path):
    store = PointStore(spark, str(tmp_path), every_write=True)
    rows = [("k", "v", t, "Float", float(i), None, None, None, None, 0, 0) for i, t in enumerate((1, 1, 2, 3))]
    for _ in range(2):
        store.append(spark.createDataFrame(rows, POINTS))
    store.compact(store.manifest()["points"][:1])
    again = PointStore(spark, str(tmp_path))
    assert again.read().count() == 8
    again.delete("k", 3, 3)
    again.compact(fast=True)
    assert sorted(r["v_float"] for r in PointStore(spark, str(tmp_path)).read().collect()) == [0, 0, 1, 1, 2, 2]
