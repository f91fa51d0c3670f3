"""The store, the engine and the stream."""

import pytest
from pyspark.sql import functions as F

from tidemark.model import TypeConflict
from tidemark.plans.engine import Engine
from tidemark.sources import ingest
from tidemark.sources.store import PointStore
from tidemark.streaming.sink import write_points


def rows_of(df):
    return sorted((r.key, r.field, r.ts_ns, r.v_float, r.v_int, r.v_str) for r in df.collect())


def wide(spark, rows):
    df = spark.createDataFrame(rows, "key string, ts bigint, a double, b bigint")
    return ingest.unpivot(df, F.col("key"), F.col("ts"), {"a": (F.col("a"), "Float"), "b": (F.col("b"), "Integer"), "time": (F.col("b"), "Integer")}, F.lit(0))


def test_compaction_changes_nothing(spark, tmp_path):
    s = PointStore(spark, str(tmp_path))
    assert s.read().count() == 0
    s.append(wide(spark, [("x", t, float(t), t) for t in range(20)]))
    s.delete("x", 5, 9)
    s.append(wide(spark, [("x", 7, 70.0, None), ("y", 1, 1.0, 1)]))
    s.delete("y", field="b")
    before = rows_of(s.read())
    assert ("x", "a", 7, 70.0, None, None) in before and ("x", "b", 7, None, 7, None) not in before
    first = s.manifest()["points"][0]
    s.compact([first])
    assert rows_of(s.read()) == before
    s.compact()
    assert rows_of(s.read()) == before and s.tombstones().count() == 0
    assert s.vacuum() and rows_of(s.read()) == before


def test_later_batches_win_and_types_hold(spark, tmp_path):
    s = PointStore(spark, str(tmp_path))
    s.append(wide(spark, [("x", 1, 1.0, 1)]))
    s.append(wide(spark, [("x", 1, 2.0, 2)]))
    assert rows_of(s.read()) == [("x", "a", 1, 2.0, None, None), ("x", "b", 1, None, 2, None)]
    df = spark.createDataFrame([("x", 3, 5)], "key string, ts bigint, a bigint")
    with pytest.raises(TypeConflict):
        s.append(ingest.unpivot(df, F.col("key"), F.col("ts"), {"a": (F.col("a"), "Integer")}, F.lit(0)))
    assert s.read().count() == 2


def test_statements(spark, tmp_path):
    e = Engine(spark, str(tmp_path), buffer_rows=50)
    for i in range(30):
        e.execute(f'insert into hh field1={i}, field4="v{i}", time={i * 10};')
    assert [tuple(r) for r in e.execute("select field1 from hh limit 2").collect()] == [(290, 29), (280, 28)]
    for i in (0, 7, 29):
        assert [r.value for r in e.execute(f"select field1 from hh where time > {i * 10 - 1} and time < {i * 10 + 1} asc").collect()] == [i]
    e.execute("delete from hh where time < 55;")
    assert [r.ts_ns for r in e.execute("select field4 from hh limit 1 asc").collect()] == [60]
    e.execute("insert into hh field1=99, time=20")
    assert [tuple(r) for r in e.execute("select field1 from hh limit 1 asc").collect()] == [(20, 99)]
    e.execute("insert into hh field1=98, time=20")
    assert e.text("select field1 from hh limit 1 asc") == "timestamp\tfield1\n1970-01-01T00:00:00.00000002Z\t98"
    with pytest.raises(TypeConflict):
        e.execute("insert into hh field1=1.5")
    with pytest.raises(LookupError):
        e.execute("select nothing from hh")
    e.execute("delete from hh")
    assert e.execute("select field1 from hh").count() == 0 and e.text("insert into u n=18446744073709551615u, time=1") == "ok"
    assert int(e.execute("select n from u").first().value) == 18446744073709551615
    e.flush()
    assert int(Engine(spark, str(tmp_path)).execute("select n from u").first().value) == 18446744073709551615


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    ingest.generate(spark, 200).repartition(3).write.parquet(src)
    s = PointStore(spark, str(tmp_path / "store"))
    schema = spark.read.parquet(src).schema
    to_points = lambda b: ingest.unpivot(b, F.lit("k"), F.col("ts_ns"), {"field1": (F.col("field1"), "String")}, F.lit(0))
    for _ in range(2):  # the second run finds nothing new
        write_points(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), s, str(tmp_path / "ck"), to_points, True).awaitTermination()
    assert sorted((r.ts_ns, r.v_str) for r in s.read().collect()) == sorted((r.ts_ns, r.field1) for r in spark.read.parquet(src).collect())
    assert s.raw().count() == 200


def test_delimited_text(spark, tmp_path):
    path = str(tmp_path / "csv")
    ingest.generate(spark, 100).repartition(4).write.csv(path)
    p = ingest.read_delimited(spark, path, 2, workers=3)
    assert p.count() == 200 and {r.field for r in p.select("field").distinct().collect()} == {"field1", "field2"}
    assert all(r.key == f"test{r.lifecycle}" for r in p.select("key", "lifecycle").distinct().collect())


def one_series(key):
    return lambda b: ingest.unpivot(b, F.lit(key), F.col("ts_ns"), {"field1": (F.col("field1"), "String")}, F.lit(0))


def test_streams_do_not_hide_each_other(spark, tmp_path):
    """Two streams into one store, and one with a new checkpoint in the place of the old."""
    import shutil

    src = str(tmp_path / "in")
    ingest.generate(spark, 50).repartition(2).write.parquet(src)
    s, schema = PointStore(spark, str(tmp_path / "store")), spark.read.parquet(src).schema
    run = lambda key, ck: write_points(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / ck), one_series(key), True).awaitTermination()
    run("a", "ck1")
    run("b", "ck2")
    shutil.rmtree(tmp_path / "ck1")
    run("c", "ck1")
    run("c", "ck1")
    assert {r.key: r.n for r in s.raw().groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 50, "b": 50, "c": 50}


def test_a_batch_tried_again_is_written_once(spark, tmp_path):
    """A crash after the store's commit and before the stream's own: the batch comes again, a delete in between holds."""
    src, ck = str(tmp_path / "in"), tmp_path / "ck"
    ingest.generate(spark, 20).coalesce(1).write.parquet(src)
    s, schema = PointStore(spark, str(tmp_path / "store")), spark.read.parquet(src).schema
    run = lambda: write_points(spark.readStream.schema(schema).parquet(src), s, str(ck), one_series("k"), True).awaitTermination()
    run()
    s.delete("k", 0, 9)
    for f in (ck / "commits").iterdir():
        f.unlink()
    run()
    assert s.raw().count() == 20 and sorted(r.ts_ns for r in s.read().collect()) == list(range(10, 20))


def test_acknowledged_rows_survive_the_engine(spark, tmp_path):
    path = str(tmp_path)
    e = Engine(spark, path)
    e.execute("insert into pump turns=1, note=\"a\", time=10")
    e.execute("insert into pump turns=2, big=18446744073709551615u, time=10")
    again = Engine(spark, path)  # the first never flushed
    assert [tuple(r) for r in again.execute("select turns from pump").collect()] == [(10, 2)]
    assert int(again.execute("select big from pump").first().value) == 18446744073709551615
    with pytest.raises(TypeConflict):
        again.execute("insert into pump turns=1.5")
    again.execute("delete from pump where time > 9 and time < 11")
    again.execute("insert into pump turns=3, time=11")
    third = Engine(spark, path)
    assert [tuple(r) for r in third.execute("select turns from pump").collect()] == [(11, 3)]
    assert [r[2] for r in third.log.replay()] == [11]


def test_log_entries_of_a_commit_are_not_replayed(spark, tmp_path):
    """A crash after the batch's commit and before its entries are removed, and an entry that was cut short."""
    e = Engine(spark, str(tmp_path))
    e.execute("insert into pump turns=1, time=1")
    trim, e.log.trim = e.log.trim, lambda: None
    e.flush()
    assert Engine(spark, str(tmp_path))._rows == []
    trim()
    e.execute("insert into pump turns=2, time=2")
    e.execute("insert into pump turns=3, time=3")
    (tmp_path / "log" / f"entry-{e.log.last:012d}.json").write_text("[[")
    (tmp_path / "log" / f".entry-{e.log.last:012d}.json.crc").unlink(missing_ok=True)
    assert [r[2] for r in Engine(spark, str(tmp_path))._rows] == [2]


def test_numbers_of_rows_are_checked(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    monkeypatch.setattr(store, "PARTITION_BITS", 1)
    s = PointStore(spark, str(tmp_path))
    rows = wide(spark, [("x", t, float(t), t) for t in range(20)]).repartition(5)
    with pytest.raises(Exception, match="than a batch can number"):
        s.append(rows, partitions=2)
    assert s.raw().count() == 0
    s.append(rows, partitions=5)
    assert s.raw().count() == 40 and s.manifest()["next"] == 4 and s.raw().select("seq").distinct().count() == 40


def test_types_of_one_batch_and_of_many_fields(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    monkeypatch.setattr(store, "LISTED_TYPES", 3)
    s = PointStore(spark, str(tmp_path))
    both = wide(spark, [("x", 1, 1.0, None)]).unionByName(wide(spark, [("x", 2, None, 5)]).withColumn("field", F.lit("a")))
    with pytest.raises(TypeConflict):
        s.append(both)
    for k in "xyz":
        s.append(wide(spark, [(k, 1, 1.0, 1)]))
    assert isinstance(s.manifest()["types"], str) and {(r.key, r.field, r.ftype) for r in s.catalog().collect()} == {(k, f, t) for k in "xyz" for f, t in (("a", "Float"), ("b", "Integer"))}
    s.vacuum()
    assert s.catalog().count() == 6


def test_fast_compaction_changes_nothing(spark, tmp_path):
    s = PointStore(spark, str(tmp_path))
    s.append(wide(spark, [("x", t, float(t), t) for t in range(10)] + [("y", 1, 1.0, 1), ("y", 1, 2.0, 2), ("w", 1, 1.0, 1)]))
    s.append(wide(spark, [("x", 3, 30.0, None), ("z", 1, 1.0, 1)]))
    s.delete("w")
    before = rows_of(s.read())
    s.compact(fast=True)
    assert rows_of(s.read()) == before and s.raw().count() == len(before) and len(s.manifest()["points"]) == 1 and s.vacuum()
    assert rows_of(s.read()) == before


def test_value_files(spark, tmp_path):
    from tidemark.sources.values import ValueFiles

    files = ValueFiles(PointStore(spark, str(tmp_path)))
    assert files.read().count() == 0
    data = [(f"k{i}", i, i + 1, i % 2, f"block {i}".encode()) for i in range(40)]
    df = spark.createDataFrame(data, "key string, ts_min bigint, ts_max bigint, lifecycle int, block binary").repartition(3)
    pointers = files.write(df)
    assert files.resolve(pointers).count() == 40 and all(len({r.lifecycle for r in rows}) == 1 for rows in [files.read().where(f"file_id = {f.file_id}").collect() for f in pointers.select("file_id").distinct().collect()])
    live = spark.createDataFrame(pointers.where("ts_min < 12").collect(), pointers.schema)
    old = {r.file_id for r in pointers.select("file_id").distinct().collect()}
    moved = files.collect_garbage(live, 0.25)
    got = {(r.key, bytes(r.block).decode()) for r in files.resolve(moved).collect()}
    assert got == {(f"k{i}", f"block {i}") for i in range(12)}
    gone = files.vacuum()
    assert set(gone) == old - {max(old)} and {r.key for r in files.resolve(moved).where("block is not null").collect()} == {f"k{i}" for i in range(12)}
    assert files.resolve(live).where("block is null").count() > 0


def test_a_full_buffer_is_written(spark, tmp_path):
    """The buffer is written when it is full."""
    e = Engine(spark, str(tmp_path), buffer_rows=3)
    for i in range(4):
        e.execute(f"insert into pump turns={i}, time={i}")
    assert e.store.raw().count() == 3 and len(e._rows) == 1 and e.execute("select turns from pump").count() == 4
