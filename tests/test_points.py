"""Operators on points against a store kept in a dictionary."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, times, values
from tidemark.model import MAX_NS, MIN_NS
from tidemark.operators import blocks, points, ranges
from tidemark.sources import ingest

SCHEMA = "key string, field string, ts_ns bigint, ftype string, v_int bigint, seq bigint"


def frame(spark, rows):
    return spark.createDataFrame([(k, f, t, "Integer", v, s) for k, f, t, v, s in rows], SCHEMA)


def test_random_writes_and_deletes(spark):
    rng = random.Random(5)
    writes, deletes, state = [], [], {}
    for seq in range(400):
        key, field = rng.choice(["a", "a!", "ab"]), rng.choice(["x", "y"])
        if rng.random() < 0.1:
            lo = rng.randint(-20, 20)
            hi = lo + rng.randint(-2, 15)
            only = rng.choice([None, field])
            deletes.append((key, only, lo, hi, seq))
            for k in [k for k in state if k[0] == key and only in (None, k[1]) and lo <= k[2] <= hi]:
                del state[k]
        else:
            ts = rng.randint(-20, 20)
            writes.append((key, field, ts, rng.randint(0, 9), seq))
            state[key, field, ts] = writes[-1][3]
    rng.shuffle(writes)
    t = spark.createDataFrame(deletes, "key string, field string, ts_min bigint, ts_max bigint, del_seq bigint")
    live = points.live(frame(spark, writes), t).collect()
    assert {(r.key, r.field, r.ts_ns): r.v_int for r in live} == state


def test_overlay_prefers_the_newer_run(spark):
    older, newer = frame(spark, [("k", "f", 1, 1, 90), ("k", "f", 2, 2, 91)]), frame(spark, [("k", "f", 2, 3, 5), ("k", "f", 3, 4, 4), ("k", "f", 3, 5, 6)])
    assert sorted((r.ts_ns, r.v_int) for r in points.overlay(older, newer).collect()) == [(1, 1), (2, 3), (3, 5)]
    merged = points.merge_cached(points.last_write_wins(older), points.last_write_wins(newer), "v_int")
    assert sorted((r.ts_ns, r.v_int) for r in merged.collect()) == [(1, 1), (2, 3), (3, 5)]


def test_scan_and_ranges_of_time(spark):
    p = frame(spark, [("k", "f", t, t, t) for t in range(50)])
    assert [r.value for r in points.scan(p, "k", "f", "Integer", 10, 20, True, 3).collect()] == [10, 11, 12]
    assert [r.value for r in points.scan(p, "k", "f", "Integer", 10, 20, False, 2).collect()] == [20, 19]
    assert points.scan(p, "k", "f", "Integer", 20, 10).count() == 0
    assert points.scan(p, "k", "f", "Integer", MIN_NS + 2, MAX_NS - 1, limit=0).count() == 0
    assert points.include(p, 5, 7).count() + points.exclude(p, 5, 7).count() == 50
    for i in range(0, 50, 13):
        assert [r.value for r in points.scan(p, "k", "f", "Integer", i, i).collect()] == [i]


def test_keys_and_times(spark):
    p = frame(spark, [("pump_7", "f", 0, 1, 1), ("quay", "f", 5, 1, 2)])
    assert [r.key for r in points.series_keys(p, "q").collect()] == ["quay"]
    wanted = spark.createDataFrame([("pump_7", 0, 0), ("pump_70", 0, 9), ("quay", 0, 4), ("quay", 9, 0)], "key string, lo bigint, hi bigint")
    assert {(r.key, r.lo, r.hi): r.found for r in points.contains_time(p, wanted).collect()} == {("pump_7", 0, 0): True, ("pump_70", 0, 9): False, ("quay", 0, 4): False, ("quay", 9, 0): False}


def test_ranges(spark):
    rows = [("a", 1, 3), ("a", 3, 5), ("a", 6, 7), ("a", 20, 21), ("b", 0, 9), ("b", 2, 3), ("b", 10, 12), ("c", 5, MAX_NS), ("c", MIN_NS, 4)]
    r = spark.createDataFrame(rows, "g string, lo bigint, hi bigint")
    assert sorted(map(tuple, ranges.merge_ranges(r, ["g"]).collect())) == [("a", 1, 5), ("a", 6, 7), ("a", 20, 21), ("b", 0, 9), ("b", 10, 12), ("c", MIN_NS, 4), ("c", 5, MAX_NS)]
    assert sorted(map(tuple, ranges.merge_ranges(r, ["g"], adjacent=True).collect())) == [("a", 1, 7), ("a", 20, 21), ("b", 0, 12), ("c", MIN_NS, MAX_NS)]
    targets = spark.createDataFrame([("a", 2, 5), ("a", 5, 6), ("b", 1, 2)], "g string, lo bigint, hi bigint")
    assert sorted(map(tuple, ranges.covered_by(targets, r, ["g"]).collect())) == [("a", 2, 5), ("b", 1, 2)]
    assert sorted(map(tuple, ranges.covered_by_any(targets, r, ["g"]).collect())) == [("b", 1, 2)]
    series = spark.createDataFrame([("a", 1, 7), ("b", 0, 13)], "g string, ts_min bigint, ts_max bigint")
    assert [x.g for x in ranges.fully_deleted(series, r, ["g"]).collect()] == ["a"]


def test_blocks_and_encodings(spark):
    rows = [("k", "f", t * 1000, 7, t) for t in range(10)] + [("k", "f", 9_007, -3, 10), ("m", "f", 0, 1, 1), ("m", "f", 1 << 61, 2, 2), ("m", "f", (1 << 61) + 1, 2, 3)]
    b = blocks.with_blocks(frame(spark, rows), 5)
    assert sorted(r.n for r in blocks.block_stats(b).collect()) == [1, 3, 5, 5]
    found = {(r.key, r.block): (r.encoding, r.scale) for r in blocks.timestamp_encoding(b).collect()}
    assert found == {("k", 0): ("rle", 1), ("k", 1): ("rle", 1), ("k", 2): ("packed", 1), ("m", 0): ("raw", 1)}
    ints = {(r.key, r.block): r.encoding for r in blocks.integer_encoding(b).collect()}
    assert ints == {("k", 0): "rle", ("k", 1): "rle", ("k", 2): "packed", ("m", 0): "packed"}


def test_codecs(spark):
    xs = [0, -1, 1, -2, MAX_NS, MIN_NS, 12345]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint").select("x", codecs.zigzag(F.col("x")).alias("z"))
    rows = df.select("x", "z", codecs.unzigzag(F.col("z")).alias("back")).collect()
    assert all(r.x == r.back for r in rows) and [r.z for r in rows][:4] == [0, 1, 2, 3]


def test_text_forms(spark):
    df = spark.createDataFrame([("a#!~#b#!~#c", 1_500_000_001), ("plain", -1)], "c string, ns bigint")
    key, field = values.split_composite(F.col("c"))
    assert [tuple(r) for r in df.select(key, field, times.rfc3339(F.col("ns"))).collect()] == [("a", "b#!~#c", "1970-01-01T00:00:01.500000001Z"), ("plain", "", "1969-12-31T23:59:59.999999999Z")]
    kinds = spark.createDataFrame([(x,) for x in ("18446744073709551615u", "18446744073709551616u", "9223372036854775808", "", "nan", '"a"', "a")], "t string")
    assert [r[0] for r in kinds.select(values.infer_type(F.col("t"))).collect()] == ["Unsigned", "String", "Float", None, "Float", "String", "String"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as ts, '2024-03-10T02:30:00.123456789Z' as t")
        assert tuple(df.select(times.column_ns("ts"), times.literal_ns_column(F.col("t"))).first()) == (1_710_037_800_123_456_000, 1_710_037_800_123_456_789)
        moments = {1704412800000000001: "2024-01-05T00:00:00.000000001Z", -1: "1969-12-31T23:59:59.999999999Z", 0: "1970-01-01T00:00:00Z", 1_710_037_800_120_000_000: "2024-03-10T02:30:00.12Z", MAX_NS: "2262-04-11T23:47:16.854775807Z", MIN_NS: "1677-09-21T00:12:43.145224192Z"}
        told = spark.createDataFrame([(n,) for n in moments], "n bigint").select("n", times.rfc3339(F.col("n")).alias("t")).collect()
        assert {r.n: r.t for r in told} == moments
        now = spark.sql("select 'now()' as t").select(times.literal_ns_column(F.col("t"))).first()[0]
        assert abs(now - times.literal_ns("now()")) < 60 * 10**9
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_maps_become_typed_points(spark):
    rows = spark.createDataFrame([("k", 1, {"a": "5", "b": "5u", "c": '"x,y"', "time": "9", "d": "true", "e": "1.5", "g": ""}, 0, 1)], "key string, ts_ns bigint, fields map<string,string>, lifecycle int, seq bigint")
    found = {r.field: (r.ftype, r.v_int, r.v_uint, r.v_str, r.v_bool, r.v_float) for r in ingest.from_maps(rows).collect()}
    assert set(found) == {"a", "b", "c", "d", "e"}
    assert found["a"][:2] == ("Integer", 5) and found["c"][3] == "x,y" and found["d"][4] is True and found["e"][5] == 1.5 and int(found["b"][2]) == 5


def test_many_deletes_match_few(spark):
    """The form for very many deletes against the plain one: short, long, empty and whole ranges, one field or all."""
    rng = random.Random(8)
    writes = [(rng.choice("ab"), rng.choice("xy"), rng.randint(-(10**12), 10**12), i, i) for i in range(600)]
    deletes = []
    for i in range(80):
        lo = rng.randint(-(10**12), 10**12)
        lo, hi = (MIN_NS, MAX_NS) if i % 40 == 39 else (lo, lo + rng.choice([-5, 0, 10**6, 10**9, 10**10, 10**11, MAX_NS - 10**13]))
        deletes.append((rng.choice("ab"), rng.choice([None, "x"]), lo, hi, rng.randint(0, 150)))
    p, t = frame(spark, writes), spark.createDataFrame(deletes, "key string, field string, ts_min bigint, ts_max bigint, del_seq bigint")
    want = {w[4] for w in writes if not any(k == w[0] and f in (None, w[1]) and lo <= w[2] <= hi and w[4] < s for k, f, lo, hi, s in deletes)}
    assert {r.seq for r in points.apply_many_tombstones(p, t).collect()} == want == {r.seq for r in points.apply_tombstones(p, t).collect()}
    assert points.apply_many_tombstones(p, t.limit(0)).count() == 600


def test_merging_and_cover_over_buckets(spark):
    rng = random.Random(9)
    for width in (7, 10**6):
        rows = [(rng.choice("ab"), lo, lo + rng.randint(0, 9)) for lo in (rng.randint(-60, 60) for _ in range(40))] + [("c", MIN_NS, MIN_NS + 3), ("c", MIN_NS + 4, MAX_NS)]
        r = spark.createDataFrame(rows, "g string, lo bigint, hi bigint")
        for adjacent in (False, True):
            want = []
            for g, lo, hi in sorted(rows):
                if want and want[-1][0] == g and lo <= want[-1][2] + adjacent:
                    want[-1][2] = max(hi, want[-1][2])
                else:
                    want.append([g, lo, hi])
            assert sorted(map(list, ranges.merge_ranges(r, ["g"], adjacent=adjacent, width=width).collect())) == want
        targets = [(rng.choice("abz"), lo, lo + rng.randint(0, 4)) for lo in (rng.randint(-60, 60) for _ in range(50))] + [("c", 5, 6)] * 2
        t = spark.createDataFrame(targets, "g string, lo bigint, hi bigint")
        covered = [x for x in targets if any(g == x[0] and lo <= x[1] and hi >= x[2] for g, lo, hi in rows)]
        assert sorted(map(tuple, ranges.covered_by_any(t, r, ["g"]).collect())) == sorted(covered)


def test_a_field_that_is_there_twice(spark):
    df = frame(spark, [("k", "f", 1, 5, 1), ("k", "f", 1, 6, 2), ("k", "g", 1, 7, 0)])
    text = F.col("v_int").cast("string")
    assert points.field_maps(df, text).first().fields == {"f": "6", "g": "7"} and points.lines(df, text).first().line == "k f=6,g=7 1"
    assert points.field_maps(df.drop("seq"), text).first().fields == {"f": "6", "g": "7"}


def test_expiry_knows_deletes(spark):
    df = frame(spark, [("k", "f", t, t, t) for t in range(5)]).withColumn("lifecycle", F.lit(0))
    t = spark.createDataFrame([("k", None, 1, 2, 99)], "key string, field string, ts_min bigint, ts_max bigint, del_seq bigint")
    assert sorted(r.ts_ns for r in points.unexpired(df, 10, t).collect()) == [0, 3, 4]


def test_read_order_and_unsigned_blocks(spark):
    rows = [("k", "f", 0, 9, 3, 1), ("k", "f", 5, 12, 1, 1), ("k", "f", 11, 20, 2, 1), ("k", "f", 30, 31, 1, 1), ("k", "f", 5, 6, 1, 2)]
    df = spark.createDataFrame(rows, "key string, field string, ts_min bigint, ts_max bigint, generation int, sequence int")
    assert [(r.generation, r.sequence, r.ts_min) for r in blocks.read_order(df).orderBy("place").collect()] == [(1, 1, 5), (1, 2, 5), (2, 1, 11), (3, 1, 0), (1, 1, 30)]
    top = 2**64 - 1
    data = [("k", "f", i, decimal.Decimal(v)) for i, v in enumerate([top, 0, 1, 5, 1 << 63, 5])]
    u = spark.createDataFrame(data, "key string, field string, ts_ns bigint, v_uint decimal(20,0)").withColumn("block", F.floor(F.col("ts_ns") / 3))
    assert {r.block: r.encoding for r in blocks.integer_encoding(u, "v_uint").collect()} == {0: "rle", 1: "raw"}
