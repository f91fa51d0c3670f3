"""Last-write-wins, overlays, time filters, deletes, scans and key walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import lifecycle_ns, value_bytes
from ..model import VALUE_COLUMNS
from .ranges import bucket_array, classes_of, in_classes
from .spread import dealt

IDENTITY = ["key", "field", "ts_ns"]


def last_write_wins(points: DataFrame, tasks: int | None = None) -> DataFrame:
    """The point with the greatest ``seq`` of each ``(key, field, ts_ns)``.

    Each column is aggregated by itself: what a reader does not select is not
    carried, and numbers stay in a hash aggregate with a partial one before the
    only shuffle.  ``seq`` must tell the writes of an identity apart, as a store's
    does; of writes with an equal one, columns may come from either.  With ``tasks``
    points are dealt to so many before they are aggregated, by ``bucket`` where they
    have one (a function of the time): no task that reads keeps its share.
    """
    identity = [*IDENTITY, *(["bucket"] if "bucket" in points.columns else [])]
    carried = [c for c in points.columns if c not in (*identity, "seq")]
    points = dealt(points, tasks, "key", "field", identity[-1])
    return points.groupBy(*identity).agg(*(F.max_by(c, "seq").alias(c) for c in carried), F.max("seq").alias("seq")).select(*points.columns)


def overlay(older: DataFrame, newer: DataFrame) -> DataFrame:
    """The union of two runs in which the newer wins equal timestamps, whatever ``seq`` says."""
    # One number for run and seq, so that numbers stay in a hash aggregate.
    above = F.lit(str(1 << 64)).cast("decimal(21,0)")
    ranked = older.withColumn("rank", F.col("seq").cast("decimal(21,0)")).unionByName(newer.withColumn("rank", F.col("seq").cast("decimal(21,0)") + above))
    carried = [c for c in older.columns if c not in IDENTITY]
    return ranked.groupBy(*IDENTITY).agg(*(F.max_by(c, "rank").alias(c) for c in carried)).select(*older.columns)


def merge_cached(files: DataFrame, cached: DataFrame, value: str) -> DataFrame:
    """Sort-merge of two deduplicated runs by identity; cached values win ties."""
    left, right = cached.select(*IDENTITY, F.col(value).alias("c"), F.lit(True).alias("in_cache")), files.select(*IDENTITY, F.col(value).alias("f"))
    merged = left.join(right, IDENTITY, "full")
    return merged.select(*IDENTITY, F.when(F.col("in_cache"), F.col("c")).otherwise(F.col("f")).alias(value))


def include(points: DataFrame, lo: int, hi: int) -> DataFrame:
    """Points with ``lo <= ts_ns <= hi``."""
    return points.where(F.col("ts_ns").between(lo, hi))


def exclude(points: DataFrame, lo: int, hi: int) -> DataFrame:
    """Points outside ``[lo, hi]``."""
    return points.where(~F.col("ts_ns").between(lo, hi))


def apply_tombstones(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Points that no later delete covers; a null tombstone field means all fields.

    Tombstones that overlap or touch for the same key, field and ``del_seq`` need no
    merging: an anti join by key with the range as its residual.  Spark broadcasts
    the tombstones when they are small enough and sorts by key otherwise.
    """
    t = tombstones.select(F.col("key").alias("t_key"), F.col("field").alias("t_field"), "ts_min", "ts_max", "del_seq")
    covered = (
        (F.col("key") == F.col("t_key"))
        & (F.col("t_field").isNull() | (F.col("t_field") == F.col("field")))
        & F.col("ts_ns").between(F.col("ts_min"), F.col("ts_max"))
        & (F.col("seq") < F.col("del_seq"))
    )
    return points.join(t, covered, "left_anti")


def live(points: DataFrame, tombstones: DataFrame, tasks: int | None = None) -> DataFrame:
    """What a read sees: deletes applied, then the last write of each point; ``tasks`` as in :func:`last_write_wins`."""
    return last_write_wins(apply_tombstones(points, tombstones), tasks)


def scan(points: DataFrame, key: str, field: str, ftype: str, lo: int, hi: int, ascending: bool = False, limit: int | None = None) -> DataFrame:
    """``ts_ns, value`` of one field of one series in a time range, in time order."""
    rows = include(points.where((F.col("key") == key) & (F.col("field") == field)), lo, hi)
    rows = rows.select("ts_ns", F.col(VALUE_COLUMNS[ftype]).alias("value"))
    rows = rows.orderBy(F.col("ts_ns").asc() if ascending else F.col("ts_ns").desc())
    return rows if limit is None else rows.limit(limit)


def series_keys(points: DataFrame, seek: str | None = None) -> DataFrame:
    """Distinct keys and fields with their type, in byte order, from ``seek`` on."""
    rows = points if seek is None else points.where(F.col("key") >= seek)
    return rows.select("key", "field", "ftype").distinct().orderBy("key", "field")


def contains_time(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted(key, lo, hi)`` with whether the series has a point in the range.

    Only ranges with a key in common meet; each point counts once per range.
    """
    hits = wanted.join(points.select("key", "ts_ns"), (wanted["key"] == points["key"]) & F.col("ts_ns").between(F.col("lo"), F.col("hi")), "left_semi")
    marked = hits.select("key", "lo", "hi", F.lit(True).alias("found")).distinct()
    return wanted.join(marked, ["key", "lo", "hi"], "left").select("key", "lo", "hi", F.coalesce("found", F.lit(False)).alias("found"))


def keys_present(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted(key)`` that have points: the walk that a delete takes."""
    return wanted.join(points.select("key"), "key", "left_semi")


def bounds(points: DataFrame) -> DataFrame:
    """Least and greatest time, points and bytes of each series field."""
    return points.groupBy("key", "field").agg(F.min("ts_ns").alias("ts_min"), F.max("ts_ns").alias("ts_max"), F.count(F.lit(1)).alias("n"), F.sum(value_bytes()).alias("n_bytes"))


def unexpired(points: DataFrame, now_ns: int, tombstones: DataFrame | None = None) -> DataFrame:
    """Points that their life-cycle still keeps at ``now_ns``; unknown life-cycles are dropped.

    With ``tombstones`` those that a later delete covers are dropped too.
    """
    ttl = lifecycle_ns(F.col("lifecycle"))
    kept = points.where((ttl < 0) | (F.col("ts_ns") >= F.lit(now_ns) - ttl))
    return kept if tombstones is None else apply_tombstones(kept, tombstones)


def apply_many_tombstones(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """:func:`apply_tombstones` for very many deletes of one series.

    Deletes of a whole series are one number for each key and field.  The others
    are put into classes by length and, in a class, into buckets as wide as its
    longest range, so each lies in two buckets at most and a point meets only those
    of its own bucket in each class that occurs.
    """
    lowest, highest = -(1 << 63), (1 << 63) - 1
    t = tombstones.withColumn("whole", (F.col("ts_min") == lowest) & (F.col("ts_max") == highest))
    whole = t.where("whole").groupBy("key", "field").agg(F.max("del_seq").alias("del_seq"))
    every, one = (whole.where(c) for c in ("field is null", "field is not null"))
    left = points.join(every.select("key", F.col("del_seq").alias("every_seq")), "key", "left").join(one.select("key", "field", F.col("del_seq").alias("one_seq")), ["key", "field"], "left")
    left = left.where("seq >= coalesce(every_seq, seq) and seq >= coalesce(one_seq, seq)").select(*points.columns)
    return not_within(left, t.where("not whole and ts_min <= ts_max"))


def not_within(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Points that no later one of the ranges covers."""
    t = in_classes(tombstones.select(F.col("key").alias("t_key"), F.col("field").alias("t_field"), "ts_min", "ts_max", "del_seq"), "ts_min", "ts_max")
    classes = classes_of(t)
    if not classes:
        return points
    # Each point once for each class, with a number to tell which points any class covers.
    numbered = points.withColumn("point", F.monotonically_increasing_id()).withColumn("at", bucket_array(F.col("ts_ns"), classes)).withColumn("at", F.explode("at"))
    covered = (
        (F.col("key") == F.col("t_key")) & (F.col("at") == F.col("in_bucket"))
        & (F.col("t_field").isNull() | (F.col("t_field") == F.col("field"))) & F.col("ts_ns").between(F.col("ts_min"), F.col("ts_max")) & (F.col("seq") < F.col("del_seq"))
    )
    # A point stays if it stays in all classes: as many rows as classes.
    rest = numbered.join(t, covered, "left_anti")
    counted = rest.groupBy(*points.columns, "point").agg(F.count(F.lit(1)).alias("n")) if len(classes) > 1 else rest.withColumn("n", F.lit(1))
    return counted.where(F.col("n") == len(classes)).select(*points.columns)


def replay(log: DataFrame) -> DataFrame:
    """State after a log of ``write``, ``delete`` (a key) and ``delete_range`` entries, in order of ``seq``."""
    writes = log.where("kind = 'write'")
    deletes = log.where("kind <> 'write'").select(
        "key", F.lit(None).cast("string").alias("field"),
        F.when(F.col("kind") == "delete", F.lit(-(1 << 63)).cast("bigint")).otherwise(F.col("ts_min")).alias("ts_min"),
        F.when(F.col("kind") == "delete", F.lit((1 << 63) - 1).cast("bigint")).otherwise(F.col("ts_max")).alias("ts_max"),
        F.col("seq").alias("del_seq"),
    )
    return last_write_wins(apply_many_tombstones(writes.select("key", "field", "ts_ns", "value", "seq"), deletes))


def type_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming(key, field, ftype)`` whose field already has another type."""
    known = existing.select("key", "field", F.col("ftype").alias("existing"))
    new = incoming.select("key", "field", "ftype").distinct()
    return new.join(known, ["key", "field"]).where(F.col("ftype") != F.col("existing"))


def _fields_of(points: DataFrame, text: Column) -> Column:
    """Texts of a point's fields in order of name; of a field that is there twice the greatest ``seq``, or text, stays."""
    order = [F.col("seq")] if "seq" in points.columns else []
    parts = F.sort_array(F.collect_list(F.struct("field", *order, text.alias("value"))))
    return F.filter(parts, lambda x, i: (i == F.size(parts) - 1) | (F.get(parts, i + 1)["field"] != x["field"]))


def field_maps(points: DataFrame, text: Column, apart: tuple[str, ...] = ()) -> DataFrame:
    """Fields of each key and time as one map, from field name to ``text``.

    Points of one time that differ in a column of ``apart``, such as ``seq``, are told apart.
    """
    told = points.groupBy("key", "ts_ns", *apart).agg(_fields_of(points, text).alias("f"))
    return told.select("key", "ts_ns", F.map_from_entries(F.transform("f", lambda x: F.struct(x["field"], x["value"]))).alias("fields"))


def lines(points: DataFrame, text: Column, apart: tuple[str, ...] = ()) -> DataFrame:
    """One text line for each key and time: key, fields in order of name, time; ``apart`` as in :func:`field_maps`."""
    told = points.groupBy("key", "ts_ns", *apart).agg(_fields_of(points, text).alias("f"))
    fields = F.array_join(F.transform("f", lambda x: F.concat(x["field"], F.lit("="), x["value"])), ",")
    return told.select("key", "ts_ns", F.concat_ws(" ", "key", fields, F.col("ts_ns").cast("string")).alias("line"))
