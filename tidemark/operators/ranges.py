"""Operations on inclusive ranges of integers, by group.

A group may hold most rows, so nothing here sorts or joins a group as one: ranges
are sorted within buckets of their start, what reaches from bucket to bucket is a
few numbers, and a range is looked up among those of its own length and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DAY_NS

#: The least class of lengths: ranges of up to a second, if numbers are nanoseconds, share buckets.
LEAST_CLASS = 30


def merge_ranges(ranges: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", adjacent: bool = False, width: int = DAY_NS) -> DataFrame:
    """Coalesce overlapping ranges of each group; with ``adjacent`` also those one apart.

    Sharing an end point is overlapping.  Gaps and islands: each bucket of ``width``
    starts with how far those before it reach, and its islands are numbered after
    theirs; both come from one row for each bucket.
    """
    bucketed = ranges.select(*by, lo, hi, F.expr(f"floor({lo} / {width}D)").alias("bucket"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = bucketed.groupBy(*by, "bucket").agg(F.max(hi).alias("far"))
    carried = far.select(*by, "bucket", F.max("far").over(before).alias("carried"))
    own = Window.partitionBy(*by, "bucket").orderBy(lo, hi)
    rows = bucketed.join(carried, [*by, "bucket"])
    reach = F.greatest(F.max(hi).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    # The greatest number has no successor to touch.
    touch = F.when(reach < (1 << 63) - 1, reach + 1).otherwise(reach) if adjacent else reach
    flagged = rows.withColumn("opens", F.when(reach.isNull() | (F.col(lo) > touch), 1).otherwise(0))
    numbered = flagged.withColumn("nth", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy(*by, "bucket", "nth").agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
    # What a bucket has before its first opening belongs to the island that reaches into it.
    opened = parts.groupBy(*by, "bucket").agg(F.max("nth").alias("opened"))
    starts = opened.select(*by, "bucket", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("start"))
    islands = parts.join(starts, [*by, "bucket"]).withColumn("island", F.col("start") + F.col("nth"))
    return islands.groupBy(*by, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("island")


def _length_class(lo: str, hi: str) -> Column:
    """The least power of two, as its exponent, that is more than a range's length; 63 for the longest."""
    length = F.col(hi).cast("decimal(20,0)") - F.col(lo).cast("decimal(20,0)")
    out = F.lit(63)
    for c in range(62, LEAST_CLASS - 1, -1):
        out = F.when(length < F.lit(1 << c).cast("decimal(20,0)"), c).otherwise(out)
    return out


def _bucket(value: Column, c: Column | int) -> Column:
    """The bucket of a number in a class, as a text with the class: buckets are as wide as the class's ranges are long."""
    c = c if isinstance(c, Column) else F.lit(c)
    return F.concat_ws("/", c.cast("string"), F.call_function("shiftright", value, c.cast("int")).cast("string"))


def in_classes(ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """The ranges with ``of_class`` and, once for each of the two buckets at most that they touch, ``in_bucket``."""
    classed = ranges.withColumn("of_class", _length_class(lo, hi))
    ends = F.array_distinct(F.array(_bucket(F.col(lo), F.col("of_class")), _bucket(F.col(hi), F.col("of_class"))))
    return classed.withColumn("in_bucket", F.explode(ends))


def classes_of(classed: DataFrame) -> list[int]:
    """The classes that occur, 34 at most."""
    return sorted(r["of_class"] for r in classed.select("of_class").distinct().collect())


def bucket_array(value: Column, classes: list[int]) -> Column:
    """The bucket of a number in each of the classes."""
    return F.array(*(_bucket(value, c) for c in classes))


def covered_by(targets: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``targets(lo, hi)`` that one of the ranges of their group covers whole.

    Ranges are first merged, so a group's ranges are disjoint.
    """
    return covered_by_any(targets, merge_ranges(ranges, by), by)


def covered_by_any(targets: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``targets(lo, hi)`` that a single given range covers; ranges are not merged.

    The start of a target is looked up among ranges of each length that occurs.
    """
    cover = in_classes(ranges.select(*(F.col(c).alias(f"r_{c}") for c in by), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi")).where("r_lo <= r_hi"), "r_lo", "r_hi")
    classes = classes_of(cover)
    if not classes:
        return targets.where(F.lit(False))
    spread = targets.withColumn("row", F.monotonically_increasing_id()).withColumn("at", F.explode(bucket_array(F.col("lo"), classes)))
    same = [F.col(c) == F.col(f"r_{c}") for c in by]
    hits = spread.join(cover, [*same, F.col("at") == F.col("in_bucket"), F.col("lo") >= F.col("r_lo"), F.col("hi") <= F.col("r_hi")], "left_semi")
    hits = hits.dropDuplicates(["row"]) if len(classes) > 1 else hits
    return hits.select(*targets.columns)


def fully_deleted(series: DataFrame, tombstones: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``series(ts_min, ts_max)`` that adjoining tombstones delete whole."""
    merged = merge_ranges(tombstones, by, adjacent=True).select(*(F.col(c).alias(f"r_{c}") for c in by), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    same = [F.col(c) == F.col(f"r_{c}") for c in by]
    return series.join(merged, [*same, F.col("r_lo") <= F.col("ts_min"), F.col("r_hi") >= F.col("ts_max")], "left_semi")
