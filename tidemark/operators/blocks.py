"""Blocks of consecutive points: layout, statistics and the encodings that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import scale_of, zigzag
from ..model import BLOCK_POINTS, DAY_NS, PACKED_MAX, SCALE_MAX
from .spread import dealt

SERIES = ["key", "field"]


def bucket_of(at: str = "ts_ns", bucket_ns: int = DAY_NS) -> Column:
    """The bucket of a time."""
    return F.expr(f"floor({at} / {bucket_ns}D)")


def numbered(points: DataFrame, by: list[str] = SERIES, at: str = "ts_ns", bucket_ns: int = DAY_NS, tasks: int | None = None) -> DataFrame:
    """Number each series field's points in time order, from 0, as ``place``; those of one time by ``seq``.

    Rows are numbered within buckets of time, and each bucket starts after those
    before it, so a series with very many points is spread over its days and
    only counts by bucket meet in one place.  With ``tasks`` rows and counts are
    dealt to so many; points that have their ``bucket`` are not dealt again.
    """
    order = [at] + (["seq"] if "seq" in points.columns else [])
    bucketed = points if "bucket" in points.columns else dealt(points.withColumn("bucket", bucket_of(at, bucket_ns)), tasks, *by, "bucket")
    counts = bucketed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n_before"))
    before = F.sum("n_before").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt(counts, tasks, *by).select(*by, "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order)) - 1
    return bucketed.withColumn("own", own).join(starts, [*by, "bucket"]).withColumn("place", F.col("start") + F.col("own")).drop("bucket", "own", "start")


def with_blocks(points: DataFrame, size: int = BLOCK_POINTS, tasks: int | None = None) -> DataFrame:
    """Cut each series field's points, in time order, into blocks of ``size``; ``tasks`` as in :func:`numbered`."""
    return numbered(points, tasks=tasks).withColumn("block", F.floor(F.col("place") / size).cast("bigint")).drop("place")


def _within(blocked: DataFrame):
    """The order of a block's points."""
    return Window.partitionBy(*SERIES, "block").orderBy("ts_ns", *(["seq"] if "seq" in blocked.columns else []))


def deltas(blocked: DataFrame, value: str) -> DataFrame:
    """``delta``: each point's difference from the one before in its block, the first's from 0."""
    order = _within(blocked)
    return blocked.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(order), F.lit(0)))


def block_stats(blocked: DataFrame) -> DataFrame:
    """Times and points of each block."""
    return blocked.groupBy(*SERIES, "block").agg(F.min("ts_ns").alias("ts_min"), F.max("ts_ns").alias("ts_max"), F.count(F.lit(1)).alias("n"))


def blocks_with(stats: DataFrame, lo: int, hi: int) -> DataFrame:
    """Blocks whose range overlaps ``[lo, hi]``: what a read cannot skip."""
    return stats.where((F.col("ts_min") <= hi) & (F.col("ts_max") >= lo))


def file_stats(points: DataFrame, file: Column, deleted: DataFrame | None = None) -> DataFrame:
    """Times, keys, points and tombstone flag of each file."""
    stats = points.withColumn("file", file).groupBy("file").agg(
        F.min("ts_ns").alias("ts_min"), F.max("ts_ns").alias("ts_max"), F.min("key").alias("key_min"), F.max("key").alias("key_max"), F.count(F.lit(1)).alias("n")
    )
    if deleted is None:
        return stats
    t = deleted.select(F.col("key").alias("t_key"), F.col("ts_min").alias("t_min"), F.col("ts_max").alias("t_max"))
    hit = stats.join(t, F.col("t_key").between(F.col("key_min"), F.col("key_max")) & (F.col("t_min") <= F.col("ts_max")) & (F.col("t_max") >= F.col("ts_min")), "left_semi")
    return stats.join(hit.select("file", F.lit(True).alias("has_tombstone")), "file", "left").withColumn("has_tombstone", F.coalesce("has_tombstone", F.lit(False)))


def timestamp_encoding(blocked: DataFrame, tasks: int | None = None) -> DataFrame:
    """The encoding of each block's times, with the deltas' scale: rle, packed or raw; blocks are dealt to ``tasks``."""
    blocked = dealt(blocked.select(*SERIES, "block", "ts_ns", *(["seq"] if "seq" in blocked.columns else [])), tasks, *SERIES, "block")
    order = _within(blocked)
    spaced = blocked.withColumn("delta", F.col("ts_ns") - F.lag("ts_ns").over(order))
    scales = spaced.groupBy(*SERIES, "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("delta").alias("least"), F.max("delta").alias("most"), F.min(F.when(F.col("delta").isNotNull(), scale_of(F.col("delta")))).alias("scale")
    )
    choice = F.when((F.col("n") > 1) & (F.col("least") == F.col("most")), "rle").when(F.col("most") > PACKED_MAX, "raw").otherwise("packed")
    return scales.select(*SERIES, "block", "n", choice.alias("encoding"), F.when(choice == "packed", F.least(F.coalesce("scale", F.lit(1)), F.lit(SCALE_MAX))).otherwise(1).cast("bigint").alias("scale"))


def integer_encoding(blocked: DataFrame, value: str = "v_int") -> DataFrame:
    """The encoding of each block's integers: zigzag of deltas, the first from 0.

    Unsigned numbers are encoded by their 64 bits taken as a signed number, and
    differences wrap around.
    """
    if dict(blocked.dtypes)[value].startswith("decimal"):
        top = F.lit(str(1 << 63)).cast("decimal(21,0)")
        bits = F.when(F.col(value) >= top, F.col(value).cast("decimal(21,0)") - 2 * top).otherwise(F.col(value).cast("decimal(21,0)"))
        blocked = blocked.withColumn(value, bits.cast("bigint"))
    order = _within(blocked)
    # As decimals, since differences of 64-bit numbers need 65 bits; brought back by wrapping around.
    wide = F.col(value).cast("decimal(21,0)") - F.coalesce(F.lag(value).over(order), F.lit(0)).cast("decimal(21,0)")
    turn, half = F.lit(str(1 << 64)).cast("decimal(22,0)"), F.lit(str(1 << 63)).cast("decimal(22,0)")
    wrapped = F.when(wide >= half, wide - turn).when(wide < -half, wide + turn).otherwise(wide).cast("bigint")
    coded = blocked.withColumn("delta", wrapped).withColumn("zz", zigzag(F.col("delta"))).withColumn("nth", F.row_number().over(order))
    later = F.when(F.col("nth") > 1, F.col("zz"))
    stats = coded.groupBy(*SERIES, "block").agg(F.count(F.lit(1)).alias("n"), F.min(later).alias("least"), F.max(later).alias("most"), F.max("zz").alias("top"), F.min("zz").alias("low"))
    # As bits of an unsigned number, a negative one is beyond the packed format.
    choice = F.when((F.col("n") > 2) & (F.col("least") == F.col("most")), "rle").when((F.col("top") > PACKED_MAX) | (F.col("low") < 0), "raw").otherwise("packed")
    return stats.select(*SERIES, "block", "n", choice.alias("encoding"))


def read_order(locations: DataFrame, by: list[str] = SERIES) -> DataFrame:
    """``place``: the order in which a read visits blocks ``(ts_min, ts_max, generation, sequence)``, from 1.

    Blocks whose times overlap, directly or through others, are visited by
    generation and sequence, the older file first, so that newer values come later
    and win; sets of them that do not overlap are visited in time order.
    """
    order = Window.partitionBy(*by).orderBy("ts_min", "ts_max", "generation", "sequence")
    reach = F.max("ts_max").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = locations.withColumn("opens", F.when(reach.isNull() | (F.col("ts_min") > reach), 1).otherwise(0))
    sets = opens.withColumn("of_set", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    visit = Window.partitionBy(*by).orderBy("of_set", "generation", "sequence", "ts_min", "ts_max")
    return sets.withColumn("place", F.row_number().over(visit).cast("bigint")).drop("opens", "of_set")


def rejected_floats(points: DataFrame) -> DataFrame:
    """Float points that cannot be encoded: not a number."""
    return points.where((F.col("ftype") == "Float") & F.isnan("v_float"))


def block_checksums(blocked: DataFrame, text: Column) -> DataFrame:
    """A CRC-32 of each block's points in time order and a hash of its key.

    A block has a bounded number of points, and so has what is gathered here.
    """
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts_ns", text.alias("value")))), lambda p: F.concat_ws(" ", p["ts_ns"].cast("string"), p["value"])), "\n")
    return blocked.groupBy(*SERIES, "block").agg(F.crc32(body).alias("crc"), F.count(F.lit(1)).alias("n")).withColumn("key_hash", F.xxhash64("key"))
