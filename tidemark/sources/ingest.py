"""From wide rows, files of delimited text and tables to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import column_ns, micros_literal
from ..functions.values import infer_type, typed_values
from ..model import POINTS, VALUE_COLUMNS

#: Field name that is never stored: it names the timestamp.
TIME_FIELD = "time"


def unpivot(rows: DataFrame, key: Column, ts_ns: Column, fields: dict[str, tuple[Column, str]], seq: Column, lifecycle: Column | int = 0) -> DataFrame:
    """One point for each field of each wide row; null values give none.

    ``fields`` maps a name to its column and type.  A field named ``time`` is skipped.
    """
    types = {f.name: f.dataType for f in POINTS}

    def point(name: str, value: Column, ftype: str) -> Column:
        columns = [F.lit(name).alias("field"), F.lit(ftype).alias("ftype")]
        columns += [(value if c == VALUE_COLUMNS[ftype] else F.lit(None)).cast(types[c]).alias(c) for c in VALUE_COLUMNS.values()]
        return F.struct(*columns)

    parts = F.array(*(point(n, v, t) for n, (v, t) in fields.items() if n.lower() != TIME_FIELD))
    cycle = lifecycle if isinstance(lifecycle, Column) else F.lit(lifecycle)
    wide = rows.select(key.cast("string").alias("key"), ts_ns.cast("bigint").alias("ts_ns"), cycle.cast("int").alias("lifecycle"), seq.cast("bigint").alias("seq"), F.explode(parts).alias("p"))
    told = wide.select("key", "p.field", "ts_ns", "p.ftype", *(f"p.{c}" for c in VALUE_COLUMNS.values()), "lifecycle", "seq")
    return told.where(" or ".join(f"{c} is not null" for c in VALUE_COLUMNS.values()))


def from_maps(rows: DataFrame) -> DataFrame:
    """Points of ``(key, ts_ns, fields map<string,string>, lifecycle, seq)``; types are inferred from the texts."""
    wide = rows.select("key", "ts_ns", "lifecycle", "seq", F.explode("fields").alias("field", "text")).where(F.lower("field") != TIME_FIELD)
    typed = wide.withColumn("ftype", infer_type(F.col("text"))).where("ftype is not null").withColumns(typed_values(F.col("text")))
    return typed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in POINTS))


def events_points(events: DataFrame) -> DataFrame:
    """The ``events`` table as points: a series for each type, ``seq`` its id."""
    fields = {
        "value": (F.col("value"), "Float"),
        "user_id": (F.col("user_id"), "Integer"),
        "props": (F.col("props"), "String"),
        "is_error": (F.col("event_type") == "error", "Boolean"),
    }
    return unpivot(events, F.col("event_type"), column_ns("ts"), fields, F.col("event_id"))


def series_of_events(events: DataFrame, key: str, column: str, lo: int, hi: int) -> DataFrame:
    """``ts_ns, value`` of one column of one type, with time bounds that reach the scan.

    Stored times have microseconds, so the bounds in nanoseconds are exact on them.
    """
    floor, top = -62135596800_000000, 253402300799_999999  # years 1 to 9999
    first, last = max(-(-lo // 1000), floor), min(hi // 1000, top)
    rows = events.where((F.col("event_type") == key) & (F.col("ts") >= micros_literal(first)) & (F.col("ts") <= micros_literal(last)))
    return rows.select(column_ns("ts").alias("ts_ns"), F.col(column).alias("value"))


def read_delimited(spark: SparkSession, path: str, n_fields: int, key_prefix: str = "test", workers: int | None = None) -> DataFrame:
    """Points of headerless comma-separated files: a nanosecond time and text fields.

    Files split anywhere and each split is read by its own task, which gives the
    series its number (``workers`` folds the numbers); fields are ``field1``,
    ``field2``, ...  The worker is also the life-cycle.
    """
    schema = ", ".join(["ts_ns bigint", *(f"field{i} string" for i in range(1, n_fields + 1))])
    rows = spark.read.schema(schema).csv(path)
    worker = F.spark_partition_id() if workers is None else F.pmod(F.spark_partition_id(), F.lit(workers))
    rows = rows.withColumn("worker", worker).withColumn("at", F.monotonically_increasing_id())
    fields = {f"field{i}": (F.col(f"field{i}"), "String") for i in range(1, n_fields + 1)}
    return unpivot(rows, F.concat(F.lit(key_prefix), F.col("worker").cast("string")), F.col("ts_ns"), fields, F.col("at"), F.col("worker"))


def generate(spark: SparkSession, rows: int, width: int = 32, seed: int = 1) -> DataFrame:
    """Rows of a time and two hexadecimal texts, as the bulk loader takes them."""
    text = lambda s: F.substring(F.concat(*(F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(f"{seed}.{s}.{i}")), 256) for i in range(-(-width // 64)))), 1, width)
    return spark.range(rows).select(F.col("id").alias("ts_ns"), text(1).alias("field1"), text(2).alias("field2"))
