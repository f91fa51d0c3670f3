"""The data model: points, tombstones, value types and life-cycles.

A point is ``(key, field, ts_ns)`` with one value in the column of its type.  A
``(key, field)`` pair has one type for good, so each type has a column of its own
and Parquet statistics, pushdown and vectorised reads keep working.  ``seq`` is
the global order of writes and deletes.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Value types and the column that holds each.
VALUE_COLUMNS = {"Float": "v_float", "Integer": "v_int", "Unsigned": "v_uint", "String": "v_str", "Boolean": "v_bool"}

POINTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("ftype", T.StringType()),
        T.StructField("v_float", T.DoubleType()),
        T.StructField("v_int", T.LongType()),
        T.StructField("v_uint", T.DecimalType(20, 0)),
        T.StructField("v_str", T.StringType()),
        T.StructField("v_bool", T.BooleanType()),
        T.StructField("lifecycle", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)
TOMBSTONES = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("field", T.StringType()), T.StructField("ts_min", T.LongType()), T.StructField("ts_max", T.LongType()), T.StructField("del_seq", T.LongType())]
)

MIN_NS, MAX_NS = -(1 << 63), (1 << 63) - 1
DAY_NS = 86_400 * 1_000_000_000
#: Days that each life-cycle keeps a point; None keeps it for good.
LIFECYCLE_DAYS: dict[int, int | None] = {0: None, 1: 7, 2: 14, 3: 30, 4: 180, 5: 360}
#: Points of a full block.
BLOCK_POINTS = 2000
#: What joins key and field in composite text keys.
KEY_SEPARATOR = "#!~#"
#: Greatest number that the packed integer format holds, and greatest power of ten that scales timestamps.
PACKED_MAX, SCALE_MAX = (1 << 60) - 1, 10**12


class TypeConflict(ValueError):
    """A field is written with another type than it has."""
