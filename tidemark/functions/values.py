"""Types and texts of field values, composite keys and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DAY_NS, KEY_SEPARATOR, LIFECYCLE_DAYS

_FLOAT = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def infer_type(text: Column) -> Column:
    """Type of a literal: quoted, boolean, integer, float, unsigned (``42u``), else a bare string; empty gives null."""
    text = F.trim(text)
    unsigned = F.regexp_extract(text, r"^(\d+)u$", 1)
    fits = F.length(F.regexp_replace(unsigned, "^0+", "")).between(0, 20) & (unsigned.try_cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when((F.length(text) >= 2) & text.startswith('"') & text.endswith('"'), "String")
        .when(text.isin("true", "false"), "Boolean")
        .when(text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull(), "Integer")
        .when(text.rlike(_FLOAT), "Float")
        .when((unsigned != "") & fits, "Unsigned")
        .otherwise("String")
    )


def typed_values(text: Column) -> dict[str, Column]:
    """The value column of each type for a literal; all but one are null."""
    kind, bare = infer_type(text), F.trim(text)
    return {
        "v_float": F.when(kind == "Float", bare.try_cast("double")),
        "v_int": F.when(kind == "Integer", bare.try_cast("bigint")),
        "v_uint": F.when(kind == "Unsigned", F.regexp_extract(bare, r"^(\d+)u$", 1).try_cast("decimal(20,0)")),
        "v_str": F.when(kind == "String", F.regexp_replace(bare, r'^"([\s\S]*)"$', "$1")),
        "v_bool": F.when(kind == "Boolean", bare == "true"),
    }


def value_text(prefix: str = "") -> Column:
    """Text of a point's value: ``42i``, ``42u``, plain floats and booleans, quoted strings."""
    c = lambda n: F.col(prefix + n)
    return F.coalesce(
        c("v_float").cast("string"),
        F.concat(c("v_int").cast("string"), F.lit("i")),
        F.concat(c("v_uint").cast("string"), F.lit("u")),
        c("v_bool").cast("string"),
        F.concat(F.lit('"'), c("v_str"), F.lit('"')),
    )


def value_bytes() -> Column:
    """Bytes that a point counts for: 16 for numbers, 9 for booleans, 8 and its length for a string."""
    return F.when(F.col("ftype") == "String", 8 + F.octet_length("v_str")).when(F.col("ftype") == "Boolean", 9).otherwise(16).cast("bigint")


def composite_key(key: Column, field: Column) -> Column:
    """Key and field as one text."""
    return F.concat(key, F.lit(KEY_SEPARATOR), field)


def split_composite(text: Column) -> tuple[Column, Column]:
    """Key and field of a composite text, cut at the first separator; without one the field is empty."""
    at = F.instr(text, KEY_SEPARATOR)
    key = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return key, F.when(at > 0, F.substring(text, at + len(KEY_SEPARATOR), F.length(text))).otherwise("")


def file_name(generation: Column, sequence: Column) -> Column:
    """Name of a generation's file."""
    return F.format_string("%09d-%09d.sst", generation, sequence)


def parse_file_name(path: Column) -> tuple[Column, Column]:
    """Generation and sequence of a file path; null where the name is of another form."""
    part = lambda i: F.regexp_extract(path, r"(?:^|/)(\d+)-(\d+)\.[^/]*$", i).try_cast("int")
    return part(1), part(2)


def lifecycle_ns(lifecycle: Column) -> Column:
    """Nanoseconds that a life-cycle keeps a point, -1 for good, null for an unknown one."""
    out = F.lit(None).cast("bigint")
    for code, days in LIFECYCLE_DAYS.items():
        out = F.when(lifecycle == code, F.lit(-1 if days is None else days * DAY_NS).cast("bigint")).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def megabytes(n: Column) -> Column:
    """Whole megabytes."""
    return F.floor(n / 1048576).cast("bigint")


def percent_delta(left: Column, right: Column) -> Column:
    """By how many percent the left exceeds the right."""
    return F.when(right != 0, (left - right) / right * 100)
