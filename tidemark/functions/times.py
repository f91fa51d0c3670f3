"""Nanosecond time literals, on the driver and as columns."""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_NS, MIN_NS

_ISO = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d:\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:\d\d)| (\d\d:\d\d:\d\d)(?:[.,](\d+))?)")


def literal_ns(text: str) -> int:
    """Nanoseconds of a literal: ``now()``, an integer, an RFC 3339 time, or ``date time`` in UTC."""
    text = text.strip()
    if text.lower() == "now()":
        return time.time_ns()
    if re.fullmatch(r"[+-]?\d+", text) and MIN_NS <= int(text) <= MAX_NS:
        return int(text)
    found = _ISO.fullmatch(text)
    if not found:
        raise ValueError(f"not a timestamp: {text!r}")
    day, clock, fraction, zone, plain, plain_fraction = found.groups()
    moment = datetime.datetime.fromisoformat(f"{day}T{clock or plain}{'+00:00' if zone in (None, 'Z') else zone}")
    seconds = (moment - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(seconds=1)
    return seconds * 1_000_000_000 + int(((fraction or plain_fraction or "") + "0" * 9)[:9])


def literal_ns_column(text: Column) -> Column:
    """The same for a column of literals; null where one cannot be read.

    Fractions keep all nine digits, which a timestamp type would drop.
    """
    text = F.trim(text)
    pattern = r"^(\d{4}-\d\d-\d\d)[T ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:\d\d)?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    zoned = F.substring(text, 11, 1) == "T"
    well_formed = text.rlike(pattern) & (zoned == (part(6) != ""))
    zone = F.when(part(6).isin("", "Z"), F.lit(0)).otherwise(
        F.when(part(6).startswith("-"), -1).otherwise(1) * (number(F.substring(part(6), 2, 2)) * 3600 + number(F.substring(part(6), 5, 2)) * 60)
    )
    days = F.unix_date(part(1).try_cast("date")).cast("bigint")
    seconds = days * 86400 + number(part(2)) * 3600 + number(part(3)) * 60 + number(part(4)) - zone
    valid = (number(part(2)) < 24) & (number(part(3)) < 60) & (number(part(4)) < 60)
    iso = F.when(well_formed & valid, seconds * 1_000_000_000 + F.rpad(F.substring(part(5), 1, 9), 9, "0").try_cast("bigint"))
    now = F.unix_micros(F.current_timestamp()) * 1000
    return F.when(F.lower(text) == "now()", now).otherwise(F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), iso))


def column_ns(ts: str) -> Column:
    """Nanoseconds of a timestamp column without time zone, whatever the session's zone."""
    t = f"cast({ts} as timestamp_ntz)"
    return F.expr(f"(unix_date(cast({t} as date)) * 86400L + hour({t}) * 3600L + minute({t}) * 60L) * 1000000000L + cast(extract(second from {t}) * 1000000 as bigint) * 1000L")


def micros_literal(us: int) -> Column:
    """A timestamp without time zone at ``us`` microseconds, for filters that reach the scan."""
    moment = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)
    return F.expr(f"timestamp_ntz'{moment.isoformat(sep=' ')}'")


def rfc3339(ns: Column) -> Column:
    """UTC text of nanoseconds, fraction without trailing zeros, whatever the session's zone."""
    seconds = F.floor(ns / F.lit(10**9).cast("decimal(20,0)")).cast("bigint")
    days = F.floor(seconds / F.lit(86400).cast("decimal(20,0)")).cast("int")
    rest = seconds - days.cast("bigint") * 86400
    two = lambda x: F.lpad(F.floor(x).cast("bigint").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3600), two(rest % 3600 / 60), two(rest % 60))
    fraction = F.rtrim(F.lpad(F.pmod(ns, F.lit(10**9).cast("bigint")).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.date_from_unix_date(days).cast("string"), F.lit("T"), clock, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))
