"""Numbers behind block encodings: deltas, zigzag, which encoding fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3 (as the bits of a signed 64-bit number)."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    """The inverse of :func:`zigzag`."""
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(1)))


def scale_of(delta: Column, top: int = 12) -> Column:
    """The largest power of ten, up to ``10**top``, that divides a number."""
    out = F.lit(1).cast("bigint")
    for n in range(1, top + 1):
        out = F.when(delta % (10**n) == 0, F.lit(10**n).cast("bigint")).otherwise(out)
    return out
