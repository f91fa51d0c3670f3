"""Write amplification, and whether keys and values should be stored apart."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def write_amplification(zeta: Column, n: Column, key_bytes: Column, value_bytes: Column, threshold: Column) -> tuple[Column, Column]:
    """Write amplification without and with separation.

    ``a = 1 + zeta / n``; without: ``a (K + V)``; with: ``a K``, and ``a V`` more where
    ``threshold < zeta``.
    """
    a = 1 + zeta / n
    return a * (key_bytes + value_bytes), a * key_bytes + F.when(threshold < zeta, a * value_bytes).otherwise(0.0)


def separates(zeta: Column, n: Column, key_bytes: Column, value_bytes: Column, threshold: Column, factor: float = 1.0) -> Column:
    """Whether separation pays by ``factor``."""
    without, apart = write_amplification(zeta, n, key_bytes, value_bytes, threshold)
    return factor * apart < without


_cdf = np.frompyfunc(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), 1, 1)


def zeta_of(n: int, generation_gap: float, delay: float, k: int, samples: int, mu: float, sigma: float, steps: int = 1000) -> float:
    """Expected points that fall behind, from sampled numeric integrals.

    For every sampled position the density of a Normal delay is integrated (left
    Riemann sum) against the chance that none of the next ``n`` points overtakes.
    """
    if samples <= 0 or k <= 0:
        return 0.0
    stride = max(1, k // samples)
    x = np.arange(steps) * ((mu + 5 * sigma) / steps)
    density = np.exp(-((x - mu) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    ahead = np.arange(1, n + 1)[:, None] * (generation_gap + delay) + x[None, :]
    total = 0.0
    for i in range(0, k, stride):
        # Beyond 40 deviations the factor is 1 in double precision.
        z = (ahead + i * (generation_gap + delay) - mu) / sigma
        z = z[z.min(1) < 40]
        product = _cdf(z).astype(float).prod(axis=0) if len(z) else 1.0
        total += 1.0 - float((density * product).sum() * (mu + 5 * sigma) / steps)
    return k / ((k + stride - 1) // stride) * total


def zeta(n: Column, generation_gap: Column, delay: Column, k: int = 30_000, samples: int = 10, mu: float = 40.0, sigma: float = 5.0) -> Column:
    """:func:`zeta_of` as a column: the one vectorised Python function, over block statistics."""

    @F.pandas_udf("double")
    def run(n: pd.Series, gap: pd.Series, delay: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        for key in set(zip(n, gap, delay, strict=True)):
            known[key] = zeta_of(int(key[0]), float(key[1]), float(key[2]), k, samples, mu, sigma)
        return pd.Series([known[key] for key in zip(n, gap, delay, strict=True)])

    return run(n, generation_gap, delay)
