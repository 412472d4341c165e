"""Exact tests and intervals on aggregated counts: a few rows, whatever the input."""

from __future__ import annotations

import hashlib
from math import ceil, exp, floor, lgamma, log, log1p, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str, digits: int = 4) -> Column:
    """Rounded half to even; null where the denominator is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, F.bround(a / b, digits))


def sign_p(b: int, c: int) -> float:
    """Two-sided exact binomial p at one half, by a sum of the smaller tail from its largest term, until terms vanish."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2))  # the largest; the others follow from it downwards
    total, i = term, k
    while i and term > total * 1e-17:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    return round(min(1.0, 2 * total), 6)


def exact_sign_p(b: Column | str, c: Column | str) -> Column:
    """p of ``b`` against ``c`` discordant pairs; 1 if there are none. For aggregated rows."""

    @F.pandas_udf("double")
    def p_value(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([sign_p(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")

    return p_value(b, c)


def wilson_interval(k: Column | str, n: Column | str, z: float = 1.96) -> Column:
    """``low, high`` of the 95 % Wilson interval of ``k / n``, within 0 and 1; both null where ``n`` is 0."""
    k, n = (F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (k, n))
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.struct(F.when(n != 0, F.bround(low, 4)).alias("low"), F.when(n != 0, F.bround(high, 4)).alias("high"))


def uniform_draws(n: int, *key: object) -> np.ndarray:
    """``n`` pairs of uniform numbers: 52 bits each of the md5 of the key and a counter, so that any engine draws the same."""
    heads = [hashlib.md5("-".join(map(str, (*key, i))).encode()).hexdigest() for i in range(n)]
    return np.array([(int(h[:13], 16), int(h[13:26], 16)) for h in heads], dtype=float).reshape(n, 2) / 2.0**52


def binomial_quantiles(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """The least k for each ``u`` whose binomial distribution function is above it; sums run over twelve deviations around the mean."""
    if n == 0 or p <= 0:
        return np.zeros(len(u), dtype=np.int64)
    if p >= 1:
        return np.full(len(u), n)
    spread = 12 * sqrt(n * p * (1 - p)) + 12
    low, high = max(0, floor(n * p - spread)), min(n, ceil(n * p + spread))
    k = np.arange(low, high)
    first = lgamma(n + 1) - lgamma(low + 1) - lgamma(n - low + 1) + low * log(p) + (n - low) * log1p(-p)
    terms = first + np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1)) + log(p) - log1p(-p))])
    return np.minimum(low + np.searchsorted(np.cumsum(np.exp(terms)), u, side="right"), high)


def resampled_differences(wins: int, losses: int, n: int, n_boot: int, seed: int) -> np.ndarray:
    """Wins less losses in ``n_boot`` resamples of ``n`` pairs: how many of them differ at all, and how many of those are wins."""
    u = uniform_draws(n_boot, seed, wins, losses, n)
    differ = binomial_quantiles(n, (wins + losses) / n, u[:, 0])
    won = np.zeros(n_boot, dtype=np.int64)
    for d in np.unique(differ).tolist():
        at = differ == d
        won[at] = binomial_quantiles(d, wins / (wins + losses) if d else 0.0, u[at, 1])
    return 2 * won - differ


def bootstrap_ci(n_boot: int = 2000, seed: int = 13):
    """A function of (wins, losses, n): ``low, high`` of the percentile interval of the accuracy difference.

    Paired differences are only -1, 0 and 1, so a resample of the mentions is one multinomial draw of (wins, losses, ties), made of
    two binomial ones: the cost follows the number of resamples and the spread of the counts, not the mentions. Draws invert the
    distribution functions at numbers that depend on seed, counts and the resample alone (:func:`uniform_draws`), so they
    are the same wherever they are made. Null without mentions or resamples.
    """

    @F.pandas_udf("low double, high double")
    def interval(wins: pd.Series, losses: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for w, x, m in zip(wins, losses, n, strict=True):
            if not m or not n_boot:
                out.append((None, None))
                continue
            found = np.sort(resampled_differences(int(w), int(x), int(m), n_boot, seed))
            out.append((found[int(0.025 * n_boot)] / m, found[int(0.975 * n_boot) - 1] / m))
        return pd.DataFrame(out, columns=["low", "high"], dtype="float64")

    return interval
