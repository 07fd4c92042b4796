"""Tail probabilities of test statistics as columns.

The number of steps follows from the degrees of freedom of the row, as there is no early end.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clientela.functions.probability import studentized_range_critical, studentized_range_tails

# Coefficients of Lanczos' series for the gamma function (g = 7).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
)
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function, for z of at least one half."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + c / (z + i)
    t = z + 6.5
    return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(t) - t + F.log(series)


def _guarded(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _lentz(steps: Column, c: Column, d: Column, h: Column, term) -> Column:
    """A continued fraction by Lentz's recurrence; ``term`` gives numerator and denominator of a step."""

    def step(state: Column, i: Column) -> Column:
        top, bottom = term(i.cast("double"))
        new_d = 1.0 / _guarded(bottom + top * state["d"])
        new_c = _guarded(bottom + top / state["c"])
        return F.struct(new_c.alias("c"), new_d.alias("d"), (state["h"] * new_c * new_d).alias("h"))

    start = F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), start, step, lambda s: s["h"])


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def term(i: Column) -> tuple[Column, Column]:
        m = F.floor((i + 1) / 2).cast("double")
        odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 1, odd).otherwise(even), F.lit(1.0)

    first = 1.0 / _guarded(1.0 - (a + b) * x / (a + 1.0))
    steps = 200 + 10 * F.sqrt(F.greatest(a, b))
    return _lentz(steps, F.lit(1.0), first, first, term)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function."""
    front = F.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)
    )
    low = front * _beta_fraction(a, b, x) / a
    high = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    inside = F.when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f); null if there is no statistic."""
    df1, df2 = df1.cast("double"), df2.cast("double")
    found = incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))
    return F.when(f.isNull() | (df1 <= 0) | (df2 <= 0), F.lit(None).cast("double")).when(
        f <= 0, F.lit(1.0)
    ).otherwise(found)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square > x); null if there is no statistic."""
    a, z = df.cast("double") / 2.0, x / 2.0
    front = F.exp(a * F.log(z) - z - log_gamma(a))
    steps = 200 + 20 * F.sqrt(a)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * z / (a + i)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    start = F.struct((1.0 / a).alias("term"), (1.0 / a).alias("sum"))
    series = F.aggregate(
        F.sequence(F.lit(1).cast("long"), steps.cast("long")), start, add, lambda s: s["sum"]
    )

    def term(i: Column) -> tuple[Column, Column]:
        return -i * (i - a), z + 1.0 - a + 2.0 * i

    first = 1.0 / _guarded(z + 1.0 - a)
    fraction = _lentz(steps, F.lit(1.0 / TINY), first, first, term)
    inside = F.when(z < a + 1.0, 1.0 - front * series).otherwise(front * fraction)
    return F.when(x.isNull() | (a <= 0), F.lit(None).cast("double")).when(
        x <= 0, F.lit(1.0)
    ).otherwise(inside)


def studentized_range_tail() -> callable:
    """P(Q > q) for columns ``q``, groups ``k`` and degrees of freedom: a function of three columns."""

    @F.pandas_udf("double")
    def tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
        found = pd.Series(np.nan, index=q.index)
        for (groups, free), part in pd.DataFrame({"q": q, "k": k, "df": df}).groupby(["k", "df"]):
            found[part.index] = studentized_range_tails(part["q"].to_numpy(), int(groups), float(free))
        return found

    return tail


def studentized_range_quantile(alpha: float) -> callable:
    """The q with P(Q > q) = alpha: a function of groups and degrees of freedom."""

    @F.pandas_udf("double")
    def quantile(k: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(
            [studentized_range_critical(alpha, int(a), float(b)) if a > 1 and b > 0 else np.nan
             for a, b in zip(k, df, strict=True)],
            dtype=float,
        )

    return quantile
