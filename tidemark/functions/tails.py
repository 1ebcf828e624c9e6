"""Tail probabilities, the one thing Spark SQL lacks; applied to a handful of summary rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2)) if x == x else math.nan


def t_sf(t: float, df: float) -> float:
    """P(T > t): half the regularised incomplete beta function, by its continued fraction (Lentz)."""
    if not (t == t and df == df) or df <= 0:
        return math.nan
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                step = c * d
                h *= step
            if abs(step - 1) < 1e-15:
                break
        return h

    if x >= 1:
        beta = 1.0
    elif x < (a + 1) / (a + b + 2):
        beta = front * fraction(a, b, x) / a
    else:
        beta = 1 - front * fraction(b, a, 1 - x) / b
    return 0.5 * beta if t >= 0 else 1 - 0.5 * beta


@F.pandas_udf(T.DoubleType())
def _normal(x: pd.Series) -> pd.Series:
    return x.astype(float).map(normal_sf)


@F.pandas_udf(T.DoubleType())
def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf(a, b) for a, b in zip(t.astype(float), df.astype(float))])


def normal_tail(x: Column) -> Column:
    """One-sided upper tail of the standard normal."""
    return F.when(x.isNotNull(), _normal(x))


def student_tail(t: Column, df: Column) -> Column:
    return F.when(t.isNotNull() & df.isNotNull(), _student(t, df.cast("double")))


STEPS, REACH = 400, 10.0


def _density_area(start: str, df: str) -> str:
    """SQL for the integral of cos^(df - 1) from ``start`` over REACH standard widths, at most to pi / 2, by Simpson's rule.

    With x = sqrt(df) tan(angle) this is the Student density up to a factor; beyond REACH widths it is below 1e-20."""
    stop = f"least(pi() / 2, {start} + {REACH} / sqrt({df}))"
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    value = f"{weight} * exp(({df} - 1) * ln(greatest(cos({start} + ({stop} - {start}) * i / {STEPS}), 1e-300)))"
    return f"(({stop} - {start}) / {3 * STEPS} * aggregate(sequence(0, {STEPS}), 0D, (s, i) -> s + {value}))"


def student_two_sided(t: str, df: str) -> Column:
    """Two-sided Student p-value of columns or expressions, inside the JVM; NULL where the statistic is unknown or the
    degrees of freedom are not positive."""
    t, df = f"CAST({t} AS DOUBLE)", f"CAST({df} AS DOUBLE)"
    p = f"least({_density_area(f'atan(abs({t}) / sqrt({df}))', df)} / {_density_area('CAST(0 AS DOUBLE)', df)}, 1)"
    return F.expr(f"CASE WHEN {t} IS NOT NULL AND NOT isnan({t}) AND {df} > 0 THEN {p} END")
