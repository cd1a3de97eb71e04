"""Closed-form and exact statistics as columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


def wilson_interval(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    n, s, zz = total.cast("double"), successes.cast("double"), F.lit(z * z)
    p = s / n
    scale = F.lit(1.0) + zz / n
    centre = (p + zz / (F.lit(2.0) * n)) / scale
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)


def _two_sided(successes: int, trials: int) -> float:
    """Twice the smaller tail of Binomial(trials, 1/2), at most 1. Terms are added from the largest down."""
    if trials == 0:
        return 1.0
    k = min(successes, trials - successes)
    term = math.exp(math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) - trials * math.log(2.0))
    total = 0.0
    while k >= 0 and (term > total * 1e-18 or total == 0.0):
        total += term
        if term == 0.0:
            break
        term *= k / (trials - k + 1)
        k -= 1
    return min(1.0, 2.0 * total)


@F.pandas_udf(T.DoubleType())
def exact_mcnemar(one_only: pd.Series, discordant: pd.Series) -> pd.Series:
    return pd.Series([_two_sided(int(s), int(n)) for s, n in zip(one_only, discordant)], dtype="float64")


def holm_adjust(df: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """Step-down adjusted p-values within each family; ties keep the given order.

    A family is one report's set of hypotheses, a few dozen rows.
    """
    ranked = Window.partitionBy(*family).orderBy(p, *order)
    size = Window.partitionBy(*family)
    step = (F.count(F.lit(1)).over(size) - F.row_number().over(ranked) + 1).cast("double") * F.col(p)
    df = df.withColumn("__step", step)
    running = F.max("__step").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("adjusted", F.least(F.lit(1.0), running)).drop("__step")
