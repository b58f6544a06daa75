"""Statistics shared by the roll-ups: exact percentiles and the paired t-test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import TARGET_ROWS, Seq, key_join, running


def exact_percentiles(
    df: DataFrame, keys: tuple[str, ...], value: str, ps: dict[str, float], width: float | None = None, rows: int | None = TARGET_ROWS
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, ``{name: p}``; nulls are skipped.

    The built-in exact percentile holds all distinct values of a group in one buffer.  Here equal
    values are counted first and the ranks are found from running counts over blocks of at most about
    ``rows`` distinct values (with ``rows=None``: value blocks of ``width``), so that a group of any size
    and any distribution is spread over many tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counted, Seq(keys, (value,), width, rows), {"_cum": ("sum", F.col("_c"))})
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    ranked = ranked.transform(key_join, n, keys)
    spots = {name: (F.col("_n") - 1) * p for name, p in ps.items()}
    out = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.min(F.when(F.col("_cum") > F.floor(at), F.col(value))).alias(f"_lo_{n}") for n, at in spots.items()],
        *[F.min(F.when(F.col("_cum") > F.ceil(at), F.col(value))).alias(f"_hi_{n}") for n, at in spots.items()],
    )
    return out.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (at - F.floor(at))).alias(n)
            for n, at in spots.items()
        ],
    )


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        f *= step
        if abs(1.0 - step) < 1e-15:
            break
    return front * (f - 1.0)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    def one(tv, nu):
        if pd.isna(tv) or pd.isna(nu) or nu <= 0:
            return None
        if math.isinf(tv):
            return 0.0
        return _beta_tail(nu / (nu + tv * tv), nu / 2.0, 0.5)

    return pd.Series([one(a, b) for a, b in zip(t, dof)], dtype="float64")


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t; runs on aggregated rows only."""
    return _t_two_sided(t.cast("double"), dof.cast("double"))


def paired_test(df: DataFrame, keys: tuple[str, ...], a: str, b: str, alpha: float = 0.05, fallback: bool = True) -> DataFrame:
    """Paired t statistic, p-value, significance, and the variance-based fallback rule.

    Differences that are all equal have no finite t.  With ``fallback`` they have no p-value either and
    the variance-based rule decides on them; without it t is infinite and p is 0 (both NaN if all
    differences are 0), a single pair has neither, and significance is that of the p-value alone.  A spread
    within the rounding error of the values counts as none there.
    """
    d = F.col(b) - F.col(a)
    out = df.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s"), F.stddev_pop(d).alias("_p"),
        F.max(F.greatest(F.abs(a), F.abs(b))).alias("_m"),
    )
    t = F.when(F.col("_s") > 0, F.col("mean_diff") / (F.col("_s") / F.sqrt("n")))
    p = t_two_sided_p(F.col("t_stat"), F.col("n") - 1)
    if not fallback:
        sign, noise = F.signum("mean_diff"), F.col("_m") * 1e-14
        flat = F.when(F.abs("mean_diff") > noise, sign * F.lit(math.inf)).otherwise(F.lit(math.nan))
        t = F.when(F.col("_s") <= noise, flat).otherwise(t)
        p = F.when(F.isnan("t_stat"), F.lit(math.nan)).otherwise(p)
    out = out.withColumn("t_stat", t).withColumn("p_value", p)
    spread = F.when(F.col("_p") > 0, F.abs("mean_diff") > 2 * F.col("_p")).otherwise(F.col("mean_diff") != 0)
    return out.select(
        *keys,
        "n",
        "mean_diff",
        "t_stat",
        "p_value",
        F.coalesce(F.col("p_value") < alpha, spread if fallback else F.lit(None)).alias("significant"),
        spread.alias("significant_fallback"),
    )
