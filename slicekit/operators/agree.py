"""Correlation between metrics (M3, M4).

``corr`` in Spark raises under ANSI mode when a column is constant; here r is
``covar_samp / (stddev_samp * stddev_samp)`` with ``try_divide`` so a constant
column yields null, which is what a reader of the table needs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MT_METRICS


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate expression: sample Pearson r, null when undefined."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


#: Beyond so many degrees of freedom the t tail is taken from the normal one.
_MANY = 20_000


def t_two_sided(r: float, df: int) -> float:
    """P(|correlation| >= |r|) with ``df`` degrees of freedom and no true correlation.

    With sin(a) = |r| the probability is a power series in cos(a) that starts
    where the finite sum for the central part ends, so small tails lose no digits:
    even df: sin a * sum of c_k cos^2k a over k >= df/2, c_k = (2k-1)!!/(2k)!!;
    odd df: 2/pi * sin a * sum of d_k cos^(2k+1) a over k >= (df-1)/2, d_k = (2k)!!/(2k+1)!!.
    For a very small r, whose series is long and whose p is not small, one minus
    the finite sum is used."""
    s, c2 = abs(r), 1.0 - r * r
    odd = df % 2
    start = df // 2
    if df > _MANY:  # the normal deviate that matches a t value best
        z = math.sqrt(-df * math.log1p(-r * r)) * (8 * df + 1) / (8 * df + 3)
        return math.erfc(z / math.sqrt(2))
    if s > 0.005:  # each term is at most c2 times the one before: some 40 / s**2 terms
        if odd:
            log_d = 0.5 * math.log(math.pi) - math.log(2) + math.lgamma(start + 1) - math.lgamma(start + 1.5)
            term, scale = math.exp(log_d + (start + 0.5) * math.log(c2)) if c2 > 0 else 0.0, 2 / math.pi * s
        else:
            log_c = math.lgamma(start + 0.5) - math.lgamma(start + 1) - 0.5 * math.log(math.pi)
            term, scale = math.exp(log_c + start * math.log(c2)) if c2 > 0 else 0.0, s
        total, k = 0.0, start
        while term > total * 1e-17:
            total += term
            term *= c2 * ((2 * k + 2) / (2 * k + 3) if odd else (2 * k + 1) / (2 * k + 2))
            k += 1
        return scale * total
    term, total = (math.sqrt(c2), 0.0) if odd else (1.0, 0.0)
    for k in range(start):
        total += term
        term *= c2 * ((2 * k + 2) / (2 * k + 3) if odd else (2 * k + 1) / (2 * k + 2))
    inside = 2 / math.pi * (math.asin(s) + s * total) if odd else s * total
    return min(1.0, max(0.0, 1.0 - inside))


def pearson_p_value(r: float | None, n: int | None) -> float | None:
    """Two-sided p of H0: rho = 0 (t test with n - 2 degrees of freedom)."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r, n - 2)


def sql_p(r: str, n: str, steps: int = 20_000) -> str:
    """The oracle: p as a ratio of integrals of cos^(n-3), midpoint sums over ``range()``."""
    angle = f"asin(least(abs({r}), 1.0))"
    part = lambda lo: (f"(SELECT sum(pow(cos({lo} + (pi() / 2 - {lo}) * (i + 0.5) / {steps}), {n} - 3)) "  # noqa: E731
                       f"FROM range({steps}) t(i)) * (pi() / 2 - {lo})")
    return f"CASE WHEN {n} >= 3 THEN {part(angle)} / ({part('0.0')}) END"


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Vectorised over *aggregated* rows (one per correlation), never per data row."""
    return pd.Series([pearson_p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
                      for a, b in zip(r, n)], dtype="float64")


def pearson_r(df: DataFrame, x: str, y: str, group_cols: tuple[str, ...] = (), with_p: bool = True) -> DataFrame:
    """M3: r (and p) between two columns, per group; rows with a null in x or y are skipped."""
    sub = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = (sub.groupBy(*group_cols) if group_cols else sub.groupBy()).agg(
        F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r"))
    if not with_p:
        return g
    from ..session import ship_package
    ship_package(df.sparkSession)
    return g.withColumn("p", pearson_p("r", "n"))


def metric_agreement(flat: DataFrame, metrics: tuple[str, ...] = MT_METRICS, min_rows: int = 5) -> DataFrame:
    """M4: pairwise Pearson matrix over rows where *every* metric is present
    (listwise deletion), as long (metric_a, metric_b, r, n); fewer than
    ``min_rows`` complete rows -> empty result."""
    cond = F.lit(True)
    for m in metrics:
        cond = cond & F.col(m).isNotNull()
    sub = flat.filter(cond).select(*[F.col(m).cast("double").alias(m) for m in metrics])
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1:]]
    aggs = [F.count(F.lit(1)).alias("n")] + [pearson(a, b).alias(f"{a}__{b}") for a, b in pairs]
    aggs += [F.stddev_samp(m).alias(f"sd__{m}") for m in metrics]
    g = sub.agg(*aggs)
    cells = []
    for a in metrics:
        for b in metrics:
            if a == b:
                val = F.when(F.col(f"sd__{a}") > 0, F.lit(1.0))
            else:
                key = f"{a}__{b}" if (a, b) in pairs else f"{b}__{a}"
                val = F.col(key)
            cells.append(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), val.alias("r")))
    return g.filter(F.col("n") >= min_rows).select("n", F.inline(F.array(*cells))) \
            .select("metric_a", "metric_b", "r", "n")
