"""Operators over the cross-section of a date. NULL is missing; missing rows take no part."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions import finite, nan_to_null

DATE = ("trade_date",)


def min_cross_section(panel: DataFrame, value: str, least: int = 30, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Rows of dates with at least ``least`` values."""
    return panel.withColumn("_n", F.count(value).over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def mad_clip(panel: DataFrame, value: str, n_mad: float = 5.0, median: str = "interp", out: str | None = None, keys: tuple[str, ...] = DATE) -> DataFrame:
    """Clip to the date's median plus and minus ``n_mad`` median absolute deviations (unscaled)."""
    w = Window.partitionBy(*keys)
    mid = {"interp": lambda c: F.median(c), "lower": lambda c: F.expr(f"percentile_disc(0.5) within group (order by `{c}`)")}[median]
    step = panel.withColumn("_med", mid(value).over(w)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    step = step.withColumn("_mad", mid("_dev").over(w))
    low, high = F.col("_med") - n_mad * F.col("_mad"), F.col("_med") + n_mad * F.col("_mad")
    return step.withColumn(out or value, F.when(F.col(value).isNotNull(), F.greatest(low, F.least(high, F.col(value))))).drop("_med", "_dev", "_mad")


def neutralize(panel: DataFrame, value: str, exposure: str, least: int = 30, out: str = "resid", keys: tuple[str, ...] = DATE) -> DataFrame:
    """Residual of each date's regression on 1 and one exposure; missing below ``least`` pairs; the demeaned value where the exposure is constant."""
    w = Window.partitionBy(*keys)
    both = F.col(value).isNotNull() & F.col(exposure).isNotNull()
    step = panel.withColumn("_y", F.when(both, F.col(value))).withColumn("_x", F.when(both, F.col(exposure)))
    slope, fit = F.regr_slope("_y", "_x").over(w), F.regr_intercept("_y", "_x").over(w)
    resid = F.col("_y") - F.coalesce(fit + slope * F.col("_x"), F.avg("_y").over(w))
    return step.withColumn(out, F.when(F.count("_y").over(w) >= least, resid)).drop("_y", "_x")


def neutralize_group(panel: DataFrame, value: str, exposure: str, group: str, least: int = 30, out: str = "resid", keys: tuple[str, ...] = DATE) -> DataFrame:
    """Residual on group dummies and one exposure: both are demeaned within (date, group), then regressed without intercept."""
    w, g = Window.partitionBy(*keys), Window.partitionBy(*keys, group)
    both = F.col(value).isNotNull() & F.col(exposure).isNotNull() & F.col(group).isNotNull()
    step = panel.withColumn("_y", F.when(both, F.col(value))).withColumn("_x", F.when(both, F.col(exposure)))
    step = step.withColumn("_yd", F.col("_y") - F.avg("_y").over(g)).withColumn("_xd", F.col("_x") - F.avg("_x").over(g))
    slope = F.coalesce(F.try_divide(F.sum(F.col("_yd") * F.col("_xd")).over(w), F.sum(F.col("_xd") * F.col("_xd")).over(w)), F.lit(0.0))
    return step.withColumn(out, F.when(F.count("_y").over(w) >= least, F.col("_yd") - slope * F.col("_xd"))).drop("_y", "_x", "_yd", "_xd")


def _solved(gram: pd.Series, cross: pd.Series) -> pd.Series:
    """Slopes of one date's normal equations, scaled to correlations; what others explain gets its least-norm share."""
    out = []
    for g, c in zip(gram, cross):
        c = np.asarray(c, float)
        g = np.asarray(g, float).reshape(len(c), len(c))
        size = np.sqrt(np.diag(g))
        unit = np.where(size > 0, size, 1.0)
        out.append(np.linalg.pinv(g / np.outer(unit, unit), rcond=1e-10, hermitian=True) @ (c / unit) / unit)
    return pd.Series(out)


def regression(panel: DataFrame, value: str, exposures: list[str], keys: tuple[str, ...] = DATE) -> DataFrame:
    """One row a date: ``keys, _n, _y`` (mean of the value), ``_x`` (means of the exposures) and ``_b`` (slopes) over rows that have all.

    Means and covariances are one aggregate, combined before the shuffle; only these few numbers a date are solved. One or
    two exposures are solved by expressions, more by a pseudo-inverse of the date's matrix.
    """
    m = len(exposures)
    whole = reduce(lambda a, b: a & b, [finite(F.col(c).cast("double")) for c in (value, *exposures)])
    x, y = [F.col(c).cast("double") for c in exposures], F.col(value).cast("double")
    sums = [F.count("*").alias("_n"), F.avg(y).alias("_y"), F.array(*map(F.avg, x)).alias("_x")]
    gram = [F.covar_pop(x[min(i, j)], x[max(i, j)]) for i in range(m) for j in range(m)]
    made = panel.where(whole).groupBy(*keys).agg(*sums, F.array(*gram).alias("_g"), F.array(*[F.covar_pop(e, y) for e in x]).alias("_c"))
    g, c = (lambda i, j: F.get("_g", F.lit(i * m + j))), (lambda i: F.get("_c", F.lit(i)))
    one = lambda i: F.when(g(i, i) > 0, c(i) / g(i, i)).otherwise(0.0)
    if m == 1:
        slopes = F.array(one(0))
    elif m == 2:
        det, full = g(0, 0) * g(1, 1) - g(0, 1) * g(0, 1), g(0, 0) * g(1, 1)
        apart = det > 1e-10 * full  # else one exposure says what both do
        both = F.array((g(1, 1) * c(0) - g(0, 1) * c(1)) / det, (g(0, 0) * c(1) - g(0, 1) * c(0)) / det)
        slopes = F.when(apart & (full > 0), both).when(g(0, 0) > 0, F.array(one(0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), one(1)))
    else:
        slopes = F.pandas_udf(_solved, "array<double>")("_g", "_c")
    return made.select(*keys, "_n", "_y", "_x", slopes.alias("_b"))


def neutralize_many(panel: DataFrame, value: str, exposures: list[str], least: int = 30, out: str = "resid", keys: tuple[str, ...] = DATE) -> DataFrame:
    """Residual of each date's least squares on 1 and several exposures; missing where a value is, and below ``least`` rows.

    Rows of the panel are not shuffled for it: the slopes of a date (:func:`regression`, one row a date) are broadcast.
    """
    fit = F.broadcast(regression(panel, value, exposures, keys))
    resid = F.col(value).cast("double") - F.col("_y")
    for i, e in enumerate(exposures):
        resid = resid - F.get("_b", F.lit(i)) * (F.col(e).cast("double") - F.get("_x", F.lit(i)))
    return panel.join(fit, list(keys), "left").withColumn(out, F.when(F.col("_n") >= least, nan_to_null(resid))).drop("_n", "_y", "_x", "_b")


def average_rank(panel: DataFrame, value: str, out: str = "rank", keys: tuple[str, ...] = DATE) -> DataFrame:
    """Ascending rank with the mean rank for ties; missing values have none."""
    w = Window.partitionBy(*keys)
    mean = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2)
    return panel.withColumn(out, F.when(F.col(value).isNotNull(), mean.cast("double")))


def spread_rank(rows: DataFrame, value: str, out: str = "rank", keys: tuple[str, ...] = (), parts: int = 128) -> DataFrame:
    """:func:`average_rank` of large groups: values are dealt into ``parts`` ranges of a group, ranked inside, and shifted by the sizes of the lower ranges.

    The ranges' bounds are a few numbers a group of ``keys``, of which there must be few. Rows without a value have no rank.
    """
    live = rows.where(F.col(value).isNotNull())
    quantiles = F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000)
    bounds = live.groupBy(*keys).agg(quantiles.alias("_bounds"))
    both = live.join(F.broadcast(bounds), list(keys)) if keys else live.crossJoin(F.broadcast(bounds))
    cut = both.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    lower = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_range", F.coalesce(lower, F.lit(0)).alias("_start"))  # parts rows a group
    inside = average_rank(cut, value, out, (*keys, "_range")).join(F.broadcast(starts), [*keys, "_range"])
    return inside.withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_start")


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate over pairs; missing if degenerate."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ic(panel: DataFrame, score: str, future: str, keys: tuple[str, ...] = DATE, out: str = "ic") -> DataFrame:
    return panel.groupBy(*keys).agg(pearson(score, future).alias(out))


def rank_ic(panel: DataFrame, score: str, future: str, keys: tuple[str, ...] = DATE, out: str = "rank_ic") -> DataFrame:
    """Correlation of average ranks over rows that have both values."""
    live = panel.where(F.col(score).isNotNull() & F.col(future).isNotNull())
    return ic(average_rank(average_rank(live, score, "_rs", keys), future, "_rf", keys), "_rs", "_rf", keys, out)


def quantile_groups(panel: DataFrame, score: str, groups: int = 10, out: str = "decile", keys: tuple[str, ...] = DATE) -> DataFrame:
    """Groups 1 (lowest) to ``groups`` of near-equal size, the first ones larger by one; ties by instrument."""
    return panel.where(F.col(score).isNotNull()).withColumn(out, F.ntile(groups).over(Window.partitionBy(*keys).orderBy(score, "instrument")).cast("long"))


def coverage_ratio(panel: DataFrame, value: str, keys: tuple[str, ...] = DATE) -> DataFrame:
    return panel.groupBy(*keys).agg((F.count(value) / F.count("*")).alias("coverage"))
