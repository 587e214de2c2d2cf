"""Backward rolling operators of an instrument over trading days (``date_idx``), so that gaps in its rows count as days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions import spread


def trailing(days: int, keys: tuple[str, ...] = ("instrument",)):
    return Window.partitionBy(*keys).orderBy("date_idx").rangeBetween(-(days - 1), 0)


def lagged(panel: DataFrame, value: str, days: int = 1, out: str | None = None, keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """The value exactly ``days`` trading days before; missing where that day has no row."""
    at = Window.partitionBy(*keys).orderBy("date_idx").rangeBetween(-days, -days)
    return panel.withColumn(out or f"{value}_lag", F.first(value).over(at))


def rolling_std(panel: DataFrame, value: str, window: int = 60, ddof: int = 1, min_periods: int = 2, out: str = "ts_std", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Deviation over the last ``window`` days; partial windows count from ``min_periods`` values."""
    w = trailing(window, keys)
    return panel.withColumn(out, F.when(F.count(value).over(w) >= min_periods, spread(value, ddof).over(w)))


def trailing_mean(panel: DataFrame, value: str, days: int = 10, out: str = "ts_mean", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Mean over the last ``days`` days; missing until all of them have a value."""
    w = trailing(days, keys)
    return panel.withColumn(out, F.when(F.count(value).over(w) == days, F.avg(value).over(w)))


def trailing_volatility(panel: DataFrame, price: str = "close", window: int = 60, out: str = "vol", keys: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Deviation of the last ``window`` daily returns; missing unless all are there."""
    w = trailing(window, keys)
    with_ret = lagged(panel, price, 1, "_before", keys).withColumn("_ret", F.try_divide(F.col(price), F.col("_before")) - 1)
    return with_ret.withColumn(out, F.when(F.count("_ret").over(w) == window, F.stddev_samp("_ret").over(w))).drop("_before", "_ret")
