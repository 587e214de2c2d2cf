"""Rebalance dates, forward returns, long-short books, turnover, costs and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COST = 0.0030


def rebalance_dates(days: DataFrame, unit: str = "week", by: tuple[str, ...] = ()) -> DataFrame:
    """The last trading date of each week (or month), numbered; of each calendar that the columns ``by`` tell apart."""
    last = F.max("trade_date").over(Window.partitionBy(*by, F.date_trunc(unit, "trade_date")))
    ends = days.select(*by, "trade_date").distinct().withColumn("_last", last).where("trade_date = _last").drop("_last")
    return ends.withColumn("rb_idx", (F.row_number().over(Window.partitionBy(*by).orderBy("trade_date")) - 1).cast("long"))


def forward_return(panel: DataFrame, rebalances: DataFrame, price: str = "close", out: str = "fwd", by: tuple[str, ...] = ()) -> DataFrame:
    """Price at the next rebalance over this one, less 1, on rebalance dates; missing where either is. All columns are kept."""
    at = panel.join(F.broadcast(rebalances), [*by, "trade_date"])  # one row a rebalance
    w = Window.partitionBy(*by, "instrument").orderBy("rb_idx")
    ahead = F.when(F.lead("rb_idx").over(w) == F.col("rb_idx") + 1, F.lead(price).over(w))
    return at.withColumn(out, F.try_divide(ahead, F.col(price)) - 1)


def long_short_weights(deciles: DataFrame, groups: int = 10, keys: tuple[str, ...] = ("rb_idx",), decile: str = "decile") -> DataFrame:
    """Plus 1/n in the top group, minus 1/n in the bottom one, 0 between."""
    n = F.count("*").over(Window.partitionBy(*keys, decile))
    return deciles.withColumn("weight", F.when(F.col(decile) == groups, F.lit(1.0) / n).when(F.col(decile) == 1, F.lit(-1.0) / n).otherwise(0.0))


def gross_return(book: DataFrame, future: str = "fwd", keys: tuple[str, ...] = ("rb_idx",)) -> DataFrame:
    return book.groupBy(*keys).agg(F.sum(F.col("weight") * F.coalesce(F.col(future), F.lit(0.0))).alias("gross"))


def effective_index(book: DataFrame) -> DataFrame:
    """Number the scored rebalances only (``eff_idx``): one row a rebalance is numbered."""
    scored = book.select("rb_idx").distinct().withColumn("eff_idx", (F.row_number().over(Window.orderBy("rb_idx")) - 1).cast("long"))
    return book.join(F.broadcast(scored), "rb_idx")  # one row a rebalance


def turnover(book: DataFrame, universe: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Half the absolute change of weights from the book of the rebalance before; 1 for the first.

    With ``universe`` (``eff_idx, instrument``) the book carried into each rebalance that it lists keeps only the names it
    lists there: others leave without turnover.
    Each name's weights are compared along its own rebalances: a weight that the next book lacks
    counts there as sold. Several books are told apart by the columns ``by``.
    """
    w = Window.partitionBy(*by, "instrument").orderBy("eff_idx")
    near = book.select(*by, "eff_idx", "instrument", "weight", F.lag("eff_idx").over(w).alias("_p"), F.lag("weight").over(w).alias("_was"), F.lead("eff_idx").over(w).alias("_n"))
    held = F.abs(F.col("weight") - F.when(F.col("_p") == F.col("eff_idx") - 1, F.col("_was")).otherwise(0.0))
    sold = F.when(F.coalesce(F.col("_n") != F.col("eff_idx") + 1, F.lit(True)), F.abs("weight"))
    sides = F.array(F.struct("eff_idx", held.alias("move"), F.lit(1).alias("own")), F.struct((F.col("eff_idx") + 1).alias("eff_idx"), sold.alias("move"), F.lit(0).alias("own")))
    moves = near.select(*by, "instrument", F.inline(sides)).where("move is not null")
    if universe is not None:
        sold, listed = moves.where("own = 0"), F.broadcast(universe.select(*by, "eff_idx").distinct())  # at most a row a rebalance
        kept = sold.join(listed, [*by, "eff_idx"], "left_semi").join(universe, [*by, "eff_idx", "instrument"], "left_semi")
        moves = moves.where("own = 1").unionByName(sold.join(listed, [*by, "eff_idx"], "left_anti")).unionByName(kept)
    sums = moves.groupBy(*by, "eff_idx").agg((0.5 * F.sum("move")).alias("_t"), F.max("own").alias("_own")).where("_own = 1")  # no book follows the last
    return sums.select(*by, "eff_idx", F.when(F.col("eff_idx") == 0, 1.0).otherwise(F.col("_t")).alias("turnover"))


def net_return(gross: DataFrame, turn: DataFrame, cost: float = COST, by: tuple[str, ...] = ()) -> DataFrame:
    return gross.join(turn, [*by, "eff_idx"]).withColumn("net", F.col("gross") - cost * F.col("turnover"))


def total_return(series: DataFrame, value: str, keys: tuple[str, ...] = (), out: str = "total") -> DataFrame:
    return series.groupBy(*keys).agg((F.product(1 + F.col(value)) - 1).alias(out))


def mean_and_ir(series: DataFrame, value: str, keys: tuple[str, ...] = (), periods: int = 52) -> DataFrame:
    """Mean, and mean over deviation times the root of the periods in a year."""
    ir = F.try_divide(F.avg(value), F.stddev_samp(value)) * F.sqrt(F.lit(float(periods)))
    return series.groupBy(*keys).agg(F.avg(value).alias("mean"), ir.alias("ir"), F.count(value).alias("n"))


def group_totals(deciles: DataFrame, future: str = "fwd") -> DataFrame:
    """Compounded mean forward return of each group."""
    per = deciles.groupBy("rb_idx", "decile").agg(F.avg(future).alias("r"))
    return total_return(per, "r", ("decile",))


def tolerance_report(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """``metric, value`` against ``metric, want, tol``: the difference and whether it is within tolerance."""
    return metrics.join(expected, "metric", "right").withColumn("diff", F.abs(F.col("value") - F.col("want"))).withColumn("ok", F.coalesce(F.col("diff") <= F.col("tol"), F.lit(False)))


def period_bounds(series: DataFrame, periods: DataFrame) -> DataFrame:
    """First and last number of a series (``eff_idx, trade_date``) in each period (``period, begin, finish``), both ends included."""
    inside = series.join(F.broadcast(periods), F.col("trade_date").between(F.col("begin"), F.col("finish")))
    return inside.groupBy("period").agg(F.min("eff_idx").alias("first_idx"), F.max("eff_idx").alias("last_idx"), F.count("*").alias("n"))
