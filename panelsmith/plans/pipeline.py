"""The factor, signal and replay plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.operators import backtest as b
from panelsmith.operators import intraday, rolling
from panelsmith.operators import xsection as x
from panelsmith.sources.panel import calendar, period_codes, period_days, with_date_idx


@dataclass(frozen=True)
class Params:
    """The adopted parameters of both stages, and how the job runs; only those given explicitly replace them."""

    horizon: int = 5
    response_window: int = 5
    top_k: int = 10
    exclude_before: int = 15
    min_gap: int = 5
    ts_std: int = 60
    vol_window: int = 60
    smooth_days: int = 10
    n_mad: float = 5.0
    least: int = 30
    direction: int = -1
    warmup_days: int = 80
    smooth_on_warmup: bool = False


def daily_response(bars: DataFrame, horizon: int = 5, response_window: int = 5, top_k: int = 10, exclude_before: int = 15, min_gap: int = 5) -> DataFrame:
    """``instrument, trade_date, mean_response``: dispersion after the day's separated volume peaks; one exchange of bars."""
    response = intraday.forward_std(intraday.log_return(bars, horizon), "log_ret", response_window)
    return intraday.event_mean(response, "fwd_std", "volume", top_k, exclude_before, min_gap, "mean_response")


def raw_factor(bars: DataFrame, horizon: int = 5, response_window: int = 5, top_k: int = 10, exclude_before: int = 15, min_gap: int = 5, ts_std: int = 60) -> DataFrame:
    """Dispersion after the day's separated volume peaks, and its deviation over the last days: one exchange of bars, one of days."""
    daily = daily_response(bars, horizon, response_window, top_k, exclude_before, min_gap)
    return rolling.rolling_std(with_date_idx(daily, calendar(bars)), "mean_response", ts_std, out="factor")


def signal_from_raw(panel: DataFrame, value: str, exposure: str, days: int = 10, n_mad: float = 5.0, least: int = 30, direction: int = -1, by: tuple[str, ...] = ()) -> DataFrame:
    """Pool mask, clip, residual, smoothing, clip, direction. ``panel`` has in_pool and date_idx; several panels are told apart by the columns ``by``."""
    date, name = (*by, "trade_date"), (*by, "instrument")
    s = panel.withColumn("_v", F.when(F.col("in_pool"), F.col(value)))
    s = x.neutralize(x.mad_clip(s, "_v", n_mad, keys=date), "_v", exposure, least, "_r", date)
    s = rolling.trailing_mean(s, "_r", days, "_m", name).withColumn("_m", F.when(F.col("in_pool"), F.col("_m")))
    return x.mad_clip(s, "_m", n_mad, keys=date).withColumn("signal", F.col("_m") * direction).drop("_v", "_r", "_m")


def period_tables(response: DataFrame, daily: DataFrame, membership: DataFrame, periods: DataFrame, p: Params = Params()) -> DataFrame:
    """``period, instrument, trade_date, raw, signal``: every instrument of a period's universe on each of its days, missing where invalid.

    Each ``period, begin, finish`` has the universe of who is a member on any of its days, and ``p.warmup_days`` trading days of
    history that only rolling values see. Days may belong to one period and warm up another: cells are told apart by
    period before any window. The pool is membership and a close. The exposure sees the warmup. The factor is
    scoped to the period before it is made neutral and smoothed, so the first ``smooth_days - 1`` days of a
    period have no signal; with ``p.smooth_on_warmup`` it is scoped last.

    ``response``: instrument, trade_date, mean_response (:func:`daily_response`); ``daily``: instrument, trade_date, close, whose days
    are the calendar; ``membership``: instrument, trade_date.
    """
    span = period_days(calendar(daily), periods, p.warmup_days)
    grid = period_codes(membership, span).join(F.broadcast(span), "period")  # the days of a period are few
    key = ["instrument", "trade_date"]
    pool = membership.select(*key).distinct().withColumn("_member", F.lit(True))
    cells = grid.join(daily.select(*key, "close"), key, "left").join(response.select(*key, "mean_response"), key, "left").join(pool, key, "left")
    cells = cells.withColumn("in_pool", F.coalesce("_member", F.lit(False)) & F.col("close").isNotNull())
    own = ("period", "instrument")
    made = rolling.trailing_volatility(rolling.rolling_std(cells, "mean_response", p.ts_std, out="factor", keys=own), "close", p.vol_window, keys=own)
    made = made if p.smooth_on_warmup else made.where("inside")
    signal = signal_from_raw(made, "factor", "vol", p.smooth_days, p.n_mad, p.least, p.direction, ("period",)).where("inside")
    return signal.select("period", *key, F.when(F.col("in_pool"), F.col("factor")).alias("raw"), "signal")


def weighted(scored: DataFrame, groups: int = 10, least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Groups and weights of every scored rebalance, by windows over a rebalance. ``scored``: rb_idx, instrument, score, fwd."""
    live, keys = scored.where("score is not null and fwd is not null"), (*by, "rb_idx")
    live = x.min_cross_section(live, "score", max(least, groups), keys)
    return b.long_short_weights(x.quantile_groups(live, "score", groups, keys=keys), groups, keys)


def book(scored: DataFrame, groups: int = 10, least: int = 30) -> DataFrame:
    """:func:`weighted`, with the effective number of each rebalance."""
    return b.effective_index(weighted(scored, groups, least))


def numbered(per: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a scored rebalance (``rb_idx``), with its effective number."""
    return per.withColumn("eff_idx", (F.row_number().over(Window.partitionBy(*by).orderBy("rb_idx")) - 1).cast("long"))


def replay(scored: DataFrame, groups: int = 10, least: int = 30, cost: float = b.COST, by: tuple[str, ...] = ()) -> DataFrame:
    """Gross, turnover, net, IC and rank IC of each scored rebalance, of each book ``by`` columns tell apart.

    One pass over the weights gives all sums of a rebalance; the other compares each name's weights
    along its rebalances (numbered by the first).
    """
    held, keys = weighted(scored, groups, least, by), (*by, "rb_idx")
    ranks = x.average_rank(x.average_rank(held, "score", "_rs", keys), "fwd", "_rf", keys)
    per = ranks.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"), x.pearson("score", "fwd").alias("ic"), x.pearson("_rs", "_rf").alias("rank_ic"))
    per = numbered(per, by)
    moved = b.turnover(held.join(F.broadcast(per.select(*keys, "eff_idx")), list(keys)), by=by)  # one row a rebalance
    return b.net_return(per, moved, cost, by).select(*by, "eff_idx", "rb_idx", "gross", "turnover", "net", "ic", "rank_ic")


def replay_periods(scores: DataFrame, daily: DataFrame, membership: DataFrame, span: DataFrame, unit: str = "week", groups: int = 10, least: int = 30, cost: float = b.COST) -> DataFrame:
    """Gross, turnover, net, IC and rank IC of each scored rebalance of several periods, with one book carried through all of them.

    Each period has its own rebalances, labels and universe (members on any of its days). The book that one period ends
    with is carried into the next one; names that its universe lacks leave without turnover. Rebalances are numbered over
    all periods by date. ``scores``: period, instrument, trade_date, score; ``span``: :func:`period_days`.
    """
    key = ["instrument", "trade_date"]
    own = span.where("inside")
    ends = b.rebalance_dates(own, unit, ("period",))
    codes = period_codes(membership, span)
    pool = membership.select(*key).distinct()
    priced = daily.select(*key, "close").join(F.broadcast(ends), "trade_date").join(codes, ["period", "instrument"], "left_semi")  # a few rows a rebalance
    w = Window.partitionBy("period", "instrument").orderBy("rb_idx")
    ahead = F.when(F.lead("rb_idx").over(w) == F.col("rb_idx") + 1, F.lead("close").over(w))
    labelled = priced.withColumn("fwd", F.try_divide(ahead, F.col("close")) - 1).join(pool, key, "left_semi")
    held = weighted(labelled.join(scores, ["period", *key]), groups, least, ("period",))
    rank = ("period", "rb_idx")
    ranks = x.average_rank(x.average_rank(held, "score", "_rs", rank), "fwd", "_rf", rank)
    per = ranks.groupBy("period", "rb_idx", "trade_date").agg(F.sum(F.col("weight") * F.col("fwd")).alias("gross"), x.pearson("score", "fwd").alias("ic"), x.pearson("_rs", "_rf").alias("rank_ic"))
    per = per.withColumn("eff_idx", (F.row_number().over(Window.orderBy("trade_date", "period")) - 1).cast("long"))  # one row a rebalance
    firsts = per.groupBy("period").agg(F.min("eff_idx").alias("eff_idx")).where("eff_idx > 0")
    book = held.join(F.broadcast(per.select("period", "rb_idx", "eff_idx")), ["period", "rb_idx"])
    moved = b.turnover(book, codes.join(F.broadcast(firsts), "period").select("eff_idx", "instrument"))
    return b.net_return(per, moved, cost).select("period", "trade_date", "eff_idx", "gross", "turnover", "net", "ic", "rank_ic")
