"""Parameter grids, rankings, Pareto fronts, pool correlations and redundancy studies."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelsmith.functions import rounded
from panelsmith.operators.intraday import event_means, event_patterns, response_columns, separated_events
from panelsmith.operators.rolling import rolling_std
from panelsmith.operators.xsection import average_rank, ic, neutralize, neutralize_many, pearson, rank_ic, spread_rank
from panelsmith.sources.panel import with_date_idx
from panelsmith.sources.shared import stored

def grid(spark: SparkSession, **lists: list) -> DataFrame:
    """The cross product of parameter lists; bounded by the lists that are given."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in lists.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def ranked(results: DataFrame, metric: str, tie: str, out: str = "place") -> DataFrame:
    """Place 1 is the highest metric; one row a combination."""
    return results.withColumn(out, F.row_number().over(Window.orderBy(F.col(metric).desc_nulls_last(), tie)).cast("long"))


def direction(scores: DataFrame, metric: str = "rank_ic") -> DataFrame:
    """The sign of the mean metric of a training range."""
    return scores.agg(F.signum(F.avg(metric)).alias("direction"))


def crowding(rows: DataFrame, objectives: list[str], front: str = "pareto_rank", tie: str | None = None) -> DataFrame:
    """Crowding distance in a front: the sum over objectives of the gap between neighbours over the range; infinite at the ends. Equal values are ordered by ``tie``."""
    step, parts = rows, []
    for o in objectives:
        w, every = Window.partitionBy(front).orderBy(o, *([tie] if tie else [])), Window.partitionBy(front)
        gap = F.try_divide(F.lead(o).over(w) - F.lag(o).over(w), F.max(o).over(every) - F.min(o).over(every))
        parts.append(F.when(F.lag(o).over(w).isNull() | F.lead(o).over(w).isNull(), F.lit(float("inf"))).otherwise(F.coalesce(gap, F.lit(0.0))))
    return step.withColumn("crowding", reduce(lambda a, b: a + b, parts))


def pool_correlation(candidate: DataFrame, pool: DataFrame, value: str = "factor") -> DataFrame:
    """Correlation of a factor with every accepted one (``name, instrument, trade_date, value``)."""
    a = candidate.select("instrument", "trade_date", F.col(value).alias("_a"))
    return pool.join(a, ["instrument", "trade_date"]).groupBy("name").agg(pearson("_a", value).alias("corr"))


def event_name(k: int, exclude: int, gap: int) -> str:
    return f"k{k}_x{exclude}_g{gap}"


def event_masks(bars: DataFrame, combos: list[tuple[int, int, int]], value: str = "volume") -> DataFrame:
    """Event bars of every (k, exclude_before, min_gap), named ``k_x_g``."""
    parts = [separated_events(bars, value, *c).withColumn("combo", F.lit(event_name(*c))) for c in combos]
    return reduce(DataFrame.unionByName, parts)


def _named(patterns: DataFrame, combos: list[tuple[int, int, int]]) -> DataFrame:
    """One row a combination: its name, and how many bars of :func:`~panelsmith.operators.intraday.event_patterns` it has."""
    counts = [F.sum(F.when(F.array_contains("members", c), F.col("n"))) for c in range(len(combos))]
    cells = [F.struct(F.lit(event_name(*e)).alias("combo"), F.coalesce(c, F.lit(0)).alias("n")) for e, c in zip(combos, counts)]
    return patterns.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def mask_counts(bars: DataFrame, combos: list[tuple[int, int, int]], value: str = "volume") -> DataFrame:
    """Mean events a day of each (k, exclude_before, min_gap), over all instrument-days."""
    total = bars.select("instrument", "trade_date").distinct().agg(F.count("*").alias("_days"))
    named = _named(event_patterns(bars, combos, value), combos)
    return named.crossJoin(F.broadcast(total)).select("combo", (F.col("n") / F.col("_days")).alias("mean_events"))  # one row


def mask_jaccard(bars: DataFrame, combos: list[tuple[int, int, int]], value: str = "volume") -> DataFrame:
    """Pooled Jaccard of every pair of (k, exclude_before, min_gap), from the histogram of their patterns: one scan and one exchange of bars."""
    members = F.col("members")
    pairs = F.flatten(F.transform(members, lambda a: F.transform(F.filter(members, lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    sums = event_patterns(bars, combos, value).select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    one = sums.agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))  # a row a pair of combinations
    order = sorted(range(len(combos)), key=lambda c: event_name(*combos[c]))
    every = [(x, y) for i, x in enumerate(order) for y in order[i + 1 :]]

    def count(x: int, y: int):
        return F.coalesce(F.try_element_at("m", F.struct(F.lit(min(x, y)).alias("a"), F.lit(max(x, y)).alias("b"))), F.lit(0))

    cells = [F.struct(F.lit(event_name(*combos[x])).alias("a"), F.lit(event_name(*combos[y])).alias("b"), count(x, y).alias("both"), count(x, x).alias("na"), count(y, y).alias("nb")) for x, y in every]
    out = one.select(F.inline(F.array(*cells)))
    return out.where("na > 0 and nb > 0").select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def ddof_study(bars: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Least and largest ratio of the two deviations of each (horizon, window), against sqrt(w / (w - 1)); one pass over the bars."""
    both, names = response_columns(bars, pairs, (1, 0))
    cells = []
    for h, w in pairs:
        s0 = F.col(names[h, w, 0])
        ratio = F.when(s0 > 1e-12, F.try_divide(F.col(names[h, w, 1]), s0))
        cells.append(F.struct(F.lit(h).alias("horizon"), F.lit(w).alias("window"), F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"), F.sqrt(F.lit(w / (w - 1))).alias("expected")))
    return both.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def ddof_rank_change(bars: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The largest change of an instrument's rank on a date between the daily means of the two deviations of each (horizon, window); values are rounded before they are ranked."""
    both, names = response_columns(bars, pairs, (1, 0))
    days = both.groupBy("instrument", "trade_date").agg(*[rounded(F.avg(c), 8).alias(c) for c in names.values()])
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(w).alias("window"), F.col(names[h, w, 1]).alias("s1"), F.col(names[h, w, 0]).alias("s0")) for h, w in pairs])
    rows, key = days.select("instrument", "trade_date", F.inline(cells)), ("horizon", "window", "trade_date")
    ranks = average_rank(average_rank(rows, "s1", "_r1", key), "s0", "_r0", key)
    return ranks.groupBy("horizon", "window").agg(F.max(F.abs(F.col("_r1") - F.col("_r0"))).alias("max_rank_difference"))


def responses(bars: DataFrame, combos: list[tuple[int, int]]) -> DataFrame:
    """Daily mean response of every (horizon, window), named ``h_w``: one pass over the bars for all."""
    made, names = response_columns(bars, combos)
    days = made.groupBy("instrument", "trade_date").agg(*[F.avg(c).alias(c) for c in names.values()])
    cells = F.array(*[F.struct(F.lit(f"h{h}_w{w}").alias("combo"), F.col(c).alias("response")) for (h, w, _), c in names.items()])
    return days.select("instrument", "trade_date", F.inline(cells))


def response_correlation(rows: DataFrame, combos: list[tuple[int, int]]) -> DataFrame:
    """Rank correlation of every pair of responses over all instrument-days, ranked range by range.

    The daily rows are stored once; ranks come back as columns, so all pairs are one aggregate.
    """
    names = sorted(f"h{h}_w{w}" for h, w in combos)
    ranks = spread_rank(stored(rows, "responses"), "response", "_r", ("combo",))
    wide = ranks.groupBy("instrument", "trade_date").agg(*[F.max(F.when(F.col("combo") == c, F.col("_r"))).alias(c) for c in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return wide.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(a, b).alias("corr")) for a, b in pairs]).alias("c")).select(F.inline("c"))


def response_dispersion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("combo").agg(F.avg("response").alias("mean"), F.stddev_samp("response").alias("std"), F.try_divide(F.stddev_samp("response"), F.avg("response")).alias("cv"))


def sweep_factors(bars: DataFrame, horizons: list[int], windows: list[int], ks: list[int], excludes: list[int], gaps: list[int], stds: list[int]) -> DataFrame:
    """``horizon, window, k, exclude, gap, std, instrument, trade_date, factor``: the factor of every combination of the six lists.

    The minute layer of all combinations is one scan and one exchange of bars (:func:`~panelsmith.operators.intraday.event_means`); its
    daily rows are stored, and give the calendar and, by one window of a combination's instrument, the deviations of all ``stds``.
    """
    pairs, events = list(product(horizons, windows)), list(product(ks, excludes, gaps))
    made, names = response_columns(bars, pairs)
    daily = stored(event_means(made, [names[h, w, 1] for h, w in pairs], events), "sweep")
    panel, keys = with_date_idx(daily), ("event", "value", "instrument")
    for n in stds:
        panel = rolling_std(panel, "mean", n, out=f"_s{n}", keys=keys)
    pick = lambda of, at: F.element_at(F.array(*map(F.lit, of)), F.col(at) + 1)
    labels = [pick([p[i] for p in pairs], "value").alias(c) for i, c in enumerate(("horizon", "window"))] + [pick([e[i] for e in events], "event").alias(c) for i, c in enumerate(("k", "exclude", "gap"))]
    cells = F.array(*[F.struct(F.lit(n).alias("std"), F.col(f"_s{n}").alias("factor")) for n in stds])
    return panel.select(*labels, "instrument", "trade_date", F.inline(cells))


def incremental_ic(panel: DataFrame, score: str, known: str | list[str], future: str, least: int = 30, keys: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """IC of what the accepted factors ``known`` (one, or a pool of several) do not explain of a score, by date."""
    pool = [known] if isinstance(known, str) else known
    own = neutralize(panel, score, pool[0], least, "_own", keys) if len(pool) == 1 else neutralize_many(panel, score, pool, least, "_own", keys)
    return ic(own, "_own", future, keys)


def _nearest(score: str, known: str | list[str]) -> Column:
    """The correlation with the accepted factor whose correlation is the largest either way."""
    pool = [known] if isinstance(known, str) else known
    return F.array_max(F.array(*[F.struct(F.abs(c := pearson(score, k)).alias("_a"), c.alias("c")) for k in pool]))["c"]


def fitness(panel: DataFrame, replayed: DataFrame, score: str, known: str | list[str], future: str, fold: str, nodes: int, least: int = 30, keys: tuple[str, ...] = ("rb_idx",)) -> DataFrame:
    """One row that says how good a factor is.

    direction (sign of the mean rank IC), robust_ic (|mean| less half a deviation of rank IC),
    incremental_ic (mean IC against the accepted factors), pool_correlation (with the nearest of them), net_long_short and
    turnover (means), fold_consistency (share of folds whose mean rank IC has the direction),
    coverage, complexity (``nodes``) and valid (scored rebalances).
    ``replayed``: rb_idx, net, turnover, rank_ic and the column ``fold``.
    """
    mean, dev = F.avg("rank_ic"), F.stddev_samp("rank_ic")
    series = replayed.agg(F.signum(mean).alias("direction"), (F.abs(mean) - 0.5 * dev).alias("robust_ic"), F.avg("net").alias("net_long_short"), F.avg("turnover").alias("turnover"), F.count("rank_ic").alias("valid"))
    folds = replayed.groupBy(fold).agg(F.avg("rank_ic").alias("_fold")).crossJoin(F.broadcast(series.select("direction")))
    consistent = folds.agg(F.avg((F.signum("_fold") == F.col("direction")).cast("double")).alias("fold_consistency"))
    new = incremental_ic(panel, score, known, future, least, keys).agg(F.avg("ic").alias("incremental_ic"))
    whole = panel.agg((F.count(score) / F.count("*")).alias("coverage"), _nearest(score, known).alias("pool_correlation"))
    return series.crossJoin(consistent).crossJoin(new).crossJoin(whole).withColumn("complexity", F.lit(nodes))  # one row each


def sweep(every: DataFrame, prices: DataFrame, baseline: str, periods: int = 252) -> DataFrame:
    """Combinations (``combo, instrument, trade_date, factor``) in the order of their full rank ICIR, with the place of the baseline.

    ``prices``: instrument, trade_date, fwd. combo, mean, icir, n (scored dates), place, baseline_place.
    """
    scored = rank_ic(every.join(prices, ["instrument", "trade_date"]), "factor", "fwd", ("combo", "trade_date"))
    icir = F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")) * F.sqrt(F.lit(float(periods)))
    out = scored.groupBy("combo").agg(F.avg("rank_ic").alias("mean"), rounded(icir).alias("icir"), F.count("rank_ic").alias("n"))
    own = F.max(F.when(F.col("combo") == baseline, F.col("place"))).over(Window.partitionBy())  # one row a combination
    return ranked(out, "icir", "combo").withColumn("baseline_place", own)


def sweep_periods(every: DataFrame, prices: DataFrame, periods: DataFrame, train: str) -> DataFrame:
    """combo, period (and ``full``), direction, ic, rank_ic, n: the mean scores in the direction that the period ``train`` chooses (none if its mean is 0 to 6 digits).

    ``every``: combo, instrument, trade_date, factor; ``prices``: instrument, trade_date, fwd; ``periods``: period, begin, finish.
    """
    keys = ("combo", "trade_date")
    live = every.join(prices, ["instrument", "trade_date"]).where("factor is not null and fwd is not null")
    ranks = average_rank(average_rank(live, "factor", "_rs", keys), "fwd", "_rf", keys)
    days = ranks.groupBy(*keys).agg(pearson("_rs", "_rf").alias("rank_ic"), pearson("factor", "fwd").alias("ic"))
    spans = F.broadcast(periods.unionByName(periods.agg(F.lit("full").alias("period"), F.lit("0001-01-01").cast("date").alias("begin"), F.lit("9999-12-31").cast("date").alias("finish"))))
    sums = days.join(spans, F.col("trade_date").between(F.col("begin"), F.col("finish"))).groupBy("combo", "period").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("rank_ic").alias("n"))
    sign = F.max(F.when(F.col("period") == train, F.signum(rounded(F.col("rank_ic"))))).over(Window.partitionBy("combo"))
    return sums.withColumn("direction", sign).withColumns({c: F.col("direction") * F.col(c) for c in ("ic", "rank_ic")})
