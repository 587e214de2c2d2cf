"""Operators over the bars of an instrument's day; none looks across days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions import spread

DAY = ("instrument", "trade_date")


def _bars(order: str = "minute"):
    return Window.partitionBy(*DAY).orderBy(order)


def minute_return(bars: DataFrame, horizon: int = 1, price: str = "close", out: str = "ret") -> DataFrame:
    """Price over the price ``horizon`` bars before, less 1; missing for the first bars."""
    return bars.withColumn(out, F.try_divide(F.col(price), F.lag(price, horizon).over(_bars())) - 1)


def log_return(bars: DataFrame, horizon: int = 5, price: str = "close", out: str = "log_ret") -> DataFrame:
    """Log of price over the price ``horizon`` bars before; missing for the first bars and prices not above 0."""
    c = F.when(F.col(price) > 0, F.col(price))
    return bars.withColumn(out, F.ln(c) - F.ln(F.lag(c, horizon).over(_bars())))


def forward_std(bars: DataFrame, value: str, window: int = 5, ddof: int = 1, out: str = "fwd_std") -> DataFrame:
    """Deviation of this and the next ``window - 1`` bars; missing unless all are there."""
    ahead = _bars().rowsBetween(0, window - 1)
    return bars.withColumn(out, F.when(F.count(value).over(ahead) == window, spread(value, ddof).over(ahead)))


def top_events(bars: DataFrame, value: str = "volume", k: int = 10, exclude_before: int = 15) -> DataFrame:
    """The ``k`` largest bars of each day from bar ``exclude_before`` on, with their rank; ties go to the earlier bar."""
    ranked = bars.where(F.col("minute") >= exclude_before).where(F.col(value).isNotNull())
    best = Window.partitionBy(*DAY).orderBy(F.col(value).desc(), F.col("minute"))
    return ranked.withColumn("event_rank", F.row_number().over(best).cast("long")).where(F.col("event_rank") <= k)


def separated_events(bars: DataFrame, value: str = "volume", k: int = 10, exclude_before: int = 15, min_gap: int = 5, gap_inclusive: bool = True, order: str = "value") -> DataFrame:
    """``instrument, trade_date, minute`` of the top events that keep a distance from those kept before.

    Events are taken by falling value, or by time with ``order="time"``; slots are not refilled.
    """
    if order not in ("value", "time"):
        raise ValueError("order must be value or time")
    first = "event_rank" if order == "value" else "minute"
    day = top_events(bars, value, k, exclude_before).groupBy(*DAY).agg(F.sort_array(F.collect_list(F.struct(F.col(first).cast("long").alias("o"), F.col("minute").cast("long").alias("m")))).alias("a"))
    far = (lambda a, x: F.abs(a - x) >= min_gap) if gap_inclusive else (lambda a, x: F.abs(a - x) > min_gap)
    kept = F.aggregate("a", F.array().cast("array<bigint>"), lambda acc, x: F.when(F.forall(acc, lambda a: far(a, x["m"])), F.array_append(acc, x["m"])).otherwise(acc))
    return day.select(*DAY, F.explode(kept).alias("minute"))


def masked_daily_mean(bars: DataFrame, value: str, events: DataFrame, out: str = "factor") -> DataFrame:
    """Mean of ``value`` over each day's event bars, missing values left out; days without an event are missing."""
    marked = bars.join(events.select(*DAY, "minute").withColumn("_hit", F.lit(True)), [*DAY, "minute"], "left")
    return marked.groupBy(*DAY).agg(F.avg(F.when(F.col("_hit"), F.col(value))).alias(out))


def event_mean(bars: DataFrame, value: str, size: str = "volume", k: int = 10, exclude_before: int = 15, min_gap: int = 5, out: str = "factor") -> DataFrame:
    """:func:`masked_daily_mean` of ``value`` over :func:`separated_events` of ``size``, in one grouping of the bars of a day.

    A day's bars, a bounded session, become one sorted array: the largest, those far from larger ones, their mean.
    """
    able = (F.col("minute") >= exclude_before) & F.col(size).isNotNull()
    bar = F.when(able, F.struct((-F.col(size)).alias("o"), F.col("minute").cast("long").alias("m"), F.col(value).alias("v")))
    day = bars.groupBy(*DAY).agg(F.slice(F.sort_array(F.collect_list(bar)), 1, k).alias("a"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    step = lambda acc, x: F.when(
        F.forall(acc["kept"], lambda a: F.abs(a - x["m"]) >= min_gap),
        F.struct(F.array_append(acc["kept"], x["m"]).alias("kept"), (acc["s"] + F.coalesce(x["v"], F.lit(0.0))).alias("s"), (acc["n"] + x["v"].isNotNull().cast("int")).alias("n")),
    ).otherwise(acc)
    return day.select(*DAY, F.aggregate("a", start, step, lambda acc: F.try_divide(acc["s"], acc["n"])).alias(out))


def response_columns(bars: DataFrame, pairs: list[tuple[int, int]], ddofs: tuple[int, ...] = (1,), price: str = "close") -> tuple[DataFrame, dict[tuple[int, int, int], str]]:
    """Bars with the forward deviation of the log return of every (horizon, window, ddof), and the columns' names.

    All windows are over the bars of a day, so any number of columns takes one exchange and one sort.
    """
    c, logs = F.when(F.col(price) > 0, F.col(price)), {h: f"_l{h}" for h, _ in pairs}
    step = bars.withColumns({name: F.ln(c) - F.ln(F.lag(c, h).over(_bars())) for h, name in logs.items()})
    names, made = {}, {}
    for h, w in pairs:
        ahead = _bars().rowsBetween(0, w - 1)
        for d in ddofs:
            names[h, w, d] = f"_r{h}_{w}_{d}"
            made[names[h, w, d]] = F.when(F.count(logs[h]).over(ahead) == w, spread(logs[h], d).over(ahead))
    return step.withColumns(made).drop(*logs.values()), names


def _from(day: Column, exclude: int) -> Column:
    return F.filter(day, lambda b: b["m"] >= exclude) if exclude else day


def _separated(day: Column, k: int, min_gap: int, start: Column, add) -> Column:
    """The fold over the first ``k`` bars of a sorted day: ``add`` takes what is kept (with the minutes ``kept``) and a bar that is far from all of these."""
    return F.aggregate(F.slice(day, 1, k), start, lambda acc, x: F.when(F.forall(acc["kept"], lambda a: F.abs(a - x["m"]) >= min_gap), add(acc, x)).otherwise(acc))


def _sorted_day(bars: DataFrame, size: str, values: list[str]) -> DataFrame:
    """One row an instrument-day: its bars that have a size, by falling size, then time, as an array ``a`` of ``o, m, v``."""
    bar = F.when(F.col(size).isNotNull(), F.struct((-F.col(size)).alias("o"), F.col("minute").cast("long").alias("m"), F.array(*[F.col(v).cast("double") for v in values]).alias("v")))
    return bars.groupBy(*DAY).agg(F.sort_array(F.collect_list(bar)).alias("a"))


def event_means(bars: DataFrame, values: list[str], events: list[tuple[int, int, int]], size: str = "volume") -> DataFrame:
    """``instrument, trade_date, event, value, mean``: :func:`event_mean` of every value over every (k, exclude_before, min_gap), by their places in the lists.

    A day's bars, a bounded session, become one sorted array, which is folded for all combinations: bars are
    scanned and exchanged once however many there are.
    """
    n = len(values)
    day, parts = F.col("a"), []
    zero = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array_repeat(F.lit(0.0), n).alias("s"), F.array_repeat(F.lit(0), n).alias("n"))
    add = lambda acc, x: F.struct(
        F.array_append(acc["kept"], x["m"]).alias("kept"),
        F.zip_with(acc["s"], x["v"], lambda s, v: s + F.coalesce(v, F.lit(0.0))).alias("s"),
        F.zip_with(acc["n"], x["v"], lambda s, v: s + v.isNotNull().cast("int")).alias("n"),
    )
    for k, exclude, gap in events:
        total = _separated(_from(day, exclude), k, gap, zero, add)
        parts.append(F.zip_with(total["s"], total["n"], lambda s, c: F.try_divide(s, c)))
    rows = _sorted_day(bars, size, values).select(*DAY, F.posexplode(F.array(*parts)).alias("event", "_m"))
    return rows.select(*DAY, "event", F.posexplode("_m").alias("value", "mean"))


def event_means_of(bars: DataFrame, specs: list[tuple[str, str, int, int, int]]) -> DataFrame:
    """``instrument, trade_date`` and a column ``_m0, _m1, ...`` for each (value, size, k, exclude_before, min_gap): its :func:`event_mean`, all in one grouping of the bars of a day."""
    arrays = {}
    for value, size, *_ in specs:
        arrays.setdefault(size, []).append(value)
    places = {size: {v: i for i, v in enumerate(dict.fromkeys(values))} for size, values in arrays.items()}
    bar = lambda size: F.when(F.col(size).isNotNull(), F.struct((-F.col(size)).alias("o"), F.col("minute").cast("long").alias("m"), F.array(*[F.col(v).cast("double") for v in places[size]]).alias("v")))
    names = {size: f"_a{i}" for i, size in enumerate(places)}
    day = bars.groupBy(*DAY).agg(*([F.sort_array(F.collect_list(bar(size))).alias(a) for size, a in names.items()] or [F.count("*").alias("_n")]))
    zero = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    out = []
    for i, (value, size, k, exclude, gap) in enumerate(specs):
        own = F.lit(places[size][value])
        add = lambda acc, x, own=own: F.struct(F.array_append(acc["kept"], x["m"]).alias("kept"), (acc["s"] + F.coalesce(F.get(x["v"], own), F.lit(0.0))).alias("s"), (acc["n"] + F.get(x["v"], own).isNotNull().cast("int")).alias("n"))
        total = _separated(_from(F.col(names[size]), exclude), k, gap, zero, add)
        out.append(F.try_divide(total["s"], total["n"]).alias(f"_m{i}"))
    return day.select(*DAY, *out)


def event_patterns(bars: DataFrame, events: list[tuple[int, int, int]], size: str = "volume") -> DataFrame:
    """``members, n``: how many bars are an event of just these of the (k, exclude_before, min_gap), by their places in the list.

    Each event bar becomes one set of combinations (words of 62 bits); equal sets are counted. There are no rows of
    a bar and a combination.
    """
    day, start = F.col("a"), F.struct(F.array().cast("array<bigint>").alias("kept"))
    kept = []
    for k, exclude, gap in events:
        kept.append(_separated(_from(day, exclude), k, gap, start, lambda acc, x: F.struct(F.array_append(acc["kept"], x["m"]).alias("kept")))["kept"])
    each = _sorted_day(bars, size, []).select(F.array(*kept).alias("k"))
    chunks = [range(a, min(a + 62, len(events))) for a in range(0, len(events), 62)]
    bits = lambda m: F.array(*[sum((F.when(F.array_contains(F.get("k", F.lit(c)), m), F.lit(1 << (c - ids[0]))).otherwise(F.lit(0)).cast("long") for c in ids), F.lit(0).cast("long")) for ids in chunks])
    words = each.select(F.explode(F.transform(F.array_distinct(F.flatten("k")), bits)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    own = [F.when(F.shiftrightunsigned(F.get("w", F.lit(i)), c - ids[0]).bitwiseAND(F.lit(1)) == 1, F.lit(c)) for i, ids in enumerate(chunks) for c in ids]
    return words.select(F.array_compact(F.array(*own)).alias("members"), "n")
