"""Registered studies of many parameters at once: sweeps of six lists, redundancy of masks and responses."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from panelsmith.functions import rounded as r
from panelsmith.operators import search
from panelsmith.operators import xsection as x
from panelsmith.plans import export
from panelsmith.plans.queries import _BC, _CORR, bars, query

IT = ["instrument", "trade_date"]
LISTS = {"horizons": [1, 2], "windows": [2, 3], "ks": [3, 5], "excludes": [0, 2], "gaps": [1, 3], "stds": [4, 8]}
BASELINE = "h2_w3_k5_x2_g3_n8"
SPANS = [("select", "2024-01-01", "2024-01-12"), ("valid", "2024-01-13", "2024-01-20"), ("test", "2024-01-21", "2024-01-30")]
MASKS = list(product((3, 5, 8), (0, 2, 4), (1, 2, 3)))
RESPONSES = list(product((1, 2, 3, 5, 8), (2, 3, 4)))


def _responses_sql(pairs: list[tuple[int, int]]) -> str:
    """fa: h, w, instrument, trade_date, minute, s1 and s0 (the forward deviations of both ddofs)."""
    day = "PARTITION BY instrument, trade_date ORDER BY minute"
    logs = " UNION ALL ".join(f"SELECT {h} AS h, *, ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN lag(close, {h}) OVER w > 0 THEN lag(close, {h}) OVER w END) AS lr FROM minute_bars WINDOW w AS ({day})" for h in sorted({h for h, _ in pairs}))
    parts = [f"SELECT h, {w} AS w, instrument, trade_date, minute, CASE WHEN count(lr) OVER w = {w} THEN stddev_samp(lr) OVER w END AS s1, CASE WHEN count(lr) OVER w = {w} THEN stddev_pop(lr) OVER w END AS s0 FROM la WHERE h = {h} WINDOW w AS ({day} ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)" for h, w in pairs]
    return f"la AS ({logs}), fa AS ({' UNION ALL '.join(parts)})"


def _events_sql(combos: list[tuple[int, int, int]]) -> str:
    """ea: k, x, g, instrument, trade_date, minute of every event of every combination."""
    key, values = "k, x, g, instrument, trade_date", ", ".join(map(str, combos))
    return f"""co(k, x, g) AS (VALUES {values}),
    tp AS (SELECT * FROM (SELECT k, x, g, instrument, trade_date, minute, row_number() OVER (PARTITION BY {key} ORDER BY volume DESC, minute) AS rk FROM minute_bars, co WHERE minute >= x AND volume IS NOT NULL) t WHERE rk <= k),
    wa AS (SELECT {key}, rk, [minute] AS kept FROM tp WHERE rk = 1 UNION ALL
        SELECT a.k, a.x, a.g, a.instrument, a.trade_date, t.rk, CASE WHEN len(list_filter(a.kept, lambda m: abs(m - t.minute) < a.g)) = 0 THEN list_append(a.kept, t.minute) ELSE a.kept END
        FROM wa a JOIN tp t ON t.k = a.k AND t.x = a.x AND t.g = a.g AND t.instrument = a.instrument AND t.trade_date = a.trade_date AND t.rk = a.rk + 1),
    ea AS (SELECT {key}, unnest(kept) AS minute FROM (SELECT *, max(rk) OVER (PARTITION BY {key}) AS top FROM wa) t WHERE rk = top)"""


def _sweep_sql() -> str:
    """jn: combo, instrument, trade_date, factor, fwd."""
    pairs, events = product(LISTS["horizons"], LISTS["windows"]), product(LISTS["ks"], LISTS["excludes"], LISTS["gaps"])
    std = " UNION ALL ".join(f"SELECT h, w, k, x, g, {n} AS n, instrument, trade_date, CASE WHEN count(m) OVER w_ >= 2 THEN stddev_samp(m) OVER w_ END AS factor FROM mm JOIN bc USING (trade_date) WINDOW w_ AS (PARTITION BY h, w, k, x, g, instrument ORDER BY date_idx RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in LISTS["stds"])
    return f"""{_responses_sql(list(pairs))}, {_events_sql(list(events))}, {_BC},
    mm AS (SELECT f.h, f.w, c.k, c.x, c.g, f.instrument, f.trade_date, avg(CASE WHEN e.minute IS NOT NULL THEN f.s1 END) AS m FROM fa f CROSS JOIN co c LEFT JOIN ea e ON e.k = c.k AND e.x = c.x AND e.g = c.g AND e.instrument = f.instrument AND e.trade_date = f.trade_date AND e.minute = f.minute GROUP BY ALL),
    sd AS ({std}), px AS (SELECT instrument, trade_date, lead(close) OVER (PARTITION BY instrument ORDER BY trade_date) / close - 1 AS fwd FROM bar_daily),
    jn AS (SELECT 'h' || h || '_w' || w || '_k' || k || '_x' || x || '_g' || g || '_n' || n AS combo, instrument, trade_date, round(factor, 6) + 0.0 AS factor, fwd FROM sd JOIN px USING (instrument, trade_date) WHERE factor IS NOT NULL AND fwd IS NOT NULL),
    rk AS (SELECT *, rank() OVER (PARTITION BY combo, trade_date ORDER BY factor) + (count(*) OVER (PARTITION BY combo, trade_date, factor) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY combo, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY combo, trade_date, fwd) - 1) / 2.0 AS rb FROM jn),
    ri AS (SELECT combo, trade_date, {_CORR.format('ra', 'rb')} AS rank_ic, {_CORR.format('factor', 'fwd')} AS ic FROM rk GROUP BY 1, 2)"""


def _scored(spark, d):
    """combo, instrument, trade_date, factor, fwd of every combination."""
    days = bars(spark, d).groupBy(*IT).agg(F.max_by("close", "minute").alias("close"))
    ahead = F.lead("close").over(x.Window.partitionBy("instrument").orderBy("trade_date"))
    prices = days.withColumn("fwd", F.try_divide(ahead, F.col("close")) - 1).where("fwd is not null")
    made = search.sweep_factors(bars(spark, d), **LISTS).where("factor is not null")
    combo = F.format_string("h%d_w%d_k%d_x%d_g%d_n%d", "horizon", "window", "k", "exclude", "gap", "std")
    return made.select(combo.alias("combo"), *IT, r(F.col("factor")).alias("factor")), prices


@query(f""", {_sweep_sql()}, su AS (SELECT combo, avg(rank_ic) AS mean, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(252.0), 6) + 0.0 AS icir, count(rank_ic) AS n FROM ri GROUP BY 1),
    pl AS (SELECT *, row_number() OVER (ORDER BY icir DESC NULLS LAST, combo) AS place FROM su) SELECT combo, round(mean, 6) + 0.0 AS mean, icir, n, place, (SELECT place FROM pl WHERE combo = '{BASELINE}') AS baseline_place FROM pl""")
def sweep_rank(spark, d):
    """All 64 combinations of six lists, by their full rank ICIR."""
    return search.sweep(*_scored(spark, d), BASELINE).withColumn("mean", r(F.col("mean")))


_SIDES = ", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in SPANS)


@query(f""", {_sweep_sql()}, sp(period, a, z) AS (VALUES {_SIDES}), dr AS (SELECT combo, sign(round(avg(rank_ic), 6))::DOUBLE AS direction FROM ri JOIN sp ON trade_date BETWEEN a AND z WHERE period = 'select' GROUP BY 1),
    al AS (SELECT combo, period, rank_ic, ic FROM ri JOIN sp ON trade_date BETWEEN a AND z UNION ALL SELECT combo, 'full', rank_ic, ic FROM ri)
    SELECT combo, period, direction, round(direction * avg(ic), 6) + 0.0 AS ic, round(direction * avg(rank_ic), 6) + 0.0 AS rank_ic, count(rank_ic) AS n FROM al JOIN dr USING (combo) GROUP BY 1, 2, 3""")
def sweep_periods(spark, d):
    """Every combination in every period and in full, in the direction that its select period chooses."""
    return search.sweep_periods(*_scored(spark, d), export.period_table(spark, SPANS), "select").select("combo", "period", "direction", *[r(F.col(c)).alias(c) for c in ("ic", "rank_ic")], "n")


_NAME = "'k' || k || '_x' || x || '_g' || g"


@query(f", {_events_sql(MASKS)} SELECT {_NAME} AS combo, round(count(minute)::DOUBLE / (SELECT count(*) FROM bar_daily), 6) + 0.0 AS mean_events FROM co LEFT JOIN ea USING (k, x, g) GROUP BY 1")
def mask_counts_27(spark, d):
    return search.mask_counts(bars(spark, d), MASKS).select("combo", r(F.col("mean_events")).alias("mean_events"))


@query(f""", {_events_sql(MASKS)}, mk AS (SELECT {_NAME} AS combo, instrument, trade_date, minute FROM ea), sz AS (SELECT combo, count(*) AS n FROM mk GROUP BY 1),
    bo AS (SELECT a.combo AS a, c.combo AS b, count(*) AS n FROM mk a JOIN mk c USING (instrument, trade_date, minute) WHERE a.combo < c.combo GROUP BY 1, 2)
    SELECT p.combo AS a, q.combo AS b, round(coalesce(bo.n, 0)::DOUBLE / (p.n + q.n - coalesce(bo.n, 0)), 6) AS jaccard FROM sz p JOIN sz q ON p.combo < q.combo LEFT JOIN bo ON bo.a = p.combo AND bo.b = q.combo""")
def mask_jaccard_27(spark, d):
    """All 351 pairs of 27 masks."""
    return search.mask_jaccard(bars(spark, d), MASKS).select("a", "b", r(F.col("jaccard")).alias("jaccard"))


@query(f""", {_responses_sql(RESPONSES)}, rs AS (SELECT 'h' || h || '_w' || w AS combo, instrument, trade_date, avg(s1) AS response FROM fa GROUP BY ALL),
    rr AS (SELECT *, rank() OVER (PARTITION BY combo ORDER BY response) + (count(*) OVER (PARTITION BY combo, response) - 1) / 2.0 AS k FROM rs WHERE response IS NOT NULL)
    SELECT p.combo AS a, q.combo AS b, round({_CORR.format('p.k', 'q.k')}, 6) + 0.0 AS corr FROM rr p JOIN rr q USING (instrument, trade_date) WHERE p.combo < q.combo GROUP BY 1, 2""")
def response_corr_15(spark, d):
    """All 105 pairs of 15 responses."""
    return search.response_correlation(search.responses(bars(spark, d), RESPONSES), RESPONSES).select("a", "b", r(F.col("corr")).alias("corr"))


@query(f", {_responses_sql(RESPONSES)} SELECT h AS horizon, w AS \"window\", round(min(s1 / s0), 6) AS ratio_min, round(max(s1 / s0), 6) AS ratio_max, round(sqrt(w / (w - 1)), 6) AS expected FROM fa WHERE s0 > 1e-12 GROUP BY 1, 2")
def ddof_study_15(spark, d):
    return search.ddof_study(bars(spark, d), RESPONSES).select("horizon", "window", *[r(F.col(c)).alias(c) for c in ("ratio_min", "ratio_max", "expected")])
