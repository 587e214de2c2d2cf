"""Registered queries of the job over several periods: tables, coverage, the book carried from one universe to the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelsmith.functions import rounded as r
from panelsmith.operators import search
from panelsmith.plans import export, pipeline
from panelsmith.plans.pipeline import Params
from panelsmith.plans.queries import _CORR, _EV, _FS, _LR, _MD, FW, GAP, H, K, XB, _clip_sql, _resid_sql, bars, query
from panelsmith.sources import panel as src
from panelsmith.sources.fixtures import view

P = Params(ts_std=8, vol_window=8, smooth_days=3, least=3, warmup_days=12)
SPANS = [("select", "1993-01-04", "1994-06-30"), ("valid", "1994-07-01", "1995-03-31"), ("test", "1995-04-01", "1996-06-30")]
BAR_P = Params(horizon=H, response_window=FW, top_k=K, exclude_before=XB, min_gap=GAP, ts_std=4, vol_window=3, smooth_days=2, least=3, warmup_days=5)
BAR_SPANS = [("select", "2024-01-06", "2024-01-15"), ("valid", "2024-01-16", "2024-01-28")]
_CELL = ["period", "instrument", "trade_date"]


def _cells_sql(daily: str, response: str, members: str, spans: list[tuple[str, str, str]], p: Params) -> str:
    """Common tables up to ``cells``: period, instrument, trade_date, date_idx, in_pool, factor, raw, signal inside the periods."""
    values = ", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in spans)
    own = "PARTITION BY period, instrument ORDER BY date_idx"
    back = lambda n: f"({own} RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    inside, last = ("", "WHERE inside") if p.smooth_on_warmup else ("WHERE inside", "")
    cross = ", ".join([_clip_sql("s1", "s0", "v", p.n_mad), _resid_sql("s2", "s1", "v", "vol", "rs"), f"s3 AS (SELECT *, CASE WHEN in_pool AND count(rs) OVER w = {p.smooth_days} THEN avg(rs) OVER w END AS mm FROM s2 WINDOW w AS {back(p.smooth_days)})", _clip_sql("s4", "s3", "mm", p.n_mad)])
    return f"""per(period, b, f) AS (VALUES {values}), pr AS ({response}), mb AS (SELECT DISTINCT instrument, trade_date FROM {members}),
    cl AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS date_idx FROM (SELECT DISTINCT trade_date FROM {daily}) t),
    pe AS (SELECT period, min(date_idx) AS a, max(date_idx) AS z FROM per JOIN cl ON trade_date BETWEEN b AND f GROUP BY 1),
    pd AS (SELECT period, trade_date, date_idx, date_idx >= a AS inside FROM pe JOIN cl ON date_idx BETWEEN a - {p.warmup_days} AND z),
    un AS (SELECT DISTINCT period, instrument FROM pd JOIN mb USING (trade_date) WHERE inside),
    ce AS (SELECT un.period, un.instrument, pd.trade_date, pd.date_idx, pd.inside, s.close, q.mean_response, m.instrument IS NOT NULL AND s.close IS NOT NULL AS in_pool FROM un JOIN pd USING (period)
        LEFT JOIN {daily} s ON s.instrument = un.instrument AND s.trade_date = pd.trade_date LEFT JOIN pr q ON q.instrument = un.instrument AND q.trade_date = pd.trade_date LEFT JOIN mb m ON m.instrument = un.instrument AND m.trade_date = pd.trade_date),
    fa AS (SELECT *, CASE WHEN count(mean_response) OVER w >= 2 THEN stddev_samp(mean_response) OVER w END AS factor, close / nullif(lag(close) OVER ({own}), 0) - 1 AS ret FROM ce WINDOW w AS {back(p.ts_std)}),
    vo AS (SELECT *, CASE WHEN count(ret) OVER w = {p.vol_window} THEN stddev_samp(ret) OVER w END AS vol FROM fa WINDOW w AS {back(p.vol_window)}),
    s0 AS (SELECT *, CASE WHEN in_pool THEN factor END AS v, CASE WHEN in_pool THEN factor END AS raw FROM vo {inside}), {cross.replace("PARTITION BY trade_date", "PARTITION BY period, trade_date")},
    cells AS (SELECT *, {p.direction} * mm AS signal FROM s4 {last})"""


_WEEKS = "SELECT instrument, trade_date, volume AS mean_response FROM supp_week"
_CELLS = _cells_sql("supp_week", _WEEKS, "membership", SPANS, P)
_WARM = Params(**(export.asdict(P) | {"smooth_on_warmup": True}))
_SHOWN = "SELECT period, instrument, trade_date, round(raw, 6) + 0.0 AS raw, round(signal, 4) + 0.0 AS signal FROM cells"


def _cells(spark, d, p: Params = P):
    weeks = view(spark, d, "supp_week")
    return pipeline.period_tables(weeks.withColumn("mean_response", F.col("volume")), weeks, view(spark, d, "membership"), export.period_table(spark, SPANS), p)


def _shown(cells):
    return cells.select(*_CELL, r(F.col("raw")).alias("raw"), r(F.col("signal"), 4).alias("signal"))


@query(f", {_CELLS} {_SHOWN}")
def period_tables(spark, d):
    return _shown(_cells(spark, d))


@query(f", {_cells_sql('supp_week', _WEEKS, 'membership', SPANS, _WARM)} {_SHOWN}")
def period_tables_warm(spark, d):
    return _shown(_cells(spark, d, _WARM))


@query(f", {_CELLS} SELECT period, count(DISTINCT instrument) AS instruments, count(DISTINCT trade_date) AS dates, min(trade_date) AS first, max(trade_date) AS last, count(raw) AS raw_live_cells, count(signal) AS signal_live_cells FROM cells GROUP BY 1")
def period_cells_coverage(spark, d):
    return src.period_coverage(_cells(spark, d))


@query(f", {_LR}, {_FS}, {_EV}, {_MD}, {_cells_sql('bar_daily', 'SELECT instrument, trade_date, m AS mean_response FROM md', 'bar_members', BAR_SPANS, BAR_P)} {_SHOWN.replace('round(signal, 4)', 'round(signal, 6)')}")
def export_job(spark, d):
    cells = export.tables(bars(spark, d), view(spark, d, "bar_daily"), view(spark, d, "bar_members"), export.period_table(spark, BAR_SPANS), BAR_P)
    return cells.select(*_CELL, *[r(F.col(c)).alias(c) for c in ("raw", "signal")])


# the book -------------------------------------------------------------------------------------

_G = 5
_PERIOD_BOOK = f"""{_CELLS}, rb AS (SELECT period, trade_date, row_number() OVER (PARTITION BY period ORDER BY trade_date) - 1 AS rb_idx FROM (SELECT DISTINCT period, max(trade_date) OVER (PARTITION BY period, date_trunc('month', trade_date)) AS trade_date FROM pd WHERE inside) t),
    ra AS (SELECT c.period, c.instrument, c.trade_date, rb.rb_idx, c.in_pool, c.close, round(c.signal, 4) + 0.0 AS score FROM cells c JOIN rb USING (period, trade_date)),
    fw AS (SELECT a.*, n.close / nullif(a.close, 0) - 1 AS fwd FROM ra a LEFT JOIN ra n ON n.period = a.period AND n.instrument = a.instrument AND n.rb_idx = a.rb_idx + 1),
    lv AS (SELECT *, count(*) OVER (PARTITION BY period, rb_idx) AS n_ FROM fw WHERE in_pool AND score IS NOT NULL AND fwd IS NOT NULL),
    dc AS (SELECT *, ntile({_G}) OVER (PARTITION BY period, rb_idx ORDER BY score, instrument) AS decile, dense_rank() OVER (ORDER BY trade_date) - 1 AS eff_idx FROM lv WHERE n_ >= {_G}),
    bk AS (SELECT *, CASE WHEN decile = {_G} THEN 1.0 / count(*) OVER (PARTITION BY eff_idx, decile) WHEN decile = 1 THEN -1.0 / count(*) OVER (PARTITION BY eff_idx, decile) ELSE 0.0 END AS weight FROM dc),
    gr AS (SELECT period, trade_date, eff_idx, sum(weight * fwd) AS gross, {_CORR.format('score', 'fwd')} AS ic FROM bk GROUP BY 1, 2, 3),
    cy AS (SELECT p.eff_idx + 1 AS eff_idx, p.instrument, p.weight FROM bk p JOIN gr ON gr.eff_idx = p.eff_idx + 1 SEMI JOIN un ON un.period = gr.period AND un.instrument = p.instrument),
    tv AS (SELECT coalesce(a.eff_idx, c.eff_idx) AS eff_idx, 0.5 * sum(abs(coalesce(a.weight, 0) - coalesce(c.weight, 0))) AS t FROM bk a FULL JOIN cy c ON c.eff_idx = a.eff_idx AND c.instrument = a.instrument GROUP BY 1),
    nt AS (SELECT period, trade_date, eff_idx, gross, CASE WHEN eff_idx = 0 THEN 1.0 ELSE t END AS turnover, ic FROM gr JOIN tv USING (eff_idx))"""


def _replayed(spark, d):
    days = view(spark, d, "supp_week")
    span = src.period_days(src.calendar(days), export.period_table(spark, SPANS), 0)
    scores = _cells(spark, d).select(*_CELL, r(F.col("signal"), 4).alias("score"))
    return pipeline.replay_periods(scores, days, view(spark, d, "membership"), span, "month", _G, _G)


@query(f", {_PERIOD_BOOK} SELECT period, trade_date, eff_idx, round(gross, 6) + 0.0 AS gross, round(turnover, 6) + 0.0 AS turnover, round(gross - 0.0030 * turnover, 6) + 0.0 AS net, round(ic, 6) + 0.0 AS ic FROM nt")
def carry_periods(spark, d):
    return _replayed(spark, d).select("period", "trade_date", "eff_idx", *[r(F.col(c)).alias(c) for c in ("gross", "turnover", "net", "ic")])


@query(f", {_PERIOD_BOOK}, dr AS (SELECT sign(avg(ic))::DOUBLE AS direction FROM nt WHERE period = 'select') SELECT period, direction, round(direction * avg(ic), 6) + 0.0 AS ic, count(*) AS n FROM nt, dr GROUP BY 1, 2")
def direction_select(spark, d):
    """The sign that the select period chooses, and what it makes of every period."""
    series = _replayed(spark, d)
    found = search.direction(series.where("period = 'select'"), "ic")
    return series.crossJoin(F.broadcast(found)).groupBy("period", "direction").agg(r(F.first("direction") * F.avg("ic")).alias("ic"), F.count("*").alias("n"))  # one row
