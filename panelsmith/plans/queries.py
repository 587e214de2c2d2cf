"""Registered queries of the panel engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.functions import finite
from panelsmith.functions import rounded as r
from panelsmith.operators import audit, intraday, rolling, search, skyline, tree
from panelsmith.operators import backtest as b
from panelsmith.operators import xsection as x
from panelsmith.plans import pipeline
from panelsmith.sources import panel as src
from panelsmith.sources.fixtures import panel, sql, view
from panelsmith.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
IT = ["instrument", "trade_date"]
ITM = [*IT, "minute"]
H, FW, K, XB, GAP, STD = 2, 3, 4, 2, 3, 8  # horizon, response window, events, first bar, distance, days: small, for the fixtures
LEAST = 3
BEGIN, FINISH = "1993-01-01", "1996-12-31"


def query(text: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE_SQL[f.__name__] = sql(text)
        return f

    return add


def _o(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {name or c}"


# scans, projections, filters ------------------------------------------------------------------


@query(f"SELECT instrument, trade_date, close FROM panel WHERE trade_date BETWEEN DATE '{BEGIN}' AND DATE '{FINISH}'")
def scan_scope(spark, d):
    return panel(spark, d).where(F.col("trade_date").between(BEGIN, FINISH)).select(*IT, "close")


@query("SELECT instrument, trade_date, CASE WHEN in_pool THEN close END AS close FROM panel")
def pool_mask(spark, d):
    return panel(spark, d).select(*IT, F.when(F.col("in_pool"), F.col("close")).alias("close"))


@query("SELECT instrument, trade_date, minute, ln(CASE WHEN volume > 0 THEN volume END) AS v FROM minute_bars WHERE volume > 0")
def finite_filter(spark, d):
    return view(spark, d, "minute_bars").withColumn("v", F.ln("volume")).where(finite(F.col("v"))).select(*ITM, "v")


@query(", t AS (SELECT *, count(close) OVER (PARTITION BY trade_date) AS n FROM panel WHERE in_pool) SELECT instrument, trade_date, close FROM t WHERE n >= 6")
def min_cross_section(spark, d):
    return x.min_cross_section(panel(spark, d).where("in_pool"), "close", 6).select(*IT, "close")


@query(f"SELECT DISTINCT instrument FROM membership WHERE trade_date BETWEEN DATE '{BEGIN}' AND DATE '{FINISH}'")
def universe_codes(spark, d):
    return src.pit_codes(view(spark, d, "membership"), BEGIN, FINISH)


@query(f"""SELECT p.period, min(trade_date) AS first, max(trade_date) AS last, count(DISTINCT instrument) AS instruments, count(*) AS rows, count(CASE WHEN in_pool THEN close END) AS ok_cells
    FROM panel JOIN (VALUES ('select', DATE '{BEGIN}', DATE '1994-12-31'), ('valid', DATE '1995-01-01', DATE '{FINISH}')) p(period, b, f) ON trade_date BETWEEN p.b AND p.f GROUP BY 1""")
def period_coverage(spark, d):
    periods = spark.createDataFrame([("select", BEGIN, "1994-12-31"), ("valid", "1995-01-01", FINISH)], "period string, begin string, finish string")
    periods = periods.withColumns({c: F.col(c).cast("date") for c in ("begin", "finish")})
    return src.coverage(panel(spark, d).withColumn("close", F.when(F.col("in_pool"), F.col("close"))), "close", periods)


@query(", i AS (SELECT DISTINCT instrument FROM user_daily), t AS (SELECT DISTINCT trade_date FROM user_daily) SELECT i.instrument, t.trade_date, u.close AS factor, CASE WHEN u.close IS NULL THEN 'invalid' ELSE 'ok' END AS status FROM i CROSS JOIN t LEFT JOIN user_daily u USING (instrument, trade_date)")
def dense_rectangle(spark, d):
    return src.dense_rectangle(view(spark, d, "user_daily"), "close").select(*IT, "factor", "status")


@query("SELECT DISTINCT trade_date FROM user_daily")
def trade_dates(spark, d):
    return src.calendar(view(spark, d, "user_daily")).select("trade_date")


@query("SELECT instrument, trade_date, in_pool FROM panel")
def daily_mask(spark, d):
    return src.pit_mask(view(spark, d, "supp_week"), view(spark, d, "membership")).select(*IT, "in_pool")


@query(", iv AS (SELECT instrument, min(trade_date) AS a, max(trade_date) AS z FROM membership GROUP BY 1) SELECT iv.instrument, c.trade_date FROM iv JOIN calendar c ON iv.a <= c.trade_date AND c.trade_date < iv.z")
def interval_mask(spark, d):
    spans = view(spark, d, "membership").groupBy("instrument").agg(F.min("trade_date").alias("start"), F.max("trade_date").alias("end"))
    return src.interval_days(spans, src.calendar(view(spark, d, "supp_week")))


@query(f", f AS (SELECT min(date_idx) AS a FROM calendar WHERE trade_date >= DATE '{BEGIN}') SELECT instrument, trade_date, close FROM panel, f WHERE date_idx >= f.a - 10 AND trade_date <= DATE '{FINISH}'")
def warmup_slice(spark, d):
    return src.extended(view(spark, d, "supp_week"), BEGIN, FINISH, 10).select(*IT, "close")


# minute ---------------------------------------------------------------------------------------

_LR = f"""lr AS (SELECT *, ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN lag(close, {H}) OVER w > 0 THEN lag(close, {H}) OVER w END) AS log_ret
    FROM minute_bars WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY minute))"""
_FS = f"""fs AS (SELECT *, CASE WHEN count(log_ret) OVER w = {FW} THEN stddev_samp(log_ret) OVER w END AS fwd_std FROM lr
    WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY minute ROWS BETWEEN CURRENT ROW AND {FW - 1} FOLLOWING))"""


def _events_sql(k: int, xb: int, gap: int, tag: str = "") -> str:
    return f"""top{tag} AS (SELECT * FROM (SELECT instrument, trade_date, minute, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY volume DESC, minute) AS event_rank FROM minute_bars WHERE minute >= {xb} AND volume IS NOT NULL) t WHERE event_rank <= {k}),
    walk{tag} AS (SELECT instrument, trade_date, event_rank, [minute] AS kept FROM top{tag} WHERE event_rank = 1 UNION ALL
        SELECT g.instrument, g.trade_date, t.event_rank, CASE WHEN len(list_filter(g.kept, lambda a: abs(a - t.minute) < {gap})) = 0 THEN list_append(g.kept, t.minute) ELSE g.kept END
        FROM walk{tag} g JOIN top{tag} t ON t.instrument = g.instrument AND t.trade_date = g.trade_date AND t.event_rank = g.event_rank + 1),
    ev{tag} AS (SELECT instrument, trade_date, unnest(kept) AS minute FROM (SELECT *, max(event_rank) OVER (PARTITION BY instrument, trade_date) AS top FROM walk{tag}) t WHERE event_rank = top)"""


_EV = _events_sql(K, XB, GAP)
_MD = "md AS (SELECT f.instrument, f.trade_date, avg(CASE WHEN e.minute IS NOT NULL THEN f.fwd_std END) AS m FROM fs f LEFT JOIN ev e USING (instrument, trade_date, minute) GROUP BY 1, 2)"
_BC = "bc AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS date_idx FROM (SELECT DISTINCT trade_date FROM minute_bars) t)"
_STD = f"""raw AS (SELECT instrument, trade_date, CASE WHEN count(m) OVER w >= 2 THEN stddev_samp(m) OVER w END AS factor FROM md JOIN bc USING (trade_date)
    WINDOW w AS (PARTITION BY instrument ORDER BY date_idx RANGE BETWEEN {STD - 1} PRECEDING AND CURRENT ROW))"""
_RAW = f"{_LR}, {_FS}, {_EV}, {_MD}, {_BC}, {_STD}"


def bars(spark, d):
    return view(spark, d, "minute_bars")


@query(f", t AS (SELECT *, lag(close, {H}) OVER (PARTITION BY instrument, trade_date ORDER BY minute) AS p FROM minute_bars) SELECT instrument, trade_date, minute, {_o('close / nullif(p, 0) - 1', 'ret')} FROM t")
def minute_return(spark, d):
    return intraday.minute_return(bars(spark, d), H).select(*ITM, r(F.col("ret")).alias("ret"))


@query(f", {_LR} SELECT instrument, trade_date, minute, {_o('log_ret')} FROM lr")
def minute_log_return(spark, d):
    return intraday.log_return(bars(spark, d), H).select(*ITM, r(F.col("log_ret")).alias("log_ret"))


@query(f", {_LR}, {_FS} SELECT instrument, trade_date, minute, {_o('fwd_std')} FROM fs")
def forward_window_std(spark, d):
    return intraday.forward_std(intraday.log_return(bars(spark, d), H), "log_ret", FW).select(*ITM, r(F.col("fwd_std")).alias("fwd_std"))


@query(f", {_EV} SELECT instrument, trade_date, minute, event_rank FROM top")
def topk_events_raw(spark, d):
    return intraday.top_events(bars(spark, d), "volume", K, XB).select(*ITM, "event_rank")


@query(f", {_EV} SELECT instrument, trade_date, minute FROM ev")
def topk_separated_events(spark, d):
    return intraday.separated_events(bars(spark, d), "volume", K, XB, GAP)


@query(f", {_LR}, {_FS}, {_EV}, {_MD} SELECT instrument, trade_date, {_o('m', 'factor')} FROM md")
def masked_daily_mean(spark, d):
    response = intraday.forward_std(intraday.log_return(bars(spark, d), H), "log_ret", FW)
    out = intraday.masked_daily_mean(response, "fwd_std", intraday.separated_events(bars(spark, d), "volume", K, XB, GAP))
    return out.select(*IT, r(F.col("factor")).alias("factor"))


@query(f", {_RAW} SELECT instrument, trade_date, {_o('factor')} FROM raw")
def raw_factor(spark, d):
    return pipeline.raw_factor(bars(spark, d), H, FW, K, XB, GAP, STD).select(*IT, r(F.col("factor")).alias("factor"))


@query(f", {_RAW} SELECT instrument, trade_date, {_o('factor')} FROM raw")
def tree_factor(spark, d):
    root = tree.adopted(H, FW, K, XB, GAP, STD)
    return tree.compile_tree(root, bars(spark, d)).select(*IT, r(F.col("factor")).alias("factor"))


# rolling --------------------------------------------------------------------------------------

_ROLL = "OVER (PARTITION BY instrument ORDER BY date_idx RANGE BETWEEN {} PRECEDING AND {})"
_W = _ROLL.format(STD - 1, "CURRENT ROW")
_VOL = f"""rt AS (SELECT *, close / nullif(first(close) {_ROLL.format(1, "1 PRECEDING")}, 0) - 1 AS ret FROM panel), vl AS (SELECT *, CASE WHEN count(ret) {_W} = {STD} THEN stddev_samp(ret) {_W} END AS vol FROM rt)"""


@query(f"SELECT instrument, trade_date, CASE WHEN count(close) {_W} >= 2 THEN round(stddev_samp(close) {_W}, 5) + 0.0 END AS ts_std FROM panel")
def ts_std(spark, d):
    return rolling.rolling_std(panel(spark, d), "close", STD).select(*IT, r(F.col("ts_std"), 5).alias("ts_std"))


@query(f", {_VOL} SELECT instrument, trade_date, {_o('vol')} FROM vl")
def trailing_volatility(spark, d):
    return rolling.trailing_volatility(panel(spark, d), "close", STD).select(*IT, r(F.col("vol")).alias("vol"))


@query(f"SELECT instrument, trade_date, CASE WHEN count(close) {_W} = {STD} THEN round(avg(close) {_W}, 5) + 0.0 END AS ts_mean FROM panel")
def trailing_mean(spark, d):
    return rolling.trailing_mean(panel(spark, d), "close", STD).select(*IT, r(F.col("ts_mean"), 5).alias("ts_mean"))


@query("SELECT a.instrument, a.trade_date, b.close AS close_lag FROM panel a LEFT JOIN panel b ON a.instrument = b.instrument AND b.date_idx = a.date_idx - 1")
def lag_signal(spark, d):
    return rolling.lagged(panel(spark, d), "close").select(*IT, "close_lag")


_IN = f"trade_date BETWEEN DATE '{BEGIN}' AND DATE '{FINISH}'"


@query(f"SELECT instrument, trade_date, CASE WHEN count(close) {_W} = {STD} THEN round(avg(close) {_W}, 5) + 0.0 END AS ts_mean FROM panel WHERE {_IN}")
def scope_then_smooth(spark, d):
    scoped = panel(spark, d).where(F.col("trade_date").between(BEGIN, FINISH))
    return rolling.trailing_mean(scoped, "close", STD).select(*IT, r(F.col("ts_mean"), 5).alias("ts_mean"))


@query(f", t AS (SELECT *, CASE WHEN count(close) {_W} = {STD} THEN round(avg(close) {_W}, 5) + 0.0 END AS ts_mean FROM panel) SELECT instrument, trade_date, ts_mean FROM t WHERE {_IN}")
def smooth_then_scope(spark, d):
    smoothed = rolling.trailing_mean(panel(spark, d), "close", STD)
    return smoothed.where(F.col("trade_date").between(BEGIN, FINISH)).select(*IT, r(F.col("ts_mean"), 5).alias("ts_mean"))


# cross-section --------------------------------------------------------------------------------


def _clip_sql(name: str, source: str, col: str, n: float, med: str = "median({})") -> str:
    return f"""{name}1 AS (SELECT *, {med.format(col)} OVER (PARTITION BY trade_date) AS md_ FROM {source}), {name}2 AS (SELECT *, {med.format(f'abs({col} - md_)')} OVER (PARTITION BY trade_date) AS mad_ FROM {name}1),
    {name} AS (SELECT * EXCLUDE (md_, mad_, {col}), CASE WHEN {col} IS NOT NULL THEN greatest(md_ - {n} * mad_, least(md_ + {n} * mad_, {col})) END AS {col} FROM {name}2)"""


_POOL = "pl AS (SELECT * FROM panel WHERE in_pool)"


@query(f", {_POOL}, {_clip_sql('c', 'pl', 'close', 2.0)} SELECT instrument, trade_date, round(close, 8) + 0.0 AS close FROM c")
def mad_clip(spark, d):
    return x.mad_clip(panel(spark, d).where("in_pool"), "close", 2.0).select(*IT, r(F.col("close"), 8).alias("close"))


@query(f", {_POOL}, {_clip_sql('c', 'pl', 'close', 2.0, 'quantile_disc({}, 0.5)')} SELECT instrument, trade_date, {_o('close')} FROM c")
def mad_clip_lower(spark, d):
    return x.mad_clip(panel(spark, d).where("in_pool"), "close", 2.0, "lower").select(*IT, r(F.col("close")).alias("close"))


def _resid_sql(name: str, source: str, y: str, e: str, out: str) -> str:
    w = "OVER (PARTITION BY trade_date)"
    return f"""{name}0 AS (SELECT *, CASE WHEN {y} IS NOT NULL AND {e} IS NOT NULL THEN {y} END AS y_, CASE WHEN {y} IS NOT NULL AND {e} IS NOT NULL THEN {e} END AS x_ FROM {source}),
    {name} AS (SELECT * EXCLUDE (x_, y_), CASE WHEN count(y_) {w} >= {LEAST} THEN y_ - avg(y_) {w} - coalesce(covar_pop(y_, x_) {w} / nullif(var_pop(x_) {w}, 0), 0) * (x_ - avg(x_) {w}) END AS {out} FROM {name}0)"""


@query(f", ex AS (SELECT p.*, e.ln_cap, e.grp FROM panel p JOIN exposure e USING (instrument) WHERE in_pool), {_resid_sql('n', 'ex', 'close', 'ln_cap', 'resid')} SELECT instrument, trade_date, round(resid, 5) + 0.0 AS resid FROM n")
def neutralize_one(spark, d):
    both = panel(spark, d).where("in_pool").join(view(spark, d, "exposure"), "instrument")
    return x.neutralize(both, "close", "ln_cap", LEAST).select(*IT, r(F.col("resid"), 5).alias("resid"))


@query(f""", ex AS (SELECT p.*, e.ln_cap, e.grp FROM panel p JOIN exposure e USING (instrument) WHERE in_pool),
    dm AS (SELECT *, close - avg(close) OVER (PARTITION BY trade_date, grp) AS yd, ln_cap - avg(ln_cap) OVER (PARTITION BY trade_date, grp) AS xd FROM ex)
    SELECT instrument, trade_date, CASE WHEN count(*) OVER w >= {LEAST} THEN round(yd - coalesce(sum(yd * xd) OVER w / nullif(sum(xd * xd) OVER w, 0), 0) * xd, 5) + 0.0 END AS resid FROM dm WINDOW w AS (PARTITION BY trade_date)""")
def neutralize_group_one(spark, d):
    both = panel(spark, d).where("in_pool").join(view(spark, d, "exposure"), "instrument")
    return x.neutralize_group(both, "close", "ln_cap", "grp", LEAST).select(*IT, r(F.col("resid"), 5).alias("resid"))


@query(f""", ex AS (SELECT p.*, e.ln_cap FROM panel p JOIN exposure e USING (instrument) WHERE in_pool),
    dm AS (SELECT *, close - avg(close) OVER w AS y, ln_cap - avg(ln_cap) OVER w AS a, volume - avg(volume) OVER w AS b FROM ex WINDOW w AS (PARTITION BY trade_date)),
    sm AS (SELECT *, count(*) OVER w AS n, sum(a * a) OVER w AS saa, sum(b * b) OVER w AS sbb, sum(a * b) OVER w AS sab, sum(a * y) OVER w AS say, sum(b * y) OVER w AS sby FROM dm WINDOW w AS (PARTITION BY trade_date))
    SELECT instrument, trade_date, CASE WHEN n >= 6 THEN round(y - ((sbb * say - sab * sby) * a + (saa * sby - sab * say) * b) / (saa * sbb - sab * sab), 4) + 0.0 END AS resid FROM sm""")
def neutralize_many(spark, d):
    both = panel(spark, d).where("in_pool").join(view(spark, d, "exposure"), "instrument").select(*IT, "close", "ln_cap", F.col("volume"))
    return x.neutralize_many(both, "close", ["ln_cap", "volume"], 6).select(*IT, r(F.col("resid"), 4).alias("resid"))


@query("SELECT instrument, trade_date, rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2.0 AS rank FROM panel")
def avg_rank(spark, d):
    return x.average_rank(panel(spark, d), "volume").select(*IT, "rank")


_RB = """rb AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS rb_idx FROM (SELECT DISTINCT max(trade_date) OVER (PARTITION BY date_trunc('month', trade_date)) AS trade_date FROM calendar) t)"""
_FWD = f"""{_RB}, fw AS (SELECT a.instrument, a.trade_date, g.rb_idx, a.close, a.volume, a.in_pool, n.close / a.close - 1 AS fwd FROM panel a JOIN rb g ON g.trade_date = a.trade_date
    LEFT JOIN rb g2 ON g2.rb_idx = g.rb_idx + 1 LEFT JOIN panel n ON n.trade_date = g2.trade_date AND n.instrument = a.instrument)"""
_G = 5
_BOOK = f"""{_FWD}, lv AS (SELECT *, close AS score, count(*) OVER (PARTITION BY rb_idx) AS n_ FROM fw WHERE in_pool AND close IS NOT NULL AND fwd IS NOT NULL),
    dc AS (SELECT *, ntile({_G}) OVER (PARTITION BY rb_idx ORDER BY score, instrument) AS decile, dense_rank() OVER (ORDER BY rb_idx) - 1 AS eff_idx FROM lv WHERE n_ >= {_G}),
    bk AS (SELECT *, CASE WHEN decile = {_G} THEN 1.0 / count(*) OVER (PARTITION BY rb_idx, decile) WHEN decile = 1 THEN -1.0 / count(*) OVER (PARTITION BY rb_idx, decile) ELSE 0.0 END AS weight FROM dc)"""
_GROSS = "gr AS (SELECT eff_idx, sum(weight * fwd) AS gross FROM bk GROUP BY 1)"
_TURN = """mv AS (SELECT coalesce(a.eff_idx, p.eff_idx + 1) AS eff_idx, 0.5 * abs(coalesce(a.weight, 0) - coalesce(p.weight, 0)) AS h FROM bk a FULL JOIN bk p ON a.eff_idx = p.eff_idx + 1 AND a.instrument = p.instrument),
    tv AS (SELECT eff_idx, CASE WHEN eff_idx = 0 THEN 1.0 ELSE sum(h) END AS turnover FROM mv WHERE eff_idx <= (SELECT max(eff_idx) FROM bk) GROUP BY 1)"""
_CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
_IC = f"""ic AS (SELECT eff_idx, {_CORR.format('score', 'fwd')} AS ic FROM bk GROUP BY 1),
    rk AS (SELECT *, rank() OVER (PARTITION BY rb_idx ORDER BY score) + (count(*) OVER (PARTITION BY rb_idx, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY rb_idx ORDER BY fwd) + (count(*) OVER (PARTITION BY rb_idx, fwd) - 1) / 2.0 AS rf FROM bk),
    ri AS (SELECT eff_idx, {_CORR.format('rs', 'rf')} AS rank_ic FROM rk GROUP BY 1)"""
_NET = f"{_BOOK}, {_GROSS}, {_TURN}, nt AS (SELECT eff_idx, gross, turnover, gross - 0.0030 * turnover AS net FROM gr JOIN tv USING (eff_idx))"


def _scored(spark, d):
    ends = b.rebalance_dates(view(spark, d, "supp_week").select("trade_date"), "month")
    return b.forward_return(panel(spark, d), ends).where("in_pool").withColumn("score", F.col("close"))


def _book(spark, d):
    return pipeline.book(_scored(spark, d), _G, _G)


@query(f", {_BOOK}, {_IC} SELECT eff_idx, {_o('ic')} FROM ic")
def ic(spark, d):
    return x.ic(_book(spark, d), "score", "fwd", ("eff_idx",)).select("eff_idx", r(F.col("ic")).alias("ic"))


@query(f", {_BOOK}, {_IC} SELECT eff_idx, {_o('rank_ic')} FROM ri")
def rank_ic(spark, d):
    return x.rank_ic(_book(spark, d), "score", "fwd", ("eff_idx",)).select("eff_idx", r(F.col("rank_ic")).alias("rank_ic"))


@query(f", {_POOL} SELECT instrument, trade_date, ntile(10) OVER (PARTITION BY trade_date ORDER BY close, instrument) AS decile FROM pl")
def deciles(spark, d):
    return x.quantile_groups(panel(spark, d).where("in_pool"), "close", 10).select(*IT, "decile")


@query("SELECT trade_date, count(CASE WHEN in_pool THEN close END) / count(*)::DOUBLE AS coverage FROM panel GROUP BY 1")
def coverage(spark, d):
    return x.coverage_ratio(panel(spark, d).withColumn("v", F.when(F.col("in_pool"), F.col("close"))), "v")


# backtest -------------------------------------------------------------------------------------


@query("SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS rb_idx FROM (SELECT DISTINCT max(trade_date) OVER (PARTITION BY date_trunc('week', trade_date)) AS trade_date FROM user_daily) t")
def week_end(spark, d):
    return b.rebalance_dates(view(spark, d, "user_daily"), "week")


@query(f", {_FWD} SELECT instrument, trade_date, rb_idx, {_o('fwd')} FROM fw")
def fwd_return(spark, d):
    days = panel(spark, d)
    return b.forward_return(days, b.rebalance_dates(src.calendar(days), "month")).select(*IT, "rb_idx", r(F.col("fwd")).alias("fwd"))


@query(f", {_BOOK} SELECT eff_idx, instrument, {_o('weight')} FROM bk")
def ls_weights(spark, d):
    return _book(spark, d).select("eff_idx", "instrument", r(F.col("weight")).alias("weight"))


@query(f", {_BOOK}, {_GROSS} SELECT eff_idx, {_o('gross')} FROM gr")
def gross(spark, d):
    return b.gross_return(_book(spark, d), keys=("eff_idx",)).select("eff_idx", r(F.col("gross")).alias("gross"))


@query(f", {_BOOK}, {_TURN} SELECT eff_idx, {_o('turnover')} FROM tv")
def turnover(spark, d):
    held = pipeline.weighted(_scored(spark, d), _G, _G)
    return b.turnover(b.effective_index(held)).select("eff_idx", r(F.col("turnover")).alias("turnover"))


@query(f", {_NET} SELECT eff_idx, {_o('net')} FROM nt")
def net(spark, d):
    return pipeline.replay(_scored(spark, d), _G, _G).select("eff_idx", r(F.col("net")).alias("net"))


@query(f""", {_BOOK}, pv AS (SELECT p.* FROM bk p SEMI JOIN bk a ON a.eff_idx = p.eff_idx + 1 AND a.instrument = p.instrument),
    mv AS (SELECT a.eff_idx, 0.5 * abs(a.weight - coalesce(p.weight, 0)) AS h FROM bk a LEFT JOIN pv p ON a.eff_idx = p.eff_idx + 1 AND a.instrument = p.instrument)
    SELECT eff_idx, CASE WHEN eff_idx = 0 THEN 1.0 ELSE round(sum(h), 6) + 0.0 END AS turnover FROM mv GROUP BY 1""")
def carry_book(spark, d):
    held = _book(spark, d)
    return b.turnover(held, held.select("eff_idx", "instrument")).select("eff_idx", r(F.col("turnover")).alias("turnover"))


_SHARE = 0.01  # of the capital in the book: compounding the stand-ins' returns in full leaves the range of a double's exact digits


@query(f", {_NET} SELECT {_o(f'product(1 + {_SHARE} * net) - 1', 'total')} FROM nt")
def total_return(spark, d):
    series = pipeline.replay(_scored(spark, d), _G, _G)
    return b.total_return(series.withColumn("net", _SHARE * F.col("net")), "net").select(r(F.col("total")).alias("total"))


@query(f", {_NET} SELECT round(avg(net), 6) + 0.0 AS mean, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12.0), 5) + 0.0 AS ir, count(net) AS n FROM nt")
def annual_ir(spark, d):
    series = pipeline.replay(_scored(spark, d), _G, _G)
    return b.mean_and_ir(series, "net", periods=12).select(r(F.col("mean")).alias("mean"), r(F.col("ir"), 5).alias("ir"), "n")


@query(f", {_BOOK}, pr AS (SELECT rb_idx, decile, avg({_SHARE} * fwd) AS r FROM bk GROUP BY 1, 2) SELECT decile, round(product(1 + r) - 1, 5) + 0.0 AS total FROM pr GROUP BY 1")
def decile_totals(spark, d):
    return b.group_totals(_book(spark, d).withColumn("fwd", _SHARE * F.col("fwd"))).select("decile", r(F.col("total"), 5).alias("total"))


@query(f", {_BOOK}, pr AS (SELECT rb_idx, avg({_SHARE} * fwd) AS r FROM bk GROUP BY 1) SELECT round(product(1 + r) - 1, 5) + 0.0 AS total FROM pr")
def benchmark(spark, d):
    per = _book(spark, d).groupBy("rb_idx").agg(F.avg(_SHARE * F.col("fwd")).alias("r"))
    return b.total_return(per, "r").select(r(F.col("total"), 5).alias("total"))


@query(f""", {_NET}, m AS (SELECT 'mean_net' AS metric, avg(net) AS value FROM nt UNION ALL SELECT 'weeks', count(*) FROM nt UNION ALL SELECT 'turnover', avg(turnover) FROM nt)
    SELECT e.metric, round(m.value, 6) + 0.0 AS value, e.want, e.tol, coalesce(abs(m.value - e.want) <= e.tol, FALSE) AS ok FROM (VALUES ('mean_net', 0.0::DOUBLE, 0.01::DOUBLE), ('weeks', 80.0, 5.0), ('turnover', 0.5, 0.5), ('absent', 1.0, 0.1)) e(metric, want, tol) LEFT JOIN m USING (metric)""")
def tolerance_report(spark, d):
    s = pipeline.replay(_scored(spark, d), _G, _G).agg(F.avg("net").alias("mean_net"), F.count("*").cast("double").alias("weeks"), F.avg("turnover").alias("turnover"))
    metrics = s.select(F.expr("stack(3, 'mean_net', mean_net, 'weeks', weeks, 'turnover', turnover) as (metric, value)"))
    expected = spark.createDataFrame([("mean_net", 0.0, 0.01), ("weeks", 80.0, 5.0), ("turnover", 0.5, 0.5), ("absent", 1.0, 0.1)], "metric string, want double, tol double")
    return b.tolerance_report(metrics, expected).select("metric", r(F.col("value")).alias("value"), "want", "tol", "ok")


_SIG = f"""{_VOL}, v0 AS (SELECT *, CASE WHEN in_pool THEN close END AS v FROM vl), {_clip_sql('v1c', 'v0', 'v', 5.0)}, {_resid_sql('v2', 'v1c', 'v', 'vol', 'rs_')},
    v3 AS (SELECT *, CASE WHEN in_pool AND count(rs_) {_ROLL.format(2, "CURRENT ROW")} = 3 THEN avg(rs_) {_ROLL.format(2, "CURRENT ROW")} END AS mm FROM v2), {_clip_sql('v4', 'v3', 'mm', 5.0)}"""


def _signal(spark, d):
    return pipeline.signal_from_raw(rolling.trailing_volatility(panel(spark, d), "close", STD), "close", "vol", 3, 5.0, LEAST)


@query(f", {_SIG} SELECT instrument, trade_date, round(-mm, 4) + 0.0 AS signal FROM v4")
def signal_pipeline(spark, d):
    return _signal(spark, d).select(*IT, r(F.col("signal"), 4).alias("signal"))


@query(f", {_NET}, {_IC} SELECT eff_idx, {_o('gross')}, {_o('turnover')}, {_o('net')}, {_o('ic')}, {_o('rank_ic')} FROM nt JOIN ic USING (eff_idx) JOIN ri USING (eff_idx)")
def replay_summary(spark, d):
    out = pipeline.replay(_scored(spark, d), _G, _G)
    return out.select("eff_idx", *[r(F.col(c)).alias(c) for c in ("gross", "turnover", "net", "ic", "rank_ic")])


_FACTORS, _VARIANTS = ("close", "volume"), {"A": "clip", "B": "resid", "C": "late"}


def _stage_sql() -> str:
    parts = []
    for f in _FACTORS:
        parts.append(f"""{f}_s AS (SELECT *, {f} AS v FROM ex), {_clip_sql(f"{f}_c", f"{f}_s", "v", 5.0)}, {f}_d AS (SELECT *, v - avg(v) OVER (PARTITION BY trade_date, grp) AS yd, ln_cap - avg(ln_cap) OVER (PARTITION BY trade_date, grp) AS xd FROM {f}_c),
        {f}_r AS (SELECT *, CASE WHEN count(*) OVER w >= {LEAST} THEN yd - coalesce(sum(yd * xd) OVER w / nullif(sum(xd * xd) OVER w, 0), 0) * xd END AS resid FROM {f}_d WINDOW w AS (PARTITION BY trade_date)),
        {f}_l AS (SELECT *, first(resid) {_ROLL.format(1, "1 PRECEDING")} AS late FROM {f}_r)""")
    long = " UNION ALL ".join(f"SELECT '{f}' AS factor, '{v}' AS variant, instrument, trade_date, round({c}, 5) + 0.0 AS score FROM {f}_l" for f in _FACTORS for v, c in (("A", "v"), ("B", "resid"), ("C", "late")))
    key = "factor, variant, rb_idx"
    return f""", {_FWD}, ex AS (SELECT p.*, e.ln_cap, e.grp FROM panel p JOIN exposure e USING (instrument) WHERE in_pool), {", ".join(parts)}, lg AS ({long}),
    lv AS (SELECT lg.factor, lg.variant, fw.rb_idx, instrument, lg.score, fw.fwd, count(*) OVER (PARTITION BY {key}) AS n_ FROM lg JOIN fw USING (instrument, trade_date) WHERE lg.score IS NOT NULL AND fw.fwd IS NOT NULL),
    dc AS (SELECT *, ntile({_G}) OVER (PARTITION BY {key} ORDER BY score, instrument) AS decile, dense_rank() OVER (PARTITION BY factor, variant ORDER BY rb_idx) - 1 AS eff_idx,
        rank() OVER (PARTITION BY {key} ORDER BY score) + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY {key} ORDER BY fwd) + (count(*) OVER (PARTITION BY {key}, fwd) - 1) / 2.0 AS rf FROM lv WHERE n_ >= {_G}),
    bk AS (SELECT *, CASE WHEN decile = {_G} THEN 1.0 / count(*) OVER (PARTITION BY {key}, decile) WHEN decile = 1 THEN -1.0 / count(*) OVER (PARTITION BY {key}, decile) ELSE 0.0 END AS weight FROM dc),
    gr AS (SELECT factor, variant, eff_idx, any_value(rb_idx) AS rb_idx, sum(weight * fwd) AS gross, {_CORR.format('rs', 'rf')} AS rank_ic FROM bk GROUP BY 1, 2, 3),
    mv AS (SELECT coalesce(a.factor, p.factor) AS factor, coalesce(a.variant, p.variant) AS variant, coalesce(a.eff_idx, p.eff_idx + 1) AS eff_idx, 0.5 * abs(coalesce(a.weight, 0) - coalesce(p.weight, 0)) AS h
        FROM bk a FULL JOIN bk p ON a.factor = p.factor AND a.variant = p.variant AND a.eff_idx = p.eff_idx + 1 AND a.instrument = p.instrument),
    tv AS (SELECT factor, variant, eff_idx, CASE WHEN eff_idx = 0 THEN 1.0 ELSE sum(h) END AS turnover FROM mv GROUP BY 1, 2, 3),
    nt AS (SELECT gr.*, gross - 0.0030 * turnover AS net, year(rb.trade_date) AS y FROM gr JOIN tv USING (factor, variant, eff_idx) JOIN rb USING (rb_idx))
    SELECT factor, variant, y, count(*) AS n, round(avg(rank_ic), 5) + 0.0 AS rank_ic, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(12.0), 4) + 0.0 AS icir, round(avg(net), 5) + 0.0 AS net
    FROM nt GROUP BY GROUPING SETS ((factor, variant, y), (factor, variant))"""


def _stage_scores(spark, d, dates, ends):
    """factor, variant (A clipped, B and neutral to group and size, C and a day late), instrument, rb_idx, fwd, score.

    Of the cross-sections only those of rebalances and of the day before each say anything of the scores, so windows see no others:
    the next rebalance's row is one or two rows ahead. Both factors share the exchanges; their scores are stored, a row a cell.
    """
    marked = dates.join(F.broadcast(ends), "trade_date", "left").withColumn("_next", F.lead("rb_idx").over(x.Window.orderBy("date_idx")))  # one row a day
    marked = marked.where("rb_idx is not null or _next is not null").select("trade_date", "rb_idx")
    w = x.Window.partitionBy("instrument").orderBy("date_idx")
    ahead = F.coalesce(*[F.when(F.lead("rb_idx", n).over(w) == F.col("rb_idx") + 1, F.lead("close", n).over(w)) for n in (1, 2)])
    near = panel(spark, d, dates).join(F.broadcast(marked), "trade_date").withColumn("fwd", F.try_divide(ahead, F.col("close")) - 1)
    rows = near.where("in_pool").join(view(spark, d, "exposure"), "instrument")
    for f in _FACTORS:
        rows = x.mad_clip(rows, f, 5.0, out=f"{f}_clip")
    for f in _FACTORS:
        rows = x.neutralize_group(rows, f"{f}_clip", "ln_cap", "grp", LEAST, f"{f}_resid")
    for f in _FACTORS:
        rows = rolling.lagged(rows, f"{f}_resid", 1, f"{f}_late")
    names = [f"{f}_{v}" for f in _FACTORS for v in _VARIANTS.values()]
    wide = stored(rows.where("rb_idx is not null and fwd is not null").select("instrument", "rb_idx", "fwd", *[r(F.col(c), 5).alias(c) for c in names]), "stage-scores")
    cells = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(v).alias("variant"), F.col(f"{f}_{c}").alias("score")) for f in _FACTORS for v, c in _VARIANTS.items()])
    return wide.select("instrument", "rb_idx", "fwd", F.inline(cells))


@query(_stage_sql())
def stage_compare(spark, d):
    dates = stored(src.calendar(view(spark, d, "supp_week")), "calendar")
    ends = b.rebalance_dates(dates.select("trade_date"), "month")
    books = ("factor", "variant")
    series = pipeline.replay(_stage_scores(spark, d, dates, ends), _G, _G, by=books).join(F.broadcast(ends), "rb_idx").withColumn("y", F.year("trade_date").cast("long"))  # one row a rebalance
    icir = F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")) * F.sqrt(F.lit(12.0))
    sums = series.groupingSets([(*books, "y"), books], *books, "y").agg(F.count("*").alias("n"), r(F.avg("rank_ic"), 5).alias("rank_ic"), r(icir, 4).alias("icir"), r(F.avg("net"), 5).alias("net"))
    return sums.select(*books, "y", "n", "rank_ic", "icir", "net")


@query(f""", {_BOOK}, sr AS (SELECT DISTINCT eff_idx, trade_date FROM bk) SELECT p.period, min(eff_idx) AS first_idx, max(eff_idx) AS last_idx, count(*) AS n
    FROM sr JOIN (VALUES ('select', DATE '{BEGIN}', DATE '1994-12-31'), ('valid', DATE '1995-01-01', DATE '{FINISH}')) p(period, b, f) ON trade_date BETWEEN p.b AND p.f GROUP BY 1""")
def period_bounds(spark, d):
    periods = spark.createDataFrame([("select", BEGIN, "1994-12-31"), ("valid", "1995-01-01", FINISH)], "period string, begin string, finish string")
    periods = periods.withColumns({c: F.col(c).cast("date") for c in ("begin", "finish")})
    return b.period_bounds(_book(spark, d).select("eff_idx", "trade_date").distinct(), periods)


@query(f", i AS (SELECT DISTINCT instrument FROM membership), t AS (SELECT trade_date FROM calendar WHERE trade_date BETWEEN DATE '{BEGIN}' AND DATE '{FINISH}') SELECT i.instrument, t.trade_date, s.close FROM i CROSS JOIN t LEFT JOIN supp_week s USING (instrument, trade_date)")
def aligned_close(spark, d):
    days = src.calendar(view(spark, d, "supp_week")).where(F.col("trade_date").between(BEGIN, FINISH))
    return src.aligned(view(spark, d, "supp_week"), "close", src.pit_codes(view(spark, d, "membership"), "0001-01-01", "9999-12-31"), days).select(*IT, "close")


# search and studies ---------------------------------------------------------------------------

_GRID = {"horizon": [3, 5], "window": [3, 5], "k": [5, 10], "exclude": [0, 15], "gap": [3, 5], "std": [20, 60]}


@query("""SELECT h AS horizon, w AS "window", k, e AS exclude, g AS gap, s AS std, (SELECT count(*) FROM (SELECT count(*) AS n FROM minute_bars GROUP BY instrument, trade_date) t WHERE n >= h + w AND n > e) AS days
    FROM (VALUES (3), (5)) a(h), (VALUES (3), (5)) b(w), (VALUES (5), (10)) c(k), (VALUES (0), (15)) d(e), (VALUES (3), (5)) f(g), (VALUES (20), (60)) i(s)""")
def grid(spark, d):
    """The grid, and how many instrument-days have bars enough for each combination."""
    sizes = bars(spark, d).groupBy(*IT).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("days"))  # a row a session length
    able = (F.col("n") >= F.col("horizon") + F.col("window")) & (F.col("n") > F.col("exclude"))
    return sizes.crossJoin(F.broadcast(search.grid(spark, **_GRID))).groupBy(*_GRID).agg(F.coalesce(F.sum(F.when(able, F.col("days"))), F.lit(0)).alias("days"))


_POP = "pop AS (SELECT instrument AS name, avg(close) AS f1, avg(volume) AS f2, -stddev_samp(close) AS f3 FROM panel GROUP BY 1), rp AS (SELECT name, round(f1, 3) AS f1, round(f2, 3) AS f2, round(f3, 3) AS f3 FROM pop WHERE f3 IS NOT NULL)"


def _population(spark, d):
    return panel(spark, d).groupBy(F.col("instrument").alias("name")).agg(r(F.avg("close"), 3).alias("f1"), r(F.avg("volume"), 3).alias("f2"), r(-F.stddev_samp("close"), 3).alias("f3")).where("f3 is not null")


_SWEEP = [(h, w, s) for h in (1, 2) for w in (2, 3) for s in (4, 8)]  # horizon, response window, days; the other three lists have one value
_BASE = "h2_w3_s8"


def _sweep_sql() -> str:
    parts = []
    for h, w, s in _SWEEP:
        lr, std = _LR.replace(f"lag(close, {H})", f"lag(close, {h})"), _STD.replace(f"BETWEEN {STD - 1} PRECEDING", f"BETWEEN {s - 1} PRECEDING")
        fs = _FS.replace(f"= {FW} THEN", f"= {w} THEN").replace(f"AND {FW - 1} FOLLOWING", f"AND {w - 1} FOLLOWING")
        parts.append(f"SELECT 'h{h}_w{w}_s{s}' AS combo, * FROM (WITH {lr}, {fs}, {_MD}, {_BC}, {std} SELECT instrument, trade_date, round(factor, 6) + 0.0 AS factor FROM raw) q")
    return f""", {_EV}, cb AS ({' UNION ALL '.join(parts)}), dl AS (SELECT instrument, trade_date, arg_max(close, minute) AS close FROM minute_bars GROUP BY 1, 2),
    px AS (SELECT instrument, trade_date, lead(close) OVER (PARTITION BY instrument ORDER BY trade_date) / close - 1 AS fwd FROM dl),
    jn AS (SELECT * FROM cb JOIN px USING (instrument, trade_date) WHERE factor IS NOT NULL AND fwd IS NOT NULL),
    rk AS (SELECT *, rank() OVER (PARTITION BY combo, trade_date ORDER BY factor) + (count(*) OVER (PARTITION BY combo, trade_date, factor) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY combo, trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY combo, trade_date, fwd) - 1) / 2.0 AS rb FROM jn),
    ri AS (SELECT combo, trade_date, {_CORR.format('ra', 'rb')} AS rank_ic FROM rk GROUP BY 1, 2),
    su AS (SELECT combo, avg(rank_ic) AS mean, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(252.0), 6) + 0.0 AS icir, count(rank_ic) AS n FROM ri GROUP BY 1),
    pl AS (SELECT *, row_number() OVER (ORDER BY icir DESC NULLS LAST, combo) AS place FROM su)
    SELECT combo, round(mean, 6) + 0.0 AS mean, icir, n, place, (SELECT place FROM pl WHERE combo = '{_BASE}') AS baseline_place FROM pl"""


@query(_sweep_sql())
def grid_rank(spark, d):
    days = bars(spark, d).groupBy(*IT).agg(F.max_by("close", "minute").alias("close"))
    ahead = F.lead("close").over(x.Window.partitionBy("instrument").orderBy("trade_date"))
    prices = days.withColumn("fwd", F.try_divide(ahead, F.col("close")) - 1).where("fwd is not null")
    lists = [sorted({c[i] for c in _SWEEP}) for i in range(3)]
    made = search.sweep_factors(bars(spark, d), lists[0], lists[1], [K], [XB], [GAP], lists[2]).where("factor is not null")
    named = made.select(F.format_string("h%d_w%d_s%d", "horizon", "window", "std").alias("combo"), *IT, r(F.col("factor")).alias("factor"))
    return search.sweep(named, prices, _BASE).withColumn("mean", r(F.col("mean")))


@query(f""", {_BOOK}, {_GROSS}, {_TURN}, {_IC}, nt AS (SELECT eff_idx, gross - 0.0030 * turnover AS net, turnover FROM gr JOIN tv USING (eff_idx)),
    sr AS (SELECT nt.*, rank_ic, year(g.trade_date) AS y FROM nt JOIN ri USING (eff_idx) JOIN (SELECT DISTINCT eff_idx, trade_date FROM bk) g USING (eff_idx)),
    ag AS (SELECT sign(avg(rank_ic))::DOUBLE AS direction, abs(avg(rank_ic)) - 0.5 * stddev_samp(rank_ic) AS robust_ic, avg(net) AS net_long_short, avg(turnover) AS turnover, count(rank_ic) AS valid FROM sr),
    fo AS (SELECT avg((sign(m) = direction)::INT::DOUBLE) AS fold_consistency FROM (SELECT y, avg(rank_ic) AS m FROM sr GROUP BY 1) t, ag),
    iv AS (SELECT *, score AS sc FROM bk), {_resid_sql('ir', 'iv', 'sc', 'volume', 'own')}, ii AS (SELECT rb_idx, {_CORR.format('own', 'fwd')} AS ic FROM ir WHERE own IS NOT NULL GROUP BY 1),
    wh AS (SELECT count(score)::DOUBLE / count(*) AS coverage, {_CORR.format('score', 'volume')} AS pool_correlation FROM bk)
    SELECT direction, {_o('robust_ic')}, {_o('net_long_short')}, {_o('turnover')}, valid, {_o('fold_consistency')}, round((SELECT avg(ic) FROM ii), 5) + 0.0 AS incremental_ic, {_o('coverage')}, {_o('pool_correlation')}, 5 AS complexity FROM ag, fo, wh""")
def fitness(spark, d):
    held = pipeline.weighted(_scored(spark, d), _G, _G)
    dates = held.select("rb_idx", F.year("trade_date").alias("y")).distinct()
    series = pipeline.replay(_scored(spark, d), _G, _G).join(F.broadcast(dates), "rb_idx")  # one row a rebalance
    out = search.fitness(held, series, "score", "volume", "fwd", "y", tree.complexity(tree.adopted()), LEAST)
    return out.select("direction", *[r(F.col(c)).alias(c) for c in ("robust_ic", "net_long_short", "turnover")], "valid", r(F.col("fold_consistency")).alias("fold_consistency"), r(F.col("incremental_ic"), 5).alias("incremental_ic"), r(F.col("coverage")).alias("coverage"), r(F.col("pool_correlation")).alias("pool_correlation"), "complexity")


@query(f", {_BOOK}, {_IC} SELECT sign(avg(rank_ic))::DOUBLE AS direction FROM ri")
def direction(spark, d):
    return search.direction(x.rank_ic(_book(spark, d), "score", "fwd", ("eff_idx",)))


@query(f", {_POP} SELECT name, f1, f2, f3 FROM rp x WHERE NOT EXISTS (SELECT 1 FROM rp y WHERE y.f1 >= x.f1 AND y.f2 >= x.f2 AND y.f3 >= x.f3 AND (y.f1 > x.f1 OR y.f2 > x.f2 OR y.f3 > x.f3))")
def pareto_front(spark, d):
    return skyline.pareto_front(_population(spark, d), ["f1", "f2", "f3"])


def _crowding_sql() -> str:
    gap = "CASE WHEN lag({0}) OVER (ORDER BY {0}) IS NULL OR lead({0}) OVER (ORDER BY {0}) IS NULL THEN 'inf'::DOUBLE ELSE coalesce((lead({0}) OVER (ORDER BY {0}) - lag({0}) OVER (ORDER BY {0})) / nullif(max({0}) OVER () - min({0}) OVER (), 0), 0) END"
    return f""", {_POP}, fr AS (SELECT name, f1, f2, f3 FROM rp x WHERE NOT EXISTS (SELECT 1 FROM rp y WHERE y.f1 >= x.f1 AND y.f2 >= x.f2 AND y.f3 >= x.f3 AND (y.f1 > x.f1 OR y.f2 > x.f2 OR y.f3 > x.f3))),
    cr AS (SELECT name, {' + '.join(gap.format(c) for c in ('f1', 'f2', 'f3'))} AS c FROM fr) SELECT name, CASE WHEN c < 1e300 THEN round(c, 6) + 0.0 END AS crowding FROM cr"""


@query(_crowding_sql())
def crowding(spark, d):
    front = skyline.pareto_front(_population(spark, d), ["f1", "f2", "f3"]).withColumn("pareto_rank", F.lit(0))
    c = search.crowding(front, ["f1", "f2", "f3"], tie="name")  # equal values, which the SQL leaves open, in the order of names
    return c.select("name", F.when(F.col("crowding") < 1e300, r(F.col("crowding"))).alias("crowding"))  # none at the ends


@query(f", {_VOL} SELECT 'vol' AS name, round({_CORR.format('close', 'vol')}, 6) + 0.0 AS corr FROM vl WHERE vol IS NOT NULL UNION ALL SELECT 'volume', round({_CORR.format('close', 'volume')}, 6) + 0.0 FROM panel")
def pool_corr(spark, d):
    days = panel(spark, d)
    vol = rolling.trailing_volatility(days, "close", STD).select(*IT, F.lit("vol").alias("name"), F.col("vol").alias("factor"))
    pool = vol.unionByName(days.select(*IT, F.lit("volume").alias("name"), F.col("volume").alias("factor")))
    return search.pool_correlation(days.withColumn("factor", F.col("close")), pool).select("name", r(F.col("corr")).alias("corr"))


_COMBOS = [(k, e, g) for k in (3, 5) for e in (0, 2) for g in (1, 3)]
_MASKS = ", ".join(_events_sql(k, e, g, f"_{i}") for i, (k, e, g) in enumerate(_COMBOS)) + ", mk AS (" + " UNION ALL ".join(f"SELECT 'k{k}_x{e}_g{g}' AS combo, * FROM ev_{i}" for i, (k, e, g) in enumerate(_COMBOS)) + ")"


@query(f", {_MASKS} SELECT combo, round(count(*)::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT instrument, trade_date FROM minute_bars) t), 6) AS mean_events FROM mk GROUP BY 1")
def mask_counts(spark, d):
    out = search.mask_counts(bars(spark, d), _COMBOS)
    return out.select("combo", r(F.col("mean_events")).alias("mean_events"))


@query(f""", {_MASKS}, sz AS (SELECT combo, count(*) AS n FROM mk GROUP BY 1), bo AS (SELECT a.combo AS a, c.combo AS b, count(*) AS n FROM mk a JOIN mk c USING (instrument, trade_date, minute) WHERE a.combo < c.combo GROUP BY 1, 2)
    SELECT p.combo AS a, q.combo AS b, round(coalesce(bo.n, 0)::DOUBLE / (p.n + q.n - coalesce(bo.n, 0)), 6) AS jaccard FROM sz p JOIN sz q ON p.combo < q.combo LEFT JOIN bo ON bo.a = p.combo AND bo.b = q.combo""")
def mask_jaccard(spark, d):
    return search.mask_jaccard(bars(spark, d), _COMBOS).select("a", "b", r(F.col("jaccard")).alias("jaccard"))


@query(f""", {_LR}, dd AS (SELECT CASE WHEN count(log_ret) OVER w = {FW} THEN stddev_samp(log_ret) OVER w END AS s1, CASE WHEN count(log_ret) OVER w = {FW} THEN stddev_pop(log_ret) OVER w END AS s0 FROM lr
    WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY minute ROWS BETWEEN CURRENT ROW AND {FW - 1} FOLLOWING)) SELECT round(min(s1 / s0), 6) AS ratio_min, round(max(s1 / s0), 6) AS ratio_max, round(sqrt({FW}.0 / {FW - 1}), 6) AS expected FROM dd WHERE s0 > 1e-12""")
def ddof_study(spark, d):
    return search.ddof_study(bars(spark, d), [(H, FW)]).select(*[r(F.col(c)).alias(c) for c in ("ratio_min", "ratio_max", "expected")])


@query(f""", {_LR}, dd AS (SELECT instrument, trade_date, CASE WHEN count(log_ret) OVER w = {FW} THEN stddev_samp(log_ret) OVER w END AS s1, CASE WHEN count(log_ret) OVER w = {FW} THEN stddev_pop(log_ret) OVER w END AS s0 FROM lr
    WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY minute ROWS BETWEEN CURRENT ROW AND {FW - 1} FOLLOWING)), da AS (SELECT instrument, trade_date, round(avg(s1), 8) + 0.0 AS a, round(avg(s0), 8) + 0.0 AS b FROM dd GROUP BY 1, 2),
    rr AS (SELECT rank() OVER (PARTITION BY trade_date ORDER BY a) + (count(*) OVER (PARTITION BY trade_date, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY trade_date ORDER BY b) + (count(*) OVER (PARTITION BY trade_date, b) - 1) / 2.0 AS rb FROM da WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT max(abs(ra - rb))::DOUBLE AS max_rank_difference FROM rr""")
def ddof_rank_change(spark, d):
    return search.ddof_rank_change(bars(spark, d), [(H, FW)]).select("max_rank_difference")


_HW = [(1, 3), (2, 3), (1, 4)]


def _response_sql() -> str:
    parts = []
    for h, w in _HW:
        lr = _LR.replace(f"lag(close, {H})", f"lag(close, {h})").removeprefix("lr AS (").removesuffix(")")
        parts.append(f"""SELECT 'h{h}_w{w}' AS combo, instrument, trade_date, avg(s) AS response FROM (SELECT *, CASE WHEN count(log_ret) OVER w = {w} THEN stddev_samp(log_ret) OVER w END AS s FROM ({lr}) q
            WINDOW w AS (PARTITION BY instrument, trade_date ORDER BY minute ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) t GROUP BY 2, 3""")
    return f", rs AS ({' UNION ALL '.join(parts)})"


@query(f"""{_response_sql()}, rr AS (SELECT *, rank() OVER (PARTITION BY combo ORDER BY response) + (count(*) OVER (PARTITION BY combo, response) - 1) / 2.0 AS k FROM rs WHERE response IS NOT NULL)
    SELECT p.combo AS a, q.combo AS b, round({_CORR.format('p.k', 'q.k')}, 6) + 0.0 AS corr FROM rr p JOIN rr q USING (instrument, trade_date) WHERE p.combo < q.combo GROUP BY 1, 2""")
def response_corr(spark, d):
    return search.response_correlation(search.responses(bars(spark, d), _HW), _HW).select("a", "b", r(F.col("corr")).alias("corr"))


@query(f"{_response_sql()} SELECT combo, {_o('avg(response)', 'mean')}, {_o('stddev_samp(response)', 'std')}, {_o('stddev_samp(response) / nullif(avg(response), 0)', 'cv')} FROM rs GROUP BY 1")
def response_dispersion(spark, d):
    out = search.response_dispersion(search.responses(bars(spark, d), _HW))
    return out.select("combo", *[r(F.col(c)).alias(c) for c in ("mean", "std", "cv")])


# audits ---------------------------------------------------------------------------------------


_CUTS = ["1995-06-30", "1996-12-31", "1998-06-30", "2000-06-30"]


def _causal_sql(value: str) -> str:
    """cut, rows, changed. ``value`` makes v from a table named src."""
    parts = []
    for cut in _CUTS:
        whole, erased = value.replace("src", "panel"), value.replace("src", f"(SELECT * FROM panel WHERE trade_date <= DATE '{cut}')")
        a, z = f"SELECT instrument, trade_date, v FROM ({whole}) q WHERE trade_date <= DATE '{cut}'", f"SELECT instrument, trade_date, v FROM ({erased}) q"
        parts.append(f"SELECT '{cut}' AS cut, (SELECT count(*) FROM panel WHERE trade_date <= DATE '{cut}') AS rows, (SELECT count(*) FROM ({a} EXCEPT ALL {z}) t) + (SELECT count(*) FROM ({z} EXCEPT ALL {a}) t) AS changed")
    return " UNION ALL ".join(parts)


_SQL_STD = f"SELECT instrument, trade_date, CASE WHEN count(close) {_W} >= 2 THEN round(stddev_samp(close) {_W}, 5) + 0.0 END AS v FROM src"
_SQL_VOL = f"SELECT instrument, trade_date, CASE WHEN count(ret) {_W} = {STD} THEN round(stddev_samp(ret) {_W}, 6) + 0.0 END AS v FROM (SELECT *, close / nullif(first(close) {_ROLL.format(1, '1 PRECEDING')}, 0) - 1 AS ret FROM src) s"
_SQL_AHEAD = f"SELECT instrument, trade_date, first(close) OVER (PARTITION BY instrument ORDER BY date_idx RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING) AS v FROM src"


@query(_causal_sql(_SQL_STD))
def q_causality(spark, d):
    plan = lambda days, by: rolling.rolling_std(days, "close", STD, out="v", keys=(*by, "instrument")).select(*by, *IT, r(F.col("v"), 5).alias("v"))
    return audit.causality_report(plan, panel(spark, d), _CUTS)


@query(_causal_sql(_SQL_VOL))
def q_exposure_backward(spark, d):
    plan = lambda days, by: rolling.trailing_volatility(days, "close", STD, "v", (*by, "instrument")).select(*by, *IT, r(F.col("v")).alias("v"))
    return audit.causality_report(plan, panel(spark, d), _CUTS)


@query(_causal_sql(_SQL_AHEAD))
def q_planted_lookahead(spark, d):
    ahead = lambda days, by: rolling.lagged(days, "close", -3, "v", (*by, "instrument")).select(*by, *IT, "v")
    return audit.causality_report(ahead, panel(spark, d), _CUTS)


@query("""SELECT count(*) AS cells, count(*) FILTER (NOT coalesce(abs(p.close - s.close) <= 2e-6, FALSE)) AS mismatches FROM panel p
    JOIN (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) - (isodow(l_shipdate) - 1)::INT AS trade_date, sum(l_extendedprice / l_quantity) / count(*) AS close FROM lineitem GROUP BY 1, 2) s USING (instrument, trade_date)""")
def q_close_aligned(spark, d):
    """The panel's prices against the lines themselves, whose weeks and means are worked out another way."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    monday = F.date_sub(F.col("l_shipdate").cast("date"), F.weekday(F.col("l_shipdate")))
    hand = lines.groupBy(F.col("l_suppkey").cast("string").alias("instrument"), monday.alias("trade_date")).agg((F.sum(F.col("l_extendedprice") / F.col("l_quantity")) / F.count("*")).alias("close"))
    return audit.cell_report(panel(spark, d), hand, "close", 2e-6)


@query(f", {_FWD}, nx AS (SELECT a.instrument, a.trade_date, lead(a.close) OVER w / a.close - 1 AS f, lead(g.rb_idx) OVER w - g.rb_idx AS step FROM panel a JOIN rb g USING (trade_date) WINDOW w AS (PARTITION BY a.instrument ORDER BY g.rb_idx)) SELECT count(*) AS cells, count(*) FILTER (abs(fwd - f) > 1e-9) AS mismatches FROM fw JOIN nx USING (instrument, trade_date) WHERE fwd IS NOT NULL AND step = 1")
def q_label(spark, d):
    days, ends = panel(spark, d), b.rebalance_dates(view(spark, d, "supp_week").select("trade_date"), "month")
    at = days.join(ends, "trade_date").select(*IT, "rb_idx", "close")
    after = at.select("instrument", (F.col("rb_idx") - 1).alias("rb_idx"), F.col("close").alias("after"))
    hand = at.join(after, ["instrument", "rb_idx"]).select(*IT, (F.col("after") / F.col("close") - 1).alias("fwd"))
    return audit.cell_report(b.forward_return(days, ends).where("fwd is not null"), hand, "fwd", 1e-9)


@query(f", {_SIG}, {_FWD}, s AS (SELECT DISTINCT v4.instrument, v4.trade_date FROM v4 JOIN rb USING (trade_date)), f AS (SELECT DISTINCT instrument, trade_date FROM fw), j AS (SELECT s.instrument AS a, f.instrument AS b FROM s FULL JOIN f ON s.instrument = f.instrument AND s.trade_date = f.trade_date) SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS \"both\" FROM j")
def q_shared_index(spark, d):
    ends = b.rebalance_dates(view(spark, d, "supp_week").select("trade_date"), "month")
    return audit.key_report(_signal(spark, d).join(ends, "trade_date"), b.forward_return(panel(spark, d), ends))


@query(", m AS (SELECT instrument, trade_date FROM membership SEMI JOIN supp_week USING (instrument, trade_date)), p AS (SELECT instrument, trade_date FROM panel WHERE in_pool) SELECT (SELECT count(*) FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM m) t) AS only_a, (SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM p) t) AS only_b, (SELECT count(*) FROM (SELECT * FROM p INTERSECT ALL SELECT * FROM m) t) AS \"both\"")
def q_mask_is_membership(spark, d):
    listed = view(spark, d, "membership").join(view(spark, d, "supp_week").select(*IT), IT, "left_semi")
    return audit.key_report(panel(spark, d).where("in_pool"), listed)


@query(f", {_POOL}, b1 AS (SELECT *, median(close) OVER (PARTITION BY trade_date) AS m FROM pl), b2 AS (SELECT *, median(abs(close - m)) OVER (PARTITION BY trade_date) AS a FROM b1) SELECT trade_date, count(*) FILTER (abs(close - m) > 2 * a) AS moved, count(*) FILTER (abs(greatest(m - 2 * a, least(m + 2 * a, close)) - m) > 2 * a + 1e-9) AS outside FROM b2 GROUP BY 1")
def q_clip_bounds(spark, d):
    pool = panel(spark, d).where("in_pool")
    w = x.Window.partitionBy("trade_date")
    both = x.mad_clip(pool, "close", 2.0, out="clipped").withColumn("m", F.median("close").over(w)).withColumn("a", F.median(F.abs(F.col("close") - F.col("m"))).over(w))
    return both.groupBy("trade_date").agg(F.count_if(F.col("clipped") != F.col("close")).alias("moved"), F.count_if(F.abs(F.col("clipped") - F.col("m")) > 2 * F.col("a") + 1e-9).alias("outside"))


@query(f""", h AS (SELECT p.instrument, p.trade_date, count(*) OVER w AS n, (SELECT count(*) FROM panel q WHERE q.instrument = p.instrument AND q.date_idx BETWEEN p.date_idx - 2 AND p.date_idx) AS have,
    (SELECT sum(q.close) / 3 FROM panel q WHERE q.instrument = p.instrument AND q.date_idx BETWEEN p.date_idx - 2 AND p.date_idx) AS hand, CASE WHEN count(p.close) OVER f = 3 THEN avg(p.close) OVER f END AS made FROM panel p
    WINDOW w AS (PARTITION BY p.instrument ORDER BY p.date_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY p.instrument ORDER BY p.date_idx RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT count(*) AS cells, count(*) FILTER (have = 3 AND NOT coalesce(abs(made - hand) <= 1e-6, FALSE) OR have < 3 AND made IS NOT NULL) AS mismatches, count(made) AS live, count(*) FILTER (n < 3 AND made IS NOT NULL) AS early FROM h""")
def q_smoothing(spark, d):
    days = panel(spark, d)
    lags = rolling.lagged(rolling.lagged(days, "close", 1, "l1"), "close", 2, "l2").select(*IT, ((F.col("close") + F.col("l1") + F.col("l2")) / 3).alias("ts_mean"))
    made = rolling.trailing_mean(days, "close", 3).withColumn("n", F.row_number().over(x.Window.partitionBy("instrument").orderBy("date_idx")))
    live = made.agg(F.count("ts_mean").alias("live"), F.count_if((F.col("n") < 3) & F.col("ts_mean").isNotNull()).alias("early"))
    return audit.cell_report(made, lags, "ts_mean", 1e-6).crossJoin(live)  # one row each


@query(f", {_BOOK}, sh AS (SELECT *, lead(fwd) OVER (PARTITION BY instrument ORDER BY eff_idx) AS late FROM bk) SELECT eff_idx, round({_CORR.format('score', 'fwd')}, 6) + 0.0 AS ic, round((SELECT {_CORR.format('t.score', 't.late')} FROM sh t WHERE t.eff_idx = sh.eff_idx AND t.late IS NOT NULL), 6) + 0.0 AS shifted FROM sh GROUP BY eff_idx")
def q_pairing(spark, d):
    late = F.lead("fwd").over(x.Window.partitionBy("instrument").orderBy("eff_idx"))
    held = _book(spark, d).withColumn("late", late)
    return held.groupBy("eff_idx").agg(r(x.pearson("score", "fwd")).alias("ic"), r(x.pearson("score", "late")).alias("shifted"))


@query(f", {_BOOK}, {_IC}, va AS (SELECT rb_idx FROM fw WHERE in_pool AND close IS NOT NULL AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= {_G}) SELECT (SELECT count(*) FROM ic) AS scores, (SELECT count(*) FROM va) AS weeks")
def q_series_length(spark, d):
    scores = x.ic(_book(spark, d), "score", "fwd", ("eff_idx",)).agg(F.count("*").alias("scores"))
    weeks = _scored(spark, d).where("score is not null and fwd is not null").groupBy("rb_idx").count().where(F.col("count") >= _G).agg(F.count("*").alias("weeks"))
    return scores.crossJoin(weeks)  # one row each


@query(f", {_SIG} SELECT count(*) AS leaks FROM v4 WHERE mm IS NOT NULL AND NOT in_pool")
def q_pool_leak(spark, d):
    return audit.pool_leaks(_signal(spark, d), view(spark, d, "membership"), "signal").agg(F.count("*").alias("leaks"))


@query(f", ex AS (SELECT p.*, e.ln_cap, e.grp FROM panel p JOIN exposure e USING (instrument) WHERE in_pool), {_resid_sql('n', 'ex', 'close', 'ln_cap', 'resid')} SELECT trade_date, round({_CORR.format('close', 'ln_cap')}, 6) + 0.0 AS before, round(avg(resid * ln_cap) - avg(resid) * avg(ln_cap), 3) + 0.0 AS after FROM n GROUP BY 1 HAVING count(resid) >= {LEAST}")
def q_orthogonality(spark, d):
    both = panel(spark, d).where("in_pool").join(view(spark, d, "exposure"), "instrument")
    resid = x.neutralize(both, "close", "ln_cap", LEAST).groupBy("trade_date")
    sums = resid.agg(F.count("resid").alias("n"), r(x.pearson("close", "ln_cap")).alias("before"), r(F.avg(F.col("resid") * F.col("ln_cap")) - F.avg("resid") * F.avg("ln_cap"), 3).alias("after"))
    return sums.where(F.col("n") >= LEAST).drop("n")


@query(""", e AS (SELECT min(trade_date) AS a, max(trade_date) AS z FROM membership), fi AS (SELECT instrument FROM membership, e WHERE trade_date = e.a), la AS (SELECT instrument FROM membership, e WHERE trade_date = e.z),
    sz AS (SELECT count(*) AS n FROM membership GROUP BY trade_date) SELECT (SELECT count(*) FROM fi ANTI JOIN la USING (instrument))::DOUBLE / nullif((SELECT count(*) FROM fi), 0) AS changed, (SELECT min(n) FROM sz) AS least, (SELECT max(n) FROM sz) AS most""")
def q_membership_churn(spark, d):
    return audit.membership_churn(view(spark, d, "membership"))
