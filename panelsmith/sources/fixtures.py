"""Panels made from the star-schema tables: the same text runs on Spark and on the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelsmith.functions import NUDGE
from panelsmith.sources.panel import with_date_idx

VIEWS = {
    "minute_bars": """SELECT event_type AS instrument, CAST(ts AS DATE) AS trade_date,
        row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS minute,
        value AS close, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS volume FROM {events}""",
    "user_daily": """SELECT CAST(user_id AS VARCHAR(20)) AS instrument, CAST(ts AS DATE) AS trade_date,
        round(avg(value) + 1e-9, 6) AS close, round(sum(value) + 1e-9, 6) AS volume, count(*) AS n FROM {events} GROUP BY 1, 2""",
    "supp_week": """SELECT CAST(l_suppkey AS VARCHAR(20)) AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
        round(avg(l_extendedprice / l_quantity) + 1e-9, 6) AS close, sum(l_quantity) AS volume FROM {lineitem} GROUP BY 1, 2""",
    "calendar": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS date_idx FROM (SELECT DISTINCT trade_date FROM {supp_week}) t",
    "membership": """SELECT a.instrument, c.trade_date FROM {supp_week} a JOIN {calendar} p ON a.trade_date = p.trade_date
        JOIN {calendar} c ON c.date_idx = p.date_idx + 1 WHERE a.volume >= 20""",
    "bar_daily": "SELECT instrument, trade_date, max_by(close, minute) AS close, sum(volume) AS volume FROM {minute_bars} GROUP BY 1, 2",
    "bar_members": """SELECT instrument, trade_date FROM (SELECT instrument, trade_date, lag(share) OVER (PARTITION BY instrument ORDER BY trade_date) AS was
        FROM (SELECT instrument, trade_date, volume / sum(volume) OVER (PARTITION BY trade_date) AS share FROM {bar_daily}) s) t WHERE was >= 0.17""",
    "exposure": "SELECT CAST(s_suppkey AS VARCHAR(20)) AS instrument, s_nationkey % 5 AS grp, ln(s_acctbal + 2000) AS ln_cap FROM {supplier}",
}
_BASE = ("events", "lineitem", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A panel as a DataFrame."""
    if name in _BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {k: view(spark, sf_dir, k) for k in (*_BASE, *VIEWS) if "{" + k + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **needs)


def panel(spark: SparkSession, sf_dir: str, calendar: DataFrame | None = None) -> DataFrame:
    """supp_week with date_idx (of ``calendar``, if it is at hand) and in_pool: membership follows from the row of the day before, so the panel is scanned once."""
    days = with_date_idx(view(spark, sf_dir, "supp_week"), calendar)
    w = Window.partitionBy("instrument").orderBy("date_idx")
    was = (F.lag("date_idx").over(w) == F.col("date_idx") - 1) & (F.lag("volume").over(w) >= 20)
    return days.withColumn("in_pool", F.coalesce(was, F.lit(False)))


def sql(tail: str) -> str:
    """Oracle text: the panels as common table expressions, and ``tail`` (more expressions, or the query)."""
    names = {k: k for k in (*_BASE, *VIEWS)}
    views = ", ".join(f"{k} AS ({v.format(**names)})" for k, v in VIEWS.items())
    pool = """panel AS (SELECT s.*, c.date_idx, m.instrument IS NOT NULL AS in_pool FROM supp_week s JOIN calendar c USING (trade_date)
        LEFT JOIN membership m USING (instrument, trade_date))"""
    tail = nudged(tail)
    return f"WITH RECURSIVE {views}, {pool}{tail if tail.lstrip().startswith(',') else ' ' + tail}"


def nudged(text: str) -> str:
    """``round(x, n)`` becomes ``round((x) + 1e-9, n)``, as :func:`panelsmith.functions.rounded` does."""
    out, at = "", 0
    while (start := text.find("round(", at)) >= 0:
        depth, comma, k = 1, -1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            comma = k if text[k] == "," and depth == 1 else comma
            k += 1
        out += f"{text[at:start]}round(({nudged(text[start + 6:comma])}) + {NUDGE}, {text[comma + 1:k - 1].strip()})"
        at = k
    return out + text[at:]
