"""Registered queries of factor pools: regressions on several exposures, ranks of fronts, the choice of factors, the miner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelsmith.functions import rounded as r
from panelsmith.operators import search, skyline
from panelsmith.operators import xsection as x
from panelsmith.plans import miner
from panelsmith.plans.queries import _BOOK, _CORR, IT, LEAST, _book, bars, query
from panelsmith.sources.fixtures import panel, view


def _project_sql(name: str, source: str, y: str, known: list[str], by: str, least: int) -> str:
    """``name`` has ``own``: y less its least squares on the exposures, one after the other, each freed of those before it."""
    w, every = f"OVER (PARTITION BY {by})", [y, *known]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in every)
    steps = [f"{name}0 AS (SELECT *, count(*) {w} AS n_, {', '.join(f'{c} - avg({c}) {w} AS e{i}' for i, c in enumerate(every))} FROM {source} WHERE {whole})"]
    for i in range(1, len(every)):
        rest = [j for j in range(len(every)) if j == 0 or j > i]
        freed = ", ".join(f"e{j} - coalesce(sum(e{j} * e{i}) {w} / nullif(sum(e{i} * e{i}) {w}, 0), 0) * e{i} AS e{j}" for j in rest)
        steps.append(f"{name}{i} AS (SELECT * EXCLUDE ({', '.join(f'e{j}' for j in [*rest, i])}), {freed} FROM {name}{i - 1})")
    return ", ".join([*steps, f"{name} AS (SELECT *, CASE WHEN n_ >= {least} THEN e0 END AS own FROM {name}{len(known)})"])


_EX = "ex AS (SELECT p.*, e.ln_cap, (e.grp % 3)::DOUBLE AS grp FROM panel p JOIN exposure e USING (instrument) WHERE in_pool)"


@query(f", {_EX}, {_project_sql('pj', 'ex', 'close', ['ln_cap', 'volume', 'grp'], 'trade_date', 8)} SELECT instrument, trade_date, round(own, 4) + 0.0 AS resid FROM pj")
def neutralize_three(spark, d):
    both = panel(spark, d).where("in_pool").join(view(spark, d, "exposure"), "instrument").withColumn("grp", (F.col("grp") % 3).cast("double"))
    return x.neutralize_many(both, "close", ["ln_cap", "volume", "grp"], 8).select(*IT, r(F.col("resid"), 4).alias("resid"))


@query(f", {_BOOK}, hx AS (SELECT b.*, e.ln_cap FROM bk b JOIN exposure e USING (instrument)), {_project_sql('pj', 'hx', 'score', ['volume', 'ln_cap'], 'rb_idx', 6)} SELECT rb_idx, round({_CORR.format('own', 'fwd')}, 5) + 0.0 AS ic FROM pj WHERE own IS NOT NULL GROUP BY 1")
def incremental_ic_pool(spark, d):
    """IC of what two accepted factors do not explain, by rebalance."""
    held = _book(spark, d).join(view(spark, d, "exposure").select("instrument", "ln_cap"), "instrument")
    found = search.incremental_ic(held, "score", ["volume", "ln_cap"], "fwd", 6, ("rb_idx",))
    return found.where("ic is not null").select("rb_idx", r(F.col("ic"), 5).alias("ic"))


_OBJ = ["f1", "f2", "f3"]
_BEATS = " AND ".join(f"y.{c} >= x.{c}" for c in _OBJ) + " AND (" + " OR ".join(f"y.{c} > x.{c}" for c in _OBJ) + ")"


@query(f""", pp AS (SELECT instrument || '_' || year(trade_date) AS name, round(avg(close), 2) + 0.0 AS f1, round(avg(volume), 1) + 0.0 AS f2, round(-stddev_samp(close), 1) + 0.0 AS f3 FROM panel GROUP BY instrument, year(trade_date)), rp AS (SELECT * FROM pp WHERE f3 IS NOT NULL),
    r0 AS (SELECT * FROM rp x WHERE NOT EXISTS (SELECT 1 FROM rp y WHERE {_BEATS})), rs AS (SELECT * FROM rp ANTI JOIN r0 USING (name)), r1 AS (SELECT * FROM rs x WHERE NOT EXISTS (SELECT 1 FROM rs y WHERE {_BEATS}))
    SELECT name, f1, f2, f3, 0 AS pareto_rank FROM r0 UNION ALL SELECT name, f1, f2, f3, 1 FROM r1""")
def pareto_ranks(spark, d):
    """The first two fronts of every instrument's years."""
    name = F.concat_ws("_", "instrument", F.year("trade_date"))
    people = panel(spark, d).groupBy("instrument", F.year("trade_date"), name.alias("name")).agg(r(F.avg("close"), 2).alias("f1"), r(F.avg("volume"), 1).alias("f2"), r(-F.stddev_samp("close"), 1).alias("f3")).where("f3 is not null")
    return skyline.pareto_ranks(people.select("name", *_OBJ), "name", _OBJ, 1, 512)


_FACTORS = {"a": "close", "b": "close + 0.4 * volume", "c": "close + volume", "d": "-volume", "e": "volume * volume", "f": "close + 4 * volume", "g": "close"}
_MOST = 0.9


def _distinct_sql() -> str:
    every = " UNION ALL ".join(f"SELECT '{n}' AS name, instrument, trade_date, ({e})::DOUBLE AS factor FROM panel" for n, e in _FACTORS.items())
    first = ", ".join(f"('{n}', {i})" for i, n in enumerate(n for n, e in _FACTORS.items() if list(_FACTORS.values()).index(e) == list(_FACTORS).index(n)))
    return f""", ev AS ({every}), nm(name, i) AS (VALUES {first}), cr AS (SELECT p.name AS a, q.name AS b, {_CORR.format('p.factor', 'q.factor')} AS corr FROM ev p JOIN ev q USING (instrument, trade_date) WHERE p.name < q.name GROUP BY 1, 2),
    wk AS (SELECT 0 AS i, [(SELECT name FROM nm WHERE i = 0)] AS kept UNION ALL SELECT w.i + 1, CASE WHEN EXISTS (SELECT 1 FROM cr WHERE cr.b = n.name AND list_contains(w.kept, cr.a) AND abs(corr) > {_MOST}) THEN w.kept ELSE list_append(w.kept, n.name) END FROM wk w JOIN nm n ON n.i = w.i + 1)
    SELECT unnest(kept) AS name FROM wk WHERE i = (SELECT max(i) FROM nm)"""


@query(_distinct_sql())
def distinct_factors(spark, d):
    days = panel(spark, d)
    parts = [days.select(F.lit(n).alias("name"), *IT, F.expr(e).cast("double").alias("factor")) for n, e in _FACTORS.items()]
    candidates = spark.createDataFrame(list(_FACTORS.items()), "name string, expression string")
    return skyline.distinct_factors(candidates, reduce(lambda a, b: a.unionByName(b), parts), _MOST)


@query()
def miner_search(spark, d):
    """Two generations of trees over the bars, with the panel's own price as an external leaf; the same rows for the same seed."""
    days = view(spark, d, "bar_daily")
    ahead = F.lead("close").over(x.Window.partitionBy("instrument").orderBy("trade_date"))
    prices = days.withColumn("fwd", F.try_divide(ahead, F.col("close")) - 1).select(*IT, "fwd", F.date_trunc("week", "trade_date").alias("fold"))
    leaf = days.select(*IT, F.col("close").alias("factor"))
    return miner.mine(bars(spark, d), prices, miner.Search(seed=3, population=10, generations=2, keep=4), {"daily_close": leaf})
