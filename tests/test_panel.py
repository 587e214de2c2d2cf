"""Panel functions that no query calls, against plain Python."""

import json
import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelsmith.operators import audit, intraday, skyline, tree
from panelsmith.operators import xsection as x
from panelsmith.plans import export, miner, pipeline
from panelsmith.sources import definitions
from panelsmith.sources import panel as src

DAYS = [date(2024, 1, 1) + timedelta(days=k) for k in range(12)]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(1)
    rows = [(f"i{i}", d, m, float(100 + rng.normal()), float(rng.integers(1, 50))) for i in range(6) for d in DAYS for m in range(25)]
    rows[3] = (*rows[3][:3], float("nan"), rows[3][4])
    return spark.createDataFrame(rows, "instrument string, trade_date date, minute int, close double, volume double")


@pytest.fixture(scope="module")
def folder(bars, tmp_path_factory):
    at = tmp_path_factory.mktemp("panel")
    bars.write.parquet(f"{at}/bars")
    daily = bars.groupBy("instrument", "trade_date").agg(F.max_by("close", "minute").alias("close"))
    daily.write.parquet(f"{at}/daily")
    daily.where("instrument <> 'i5'").select("instrument", "trade_date").write.parquet(f"{at}/members")
    return str(at)


def test_reading(spark, folder):
    members = spark.read.parquet(f"{folder}/members")
    got = src.read_panel(spark, f"{folder}/bars", "2024-01-03", "2024-01-05", members)
    assert got.count() == 5 * 3 * 25 and src.read_panel(spark, f"{folder}/bars").where("close is null").count() == 1
    rows, meta = src.build_slice(spark, f"{folder}/bars", "2024-01-05", "2024-01-08", members, 2)
    assert meta == {"instruments": 5, "dates": 4, "first": DAYS[4], "last": DAYS[7], "warmup": 2} and rows.count() == 5 * 6 * 25
    days = src.calendar(spark.read.parquet(f"{folder}/daily"))
    whole = src.aligned(spark.read.parquet(f"{folder}/daily").where("instrument <> 'i0'"), "close", spark.read.parquet(f"{folder}/daily"), days)
    assert whole.count() == 72 and whole.where("close is null").count() == 12
    with pytest.raises(ValueError, match="minute"):
        src.require(members, instrument="text", minute="number")


SMALL = {"horizon": 1, "response_window": 2, "top_k": 3, "exclude_before": 2, "min_gap": 2, "ts_std": 3, "vol_window": 3, "smooth_days": 2, "least": 3, "warmup_days": 4}


def test_export(spark, folder, tmp_path):
    given = {"bars": f"{folder}/bars", "daily": f"{folder}/daily", "membership": f"{folder}/members", "out": str(tmp_path)}
    words = [w for k, v in (given | SMALL).items() for w in (f"--{k.replace('_', '-')}", str(v))]
    paths, periods, adopted, own = export.arguments([*words, "--period", "select:2024-01-05:2024-01-08", "--period=valid:2024-01-09:2024-01-12"])
    assert paths == given and adopted is None and periods == [("select", "2024-01-05", "2024-01-08"), ("valid", "2024-01-09", "2024-01-12")]
    p = export.settings(spark, adopted, own)
    assert p.n_mad == 5.0 and p.direction == -1 and p.ts_std == 3 and not p.smooth_on_warmup and export.settings(spark, None, export.arguments([*words, "--period", "a:b:c", "--smooth-on-warmup"])[3]).smooth_on_warmup
    export.export(spark, **paths, periods=periods, p=p)
    raw, signal = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("raw", "signal"))
    assert dict(raw.dtypes) == {"instrument": "string", "trade_date": "string", "factor": "float", "status": "string"}
    assert raw.count() == signal.count() == 5 * 8 and raw.where("status = 'ok'").count() == 5 * 8
    live = {r.trade_date for r in signal.where("status = 'ok'").collect()}
    assert live == {f"2024-01-{n:02}" for n in (6, 7, 8, 10, 11, 12)}  # the first day of each period has no smoothed value
    side = json.loads((spark.read.text(f"{tmp_path}/signal.json").first()[0]))
    assert side["params"]["horizon"] == 1 and side["rows"] == 40 and side["ok_cells"] == 30 and "window=3" in side["expression"] and "2-day mean" in side["pipeline"]
    assert side["windows"]["valid"] == {"instruments": 5, "dates": 4, "first": "2024-01-09", "last": "2024-01-12", "raw_live_cells": 20, "signal_live_cells": 15}
    assert spark.read.json(f"{tmp_path}/manifest").where("length(sha256_16) = 16 and bytes > 0").count() >= 2
    for bad in ([("a", "2024-01-05", "2024-01-04")], [("a", "2024-01-01", "2024-01-02")] * 2, [("a", "1999-01-01", "1999-02-01")]):
        with pytest.raises(ValueError):
            export.export(spark, **paths, periods=bad, p=p)


def test_job_reads_no_further_than_its_periods(spark, folder):
    periods = export.period_table(spark, [("a", "2024-01-06", "2024-01-07"), ("b", "2024-01-08", "2024-01-09")])
    bars, daily, members = export.read_inputs(spark, f"{folder}/bars", f"{folder}/daily", f"{folder}/members", periods, 2)
    for t in (bars, daily, members):
        assert t.select(F.min("trade_date"), F.max("trade_date")).first() == (DAYS[3], DAYS[8])
    assert "i5" not in {r.instrument for r in bars.select("instrument").distinct().collect()}
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert all(re.search(rf"DataFilters: \[.*trade_date#\d+ {c}", plan) for c in (">= 2024-01-04", "<= 2024-01-09"))
    made = export.tables(bars, daily, members, periods, export.Params(**SMALL | {"warmup_days": 2}))
    assert len(re.findall(r"FileScan parquet \[.*minute#", made._jdf.queryExecution().executedPlan().toString())) == 1  # bars are read once for all periods


def test_a_period_has_its_own_universe_and_history(spark):
    """Two periods whose warmups overlap, each name a member of one: against one period at a time."""
    rng = np.random.default_rng(5)
    rows = [(f"n{i}", d, float(50 + rng.normal()), float(rng.normal())) for i in range(8) for d in DAYS if rng.random() < 0.9]
    table = spark.createDataFrame(rows, "instrument string, trade_date date, close double, mean_response double")
    members = table.where("(trade_date < date'2024-01-07' and instrument <> 'n7') or (trade_date >= date'2024-01-07' and instrument <> 'n0')").select("instrument", "trade_date")
    spans = [("a", "2024-01-04", "2024-01-06"), ("b", "2024-01-07", "2024-01-11")]
    for warm in (False, True):
        p = export.Params(**SMALL | {"smooth_on_warmup": warm})
        key = ["period", "instrument", "trade_date", "raw", "signal"]
        both = pipeline.period_tables(table, table, members, export.period_table(spark, spans), p).select(*key).collect()
        alone = [r for s in spans for r in pipeline.period_tables(table, table, members, export.period_table(spark, [s]), p).select(*key).collect()]
        assert sorted(map(repr, both)) == sorted(map(repr, alone)) and len(both) == 7 * 3 + 7 * 5
        assert {r.instrument for r in both if r.period == "a"} == {f"n{i}" for i in range(7)}
        assert any(r.signal is not None for r in both if r.trade_date == DAYS[6]) == warm


RECORD = {
    "family": "seed_tree", "pareto_rank": 0, "unknown": [1], "genome": {"kind": "typed_seed_tree", "name": "own", "root": None},
    "definition": {"stage_2_cross_section": {"winsorize": {"method": "MAD", "n_mad": 4.0}, "neutralize": {"vol_window": 40, "min_cross_section": 20}, "smooth": {"days": 7}, "direction": 1}},
    "measured": {"windows": {"select": {"weeks": 10, "rank_ic": 0.5}}, "full": {"weeks": 12, "net": -0.25}},
}


def test_adopted_definition(spark, tmp_path):
    node = lambda n: {"leaf": n.leaf} if n.leaf else {"operator": n.operator, "params": dict(n.params), "children": [node(c) for c in n.children]}
    record = RECORD | {"genome": RECORD["genome"] | {"root": node(tree.adopted(horizon=3, ts_std=20))}}
    (tmp_path / "own.jsonl").write_text(json.dumps(record) + "\n")
    words = ["--bars", "b", "--daily", "d", "--membership", "m", "--out", "o", "--period", "a:2024-01-01:2024-01-02", "--from-adopted", f"{tmp_path}/own.jsonl", "--smooth-days=9", "--horizon", "4"]
    _, _, adopted, own = export.arguments(words)
    p = export.settings(spark, adopted, own)
    assert (p.horizon, p.smooth_days) == (4, 9)  # given explicitly, in either form
    assert (p.ts_std, p.vol_window, p.least, p.n_mad, p.direction, p.top_k, p.warmup_days) == (20, 40, 20, 4.0, 1, 10, 80)
    got = {(r.period, r.metric): (r.want, r.tol) for r in definitions.expected_metrics(definitions.read_definitions(spark, f"{tmp_path}/own.jsonl")).collect()}
    assert got == {("select", "weeks"): (10, 0), ("select", "rank_ic"): (0.5, 1e-4), ("full", "weeks"): (12, 0), ("full", "net"): (-0.25, 2e-2)}
    assert "ts_std" in export.expression(export.asdict(p)) and "window=20" in export.expression(export.asdict(p))
    for genome in ({"kind": "x", "name": "y", "root": {"operator": "ts_mean_daily", "params": {}, "children": []}}, {"kind": "x", "name": "y", "root": None}):
        (tmp_path / "bad.jsonl").write_text(json.dumps(RECORD | {"genome": genome}) + "\n")
        with pytest.raises(ValueError):
            definitions.adopted_parameters(spark, f"{tmp_path}/bad.jsonl")
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError):
        definitions.adopted_parameters(spark, f"{tmp_path}/none.jsonl")


def test_event_mean_is_the_join(bars):
    bars = bars.where(~F.isnan("close"))
    response = intraday.forward_std(intraday.log_return(bars, 1), "log_ret", 3)
    for k, xb, gap in ((3, 0, 1), (5, 4, 6), (30, 2, 2)):
        a = intraday.event_mean(response, "fwd_std", "volume", k, xb, gap)
        b = intraday.masked_daily_mean(response, "fwd_std", intraday.separated_events(bars, "volume", k, xb, gap))
        assert audit.cell_mismatches(a, b, "factor", 1e-12).count() == 0 and audit.key_mismatches(a, b).count() == 0


def test_trees(bars):
    record = {"operator": "seed_ts_std_daily", "params": {"window": 4, "ddof": 1}, "children": [{"operator": "ts_mean_daily", "params": {"days": 2}, "children": [{"leaf": "known"}]}]}
    node = tree.parse(json.dumps(record))
    assert tree.text(node) == "seed_ts_std_daily(ts_mean_daily(known, days=2), ddof=1, window=4)" and tree.complexity(node) == 2
    known = bars.groupBy("instrument", "trade_date").agg(F.avg("volume").alias("factor"))
    assert tree.compile_tree(node, bars, {"known": known}).where("factor is not null").count() == 6 * 10
    assert tree.decode(tree.adopted()) == {"horizon": 5, "response_window": 5, "top_k": 10, "exclude_before": 15, "min_gap": 5, "ts_std": 60}
    with pytest.raises(ValueError):
        tree.decode(node)
    rng, leaves = random.Random(3), ("known",)
    grown = [tree.random_tree(rng, leaves, 0.3) for _ in range(60)]
    assert len({tree.text(t) for t in grown}) > 40 and any(leaf.leaf == "known" for t in grown for leaf in tree.subtrees(t))
    for a, b in zip(grown, grown[1:]):
        assert tree.kind(tree.crossover(a, b, rng, leaves), {"known": None}) == tree.DAILY
    for t in grown[:3]:
        assert tree.compile_tree(t, bars, {"known": known}).count() == 72


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_pareto_ranks(spark, block):
    """Against comparing all rows: with ties, repeated points and missing objectives; large fronts take the pairs of blocks."""
    rng = np.random.default_rng(2)
    points = [(k, *map(float, rng.integers(0, 6, 2))) for k in range(40)] + [(k, float(k), float(-k)) for k in range(40, 70)] + [(70, None, 3.0), (71, 2.0, 2.0), (72, 2.0, 2.0)]
    got = {r.name: r.pareto_rank for r in skyline.pareto_ranks(spark.createDataFrame(points, "name long, a double, b double"), "name", ["a", "b"], block=block).collect()}
    left, rank, want = list(points), 0, {}
    better = lambda q, p: None not in (*q, *p) and q[1] >= p[1] and q[2] >= p[2] and (q[1] > p[1] or q[2] > p[2])
    while left:
        front = [p for p in left if not any(better(q, p) for q in left)]
        want |= {p[0]: rank for p in front}
        left, rank = [p for p in left if p not in front], rank + 1
    assert got == want


def test_pareto_ranks_of_chains_and_nothing(spark):
    chain = spark.createDataFrame([(k, k) for k in range(5)], "name long, a long")
    assert {r.pareto_rank for r in skyline.pareto_ranks(chain, "name", ["a"]).collect()} == set(range(5))
    assert [r.name for r in skyline.pareto_ranks(chain, "name", ["a"], 1).orderBy("pareto_rank").collect()] == [4, 3]
    assert skyline.pareto_ranks(chain.where("a < 0"), "name", ["a"]).count() == 0 == skyline.pareto_front(chain.where("a < 0"), ["a"]).count()


def test_distinct_factors(spark):
    """Against taking names one after the other; c repeats b, which goes for a, and stays."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3, 200))
    values = {"a": base[0], "b": base[0] + 0.25 * base[1], "c": base[0] + 0.5 * base[1], "d": -base[2], "e": base[2] + 0.01 * base[0], "f": base[1], "g": np.full(200, 2.0), "h": base[0]}
    values |= {f"x{k}": base[0] * np.cos(k / 9) + base[1] * np.sin(k / 9) for k in range(12)}
    rows = [(n, f"i{k % 20}", DAYS[k // 20], float(v[k])) for n, v in values.items() for k in range(200) if not (n == "e" and k < 30)]
    factors = spark.createDataFrame(rows, "name string, instrument string, trade_date date, factor double").repartition(6)
    corr = {(r.a, r.b): r.corr for r in skyline.factor_correlations(factors).collect()}
    for (a, b), c in corr.items():
        live = slice(30, None) if "e" in (a, b) else slice(None)
        want = np.corrcoef(values[a][live], values[b][live])[0, 1] if "g" not in (a, b) else None
        assert (c is None) == (want is None) and (c is None or abs(c - want) < 1e-9)
    assert len(corr) == len(values) * (len(values) - 1) // 2
    expressions = spark.createDataFrame([(n, "same" if n in ("a", "h") else n) for n in values], "name string, expression string")
    kept = []
    for n in sorted(set(values) - {"h"}):
        if not any(abs(corr[min(n, k), max(n, k)] or 0) > 0.95 for k in kept):
            kept.append(n)
    assert sorted(r.name for r in skyline.distinct_factors(expressions, factors).collect()) == kept and "b" not in kept and "c" in kept


def test_neutralize_many(spark):
    """Against numpy's least squares a date: collinear and constant exposures, missing values, a date too small."""
    rng = np.random.default_rng(8)
    rows = []
    for k, d in enumerate(DAYS[:5]):
        for i in range(3 if k == 4 else 40):
            a, b, c = rng.normal(size=3)
            a, b, c = (a, 2 * a + 1, c) if k == 1 else (a, b, 5.0) if k == 2 else (1e6 + a, 1e6 + a + 1e-3 * b, c) if k == 3 else (a, b, c)
            rows.append((f"i{i}", d, None if i == 7 else float(rng.normal() + a - c), float(a), float(b), float("nan") if i == 9 else float(c)))
    df = spark.createDataFrame(rows, "instrument string, trade_date date, y double, a double, b double, c double")
    for use in (["a"], ["a", "b"], ["a", "b", "c"], ["c", "a"]):
        got = {(r.instrument, r.trade_date): r.resid for r in x.neutralize_many(df, "y", use, 6).collect()}
        assert len(got) == len(rows)
        for d in DAYS[:5]:
            live = [r for r in rows if r[1] == d and r[2] is not None and not any(np.isnan(r[3 + "abc".index(c)]) for c in use)]
            own = {i: v for (i, day), v in got.items() if day == d and v is not None}
            if len(live) < 6:
                assert not own
                continue
            m = np.array([[r[3 + "abc".index(c)] for c in use] for r in live])
            m = np.column_stack([np.ones(len(live)), m - m.mean(axis=0)])
            y = np.array([r[2] for r in live])
            want = y - m @ np.linalg.lstsq(m, y, rcond=1e-7)[0]
            assert own.keys() == {r[0] for r in live} and max(abs(own[r[0]] - w) for r, w in zip(live, want)) < 1e-4


def test_mismatches(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("y", 1, None), ("z", 1, 2.0)], "instrument string, trade_date int, v double")
    b = spark.createDataFrame([("x", 1, 1.1), ("y", 1, None), ("w", 1, 2.0)], "instrument string, trade_date int, v double")
    assert sorted(r.instrument for r in audit.key_mismatches(a, b).collect()) == ["w", "z"]
    assert [r.instrument for r in audit.cell_mismatches(a, b, "v").collect()] == ["x"] and audit.cell_mismatches(a, b, "v", 0.2).count() == 0
    assert audit.key_report(a, b).first().asDict() == {"only_a": 1, "only_b": 1, "both": 2} and audit.cell_report(a, b, "v").first().asDict() == {"cells": 2, "mismatches": 1}


def test_spread_rank(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(v) if v else None) for g, v in zip(rng.integers(0, 3, 600), rng.integers(0, 40, 600))] + [(0, 7)] * 300
    df = spark.createDataFrame(rows, "g int, v int")
    want = sorted(map(tuple, x.average_rank(df.where("v is not null"), "v", "k", ("g",)).select("g", "v", "k").collect()))
    for parts in (2, 16):
        assert sorted(map(tuple, x.spread_rank(df, "v", "k", ("g",), parts).select("g", "v", "k").collect())) == want


def test_causality_report_is_the_run_of_each_cut(spark, bars):
    """Against erasing and running again, for plans that look back, ahead, and drop rows."""
    days = bars.groupBy("instrument", "trade_date").agg(F.max_by("volume", "minute").alias("volume"))
    cuts = ["2024-01-03", "2024-01-07", "2024-01-11", "1999-01-01"]

    def ahead(rows, by=(), n=1):
        w = Window.partitionBy(*by, "instrument").orderBy("trade_date")
        return rows.withColumn("v", F.lead("volume", n).over(w))

    plans = [lambda rows, by=(): ahead(rows, by, -1), ahead, lambda rows, by=(): ahead(rows, by).where("v is not null")]
    for build, changes in zip(plans, (False, True, True)):
        got = {r.cut: r.changed for r in audit.causality_report(build, days, cuts).collect()}
        for cut in cuts[:3]:
            assert got[cut] == audit.causality(lambda p: build(p).select("instrument", "trade_date", "v"), days, cut).count()
            assert (got[cut] > 0) == changes
        assert set(got) == set(cuts[:3])


def test_miner(spark, bars):
    """One plan for a population: each tree as it is compiled alone; the same seed gives the same rows, and no tree twice."""
    bars = bars.where(~F.isnan("close"))
    days = bars.groupBy("instrument", "trade_date").agg(F.max_by("close", "minute").alias("close"))
    known = days.withColumn("factor", F.col("close"))
    rng = random.Random(5)
    nodes = {}
    while len(nodes) < 12:
        n = tree.random_tree(rng, ("known",), 0.3)
        nodes[tree.text(n)] = n
    whole = miner.compile_population(nodes, bars, {"known": known})
    assert len(re.findall("FileScan|Scan ExistingRDD|LogicalRDD", whole._jdf.queryExecution().optimizedPlan().toString())) <= 4
    for name, n in list(nodes.items())[:5]:
        alone = tree.compile_tree(n, bars, {"known": known})
        assert audit.cell_mismatches(whole.where(F.col("name") == name), alone, "factor", 1e-9).count() == 0
    ahead = F.lead("close").over(Window.partitionBy("instrument").orderBy("trade_date"))
    prices = days.withColumn("fwd", ahead / F.col("close") - 1).select("instrument", "trade_date", "fwd", (F.dayofmonth("trade_date") % 3).alias("fold"))
    s = miner.Search(seed=2, population=8, generations=2, keep=3)
    first, again = ([tuple(r) for r in miner.mine(bars, prices, s, {"known": known}).orderBy("name").collect()] for _ in range(2))
    assert first == again and len(first) == len({r[0] for r in first}) == 16 and {r[1] for r in first} == {0, 1} and min(r[8] for r in first) == 0


def test_leaves_of_a_record():
    leaf = tree.parse({"leaf": "close", "type": "minute_close"})
    assert leaf.leaf == "minute_close" and tree.text(leaf) == "close"
