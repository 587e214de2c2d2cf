"""Mining factors: generations of typed trees, each compiled to one plan, scored in one aggregate, and selected by rank and crowding."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.functions import rounded
from panelsmith.operators import intraday, rolling
from panelsmith.operators.search import crowding
from panelsmith.operators.skyline import pareto_ranks
from panelsmith.operators.tree import DAILY, LEAVES, RULES, Node, complexity, crossover, kind, random_tree, text
from panelsmith.operators.xsection import average_rank, pearson
from panelsmith.sources.panel import with_date_idx
from panelsmith.sources.shared import stored

OBJECTIVES = ["robust_ic", "fold_consistency", "simplicity"]
_KEY = ["instrument", "trade_date"]


@dataclass(frozen=True)
class Search:
    """How a search runs. ``keep`` of a generation breed the next ``population``; ``graft`` is the share of external leaves, ``mutate`` of new trees."""

    seed: int = 0
    population: int = 24
    generations: int = 3
    keep: int = 8
    graft: float = 0.1
    mutate: float = 0.25


def compile_population(nodes: dict[str, Node], bars: DataFrame, daily: dict[str, DataFrame] | None = None) -> DataFrame:
    """``name, instrument, trade_date, factor`` of all trees, as one plan.

    Subtrees of equal text are built once, whatever trees they are in. Minute operators are columns of one frame over a
    day's bars (one exchange), all event means one fold of it; their daily values are stored, external
    leaves (``daily``: instrument, trade_date, factor) joined to them, and daily operators are columns over an
    instrument's days (one more exchange). So scans and exchanges do not grow with the population.
    """
    daily = daily or {}
    for name, n in nodes.items():
        if kind(n, daily) != DAILY:
            raise ValueError(f"the root of {name} must be daily")
    minute: dict[str, str] = {}
    frame, specs = bars, {}

    def bar_column(n: Node) -> str:
        nonlocal frame
        if n.leaf:
            return LEAVES[n.leaf]
        if (t := text(n)) not in minute:
            source, p = bar_column(n.children[0]), RULES[n.operator].defaults | dict(n.params)
            minute[t] = name = f"_n{len(minute)}"
            if n.operator == "close_minute_log_return":
                frame = intraday.log_return(frame, p["horizon"], source, name)
            else:
                frame = intraday.forward_std(frame, source, p["window"], p["ddof"], name)
        return minute[t]

    def bases(n: Node) -> None:
        if n.operator == "masked_daily_mean_signal":
            value, mask = n.children
            p = RULES[mask.operator].defaults | dict(mask.params)
            specs.setdefault(text(n), (bar_column(value), bar_column(mask.children[0]), p["k"], p["exclude_before"], p["min_gap"]))
        elif not n.leaf:
            bases(n.children[0])

    for n in nodes.values():
        bases(n)
    days = stored(intraday.event_means_of(frame, list(specs.values())), "population")
    columns = {t: f"_m{i}" for i, t in enumerate(specs)}
    leaves = sorted({x.leaf for n in nodes.values() for x in _chain(n) if x.leaf})
    for i, leaf in enumerate(leaves):
        days = days.join(daily[leaf].select(*_KEY, F.col("factor").alias(f"_x{i}")), _KEY, "left")
        columns[leaf] = f"_x{i}"
    panel = with_date_idx(days)

    def day_column(n: Node) -> str:
        nonlocal panel
        t = text(n)
        if t not in columns:
            source, p = day_column(n.children[0]), RULES[n.operator].defaults | dict(n.params)
            name = f"_d{len(columns)}"
            build = {"seed_ts_std_daily": rolling.rolling_std, "ts_mean_daily": rolling.trailing_mean}[n.operator]
            panel = build(panel, source, **p, out=name)
            columns[t] = name
        return columns[t]

    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.col(day_column(n)).alias("factor")) for name, n in nodes.items()])
    return panel.select(*_KEY, F.inline(cells)).select("name", *_KEY, "factor")


def _chain(n: Node) -> list[Node]:
    """The daily nodes of a tree, from the root down."""
    return [n] if n.leaf or n.operator == "masked_daily_mean_signal" else [n, *_chain(n.children[0])]


def population_fitness(factors: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a name, all names in one pass: direction, robust_ic, fold_consistency, coverage, days.

    ``factors``: name, instrument, trade_date, factor; ``prices``: instrument, trade_date, fwd, fold. robust_ic is the mean
    rank IC either way less half its deviation; fold_consistency is the share of folds whose mean has the direction.
    Values are rounded to 6 digits; missing scores are 0.
    """
    both = factors.withColumn("factor", rounded(F.col("factor"), 9)).join(prices.where("fwd is not null"), _KEY)
    dates = Window.partitionBy("name", "trade_date")
    live = both.withColumn("_all", F.count("*").over(dates)).where("factor is not null")
    keys = ("name", "trade_date")
    ranks = average_rank(average_rank(live, "factor", "_rs", keys), "fwd", "_rf", keys)
    per = ranks.groupBy("name", "trade_date", "fold").agg(pearson("_rs", "_rf").alias("rank_ic"), F.count("*").alias("_n"), F.max("_all").alias("_all"))
    folds = per.groupBy("name", "fold").agg(F.sum("rank_ic").alias("s"), F.sum(F.col("rank_ic") * F.col("rank_ic")).alias("q"), F.count("rank_ic").alias("n"), F.sum("_n").alias("live"), F.sum("_all").alias("cells"))
    sums = folds.groupBy("name").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum("live").alias("live"), F.sum("cells").alias("cells"), F.collect_list(F.try_divide("s", "n")).alias("means"))
    mean = F.try_divide("s", "n")
    dev = F.sqrt(F.greatest(F.try_divide(F.col("q") - mean * F.col("s"), F.col("n") - 1), F.lit(0.0)))
    sums = sums.withColumn("direction", F.signum(rounded(F.coalesce(mean, F.lit(0.0)))))
    agree = F.size(F.filter("means", lambda m: F.signum(rounded(m)) == F.col("direction")))
    zero = lambda c: F.coalesce(rounded(c), F.lit(0.0))
    return sums.select("name", "direction", zero(F.abs(mean) - 0.5 * dev).alias("robust_ic"), zero(F.try_divide(agree, F.size("means"))).alias("fold_consistency"), zero(F.try_divide("live", "cells")).alias("coverage"), F.col("n").alias("days"))


def mine(bars: DataFrame, prices: DataFrame, s: Search = Search(), daily: dict[str, DataFrame] | None = None) -> DataFrame:
    """``name, generation, direction, robust_ic, fold_consistency, simplicity, coverage, days, pareto_rank, crowding`` of every tree of the search.

    A name is the tree's canonical text. Each generation is compiled, scored and stored in the shared folder; then ranks and
    crowding over all trees so far choose ``keep`` of them, whose crossovers and new random trees are the next generation. Trees
    that were scored are not scored again. The same seed and tables give the same rows.
    """
    spark, daily = bars.sparkSession, daily or {}
    rng, leaves = random.Random(s.seed), tuple(sorted(daily))
    known: dict[str, Node] = {}
    scored, ranked = None, None
    parents: list[Node] = []
    for generation in range(s.generations):
        fresh: dict[str, Node] = {}
        for _ in range(50 * s.population):  # a small space may have no more trees
            if len(fresh) == s.population:
                break
            tree = crossover(rng.choice(parents), rng.choice(parents), rng, leaves) if parents and rng.random() >= s.mutate else random_tree(rng, leaves, s.graft)
            if text(tree) not in known and kind(tree, daily) == DAILY:
                fresh[text(tree)] = known[text(tree)] = tree
        if not fresh:
            break
        simple = spark.createDataFrame([(t, -float(complexity(n)), generation) for t, n in fresh.items()], "name string, simplicity double, generation int")
        made = simple.join(population_fitness(compile_population(fresh, bars, daily), prices), "name", "left")
        made = stored(made.fillna(0.0, ["direction", "robust_ic", "fold_consistency", "coverage"]).fillna(0, ["days"]), "generation")
        scored = made if scored is None else scored.unionByName(made)
        ranked = stored(crowding(pareto_ranks(scored, "name", OBJECTIVES), OBJECTIVES, tie="name"), "ranked")
        best = ranked.orderBy("pareto_rank", F.col("crowding").desc(), "name").limit(s.keep).collect()  # as many as breed
        parents = [known[r.name] for r in best]
    return ranked.select("name", "generation", "direction", "robust_ic", "fold_consistency", "simplicity", "coverage", "days", "pareto_rank", "crowding")
