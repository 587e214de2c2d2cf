"""Pareto fronts and ranks of any number of candidates, and the ordered choice of factors that do not repeat each other."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.sources.shared import removed, stored

BLOCK = 4096  # candidates that are compared with each other in one task


def _undominated(points: np.ndarray) -> np.ndarray:
    """Whether no row is at least as good in all columns and better in one; rows with a missing value neither win nor lose."""
    keep = np.ones(len(points), bool)
    whole = np.flatnonzero(~np.isnan(points).any(axis=1))
    order = whole[np.lexsort(tuple(-points[whole, k] for k in reversed(range(points.shape[1]))))]  # only earlier rows win
    front, n = np.empty((len(order), points.shape[1])), 0
    for i in order.tolist():
        p = points[i]
        no_worse = (front[:n] >= p).all(axis=1)
        if no_worse.any() and (front[:n][no_worse] > p).any():
            keep[i] = False
        else:
            front[n], n = p, n + 1
    return keep


def _local_fronts(points: DataFrame, objectives: list[str], blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64(*objectives), F.lit(blocks)).cast("int")

    def front(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[_undominated(rows[objectives].to_numpy(float)), objectives]

    schema = ", ".join(f"`{o}` double" for o in objectives)
    return points.withColumn("_block", block).groupBy("_block").applyInPandas(front, schema)


def _losers(points: DataFrame, objectives: list[str], blocks: int) -> DataFrame:
    """Points that another one dominates, each pair of blocks in a task of its own."""
    block, other = F.pmod(F.xxhash64(*objectives), F.lit(blocks)).cast("int"), F.col("_o")
    dealt = points.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("_lo", F.least("_b", other)).withColumn("_hi", F.greatest("_b", other))

    def beaten(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[~_undominated(rows[objectives].to_numpy(float)), objectives]

    schema = ", ".join(f"`{o}` double" for o in objectives)
    return dealt.groupBy("_lo", "_hi").applyInPandas(beaten, schema).distinct()


def _same(a: DataFrame, b: DataFrame, objectives: list[str], how: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{o}").eqNullSafe(F.col(f"b.{o}")) for o in objectives]), how)


def pareto_front(rows: DataFrame, objectives: list[str], block: int = BLOCK) -> DataFrame:
    """Rows that no row dominates (is at least as good in all objectives, higher is better, and better in one).

    Different points are dealt into blocks; what is left of each meets that of others in fewer blocks, up a tree, until one
    block is left. Where a step leaves more than half, the front is too large for that: then each pair of blocks is compared in a
    task of its own. No task holds more than two blocks' points. Rows with a missing objective neither win nor lose.
    """
    points = rows.select(*[F.col(o).cast("double").alias(o) for o in objectives]).distinct()
    left, n = stored(points, "points"), None
    while True:
        size = left.count()
        if n is not None and (size <= block or size > n / 2):
            break
        n, last = size, left
        left = stored(_local_fronts(left, objectives, -(-max(size, 1) // block)), "fronts")
        removed(rows.sparkSession, last)
        if n <= block:
            break
    if n > block and size > block:
        left = _same(left, stored(_losers(left, objectives, -(-size // block)), "losers"), objectives, "left_anti")
    elif n > block:
        left = _local_fronts(left, objectives, 1)
    named = left.select(*[F.col(o).alias(f"_{i}") for i, o in enumerate(objectives)])
    match = reduce(lambda x, y: x & y, [F.col(o).cast("double").eqNullSafe(F.col(f"_{i}")) for i, o in enumerate(objectives)])
    return rows.join(named, match, "left_semi")


def pareto_ranks(rows: DataFrame, key: str, objectives: list[str], most: int | None = None, block: int = BLOCK) -> DataFrame:
    """Add pareto_rank: 0 for the front, 1 for the front of the rest, and so on, until none is left, or up to rank ``most`` (rows beyond it are left out).

    What is left is stored in the shared folder for each front. ``key`` tells rows apart.
    """
    left, out, rank = stored(rows, "candidates"), None, 0
    while not left.isEmpty() and (most is None or rank <= most):
        front = stored(pareto_front(left, objectives, block), "front").withColumn("pareto_rank", F.lit(rank))
        out = front if out is None else out.unionByName(front)
        left, rank = stored(left.join(front.select(key), key, "left_anti"), "candidates"), rank + 1
    return out if out is not None else rows.withColumn("pareto_rank", F.lit(0))


def factor_correlations(factors: DataFrame) -> DataFrame:
    """``a, b, corr`` (a before b) of every pair of names of ``name, instrument, trade_date, factor``, over the cells that both have.

    Cells are dealt over tasks; each task adds up the products of all pairs of its cells, so rows of pairs are
    shipped once a task and pair, not once a cell. A pair without spread has no correlation.
    """
    means = factors.groupBy("name").agg(F.avg("factor").alias("_mean"))  # a row a name
    centred = factors.join(F.broadcast(means), "name").select("name", "instrument", "trade_date", (F.col("factor") - F.col("_mean")).alias("v")).where("v is not null")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], np.ndarray] = {}
        for f in _whole_cells(frames):
            wide = f.pivot_table(index=["instrument", "trade_date"], columns="name", values="v", sort=True)
            names, values = list(wide.columns), wide.to_numpy()
            has = ~np.isnan(values)
            x, m = np.where(has, values, 0.0), has.astype(float)
            parts = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    k = (a, names[j])
                    total[k] = total.get(k, 0.0) + parts[:, i, j]
        if total:
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])

    # dealt by a hash of its own: dealt by the columns themselves, Spark leaves the exchange out where a union's parts were dealt so, and cells are torn
    cells = centred.repartition(F.xxhash64("instrument", "trade_date")).sortWithinPartitions("instrument", "trade_date", "name")
    made = cells.mapInPandas(sums, "a string, b string, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = made.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).where("n > 0")
    var = lambda p: F.col(f"s{p}{p}") - F.col(f"s{p}") * F.col(f"s{p}") / F.col("n")
    tiny = lambda p: F.when(var(p) > 1e-12 * F.col(f"s{p}{p}"), var(p))
    return s.select("a", "b", ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(tiny("x") * tiny("y"))).alias("corr"))


def _whole_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that end where a cell ends; rows are sorted by cell."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        last = (f["instrument"] == f["instrument"].iloc[-1]) & (f["trade_date"] == f["trade_date"].iloc[-1]) if len(f) else None
        if last is not None:
            held = f[last]
            if len(rest := f[~last]):
                yield rest
    if held is not None and len(held):
        yield held


def distinct_factors(candidates: DataFrame, factors: DataFrame, most: float = 0.95) -> DataFrame:
    """``name`` of the candidates (``name, expression``) that stay.

    Of equal expressions the first name stays. Then names are taken in order, and each goes if it correlates above ``most``,
    either way, with an earlier one that stayed; one that repeats only a name that went itself stays. In rounds: who has no
    undecided earlier neighbour stays, and all that are near to these go. ``factors``: name, instrument, trade_date, factor.
    """
    spark = candidates.sparkSession
    names = candidates.groupBy("expression").agg(F.min("name").alias("name")).select("name")
    near = factor_correlations(factors.join(names, "name", "left_semi")).where(F.abs(F.col("corr")) > most).select("a", "b")
    open_, links, kept = stored(names, "open"), stored(near, "links"), None
    while not open_.isEmpty():
        first = open_.join(links.select(F.col("b").alias("name")).distinct(), "name", "left_anti")
        first = stored(first, "kept")
        kept = first if kept is None else kept.unionByName(first)
        gone = links.join(first.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        done = stored(first.unionByName(gone), "decided")
        last = open_, links
        open_ = stored(open_.join(done, "name", "left_anti"), "open")
        for side in ("a", "b"):
            links = links.join(done.select(F.col("name").alias(side)), side, "left_anti")
        links = stored(links.select("a", "b"), "links")
        for t in last:
            removed(spark, t)
    return kept if kept is not None else names
