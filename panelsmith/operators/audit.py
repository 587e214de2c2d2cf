"""Audits of a panel pipeline: causality, membership, bounds and orthogonality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.operators.xsection import ic


def causality(build: Callable[[DataFrame], DataFrame], panel: DataFrame, cut: str) -> DataFrame:
    """Rows at or before ``cut`` that change when all data after it are erased; none if the plan looks back only."""
    day = F.lit(cut).cast("date")
    full, erased = build(panel).where(F.col("trade_date") <= day), build(panel.where(F.col("trade_date") <= day))
    return full.exceptAll(erased).unionByName(erased.exceptAll(full))


def causality_report(build: Callable[[DataFrame, tuple[str, ...]], DataFrame], panel: DataFrame, cuts: list[str]) -> DataFrame:
    """cut, rows (at or before it) and changed (those that the erased data change, on either side), one row a cut.

    One run serves all cuts: each row is there once as it is, and once for every cut that does not erase it, and
    ``build(rows, by)`` keeps these runs apart by the columns ``by``. It gives ``instrument, trade_date`` (which tell rows
    apart) and ``v``. Runs meet by row, so scans and exchanges do not grow with the cuts, only rows do.
    """
    day = F.col("trade_date")
    kept = F.array_compact(F.array(*[F.when(day <= F.lit(c).cast("date"), F.lit(c)) for c in cuts]))
    runs = panel.withColumn("cut", F.explode(F.concat(F.array(F.lit("")), kept)))
    made = build(runs, ("cut",)).select("cut", "instrument", "trade_date", F.struct("v").alias("_v"))
    cells = made.groupBy("instrument", "trade_date").agg(F.first(F.when(F.col("cut") == "", F.col("_v")), True).alias("_whole"), F.map_from_entries(F.collect_list(F.when(F.col("cut") != "", F.struct("cut", "_v")))).alias("_erased"))
    each = cells.select("_whole", "_erased", F.explode(kept).alias("cut")).select("cut", "_whole", F.try_element_at("_erased", F.col("cut")).alias("_other"))
    both = F.col("_whole").isNotNull() & F.col("_other").isNotNull() & F.col("_whole.v").eqNullSafe(F.col("_other.v"))
    sides = F.col("_whole").isNotNull().cast("long") + F.col("_other").isNotNull().cast("long")
    return each.groupBy("cut").agg(F.count_if(F.col("_whole").isNotNull()).alias("rows"), F.sum(F.when(both, 0).otherwise(sides)).alias("changed"))


def cell_report(a: DataFrame, b: DataFrame, value: str, tol: float = 0.0, keys: tuple[str, ...] = ("instrument", "trade_date")) -> DataFrame:
    """cells (keys that both have) and mismatches (see :func:`cell_mismatches`), one row."""
    cells = a.select(*keys).join(b.select(*keys), list(keys)).agg(F.count("*").alias("cells"))
    return cells.crossJoin(cell_mismatches(a, b, value, tol, keys).agg(F.count("*").alias("mismatches")))


def key_report(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("instrument", "trade_date")) -> DataFrame:
    """Keys that only the first, only the second and both have, one row."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, list(keys), "full").agg(*[F.count_if(c).alias(n) for n, c in (("only_a", F.col("_b").isNull()), ("only_b", F.col("_a").isNull()), ("both", F.col("_a").isNotNull() & F.col("_b").isNotNull()))])


def pool_leaks(signal: DataFrame, membership: DataFrame, value: str) -> DataFrame:
    """Live values outside the pool."""
    return signal.where(F.col(value).isNotNull()).join(membership, ["instrument", "trade_date"], "left_anti")


def membership_churn(membership: DataFrame) -> DataFrame:
    """Share of the first day's members that are gone on the last, and least and largest daily size."""
    ends = membership.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    first = membership.join(F.broadcast(ends.select(F.col("a").alias("trade_date"))), "trade_date").select("instrument")
    last = membership.join(F.broadcast(ends.select(F.col("b").alias("trade_date"))), "trade_date").select("instrument")
    gone = first.join(last, "instrument", "left_anti").agg(F.count("*").alias("gone")).crossJoin(first.agg(F.count("*").alias("n")))
    sizes = membership.groupBy("trade_date").agg(F.count("*").alias("size")).agg(F.min("size").alias("least"), F.max("size").alias("most"))
    return gone.crossJoin(sizes).select(F.try_divide("gone", "n").alias("changed"), "least", "most")


def orthogonality(panel: DataFrame, residual: str, exposure: str) -> DataFrame:
    """The largest absolute correlation of a residual with its exposure on any date."""
    return ic(panel, residual, exposure, out="c").agg(F.max(F.abs("c")).alias("worst"))


def key_mismatches(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("instrument", "trade_date")) -> DataFrame:
    """Keys that one side lacks."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, list(keys), "full").where("_a is null or _b is null").drop("_a", "_b")


def cell_mismatches(a: DataFrame, b: DataFrame, value: str, tol: float = 0.0, keys: tuple[str, ...] = ("instrument", "trade_date")) -> DataFrame:
    """Cells of both whose values differ by more than ``tol``, or of which one is missing."""
    y = b.select(*keys, F.col(value).alias("_other"))
    same = (F.col(value).isNull() & F.col("_other").isNull()) | (F.abs(F.col(value) - F.col("_other")) <= tol)
    return a.select(*keys, value).join(y, list(keys)).where(~F.coalesce(same, F.lit(False)))
