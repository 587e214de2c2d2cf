"""The export job: bars, daily prices and membership in, raw and signal tables of all periods with their sidecars and a manifest out.

``spark-submit --py-files ... -m panelsmith.plans.export --bars B --daily D --membership M --out O --period select:2018-01-02:2022-12-30 --period ...``
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.plans.pipeline import Params, daily_response, period_tables
from panelsmith.sources import panel as src
from panelsmith.sources.definitions import adopted_parameters, expression
from panelsmith.sources.shared import removed, stored

PATHS = ("bars", "daily", "membership", "out")


def period_table(spark: SparkSession, periods: list[tuple[str, str, str]]) -> DataFrame:
    """period, begin, finish; raises ValueError for a repeated name or a range that ends before it begins."""
    if len({n for n, _, _ in periods}) < len(periods) or any(a > z for _, a, z in periods):
        raise ValueError("periods need names of their own, and dates in order")
    rows = spark.createDataFrame(periods, "period string, begin string, finish string")
    return rows.withColumns({c: F.col(c).cast("date") for c in ("begin", "finish")})


def tables(bars: DataFrame, daily: DataFrame, membership: DataFrame, periods: DataFrame, p: Params = Params()) -> DataFrame:
    """The cells of all periods (:func:`~panelsmith.plans.pipeline.period_tables`), from bars that are read once for all of them."""
    src.require(bars, instrument="any", trade_date="date", minute="number", close="number", volume="number")
    src.require(daily, instrument="any", trade_date="date", close="number")
    response = daily_response(bars, p.horizon, p.response_window, p.top_k, p.exclude_before, p.min_gap)
    return period_tables(response, daily, membership, periods, p)


def read_inputs(spark: SparkSession, bars: str, daily: str, membership: str, periods: DataFrame, warmup_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, daily prices and membership rows, read no further than the periods and their warmup, and bars and prices of members only."""
    members = spark.read.parquet(membership)
    days = src.calendar(src.read_panel(spark, daily, values=()))
    span = src.period_days(days, periods, warmup_days)
    ends = span.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("z")).first()
    if ends.a is None:
        raise ValueError("no period has a trading day")
    first, last = str(ends.a), str(ends.z)
    codes = src.period_codes(members, span)
    return src.read_panel(spark, bars, first, last, codes), src.read_panel(spark, daily, first, last), members.where(F.col("trade_date").between(first, last))


def record(p: Params) -> dict:
    """What the sidecars say of the parameters; all text follows them."""
    own, first = asdict(p), "smoothed on the warmup, then scoped" if p.smooth_on_warmup else "scoped, then smoothed"
    steps = f"raw -> members with a close -> MAD {p.n_mad:g} -> residual on {p.vol_window}-day volatility -> {p.smooth_days}-day mean ({first}) -> MAD {p.n_mad:g} -> x({p.direction:+d})"
    return {"expression": expression(own), "params": own, "pipeline": steps, "warmup_days_requested": p.warmup_days}


def export(spark: SparkSession, bars: str, daily: str, membership: str, out: str, periods: list[tuple[str, str, str]], p: Params = Params()) -> None:
    """Write ``raw`` and ``signal`` of all periods with their sidecars under ``out``, and the manifest of both."""
    spans = period_table(spark, periods)
    cells = stored(tables(*read_inputs(spark, bars, daily, membership, spans, p.warmup_days), spans, p), "cells")
    for name in ("raw", "signal"):
        src.write_cells(cells, f"{out}/{name}", name)
        src.write_sidecar(cells, f"{out}/{name}.json", name, record(p))
    files = src.manifest(spark, f"{out}/raw").unionByName(src.manifest(spark, f"{out}/signal"))
    files.write.json(f"{out}/manifest")
    removed(spark, cells)


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def arguments(given: list[str] | None = None) -> tuple[dict[str, str], list[tuple[str, str, str]], str | None, dict]:
    """(paths, periods, the adopted definition's file if one is named, the parameters that are given explicitly)."""
    parser = argparse.ArgumentParser(description=__doc__)
    for name in PATHS:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--period", action="append", required=True, help="name:begin:finish; may be repeated")
    parser.add_argument("--from-adopted", help="a definition file whose parameters replace the defaults, not what is given here")
    for f in fields(Params):
        flag = f"--{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            parser.add_argument(flag, type=_flag, nargs="?", const=True, default=argparse.SUPPRESS)
        else:
            parser.add_argument(flag, type=type(f.default), default=argparse.SUPPRESS)
    found = vars(parser.parse_args(given))
    periods = [tuple(text.split(":")) for text in found.pop("period")]
    if any(len(t) != 3 for t in periods):
        parser.error("a period is name:begin:finish")
    paths = {k: found.pop(k) for k in PATHS}
    return paths, periods, found.pop("from_adopted"), found


def settings(spark: SparkSession, adopted: str | None, given: dict) -> Params:
    """Defaults, replaced by those of an adopted definition, replaced by those given explicitly."""
    return Params(**(adopted_parameters(spark, adopted) if adopted else {}) | given)


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    places, spans, source, explicit = arguments()
    export(session, **places, periods=spans, p=settings(session, source, explicit))
