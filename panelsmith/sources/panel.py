"""Panels: reading, point-in-time membership, calendars, dense rectangles and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelsmith.functions import nan_to_null


def require(df: DataFrame, **kinds: str) -> DataFrame:
    """``df`` if it has these columns and types (``number``, ``text``, ``date`` or any); else ValueError, before a plan is built."""
    types, wrong = dict(df.dtypes), []
    groups = {"number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "text": ("string", "varchar", "char"), "date": ("date", "timestamp", "timestamp_ntz")}
    for name, kind in kinds.items():
        if name not in types or (kind in groups and not types[name].startswith(groups[kind])):
            wrong.append(f"{name} {types.get(name, 'missing')}, not {kind}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def build_slice(spark: SparkSession, bars: str, begin: str, finish: str, members: DataFrame | None = None, warmup_days: int = 0) -> tuple[DataFrame, dict]:
    """Bars of a date range, with ``warmup_days`` trading days before it, and what the slice holds: instruments, dates, first, last, warmup."""
    rows = require(read_panel(spark, bars, None, finish, members), instrument="any", trade_date="date", minute="number", close="number", volume="number")
    kept = extended(rows, begin, finish, warmup_days)
    inside = F.col("trade_date") >= F.lit(begin).cast("date")
    day = F.when(inside, F.col("trade_date"))
    meta = kept.agg(F.count_distinct(F.when(inside, F.col("instrument"))).alias("instruments"), F.count_distinct(day).alias("dates"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(F.when(~inside, F.col("trade_date"))).alias("warmup"))
    return kept, meta.first().asDict()


def aligned(values: DataFrame, column: str, instruments: DataFrame, days: DataFrame) -> DataFrame:
    """``column`` on every given instrument and day, in that order of keys; missing where the table has no row."""
    grid = instruments.select("instrument").distinct().crossJoin(F.broadcast(days.select("trade_date").distinct()))  # days are few
    return grid.join(values.select("instrument", "trade_date", column), ["instrument", "trade_date"], "left")


def read_panel(spark: SparkSession, path: str, begin: str | None = None, finish: str | None = None, members: DataFrame | None = None, values: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """Rows of ``instrument, trade_date, ...`` in the date range (both ends) and, if given, of members only; NaN becomes NULL.

    Range and columns reach the Parquet scan.
    """
    df = spark.read.parquet(path)
    if begin or finish:
        df = df.where(F.col("trade_date").between(begin or "0001-01-01", finish or "9999-12-31"))
    if members is not None:
        df = df.join(members.select("instrument").distinct(), "instrument", "left_semi")
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in values if c in df.columns})


def calendar(panel: DataFrame) -> DataFrame:
    """trade_date and its position; one row a day, so numbering it in one task is cheap."""
    days = panel.select("trade_date").distinct()
    return days.withColumn("date_idx", (F.row_number().over(Window.orderBy("trade_date")) - 1).cast("long"))


def with_date_idx(panel: DataFrame, days: DataFrame | None = None) -> DataFrame:
    return panel.join(days if days is not None else calendar(panel), "trade_date")


def extended(panel: DataFrame, begin: str, finish: str, warmup_days: int) -> DataFrame:
    """The range and the ``warmup_days`` trading days before it."""
    days = calendar(panel)
    first = days.where(F.col("trade_date") >= F.lit(begin).cast("date")).agg(F.min("date_idx").alias("_first"))
    kept = days.crossJoin(first).where((F.col("date_idx") >= F.col("_first") - warmup_days) & (F.col("trade_date") <= F.lit(finish).cast("date")))
    return panel.join(kept.drop("_first"), "trade_date")


def pit_codes(membership: DataFrame, begin: str, finish: str) -> DataFrame:
    """Instruments that are members at any time in the range (both ends)."""
    return membership.where(F.col("trade_date").between(begin, finish)).select("instrument").distinct()


def pit_mask(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Add in_pool from membership rows ``instrument, trade_date``."""
    days = membership.select("instrument", "trade_date").distinct().withColumn("in_pool", F.lit(True))
    return panel.join(days, ["instrument", "trade_date"], "left").withColumn("in_pool", F.coalesce("in_pool", F.lit(False)))


def interval_days(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """Membership rows of half-open intervals ``instrument, start, end`` on the calendar; an interval without end is open.

    Each interval becomes its calendar days, which meet the trading days by equality.
    """
    ends = days.agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_z"))
    first, last = F.greatest("start", "_a"), F.least(F.coalesce(F.date_sub("end", 1), F.col("_z")), F.col("_z"))
    spans = intervals.crossJoin(F.broadcast(ends)).where(first <= last)  # one row
    return spans.select("instrument", F.explode(F.sequence(first, last)).alias("trade_date")).join(F.broadcast(days.select("trade_date")), "trade_date", "left_semi").select("instrument", "trade_date").distinct()


def period_days(days: DataFrame, periods: DataFrame, warmup_days: int = 0) -> DataFrame:
    """period, trade_date, date_idx, inside: the trading days of every ``period, begin, finish`` (both ends), and up to ``warmup_days`` before its first.

    A day is there once for each period it belongs to or warms up. ``days``: trade_date, date_idx; both tables are small.
    """
    own = days.join(F.broadcast(periods), F.col("trade_date").between(F.col("begin"), F.col("finish")))
    ends = own.groupBy("period").agg(F.min("date_idx").alias("_a"), F.max("date_idx").alias("_z"))
    span = F.sequence(F.greatest(F.col("_a") - warmup_days, F.lit(0)), F.col("_z"))
    return ends.select("period", "_a", F.explode(span).alias("date_idx")).join(days, "date_idx").select("period", "trade_date", "date_idx", (F.col("date_idx") >= F.col("_a")).alias("inside"))


def period_codes(membership: DataFrame, span: DataFrame) -> DataFrame:
    """period, instrument: who is a member on any day inside a period of :func:`period_days`."""
    return membership.join(F.broadcast(span.where("inside").select("period", "trade_date")), "trade_date").select("period", "instrument").distinct()


def dense_rectangle(values: DataFrame, column: str) -> DataFrame:
    """Every instrument on every day, with the value and its status (``ok``, ``invalid``)."""
    grid = values.select("instrument").distinct().crossJoin(F.broadcast(values.select("trade_date").distinct()))  # days are few
    out = grid.join(values.select("instrument", "trade_date", F.col(column).alias("factor")), ["instrument", "trade_date"], "left")
    return out.withColumn("status", F.when(F.col("factor").isNull(), "invalid").otherwise("ok"))


def write_factor(values: DataFrame, path: str, column: str, parts: int | None = None) -> None:
    """The long interchange table of the dense rectangle of ``values`` (see :func:`write_cells`)."""
    write_cells(dense_rectangle(values, column), path, "factor", parts)


def write_cells(cells: DataFrame, path: str, column: str, parts: int | None = None) -> None:
    """The long interchange table, sorted by instrument and date: date as text, factor as float, status ``ok`` or ``invalid``."""
    out = cells.select("instrument", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), F.col(column).cast("float").alias("factor"))
    out = out.withColumn("status", F.when(F.col("factor").isNull(), "invalid").otherwise("ok"))
    out.repartitionByRange(*([parts] if parts else []), "instrument", "trade_date").sortWithinPartitions("instrument", "trade_date").write.parquet(path)


def coverage(values: DataFrame, column: str, periods: DataFrame | None = None) -> DataFrame:
    """First and last date, instruments, rows and live cells, for each period if ``period, begin, finish`` are given."""
    keys = []
    if periods is not None:
        values, keys = values.join(F.broadcast(periods), F.col("trade_date").between(F.col("begin"), F.col("finish"))), ["period"]
    return values.groupBy(*keys).agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count_distinct("instrument").alias("instruments"), F.count("*").alias("rows"), F.count(column).alias("ok_cells"))


def period_coverage(cells: DataFrame) -> DataFrame:
    """instruments, dates, first, last and live cells of ``raw`` and ``signal``, one row a ``period``."""
    return cells.groupBy("period").agg(
        F.count_distinct("instrument").alias("instruments"), F.count_distinct("trade_date").alias("dates"), F.min("trade_date").alias("first"), F.max("trade_date").alias("last"),
        F.count("raw").alias("raw_live_cells"), F.count("signal").alias("signal_live_cells"),
    )


def write_sidecar(cells: DataFrame, path: str, column: str, record: dict) -> None:
    """A JSON record beside the table of ``column``: what each period covers, rows and live cells, and ``record`` (text that follows the parameters)."""
    windows = period_coverage(cells).select("period", F.struct("instruments", "dates", *[F.col(c).cast("string").alias(c) for c in ("first", "last")], "raw_live_cells", "signal_live_cells").alias("w"))
    whole = windows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("period", "w")))).alias("windows"))  # a row a period
    counts = cells.agg(F.count("*").alias("rows"), F.count(column).alias("ok_cells"))
    fields = {k: F.from_json(F.lit(json.dumps(v)), F.schema_of_json(F.lit(json.dumps(v)))) if isinstance(v, (dict, list)) else F.lit(v) for k, v in record.items()}
    whole.crossJoin(counts).withColumns(fields | {"column": F.lit(column)}).coalesce(1).write.json(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and the first 16 digits of the SHA-256 of every file of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"), F.substring(F.sha2("content", 256), 1, 16).alias("sha256_16"))
