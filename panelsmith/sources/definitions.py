"""Factor definitions: JSON lines of a declared schema, decoded to the parameters of both stages and to expected metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsmith.operators.tree import Node, decode, parse, text

#: fixed values: the summary metrics of a replay, and how far each may be from what was published
TOLERANCES = {"weeks": 0.0, "rank_ic": 1e-4, "rank_icir": 1e-2, "ic": 1e-4, "icir": 1e-2, "gross": 2e-2, "net": 2e-2, "turnover": 2e-3}

_METRICS = "weeks double, turnover double, net double, gross double, rank_ic double, rank_icir double, ic double, icir double, benchmark double, q1 double, q10 double"
#: A tree is recursive, which a schema is not: it stays text.
SCHEMA = f"""family string, pareto_rank long, crowding double,
    fitness struct<robust_ic: double, incremental_ic: double, net_long_short: double, complexity: double, fold_consistency: double, coverage: double,
        valid: boolean, direction: int, turnover: double, pool_correlation: double>,
    genome struct<kind: string, name: string, root: string>, expression string,
    definition struct<stage_2_cross_section: struct<winsorize: struct<method: string, n_mad: double>,
        neutralize: struct<kind: string, vol_window: int, min_cross_section: int>, smooth: struct<kind: string, days: int>, direction: int>,
        evaluation: struct<rebalance: string, `groups`: int, cost_bps: double>>,
    measured struct<windows: map<string, struct<{_METRICS.replace(" double", ": double")}>>, `full`: struct<{_METRICS.replace(" double", ": double")}>, deciles_full: array<double>>"""


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """The records of a definition file, one a line; fields that a record lacks are null, fields that the schema lacks are left out."""
    return spark.read.schema(SCHEMA).json(path)


def parameters(record) -> dict:
    """The parameters of both stages of one record: those of its tree, and those of its cross-section that it has.

    Raises ValueError for a tree of another shape than the adopted one.
    """
    if record.genome is None or record.genome.root is None:
        raise ValueError("the record has no tree")
    found = decode(parse(record.genome.root))
    cross = record.definition and record.definition.stage_2_cross_section
    if cross is not None:
        found |= {
            "vol_window": cross.neutralize and cross.neutralize.vol_window,
            "least": cross.neutralize and cross.neutralize.min_cross_section,
            "smooth_days": cross.smooth and cross.smooth.days,
            "n_mad": cross.winsorize and cross.winsorize.n_mad,
            "direction": cross.direction,
        }
    return {k: v for k, v in found.items() if v is not None}


def adopted_parameters(spark: SparkSession, path: str) -> dict:
    """:func:`parameters` of the first record of a file."""
    first = read_definitions(spark, path).where("genome is not null").first()
    if first is None:
        raise ValueError(f"{path} has no definition")
    return parameters(first)


def expected_metrics(definitions: DataFrame) -> DataFrame:
    """name, period (and ``full``), metric, want, tol: what the records say they measured, a row a metric."""
    every = F.map_concat(F.coalesce("measured.windows", F.from_json(F.lit("{}"), f"map<string, struct<{_METRICS.replace(' double', ': double')}>>")), F.create_map(F.lit("full"), F.col("measured.full")))
    rows = definitions.where("measured is not null").select(F.col("genome.name").alias("name"), F.explode(every).alias("period", "m"))
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"m.{k}").alias("want"), F.lit(tol).alias("tol")) for k, tol in TOLERANCES.items()])
    return rows.select("name", "period", F.inline(cells)).where("want is not null")


def expression(params: dict) -> str:
    """The one-line tree of these parameters: text that follows the parameters, not a literal."""
    from panelsmith.operators.tree import adopted

    keys = ("horizon", "response_window", "top_k", "exclude_before", "min_gap", "ts_std")
    root: Node = adopted(**{k: params[k] for k in keys})
    return text(root)
