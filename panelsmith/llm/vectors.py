"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import block_pairs, components, forest, hot_keys, map_blocks, spread_join, written


@dataclass(frozen=True)
class Settings:
    """``tables`` hash tables of ``projections`` quantised projections of width ``width`` each.

    At the least cosine, 0.9 (a distance of 0.447 between normalised vectors), a table catches a
    pair with probability 0.17, so 32 tables miss 3 of 1000 such pairs; at cosine 0.95 they miss
    fewer than 1 of 100,000. More projections make smaller buckets for larger tables.
    """

    least: float = 0.9
    tables: int = 32
    projections: int = 8
    width: float = 1.8
    block_rows: int = 2048
    seed: int = 29


def planes(dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((s.seed, dim))
    return rng.standard_normal((dim, s.tables * s.projections)), rng.uniform(0, s.width, s.tables * s.projections)


def bucket_keys(unit: np.ndarray, s: Settings) -> np.ndarray:
    """rows x tables: a hash of each table's quantised projections of the normalised vectors."""
    a, b = planes(unit.shape[1], s)
    cells = np.floor((unit @ a + b) / s.width).astype(np.int64).reshape(len(unit), s.tables, s.projections).astype(np.uint64)
    h = np.zeros(cells.shape[:2], np.uint64)
    for k in range(s.projections):
        h = (h ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _check_block(at, unit, key, node, copies, side, same, least, links, up) -> None:
    """Count the links of one pair of blocks (row numbers ``at``) that no earlier table joins; name for each row the top of its tree."""
    left = at if same else at[side[at] == 0]
    right = at if same else at[side[at] == 1]
    trees = []
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= least - 1e-9)
        i, j = rows[i], right[j]
        fresh = i != j
        if not fresh.any():
            continue
        for b in range(0, len(i), 1 << 16):  # bounds the compared keys
            cut = slice(b, b + (1 << 16))
            fresh[cut] &= ~(key[i[cut]] == key[j[cut]]).any(axis=1)
            fresh[cut] &= np.einsum("ij,ij->i", unit[i[cut]], unit[j[cut]]) >= least
        i, j = i[fresh], j[fresh]
        np.add.at(links, i, copies[j])
        if not same:
            np.add.at(links, j, copies[i])
        trees.append(forest(i, j))
    if trees:
        a, b = forest(*(np.concatenate(x) for x in zip(*trees)))
        up[a] = node[b]


def near_vectors(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Two vectors of one length link if some table has them in one bucket and their cosine, in
    double precision, is at least ``least``. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing. Equal vectors are checked once and counted as often as
    they occur; they link with each other. A pair is counted in the first table that joins it, so
    nothing is listed pair by pair: each pair of blocks of a bucket returns a count for each of
    its vectors and a spanning forest of its links. Rows with a null vec_id count as links of
    others and name no component; repeated vec_ids are vectors of their own. An empty table gives
    no rows; other columns are not read.
    """
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.size("v") > 0
    sound &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    good = base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    good = good.withColumn("node", F.xxhash64("v"))
    good = written(good, "vectors")  # one row for each different vector

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby(f["v"].map(len), sort=False):
                if len(part):
                    k = bucket_keys(_unit(part["v"]), s)
                    n = len(part)
                    yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), s.tables), "dim": np.full(n * s.tables, dim), "tab": np.tile(np.arange(s.tables), n), "val": k.ravel()})

    placed = good.select("node", "v").mapInPandas(keys, "node long, dim int, tab int, val long")
    dealt = block_pairs(written(placed, "vector-keys"), ["dim", "tab", "val"], "node", s.block_rows)
    # vectors join their places only after buckets of one row are gone
    dealt = dealt.join(good.select("node", "v", "copies"), "node")

    def check(frame: pd.DataFrame, groups: list[slice]) -> pd.DataFrame:
        node, side, copies = frame["node"].to_numpy(), frame["side"].to_numpy(), frame["copies"].to_numpy()
        tab, same, dims = frame["tab"].to_numpy(), (frame["lo"] == frame["hi"]).to_numpy(), frame["dim"].to_numpy()
        links, up = np.zeros(len(frame), np.int64), node.copy()
        for dim in np.unique(dims):
            own = np.nonzero(dims == dim)[0]
            unit = np.zeros((len(frame), dim))
            unit[own] = _unit(frame["v"].iloc[own])
            key = np.zeros((len(frame), s.tables), np.int64)
            key[own] = bucket_keys(unit[own], s)
            for g in groups:
                if dims[g.start] == dim:
                    _check_block(np.arange(g.start, g.stop), unit, key[:, : tab[g.start]], node, copies, side, bool(same[g.start]), s.least, links, up)
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "up": up[some]})

    found = written(map_blocks(dealt, ["dim", "tab", "val", "lo", "hi"], check, "node long, links long, up long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("up").alias("b")), "vector-components")
    named = good.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = written(named.select("node", "v", "root", "copies", F.coalesce("links", F.lit(0)).alias("links"), "first"), "vector-roots")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_join(named, lowest, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    hot = hot_keys(good.select("node", F.col("copies").alias("_n")), "node")
    out = spread_join(base.where("v is not null").select("vec_id", F.xxhash64("v").alias("node")), named, "node", hot=hot, scanned=True).select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
