"""Rendezvous hashing of stable record keys over weighted shards, in built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import repeated


def rendezvous(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard (0 to ``shards - 1``) with the highest weighted score for ``key``.

    The score of a shard is ``-weight / ln(u)``, ``u`` in (0, 1) being a hash of key and shard;
    ties go to the lower shard. Only the key and the shard decide a score, so another shard
    takes rows only into itself, and removing the last one moves only its own rows. A shard of
    weight 0 gets nothing.
    """
    w = [1.0] * shards if weights is None else [float(x) for x in weights]
    if len(w) != shards or min(w) < 0 or max(w) <= 0:
        raise ValueError("weights must be as many as shards, not negative, and not all 0")
    scores = []
    for s in range(shards):
        if w[s] > 0:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
            scores.append(F.struct((F.lit(w[s]) / -F.log(u)).alias("v"), F.lit(-s).alias("s")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["s"]).cast("int")


def gapless_slots(df: DataFrame, group: str, key: Column, order: list[str], buckets: int = 256) -> DataFrame:
    """Add ``slot``: the position of each row in its ``group``, gapless from 0.

    Equal rows are counted first, and written out again at the end. Each group is cut into
    ``buckets`` by a hash of ``key``. The sizes of all (group, bucket) pairs, at most groups x
    buckets rows, become offsets; the rows are numbered inside a pair only, so no task holds a
    whole group or all equal rows. Rows equal in ``order`` are numbered arbitrarily.
    """
    cut = df.groupBy(*df.columns).agg(F.count("*").alias("_many")).withColumn("_bucket", F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy(group, "_bucket").agg(F.sum("_many").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(group, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("_before", F.coalesce(F.sum("_many").over(inside), F.lit(0)))
    # groups x buckets rows at most: a bound that does not depend on the data
    placed = numbered.join(F.broadcast(starts), [group, "_bucket"])
    slot = F.col("_start") + F.col("_before") + F.col("_nth") - 1
    return repeated(placed, "_many", "_nth").withColumn("slot", slot.cast("long")).drop("_start", "_before", "_bucket", "_many", "_nth")


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Place every document in a shard by rendezvous hashing of its key (law ``key``).

    Returns key, size (UTF-8 bytes of the text plus 8), text_crc32 (unsigned; 0 for no bytes),
    law, shard, slot (position in the shard, gapless from 0) and grown_shard (the shard with one
    more of weight 1). Null text counts as no bytes. A null key is a key of its own: its rows
    share a shard, but are spread over that shard's numbering buckets by their text. Repeated
    rows get slots of their own; empty tables give no rows; other columns are not read.
    """
    grown = [*([1.0] * shards if weights is None else weights), 1.0]
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, shards, weights).alias("shard"),
        rendezvous(k, shards + 1, grown).alias("grown_shard"),
    )
    spread = F.struct(F.col(key), F.col("text_crc32"), F.col("size"))
    placed = gapless_slots(rows, "shard", spread, [key, "text_crc32", "size"])
    return placed.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
