"""Mixing sources to target weights by pivotal dependent rounding, in built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import WORD, fresh, repeated, written

FANOUT = 64


def _named(**fields: Column) -> Column:
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` for each source (one row each) of ``source, size``.

    Sources sorted by code point, null last, take the weights in turn, and share ``share`` of
    all sizes by weight; no target exceeds ``most`` times its source's size, the excess going to
    the other sources by weight until none is above. The limit is found in closed form: sources
    fill up in the order of their limit per weight. The table of sources must be small enough
    for one row (names and sums only); documents are only summed.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_rows = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("nul"), F.col("source"), F.col("source_size"))))
    one = per.agg(all_rows.alias("a"))
    ranked = one.select(
        F.transform(
            "a",
            lambda x, i: _named(
                fill=F.lit(most) * x["source_size"] / w[i % len(weights)],
                rank=i,
                source=x["source"],
                source_size=x["source_size"],
                weight=w[i % len(weights)],
            ),
        ).alias("a")
    ).select(F.sort_array("a").alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["source_size"]) * F.lit(min(share, most))
    weight = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["weight"])
    level = F.aggregate(
        "a",
        _named(left=total, weight=weight, level=F.lit(None).cast("double")),
        lambda acc, x: F.when(
            acc["level"].isNull() & (x["fill"] * acc["weight"] <= acc["left"]),
            _named(left=acc["left"] - x["fill"] * x["weight"], weight=acc["weight"] - x["weight"], level=acc["level"]),
        ).otherwise(_named(left=acc["left"], weight=acc["weight"], level=F.coalesce(acc["level"], acc["left"] / acc["weight"]))),
        lambda acc: F.coalesce(acc["level"], F.lit(float("inf"))),
    )
    return ranked.select(level.alias("level"), F.explode("a").alias("x")).select(
        F.col("x.source").alias("source"),
        F.col("x.source_size").alias("source_size"),
        F.least(F.least(F.col("x.fill"), F.col("level")) * F.col("x.weight"), F.lit(most) * F.col("x.source_size")).alias("target"),
    )


def _uniform(*key) -> Column:
    """A number in (0, 1) that depends on ``key`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _settle(items: str, row: str, seed: int) -> Column:
    """Fold the fractional documents of a group: pair the carried one with the next, move mass
    at random until one of them is whole, carry on with the other.

    Mass is counted in words, so the sum of size x copies stays as it is; each copy count keeps
    its expectation. The state is ``held`` (the carried document) and ``done`` (the settled ones).
    """
    start = _named(held=F.expr(f"cast(null as {row})"), done=F.expr(f"cast(array() as array<{row}>)"))

    def step(acc, b):
        a = acc["held"]
        ma, mb = a["frac"] * a["size"], b["frac"] * b["size"]
        to_a = F.least(a["size"] - ma, mb)  # the mass that b can give to a
        to_b = F.least(b["size"] - mb, ma)
        move_a = _uniform(a["id"], b["id"], F.lit(seed)) * (to_a + to_b) < to_b
        a_whole = F.when(move_a, a["size"] - ma <= mb).otherwise(ma <= b["size"] - mb)
        fa = F.when(move_a, (ma + to_a) / a["size"]).otherwise((ma - to_b) / a["size"])
        fb = F.when(move_a, (mb - to_a) / b["size"]).otherwise((mb + to_b) / b["size"])
        a_now, b_now = a.withField("frac", fa), b.withField("frac", fb)
        return F.when(a.isNull(), _named(held=b, done=acc["done"])).otherwise(
            _named(
                held=F.when(a_whole, b_now).otherwise(a_now),
                done=F.concat(acc["done"], F.array(F.when(a_whole, a_now).otherwise(b_now))),
            )
        )

    return F.aggregate(items, start, step)


def pivotal_rounding(items: DataFrame, seed: int = 0, fanout: int = FANOUT, name: str = "pivotal") -> DataFrame:
    """Round the fractions of ``src, id (longs), size (long > 0), frac (0 < f < 1), pay (a struct)``.

    A tree of groups of about ``fanout`` rows per source: each group settles all its rows but one,
    the residual; residuals of ``fanout`` groups make a group of the next level, up to one row per
    source, which is rounded at random. A row's group follows from its id, so a hot source makes
    more groups, not larger ones, and reruns agree; ids should differ. Returns ``pay, up`` (0 or
    1); a source's sum of size x up differs from its sum of size x frac by less than one size.
    """
    largest = items.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = 1
    while groups * fanout < largest:
        groups *= fanout
    # larger documents pair first, so that residuals tend to be small
    row = F.struct((-F.col("size")).alias("order"), F.xxhash64("id", F.lit(seed + 1)).alias("h"), "id", "size", "frac", "pay")
    level = items.select("src", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).alias("g"), row.alias("x"))
    kind = level.schema["x"].dataType.simpleString()
    out = None
    while True:
        packed = level.groupBy("src", "g").agg(F.sort_array(F.collect_list("x")).alias("items"))
        settled = written(packed.select("src", "g", _settle("items", kind, seed).alias("s")), name)
        done = settled.select(F.explode("s.done").alias("x")).select("x.pay", F.round("x.frac").cast("int").alias("up"))
        out = done if out is None else out.unionByName(done)
        if groups == 1:
            last = (_uniform("s.held.id", F.lit(seed + 2)) < F.col("s.held.frac")).cast("int")
            return out.unionByName(settled.select("s.held.pay", last.alias("up")))
        groups //= fanout
        level = settled.select("src", (F.col("g") % F.lit(groups)).alias("g"), F.col("s.held").alias("x"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """How many copies of each document the mix takes, so that sources come near their targets.

    Returns doc_id, size (words; null text 0), source_size, target, taken (copies x size), source,
    copies and text_hash (XXH64) for every row. The copies of a source's documents are target / source_size each:
    whole copies plus a fraction, which pivotal rounding settles; documents without words take
    none. Rows with a null or repeated doc_id, or equal in all, are rows of their own. An empty
    table gives no rows; other columns are not read.
    """
    base = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    base = written(base, "mix-sizes")
    targets = source_targets(base, weights, share, most).withColumnRenamed("source", "name")
    same = base.groupBy(*base.columns).agg(F.count("*").alias("n"))  # equal rows get ids of their own by their number
    rows = repeated(same, "n", "nth").select(*base.columns, F.xxhash64(*base.columns, "nth").alias("id"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("whole", F.floor(rate))
        .withColumn("frac", rate - F.floor(rate))
        .withColumn("pay", F.struct("doc_id", "size", "source_size", "target", "source", "whole", "text_hash"))
    )
    opened = (F.col("size") > 0) & (F.col("frac") > 0)
    settled = pivotal_rounding(rows.where(opened).select(F.xxhash64("source").alias("src"), "id", "size", "frac", "pay"), seed)
    all_rows = settled.unionByName(rows.where(~opened).select("pay", F.lit(0).alias("up"))).select("pay.*", "up")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0).cast("long")
    return all_rows.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "text_hash"
    )


def take_copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as :func:`mix_documents` says, with all its columns.

    Rows equal in doc_id, source and text share the copies they have together, as evenly as they can.
    """
    key, text_key, copies, alike, part, nth, start = fresh(docs, "key", "text_key", "copies", "alike", "part", "nth", "start")
    same = [key, text_key]
    keys = [F.xxhash64("doc_id", "source").alias(key), F.xxhash64("text").alias(text_key)]
    taken = mix_documents(docs, weights, share, most, seed).select(keys[0], F.col("text_hash").alias(text_key), "copies")
    taken = taken.groupBy(*same).agg(F.sum("copies").alias(copies), F.count("*").alias(alike)).where(F.col(copies) > 0)
    rows = docs.select("*", *keys, F.spark_partition_id().alias(part)).join(taken, same)
    # equal rows are numbered inside the parts of the table, so no task holds all of them
    many = rows.where(F.col(alike) > 1)
    sizes = many.groupBy(*same, part).agg(F.count("*").alias(nth))
    before = F.sum(nth).over(Window.partitionBy(*same).orderBy(part)) - F.col(nth)
    place = F.row_number().over(Window.partitionBy(*same, part).orderBy(copies)) + F.col(start)
    own = F.floor(F.col(copies) / F.col(alike)) + F.when(F.col(nth) <= F.col(copies) % F.col(alike), 1).otherwise(0)
    many = many.join(sizes.select(*same, part, before.alias(start)), [*same, part]).withColumn(nth, place).withColumn(nth, own).drop(start)
    each = rows.where(F.col(alike) == 1).withColumn(nth, F.col(copies)).unionByName(many).where(F.col(nth) > 0)
    return each.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(nth).cast("long")))).select(*[F.col(f"`{c}`") for c in docs.columns])
