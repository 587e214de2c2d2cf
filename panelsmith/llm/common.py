"""Helpers that several operators share: shared storage, components, block pairs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local
    (tests) a temporary folder is made and set as the checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="panelsmith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/panelsmith-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; Arrow batches to Python workers hold ``ARROW_BYTES`` of rows at most from now on, so long texts do not fill a worker."""
    setting, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(setting, str(ARROW_BYTES + 1)).rstrip("bB")) > ARROW_BYTES:
        conf.set(setting, str(ARROW_BYTES))
    return df


TOOLS: list[Callable[[], None]] = []  # each drops a tool that a Python worker remembers for the tasks of one kind of stage


def lean(run: Callable[[Iterator], Iterator], tools: bool = False) -> Callable[[Iterator], Iterator]:
    """``run``, for a task's batches, so that its worker keeps little for later stages, whose tasks it runs beside a JVM that needs the memory.

    What other stages' tasks remember is dropped first, unless the task uses such ``tools`` itself; what was freed goes back to the system at the end.
    """

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        if not tools:
            drop_tools()
        yield from run(batches)
        give_back()

    return task


def drop_tools() -> None:
    for drop in TOOLS:
        drop()


def give_back() -> None:
    """Return the freed memory of Arrow and of the C library to the system, where they can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`new_folder` that no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask for the shuffle files of plans that nothing refers to any more: Spark drops them when the driver collects its garbage, which a loop of small jobs seldom makes it do."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has in any case: each of ``names``, with underscores before it as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


HOT_KEYS = 2048  # a key may be hot if it has more than this part of all rows; so there are no more hot keys
HOT_ROWS = 64  # and more rows than this


def hot_keys(counts: DataFrame, key: str, total: int | None = None) -> tuple[DataFrame | None, float]:
    """The keys with more than 1 / ``HOT_KEYS`` of all rows (none: None), and that part of all rows, from ``key, _n`` (its rows).

    The table is small whatever the data: it may be broadcast.
    """
    if total is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_ROWS, total / HOT_KEYS)
    top = counts.where(F.col(key).isNotNull() & (F.col("_n") > least)).select(F.col(key).alias("_hot"), F.col("_n").cast("long").alias("_n"))
    rows = top.collect()  # at most HOT_KEYS
    return (counts.sparkSession.createDataFrame(rows, top.schema) if rows else None), least


def spread_join(df: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: tuple[DataFrame | None, float] | None = None, scanned: bool = False) -> DataFrame:
    """``df`` joined (inner or left) with the rows of ``lookup``, at most one for each ``key``.

    Rows of a hot key are dealt over several tasks by a hash of themselves, and the row of ``lookup``
    is repeated for each: no task holds more of a key than about its part of all rows. Equal rows of
    a table that is ``scanned`` from files are told apart by their place.
    """
    keys, least = hot_keys(df.groupBy(key).agg(F.count("*").alias("_n")), key) if hot is None else hot
    if keys is None:
        return df.join(lookup, key, how)
    parts, place = F.ceil(F.col("_n") / F.lit(least)).cast("int"), [F.monotonically_increasing_id()] * scanned
    keys = F.broadcast(keys.select("_hot", parts.alias("_parts")))
    dealt = df.join(keys, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*df.columns, *place), F.col("_parts")).cast("int"), F.lit(0)))
    many = lookup.join(keys, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_hot", "_parts").join(many.drop("_hot", "_parts"), [key, "_salt"], how).drop("_salt")


def repeated(df: DataFrame, count: str, number: str, each: int = 100_000) -> DataFrame:
    """``df`` with every row ``count`` times, numbered from 1; a row of a large count is repeated in several tasks, ``each`` times in one go."""
    n, part, size = F.col(count).cast("long"), F.col("_part"), F.lit(each).cast("long")
    few = df.where(n <= each).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    parts = df.where(n > each).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size).cast("long"))))
    spread = parts.repartition(F.xxhash64(*parts.columns))
    return few.unionByName(spread.withColumn(number, F.explode(F.sequence(part * size + 1, F.least(n, (part + 1) * size)))).drop("_part"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each node to the smallest node of its component, given the links ``a, b``."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


CHUNK_LINKS = 1 << 17  # links that one task joins by itself (2 MB of ends)


def joined_chunk(e: DataFrame) -> DataFrame:
    """The links ``u, v`` from each node to the smallest of its component, of at most ``CHUNK_LINKS`` links ``u, v``, found in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.array([b.column(0).to_numpy(), b.column(1).to_numpy()], np.int64) for b in batches]
        u, v = forest(*np.concatenate(parts, axis=1)) if parts else np.zeros((2, 0), np.int64)
        yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return e.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected links ``a, b`` (longs, no nulls).

    Alternates large-star and small-star steps until no link changes; each step groups with
    map-side combining and joins back by :func:`spread_join`, so a node with very many links is
    dealt over tasks; each round is written to the shared folder, and the one before it removed, with its
    shuffle files. Links that are no more than a chunk of ``CHUNK_LINKS`` (after any round, or from the start) need no
    further round: one task joins them.
    Self-links and repeated links are allowed. Returns ``node, component`` (the smallest node
    reachable) for every node with a link, but for the smallest of each component; an empty input
    gives an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    spark, state, path = e.sparkSession, None, None
    del edges
    while True:
        last, path = path, new_folder(spark, name)
        e.write.parquet(path)
        if last is not None:
            removed(spark, last)
        e = spark.read.schema(e.schema).parquet(path)
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == state or not sums[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(sums)
        free_shuffles(spark)
        if sums[0] <= CHUNK_LINKS:
            e = written(joined_chunk(e), name)
            removed(spark, path)
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        e = _contracted(e, 2 * sums[0])


def _contracted(e: DataFrame, ends: int) -> DataFrame:
    """The links ``u, v`` (v below u), of that many ends, after a large-star and a small-star step."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hot = hot_keys(both.groupBy("u").agg(F.count("*").alias("_n")), "u", ends)  # a node has no more links in the second join
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = spread_join(both, low, "u", hot=hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = spread_join(large, low, "u", hot=hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def block_pairs(df: DataFrame, bucket: list[str], row: str, block_rows: int) -> DataFrame:
    """Deal the rows of each bucket into pairs of blocks of about ``block_rows`` rows.

    A pair of rows of one bucket meets in exactly one block pair ``lo, hi``: rows of the same
    block meet in ``lo = hi``. ``side`` is 0 for rows of block ``lo``, 1 for rows of block ``hi``
    (0 where both are the same). Buckets of one row are left out, since they hold no pair.
    No group grows with its bucket: a hot bucket makes more groups, not larger ones, and its rows
    learn their bucket's size in several tasks. A row of a bucket of n rows is repeated n /
    ``block_rows`` times.
    """
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    keyed = df.select("*", F.xxhash64(*bucket).alias("_bucket"))  # buckets of equal hash share a size, but no group
    sizes = written(keyed.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "bucket-sizes")
    sized = spread_join(keyed, sizes, "_bucket", hot=hot_keys(sizes, "_bucket"))
    dealt = (
        sized.withColumn("_k", blocks)
        .withColumn("_b", F.pmod(F.xxhash64(row, F.lit("block")), F.col("_k")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    )
    return dealt.select(
        *df.columns,
        F.least("_b", "_o").alias("lo"),
        F.greatest("_b", "_o").alias("hi"),
        F.when(F.col("_b") > F.col("_o"), 1).otherwise(0).alias("side"),
    )


def map_blocks(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, list[slice]], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``run`` on frames of whole groups of ``keys``, with the slice of each group.

    Like ``applyInPandas``, but many small groups share a call; a group that ends a frame waits for
    the next one. Groups must be bounded (see :func:`block_pairs`).
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            new = _group_starts(f, keys)
            if len(new) > 1 or (held and (f[keys].iloc[0] != held[-1][keys].iloc[-1]).any()):
                rows = pd.concat([*held, f], ignore_index=True)
                last = len(rows) - len(f) + int(new[-1])
                yield run(done := rows[:last], _slices(done, keys))
                held = [rows[last:]]
            else:
                held.append(f)
        if held:
            yield run(rows := pd.concat(held, ignore_index=True), _slices(rows, keys))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small_batches(df).repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(lean(batches), schema)


def _group_starts(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    k = f[keys].to_numpy()
    return np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1])


def _slices(f: pd.DataFrame, keys: list[str]) -> list[slice]:
    starts = _group_starts(f, keys).tolist()
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], len(f)])]
