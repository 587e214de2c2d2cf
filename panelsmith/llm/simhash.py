"""SimHash near-duplicates, with pigeonring filtering before the Hamming check."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import block_pairs, components, forest, fresh, hot_keys, lean, map_blocks, small_batches, spread_join, written
from panelsmith.llm.tokens import gather

BITS = 64
BLOCK_ROWS = 4096
SET_ROWS = 1024  # rows of a block whose shingle sets are compared
PIVOTS = 4  # rows of a large group that all its blocks are tried against
WIDE = 256  # bits of the fingerprints of sets
WIDE_BITS = 80  # of them may differ: sets of a similarity of 0.8 differ in 39 on average (48 if tiny, deviation 6), unlike ones in 128
_ROWS = 500  # texts that are hashed at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text (or its UTF-8 bytes): A-Z becomes a-z, split at ASCII white space."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_LOWER).split()


def shingles(words: list[bytes], words_per_shingle: int) -> np.ndarray:
    """The hash of each shingle, repeats included; none without words.

    Shingles are joined by one space; fewer words are one shingle. The hash is XXH64 of the UTF-8
    bytes with seed 42.
    """
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = memoryview(b" ".join(words)), min(words_per_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def shingle_hashes(text: str | bytes | None, words_per_shingle: int) -> np.ndarray:
    return shingles(words_of(text), words_per_shingle)


def by_rows(docs: DataFrame, columns: list[str], made: str, run: Callable[[list[bytes]], dict[str, pa.Array]]) -> DataFrame:
    """``columns`` and what ``run`` makes of the UTF-8 bytes of each ``text``, a few rows at a time, so that little is in memory."""
    cut = small_batches(docs).select(*columns, F.col("text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                part = whole.slice(at, _ROWS)
                new = run([x or b"" for x in part.column(len(columns)).to_pylist()])
                yield pa.record_batch([*part.columns[:-1], *new.values()], names=[*columns, *new])

    kinds = [f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in columns]
    return cut.mapInArrow(lean(work), ", ".join([*kinds, made]))


def majority(hashes: np.ndarray) -> int:
    """Bit by bit, whether over half of the hashes have it; 0 without hashes."""
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(text: str | bytes | None, words_per_shingle: int = 3) -> int:
    """The fingerprint of a text: bit by bit, whether over half of its shingle hashes have it (0 without words)."""
    return majority(shingle_hashes(text, words_per_shingle))


def fingerprints(docs: DataFrame, key: list[str], words_per_shingle: int = 3) -> DataFrame:
    """``key``, fp (the fingerprint of ``text`` as a signed long) for every row."""

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"fp": pa.array(np.array([simhash(x, words_per_shingle) for x in texts], np.uint64).view(np.int64))}

    return by_rows(docs, key, "fp long", run)


def segments(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each of ``parts`` near-equal segments of the fingerprint."""
    edges = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ring_filter(diff: np.ndarray, start: int, bits: int, parts: int) -> np.ndarray:
    """Which differences (XORs) pass the chain that begins at segment ``start`` of the ring.

    If two fingerprints differ in at most ``bits`` bits, some chain of consecutive segments has,
    at each of its lengths l, a cumulative difference of at most floor(l * bits / parts); so
    pairs that fail at every start need no full check. Equality of the first segment is the
    chain's length 1 where ``bits < parts``.
    """
    ok, total, segs = np.ones(diff.shape, bool), np.zeros(diff.shape, np.uint8), segments(parts)
    for length in range(1, parts + 1):
        first, width = segs[(start + length - 1) % parts]
        mask = np.uint64(((1 << width) - 1) << first)
        total = total + np.bitwise_count(diff & mask)
        ok &= total <= length * bits // parts
        if not ok.any():
            break
    return ok


def near_links(reps: DataFrame, bits: int = 2, parts: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``a, b`` between different fingerprints of ``reps`` (fp) that join all pairs at most ``bits`` apart.

    Each fingerprint goes to one bucket per segment start; rows of a bucket meet in pairs of
    blocks, and each block pair returns a spanning forest of the pairs it finds: no more links
    than rows, but the same components.
    """
    parts = parts or bits + 1
    if bits >= parts:
        raise ValueError("parts must exceed bits, so that some segment is equal")
    keys = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)).alias("val"))
            for i, (first, width) in enumerate(segments(parts))
        ])
    )
    dealt = block_pairs(reps.select("fp", keys.alias("k")).select("fp", "k.seg", "k.val"), ["seg", "val"], "fp", block_rows)

    def link(frame: pd.DataFrame, groups: list[slice]) -> pd.DataFrame:
        fp, seg, side = frame["fp"].to_numpy().view(np.uint64), frame["seg"].to_numpy(), frame["side"].to_numpy()
        same = (frame["lo"] == frame["hi"]).to_numpy()
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for g in groups:
            left = right = fp[g]
            if not same[g.start]:
                left, right = left[side[g] == 0], right[side[g] == 1]
            links = []
            for at in range(0, len(left), 256):
                diff = left[at : at + 256, None] ^ right[None, :]
                ok = ring_filter(diff, int(seg[g.start]), bits, parts) & (diff != 0)
                i, j = np.nonzero(ok & (np.bitwise_count(diff) <= bits))
                if len(i):
                    links.append(forest(left[at + i], right[j]))
            if links:
                found.append(forest(*(np.concatenate(x) for x in zip(*links))))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return map_blocks(dealt, ["seg", "val", "lo", "hi"], link, "a long, b long")


def simhash_groups(docs: DataFrame, key: list[str], bits: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """``key``, fp, root for every row: rows share ``root`` exactly if links of fingerprints join them.

    Fingerprints at most ``bits`` apart link. Null texts count as empty; texts without words have
    fingerprint 0 and link like any other. Equal fingerprints are one node, so copies are never
    paired.
    """
    fps = written(fingerprints(docs, key, words_per_shingle=words_per_shingle), "simhash")
    roots = components(near_links(written(fps.select("fp").distinct(), "simhash-nodes"), bits), "simhash-links")
    named = spread_join(fps, roots.withColumnRenamed("node", "fp"), "fp", "left", scanned=True)
    return named.select(*key, "fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, bits: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    Null doc_ids belong to their component but do not name it (a component of nothing else has a
    null id); repeated rows are returned as often. An empty table gives no rows.
    """
    groups = written(simhash_groups(docs, ["doc_id"], bits, words_per_shingle), "simhash-groups")
    lowest = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = spread_join(groups, lowest, "root", scanned=True)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of ``WIDE`` bits of a set of shingle hashes, as 32-bit segments: each hash yields as many bits by mixing."""
    parts = []
    for k in range(WIDE // BITS):
        h = (hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        parts.append(majority(h ^ (h >> np.uint64(32))))
    return np.array(parts, "<u8").view("<u4")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def common_shingles(docs: DataFrame, set_words: int, rows: int = 4000, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that several of about ``rows`` texts share.

    They only order the shingles in :func:`prefix`: another sample costs work, not pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for x in f.column(0):
                yield pa.record_batch([pa.array(np.unique(shingle_hashes(x.as_py(), set_words)).view(np.int64))], names=["s"])

    rate = min(1.0, rows / max(1, docs.count()))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))
    seen = docs.where(chance).select(F.col("text").cast("binary")).mapInArrow(lean(run), "s long").groupBy("s").count().where("count > 2")
    top = seen.orderBy(F.desc("count"), "s").limit(most).toPandas()
    s, n = top["s"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """How many of its n shingles (in an order that all sets share) a set must show for similar sets to meet: to smaller sets, and to larger ones.

    Sets of that Jaccard similarity share at least ``similarity`` x n of the larger one's n shingles and 2 x
    ``similarity`` / (1 + ``similarity``) x m of the smaller one's m, so the first they share lies in what both show.
    """
    return (n - math.ceil(similarity * n - 1e-9) + 1, n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1) if n else (0, 0)


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The part of a sorted set that a set shows to smaller ones, in the order of all sets: common shingles last."""
    n, (known, counts) = len(hashes), common
    if n and len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: prefix_sizes(n, similarity)[0]]


def profiles(docs: DataFrame, key: str, words_per_shingle: int, set_words: int, similarity: float | None) -> DataFrame:
    """``key``, node (an id of the text's words) and fp for every row; with ``similarity`` also of its set of ``set_words`` shingles
    n (its size), wide (see :func:`wide_simhash`), shown (its prefix) and short (how much of it is shown to larger sets)."""
    share = docs.sparkSession.sparkContext.broadcast(None if similarity is None else common_shingles(docs, set_words))  # of bounded size

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        words = [words_of(x) for x in texts]
        node = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64)
        fp = np.array([majority(shingles(w, words_per_shingle)) for w in words], np.uint64)
        out = {"node": pa.array(node.view(np.int64)), "fp": pa.array(fp.view(np.int64))}
        if share.value is not None:
            sets = [np.unique(shingles(w, set_words)) for w in words]
            out["n"] = pa.array([len(x) for x in sets], pa.int64())
            out["wide"] = pa.array([wide_simhash(x).tobytes() for x in sets], pa.binary())
            out["shown"] = pa.array([prefix(x, share.value, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
            out["short"] = pa.array([prefix_sizes(len(x), similarity)[1] for x in sets], pa.int64())
        return out

    return by_rows(docs, [key], "node long, fp long" + ("" if similarity is None else ", n long, wide binary, shown array<long>, short long"), run)


def shingle_sets(docs: DataFrame, set_words: int) -> DataFrame:
    """node, component, wide and the text's sorted set of shingle hashes as bytes."""

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        return {"shingles": pa.array([np.unique(shingle_hashes(x, set_words)).tobytes() for x in texts], pa.binary())}

    return by_rows(docs, ["node", "component", "wide"], "shingles binary", run)


def ring_near(diff: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of wide fingerprints, given their differences (XORs) by segment, are at most ``bits`` apart.

    From each segment of the ring a chain goes on as long as its cumulative difference is at most its
    length's share of ``bits``; a pair that no chain brings round the ring is not checked in full.
    """
    n, parts = diff.shape
    found, open_ = np.zeros(n, bool), np.arange(n)
    for start in range(parts):
        i, total = open_, np.zeros(len(open_), np.int64)
        for length in range(1, parts + 1):
            total = total + np.bitwise_count(diff[i, (start + length - 1) % parts])
            ok = total <= length * bits // parts
            i, total = i[ok], total[ok]
            if not len(i):
                break
        found[i] = True
        open_ = open_[~found[open_]]
        if not len(open_):
            break
    at = np.nonzero(found)[0]
    found[at] = np.bitwise_count(diff[at]).sum(axis=1) <= bits
    return found


def spanning(near: Callable[[int, np.ndarray], np.ndarray], group: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows that ``near`` (a row, rows to try) finds, no more than rows; rows of a ``group`` are joined already.

    Every row reached is tried against the rows not reached yet, with ``side`` only those of the other
    side. So rows that are all alike are tried once, not with each other.
    """
    free, out = np.ones(len(group), bool), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for seed in range(len(group)):
        if not free[seed]:
            continue
        reached = free & (group == group[seed])
        free &= ~reached
        queue = np.nonzero(reached)[0].tolist()
        while queue:
            x = queue.pop()
            rest = np.nonzero(free if side is None else free & (side != side[x]))[0]
            y = near(x, rest) if len(rest) else rest
            if len(y):
                y = y[np.unique(group[y], return_index=True)[1]]
                out.append((np.full(len(y), x), y))
                reached = free & np.isin(group, group[y])
                free &= ~reached
                queue += np.nonzero(reached)[0].tolist()
    return tuple(np.concatenate(z) for z in zip(*out))


def _wide(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["wide"]), "<u4").reshape(len(frame), WIDE // 32)


def ring_candidates(rows: DataFrame, similarity: float, bits: int = WIDE_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``a, b`` that join all nodes that meet in a bucket and whose sets may have that similarity.

    ``rows``: s (the bucket), node, n, short (whether it shows s to larger sets), wide. Each pair of
    blocks returns fewer links than rows.
    """

    def meet(frame: pd.DataFrame, groups: list[slice]) -> pd.DataFrame:
        wide = _wide(frame)
        node, n, short, side = (frame[c].to_numpy() for c in ("node", "n", "short", "side"))
        same = (frame["lo"] == frame["hi"]).to_numpy()

        def may(x, c):
            ok = (np.minimum(n[x], n[c]) >= similarity * np.maximum(n[x], n[c]) - 1e-9) & (((n[x] <= n[c]) & short[x]) | ((n[c] <= n[x]) & short[c]))
            ok[ok] = ring_near((wide[x] ^ wide[c])[ok], bits)
            return ok

        x = np.array([g.start for g in groups if g.stop - g.start == 2], np.int64)  # most buckets: all of them at once
        x = x[same[x] | (side[x] != side[x + 1])]
        x = x[may(x, x + 1)]
        found = [(x, x + 1)]
        for g in groups:
            if g.stop - g.start > 2:
                i, j = spanning(lambda x, c, at=g.start: c[may(at + x, at + c)], np.arange(g.stop - g.start), None if same[g.start] else side[g])
                found.append((g.start + i, g.start + j))
        a, b = (np.concatenate(z) for z in zip(*found))
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return map_blocks(block_pairs(rows, ["s"], "node", block_rows), ["s", "lo", "hi"], meet, "a long, b long").distinct()


class Overlaps:
    """How many elements one set of a group shares with each set, from the rows that hold each element."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets], np.int64)
        _, of = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(of, np.cumsum(sizes)[:-1])
        self.counts = np.bincount(of)
        self.starts = np.cumsum(self.counts) - self.counts
        self.rows = np.repeat(np.arange(len(sets)), sizes)[np.argsort(of, kind="stable")]

    def shared(self, x: int) -> np.ndarray:
        own = self.sets[x]
        return np.bincount(gather(self.rows, self.starts[own], self.counts[own]), minlength=len(self.sets))


def in_blocks(sets: DataFrame, block_rows: int) -> DataFrame:
    """The nodes of each component dealt into blocks (``lo = hi``) of about ``block_rows``; up to ``PIVOTS`` nodes of the first block are in all blocks.

    A large group whose texts are like most others of it is joined by its pivots, so its rows are shipped once.
    """
    sizes = written(sets.groupBy("component").agg(F.count("*").alias("_n")), "component-sizes")
    sized = spread_join(sets, sizes, "component", hot=hot_keys(sizes, "component")).withColumn("_k", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int"))
    own = sized.withColumn("lo", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_k")).cast("int"))
    first = own.where("lo = 0 and _k > 1")  # about a block of each large component
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit("pivot"))))
    pivots = first.withColumn("_r", rank).where(F.col("_r") <= PIVOTS).drop("_r")
    every = own.unionByName(pivots.withColumn("lo", F.explode(F.sequence(F.lit(1), F.col("_k") - 1))))
    return every.select(*sets.columns, "lo", F.col("lo").alias("hi"), F.lit(0).alias("side"))


def checked_links(dealt: DataFrame, similarity: float, bits: int = WIDE_BITS) -> DataFrame:
    """Links ``a, b`` that join all nodes of the pairs of blocks ``component, lo, hi`` whose sets have that similarity, unless their cluster does."""

    def check(frame: pd.DataFrame, groups: list[slice]) -> pd.DataFrame:
        wide, sets = _wide(frame), [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        n = np.array([len(x) for x in sets])
        node, cluster, side = (frame[c].to_numpy() for c in ("node", "cluster", "side"))
        same, found = (frame["lo"] == frame["hi"]).to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for g in groups:
            overlaps = Overlaps(sets[g]) if g.stop - g.start > 8 else None

            def near(x, c, at=g.start, overlaps=overlaps):
                c = c[np.minimum(n[at + x], n[at + c]) >= similarity * np.maximum(n[at + x], n[at + c]) - 1e-9]
                c = c[ring_near(wide[at + x] ^ wide[at + c], bits)]
                if len(c) and overlaps is not None and n[at + x]:
                    common = overlaps.shared(x)[c]
                    return c[common / (n[at + x] + n[at + c] - common) >= similarity]
                return c[[jaccard(sets[at + x], sets[at + y]) >= similarity for y in c.tolist()]] if len(c) else c

            i, j = spanning(near, cluster[g], None if same[g.start] else side[g])
            found.append((g.start + i, g.start + j))
        a, b = (np.concatenate(z) for z in zip(*found))
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return map_blocks(dealt, ["component", "lo", "hi"], check, "a long, b long")


def similar_links(docs: DataFrame, made: DataFrame, key: str, set_words: int, similarity: float, block_rows: int = SET_ROWS) -> DataFrame:
    """Links ``a, b`` that join all nodes of ``made`` whose shingle sets have that Jaccard similarity.

    Similar sets meet in the bucket of a shingle that both show. Nodes of a bucket that pass
    :func:`ring_near` are candidates; only links that span them are kept, and their components are
    searched by whole sets, first inside blocks, then between blocks for what is not joined yet. So
    links and rows grow with the texts, also in large groups of copies. No pair is lost but for
    fingerprints further apart than ``WIDE_BITS`` (less than 1 of 10 million pairs of the
    similarity) or equal hashes of unlike shingles. Only a component of several blocks that its
    pivots leave in several clusters (:func:`in_blocks`) is compared block by block, whose rows are
    shipped once a block.
    """
    nodes = made.dropDuplicates(["node"])
    shown = nodes.select("node", "n", "short", F.posexplode("shown").alias("at", "s")).select("s", "node", "n", (F.col("at") < F.col("short")).alias("short"))
    sizes = shown.groupBy("s").agg(F.count("*").alias("_n"), F.max("short").alias("some")).where("_n > 1 and some")
    sizes = written(sizes.select("s", "_n"), "bucket-sizes")
    rows = spread_join(shown, sizes, "s", hot=hot_keys(sizes, "s")).drop("_n")
    rows = written(rows.join(nodes.select("node", "wide"), "node"), "buckets")
    below = components(ring_candidates(rows, similarity), "candidates")
    found = written(below.unionByName(below.select(F.col("component").alias("node"), "component").distinct()), "candidates")
    one = spread_join(made, found, "node", scanned=True).groupBy("node", "component").agg(F.min(key).alias(key), F.min("wide").alias("wide"))
    texts = spread_join(docs.select(key, "text"), one, key).dropDuplicates([key])  # a node has one key here
    sets = written(shingle_sets(texts, set_words).withColumn("cluster", F.col("node")), "shingle-sets")
    inside = written(checked_links(in_blocks(sets, block_rows), similarity), "inside-links")
    if found.groupBy("component").count().where(F.col("count") > block_rows).isEmpty():
        return inside
    joined = components(inside, "inside").select("node", F.col("component").alias("cluster"))
    named = written(found.join(joined, "node", "left").select("node", "component", F.coalesce("cluster", "node").alias("cluster")), "clusters")
    spread = named.groupBy("component").agg(F.count("*").alias("_n"), F.min("cluster").alias("_a"), F.max("cluster").alias("_z"))
    parted = written(spread.where((F.col("_n") > block_rows) & (F.col("_a") < F.col("_z"))).select("component", "_n"), "parted")
    if parted.isEmpty():
        return inside
    known = spread_join(sets.drop("cluster"), parted, "component", hot=hot_keys(parted, "component")).join(named.select("node", "cluster"), "node")
    between = block_pairs(written(known.select(*sets.columns), "set-clusters"), ["component"], "node", block_rows).where("lo < hi")
    return inside.unionByName(written(checked_links(between, similarity), "between-links"))


def sure_links(made: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` that join all nodes whose fingerprints differ in at most ``bits`` bits."""
    fps = made.select("node", "fp").distinct()
    heads = written(fps.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = spread_join(fps, heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = written(near_links(heads.select("fp"), bits), "fingerprint-links")
    for c in "ab":
        near = spread_join(near, heads.select(F.col("fp").alias(c), F.col("head").alias(f"_{c}")), c)
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def near_copy_groups(docs: DataFrame, key: str, words_per_shingle: int = 3, sure_bits: int = 2, set_words: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """``key`` (no nulls), root for every row: rows share ``root`` exactly if links join them.

    Two texts link if their fingerprints differ in at most ``sure_bits`` bits, or if the Jaccard similarity of their sets of
    ``set_words`` shingles is ``similarity`` or more (None: by fingerprints only). See :func:`similar_links`. Null texts count as
    empty; texts without words link with each other. Equal texts are one node.
    """
    made = written(profiles(docs, key, words_per_shingle, set_words, similarity), "profiles")
    links = [written(sure_links(made, sure_bits), "sure-links")]
    if similarity is not None:
        links.append(similar_links(docs, made, key, set_words, similarity))
    roots = components(_union(links), "near-copies")
    return spread_join(made.select(key, "node"), roots, "node", "left", scanned=True).select(key, F.coalesce("component", "node").alias("root"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def keep_one(docs: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of :func:`near_copy_groups`, the row of the smallest doc_id.

    Rows of equal doc_id and equal text (null: empty) count as one document, of which one row stays, whatever its other columns; of
    near copies of equal doc_id the one of the smallest text hash. Rows without a doc_id come last and are told apart by their
    text. All columns are kept. An empty table gives no rows.
    """
    (tag,) = fresh(docs, "_tag")
    hashes = [F.hex(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(k))) for k in range(2)]
    marks = F.concat(F.coalesce(F.concat(F.lit("id"), F.col("doc_id").cast("string")), F.lit("text")), F.lit(":"), *hashes)
    tagged = docs.withColumn(tag, marks)
    groups = near_copy_groups(tagged.select("text", F.col(tag).alias("_tag")), "_tag", **bounds)
    number = F.when(F.col("_tag").startswith("id"), F.expr("CAST(substring(substring_index(_tag, ':', 1), 3) AS LONG)"))
    first = F.min(F.struct(number.isNull().alias("n"), number.alias("i"), F.col("_tag")))
    kept = groups.groupBy("root").agg(first.alias("x")).select(F.col("x._tag").alias(tag)).distinct()
    return spread_join(tagged, kept, tag, scanned=True).dropDuplicates([tag]).select(*[F.col(f"`{c}`") for c in docs.columns])
