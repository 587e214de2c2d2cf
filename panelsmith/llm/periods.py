"""Periodic runs of words, found by probing a harmonic grid and extending what survives."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import small_batches

LEAST = 6  # words of a run at least
FOLD = 4  # and periods
_CHUNK = 64  # words compared at once when a stretch begins to grow; doubled after each full chunk
_WORDS = 1 << 20  # words of whole documents that are searched together
_KINDS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _extend(flat: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The stretch of words around ``at`` (where ``flat[at] == flat[at + p]``) that has period ``p``: (first word, word after the last)."""
    chunk, hi, end = _CHUNK, at + 1, len(flat) - p
    while hi < end:
        stop = min(end, hi + chunk)
        unlike = flat[hi:stop] != flat[hi + p : stop + p]
        if (k := int(unlike.argmax())) or unlike[0]:
            hi += k
            break
        hi, chunk = stop, 2 * chunk
    chunk, lo = _CHUNK, at
    while lo > 0:
        start = max(0, lo - chunk)
        unlike = (flat[start:lo] != flat[start + p : lo + p])[::-1]
        if (k := int(unlike.argmax())) or unlike[0]:
            lo -= k
            break
        lo, chunk = start, 2 * chunk
    return lo, hi + p


def find_runs(texts: list[np.ndarray], least: int = LEAST, fold: int = FOLD) -> list[np.ndarray]:
    """Of each text, given as word numbers (0 or more), its runs: rows ``start, length, period`` by start, then period.

    A run is a maximal stretch of smallest period p and at least ``least`` words and ``fold`` periods (3 or more).
    All texts are laid end to end, longest first, with a mark of its own after each. For each p the words
    at 0, p, 2p, ... are compared with their neighbours on this grid, over the texts that are long
    enough: n log n probes in all. A run holds ``fold`` grid points, so ``fold - 1`` equal neighbours in a row;
    such a place is extended word by word both ways unless it lies within a run found whose period divides p
    (then its stretch is that run). What is found twice over has therefore its smallest period.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order]
    offsets = np.concatenate([[0], np.cumsum(ranked + 1)])
    flat = np.full(offsets[-1], -1, np.int64)
    for k, i in enumerate(order.tolist()):
        flat[offsets[k] : offsets[k] + ranked[k]] = texts[i]
        flat[offsets[k + 1] - 1] = -1 - k
    rows: list[tuple[int, int, int]] = []
    known = np.zeros((0, 3), np.int64)
    for p in range(1, int(ranked[0]) // fold + 1 if len(ranked) else 1):
        long = int(np.searchsorted(-ranked, -max(least, fold * p), side="right"))
        grid = flat[: offsets[long] : p]
        same = grid[1:] == grid[:-1]
        for _ in range(fold - 2):
            same = same[1:] & same[: len(same) - 1]
        at = np.flatnonzero(same) * p
        if not len(at):
            continue
        if len(known) < len(rows):
            known = np.array(rows, np.int64)
        own = known[p % known[:, 2] == 0] if len(known) else known
        if len(own):
            steps = np.zeros(len(at) + 1, np.int64)
            lo = np.searchsorted(at, own[:, 0])
            np.add.at(steps, lo, 1)
            np.add.at(steps, np.maximum(lo, np.searchsorted(at, own[:, 1] - p)), -1)
            at = at[np.cumsum(steps[:-1]) == 0]
        done = 0
        for x in at.tolist():
            if x >= done:
                a, b = _extend(flat, x, p)
                done = b - p
                if b - a >= max(least, fold * p):
                    rows.append((a, b, p))
    found = np.array(rows, np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], offsets)
    out: list[np.ndarray] = [found[:0]] * len(texts)
    for k, i in enumerate(order.tolist()):
        if cuts[k] < cuts[k + 1]:
            r = found[cuts[k] : cuts[k + 1]]
            out[i] = np.stack([r[:, 0] - offsets[k], r[:, 1] - r[:, 0], r[:, 2]], axis=1)
    return out


def repeated_words(n: int, doc_id: int | None) -> np.ndarray:
    """Which original word stands at each of n places of a document: most documents stay, one of ten repeats itself from some word on."""
    i = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return i
    g = h // 10
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays if every run is cut down to its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def periodic_runs(docs: DataFrame, planted: bool = False, least: int = LEAST, fold: int = FOLD) -> DataFrame:
    """The periodic runs of every whole text of ``doc_id, text``, and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``. Returns ``doc_id, n_words, runs`` (start, length, period, by start, then period) and
    ``collapsed``: the words that stay, joined by one space. Where ``planted``, one of ten documents repeats itself from
    some word on before it is searched (:func:`repeated_words`; null doc_ids do not). Null and empty texts have no words, no
    run and an empty ``collapsed``; repeated rows are rows of their own; other columns are not read; an empty table
    gives no rows. Whole documents are searched together, about a million words at once; a longer one on its own.
    """

    def searched(ids: list[int | None], words: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        texts, said, runs = [], [], []
        for i, w in zip(ids, words):
            at = repeated_words(len(w), i) if planted else np.arange(len(w))
            texts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in w), np.int64, len(w))[at])
        for w, i, t, r in zip(words, ids, texts, found := find_runs(texts, least, fold)):
            if planted and len(w):
                w = [w[k] for k in repeated_words(len(w), i).tolist()]
            if len(r):
                w = [w[k] for k in np.flatnonzero(kept_words(len(w), r)).tolist()]
            said.append(b" ".join(w))
        runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])])
        structs = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
        counts = pa.array([len(t) for t in texts], pa.int64())
        return pa.record_batch([pa.array(ids, pa.int64()), counts, lists, pa.array(said, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            ids, words, held = [], [], 0
            texts = f.column("text").cast(pa.large_string()).cast(pa.large_binary())
            for i, t in zip(f.column("doc_id").to_pylist(), texts):
                w = (t.as_py() or b"").split()  # at the six characters that are no word's
                if words and held + len(w) > _WORDS:
                    yield searched(ids, words)
                    ids, words, held = [], [], 0
                ids.append(i)
                words.append(w)
                held += len(w)
            if words:
                yield searched(ids, words)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _KINDS)


def _strongest(runs: Column) -> Column:
    """The run of the greatest length / period, the first of equals; null if there is none."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.try_element_at(runs, F.lit(1)), lambda top, r: F.when(r.length * top.period > top.length * r.period, r).otherwise(top))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row a document of :func:`periodic_runs` with planted repeats: counts, the strongest run, and digests of all runs and of the words that stay."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    top = periodic_runs(docs, planted=True).withColumn("top", _strongest(F.col("runs"))).withColumn("lines", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
