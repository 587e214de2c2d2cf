"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import lean, small_batches, written
from panelsmith.llm.tokens import crc, encode

CAPACITY = 2048
PIECE = 256
CHUNK = 4096
_KINDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The window (0 to ``ways - 1``) of each item, with near-equal sums.

    Each item begins as a partial partition: itself, and empty windows. The two partitions of the
    largest imbalance merge, the fullest windows of one with the emptiest of the other, until one
    is left. A partition holds its windows' sums (descending, less the smallest) and, for those
    above the smallest, the tree of the items in them.
    """
    if ways == 1:
        return np.zeros(len(sizes), int)
    # (sums above the least, nodes): only windows that are not empty are kept, the rest is empty
    heap: list[tuple[int, int, np.ndarray, list]] = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], np.int64), [i]))
    heapq.heapify(heap)
    left, right, count, serial = [], [], len(sizes), len(sizes)  # inner nodes: merged windows
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        if len(a) + len(b) <= ways:  # all windows of one meet empty ones of the other
            sums, nodes = np.concatenate([a, b]), na + nb
        else:
            over = len(a) + len(b) - ways  # the least windows of both meet, in opposite order
            met = a[len(a) - over :] + b[len(b) - over :][::-1]
            sums = np.concatenate([a[: len(a) - over], b[: len(b) - over], met])
            joined = list(range(count, count + over))
            left += na[len(na) - over :]
            right += nb[len(nb) - over :][::-1]
            count += over
            nodes = na[: len(na) - over] + nb[: len(nb) - over] + joined
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes = [nodes[k] for k in order.tolist()]
        low = 0 if len(sums) < ways else int(sums[-1])
        heapq.heappush(heap, (-(int(sums[0]) - low), serial, sums - low, nodes))
        serial += 1
    out, stack = np.zeros(len(sizes), int), list(enumerate(heap[0][3])) if heap else []
    while stack:
        w, node = stack.pop()
        if node < len(sizes):
            out[node] = w
        else:
            stack += [(w, left[node - len(sizes)]), (w, right[node - len(sizes)])]
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item, no window above ``capacity``: as few near-equal windows as differencing fits.

    The window count starts at what the total needs and rises whenever capacity is exceeded, by
    the share of the excess.
    """
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, ways)
        most = int(np.bincount(at, sizes, ways).max()) if len(sizes) else 0
        if most <= capacity:
            return at
        ways += max(1, int(ways * (most / capacity - 1) / 2))


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """The pieces of every document: full windows first, then what is left in pieces of at most ``piece`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            starts, lengths, crcs, totals = [], [], [], []
            for ids in encode(f.column("text"), path, end_id):
                n = len(ids)
                full = n // capacity * capacity
                edges = [*range(0, full, capacity), *range(full, n, piece), n]
                starts.append(edges[:-1])
                lengths += map(int.__sub__, edges[1:], edges)
                crcs += [crc(ids[a:b]) for a, b in zip(edges, edges[1:])]
                totals.append(n)
            counts = np.fromiter(map(len, starts), np.int64, len(starts))
            doc_id = f.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            flat = [x for s in starts for x in s]
            rows = [doc_id, *[pa.array(x, pa.int64()) for x in (flat, lengths, crcs)], pa.array(np.repeat(np.array(totals, np.int64), counts))]
            yield pa.record_batch(rows, names=[k.split()[0] for k in _KINDS.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, tools=True), _KINDS)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """Pack all documents' ids into sequences of at most ``capacity``; returns one row a piece.

    doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (in the sequence). A full window is a sequence of its own. Other pieces
    are dealt evenly into tasks, equal ones too, which sort them and pack ``chunk`` of them at a
    time: memory does not grow with a task, and a repeated task makes the same sequences. Null texts are empty (the end id only); null, repeated and
    equal doc_ids are documents of their own; an empty table gives no rows; other columns are not
    read.
    """
    pieces = written(cut_documents(docs, path, end_id, capacity, piece), "pieces")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, made = TaskContext.get().partitionId() << 40, 0

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal made
            at = pack(rows["length"].to_numpy(), capacity)
            rows = rows.assign(sequence_id=first + made + at).sort_values(["sequence_id", "doc_id", "start"], kind="stable")
            made += int(at.max()) + 1
            ends = rows.groupby("sequence_id")["length"].cumsum()
            return rows.assign(offset=ends - rows["length"])

        held: list[pd.DataFrame] = []
        count = 0
        for f in frames:
            f = f.astype({"doc_id": "Int64"})
            whole = f["length"] == capacity
            if whole.any():
                n = int(whole.sum())
                yield f[whole].assign(sequence_id=first + made + np.arange(n), offset=0)
                made += n
            held.append(f[~whole])
            count += len(held[-1])
            while count >= 2 * chunk:
                rows = pd.concat(held)
                yield packed(rows[:chunk])
                held, count = [rows[chunk:]], count - chunk
        if count:
            yield packed(pd.concat(held))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(parts, -(-pieces.count() // (4 * chunk))))
    # dealt in turn, each task's rows sorted before: the same rows for a repeated task
    dealt = pieces.repartition(tasks).sortWithinPartitions("doc_id", "start", "length", "ids_crc32")
    return dealt.mapInPandas(lean(run), _KINDS + ", sequence_id long, offset long")
