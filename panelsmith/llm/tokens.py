"""Token ids of documents, and their files: Arrow streams of equal-length sequences and masks."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import TOOLS, lean, new_folder, small_batches, written

SEQUENCE = 2048
BATCH_ROWS = 64
_ENCODE_BYTES = 1 << 21  # UTF-8 bytes of texts that are encoded at once; the arrays that this takes are many times as large
_KEPT = 400_000  # words that a worker remembers
_JOINED = 4096  # new words that are encoded as one text
_SPACES = r"\s\x0b\x1c-\x1f\x85\pZ"  # white space of any kind, for a class of RE2
_UNEVEN = f"^ | $| [{_SPACES}]|[{_SPACES}] "  # a space that is not between two other characters
_LOOSE = f"^[{_SPACES}]|[{_SPACES}]$|[{_SPACES}][{_SPACES}]"
_TAIL = r"^(?P<word>\pL+)(?P<tail>[!-&(-/:-@\[-`{-~]+)$"
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_PROBE = [
    "", " ", "a", " The  cat's\nthe\n\nmat,\tsat (on) it... it's 12.5% 'd o'er!  ", "Éa ñandú,\nÇa!\u00a0x \u2003y\r\nz\x0b q\x85r s\x1ct", "x_y a1b2 <|endoftext|>, b<|endoftext|>c \n d",
    "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8\uff01 e\u0301t\u00e9 \u0130x \ufb01n \U0001f600\U0001f601 ab\u00b2 \u2167.", "don't  \n\n  stop\n",
]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _flags(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


class Encoder:
    """A tokenizer file, with a memory for words.

    Texts are cut at single spaces between two characters that are not white space, at such line
    feeds, and between letters and the marks that end a word: pre-tokenizers that begin a token
    there (or drop white space) encode the parts independently, so each part is encoded once for
    as long as it is remembered. Whether a tokenizer is of that kind is tried on a probe; any other
    encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        vocabulary = self.model.get_vocab()
        names = [""] * (1 + max(vocabulary.values()))
        for name, i in vocabulary.items():
            names[i] = name
        self.closes = np.array([x.endswith("</w>") for x in names])  # ids that end a word
        self.opens = np.array([x.startswith("\u0120") for x in names])  # ids that begin with a space
        # words that can be told apart when many are encoded as one text
        self.joins = r"^ \pL+$" if self.closes.any() else f"^ [^{_SPACES}]+$"
        self._forget()
        self.cuts = True
        probe = pa.array(_PROBE, pa.large_string())
        ids, sizes = self._whole(_PROBE)
        said = self._cut(probe)
        self.cuts = all(map(np.array_equal, (ids, sizes), said))
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())  # as they are in a text, with the space if they follow one
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.array([len(x) for x in ids], np.int64)

    def _many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that match ``joins``: encoded as one text, they are told apart by a word's end or the space."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "")[0].as_py()
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        starts = np.concatenate([[0], np.nonzero(self.closes[ids])[0] + 1]) if self.closes.any() else np.concatenate([np.nonzero(self.opens[ids])[0], [len(ids)]])
        if len(starts) != len(words) + 1 or starts[0] != 0 or starts[-1] != len(ids):
            return self._whole(words.to_pylist())
        return ids, np.diff(starts)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Add words to the memory; returns their places in it."""
        n, join = len(self.words), pc.match_substring_regex(words, self.joins)
        many, rest = words.filter(join), words.filter(pc.invert(join))
        made = [self._many(many.slice(at, _JOINED)) for at in range(0, len(many), _JOINED)]
        if len(rest):
            made.append(self._whole(rest.to_pylist()))
        self.words = pa.concat_arrays([self.words, many, rest])
        self.flat = np.concatenate([self.flat, *(x for x, _ in made)])
        self.sizes = np.concatenate([self.sizes, *(n for _, n in made)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        joined = _flags(join)
        return n + np.where(joined, np.cumsum(joined) - 1, len(many) + np.cumsum(~joined) - 1)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where different words are in the memory, which learns those it does not hold."""
        if len(self.words) > _KEPT:
            self._forget()
        found = pc.index_in(words, value_set=self.words)
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            at[at < 0] = self._learn(words.filter(found.is_null()))
        return at

    def _parts(self, words: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words, of which those that are ``spaced`` follow a space."""
        lined = _flags(pc.and_(pc.match_substring(words, "\n"), pc.invert(pc.match_substring_regex(words, _LOOSE))))
        lines = pc.split_pattern(words.filter(pa.array(lined)), "\n")
        order = np.concatenate([np.nonzero(~lined)[0], np.repeat(np.nonzero(lined)[0], np.diff(np.asarray(lines.offsets)))])
        flat = pa.concat_arrays([words.filter(pa.array(~lined)), lines.flatten()])
        sort = np.argsort(order, kind="stable")
        order, flat = order[sort], flat.take(pa.array(sort))
        first = np.concatenate([[True], order[1:] != order[:-1]]) if len(order) else np.zeros(0, bool)
        found = pc.extract_regex(flat, _TAIL)
        tailed = _flags(found.is_valid())
        base = pc.if_else(pa.array(tailed), found.field("word"), flat)
        base = pc.binary_join_element_wise(pc.if_else(pa.array(first & spaced[order]), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())), base, pa.scalar("", pa.large_string()))
        atoms = pa.concat_arrays([base, found.field("tail").filter(pa.array(tailed)), pa.array(["\n"], pa.large_string())]).dictionary_encode()
        place = self._places(atoms.dictionary)[atoms.indices.to_numpy()]
        counts = 1 + ~first + tailed
        at = np.cumsum(counts) - counts
        held = np.full(int(counts.sum()), place[-1])  # where it is not overwritten, the line feed
        held[at + ~first] = place[: len(flat)]
        held[(at + ~first + 1)[tailed]] = place[len(flat) : -1]
        sizes = self.sizes[held]
        whole = np.add.reduceat(sizes, at[first]) if len(at) else np.zeros(0, np.int64)
        return gather(self.flat, self.starts[held], sizes), whole

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        even = _flags(pc.invert(uneven))
        lists = [pc.split_pattern(texts.filter(pa.array(even)), " "), pa.array([_SPLIT.split(t) for t in texts.filter(uneven).to_pylist()], pa.large_list(pa.large_string()))]
        counts = np.concatenate([np.diff(np.asarray(x.offsets)) for x in lists]).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        flat = pa.concat_arrays([x.flatten() for x in lists])
        words = flat.dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        codes[firsts] = len(words.dictionary) + np.arange(len(firsts))
        both = pa.concat_arrays([words.dictionary, flat.take(pa.array(firsts))])
        used = np.bincount(codes, minlength=len(both)) > 0
        spaced = (np.arange(len(both)) < len(words.dictionary))[used]
        ids, sizes = self._parts(both.filter(pa.array(used)), spaced)
        starts = np.cumsum(sizes) - sizes
        codes = (np.cumsum(used) - 1)[codes]
        sizes, starts = sizes[codes], starts[codes]
        order = np.concatenate([np.nonzero(even)[0], np.nonzero(~even)[0]])  # texts of uneven spaces come last
        totals = np.add.reduceat(sizes, firsts)
        out = gather(ids, starts, sizes)
        if not even.all():
            back = np.argsort(order)
            out, totals = gather(out, (np.cumsum(totals) - totals)[back], totals[back]), totals[back]
        return out, totals

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts end to end as unsigned 32-bit integers, the number of each text) of large strings without nulls."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        return self._cut(texts) if self.cuts else self._whole(texts.to_pylist())


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


TOOLS.append(encoder.cache_clear)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(texts: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each whole text (null: empty), and the end id, as unsigned 32-bit integers."""
    model = encoder(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + _ENCODE_BYTES, side="right")))
        ids, sizes = model.encode(texts.slice(at, stop - at))
        cuts = np.cumsum(sizes)
        ids = np.insert(ids, cuts, np.full(len(cuts), end_id, "<u4"))
        yield from np.split(ids, (cuts + np.arange(1, len(cuts) + 1))[:-1])
        at = stop


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a shared folder: a local path, or any URI that Arrow can open."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class SequenceWriter:
    """One Arrow file of record batches with ``ids`` and ``mask``: fixed-size lists of equal length.

    Ids (of the narrowest type that holds the vocabulary) are laid end to end; the last sequence is
    padded and its mask, a bit an id with the lowest bit first, is 0 there. The lists of a batch
    share one flat buffer, so a reader that maps the file gets any sequence without a copy.
    """

    def __init__(self, sink, length: int = SEQUENCE, batch_rows: int = BATCH_ROWS, kind: str = "<u4"):
        if length % 8:
            raise ValueError("a sequence's mask is whole bytes")
        self.kind = np.dtype(kind)
        self.length, self.size, self.total = length, length * batch_rows, 0
        self.parts: list[np.ndarray] = []
        self.held = 0
        schema = pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(self.kind), False), length)), ("mask", pa.list_(pa.field("item", pa.uint8(), False), length // 8))])
        self.schema, self.file = schema, ipc.new_file(sink, schema)

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.parts)
            for at in range(0, len(flat) - self.size + 1, self.size):
                self._put(flat[at : at + self.size])
            rest = flat[len(flat) - len(flat) % self.size :]
            self.parts, self.held = [rest], len(rest)

    def _put(self, flat: np.ndarray) -> None:
        padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
        padded[: len(flat)] = flat
        mask = np.packbits(np.arange(len(padded)) < len(flat), bitorder="little")
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in ((padded, self.schema[0]), (mask, self.schema[1]))]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.parts))
        self.file.close()


class SequenceFile:
    """Random access to a file of :class:`SequenceWriter`, by sequence or by id position."""

    def __init__(self, source, length: int = SEQUENCE, batch_rows: int = BATCH_ROWS):
        self.reader, self.length, self.rows = ipc.open_file(source), length, batch_rows
        self.at, self.batch = -1, None

    def _flat(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k)
        return self.batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask bits) of sequence i, as views of the file's memory."""
        flat, a = self._flat(i // self.rows), i % self.rows * self.length
        mask = self.batch.column(1).flatten().to_numpy(zero_copy_only=True)
        return flat[a : a + self.length], mask[a // 8 : (a + self.length) // 8]

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the file; a view where they lie in one batch."""
        size, parts = self.length * self.rows, []
        while count > 0:
            flat, a = self._flat(start // size), start % size
            parts.append(flat[a : a + count])
            count -= len(parts[-1])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts])


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Write the ids of ``doc_id, text`` to files under ``folder`` in ascending doc_id order; returns the manifest.

    Rows are dealt by ranges of doc_id, so file ``part`` holds no higher ids than the next. Each task
    writes ``tokens`` (sequences) and ``rows`` (doc_id, start in the file, n_tokens) under names of
    its own attempt and reports them; a repeated or lost attempt leaves files that no manifest
    names. Manifest: part, tokens, rows, n_tokens, one row for each file.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = max(encoder(path).model.get_vocab_size(), end_id + 1) <= 1 << 16
    # rows of one doc_id, equal ones too, may lie in several ranges
    keyed = small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("nth")]
    sorted_docs = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.stageId()}-{task.taskAttemptId()}"
        store, root = open_folder(folder)
        writer = None
        for f in batches:
            if not f.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/tokens-{name}.arrow")
                row_sink = store.open_output_stream(f"{root}/rows-{name}.arrow")
                writer, kind = SequenceWriter(sink, length, kind="<u2" if narrow else "<u4"), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                rows = ipc.new_file(row_sink, kind)
            starts, counts = [], []
            for ids in encode(f.column("text"), path, end_id):
                starts.append(writer.total)
                counts.append(len(ids))
                writer.add(ids)
            rows.write_batch(pa.record_batch([f.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=kind))
        if writer is not None:
            writer.close(), rows.close(), sink.close(), row_sink.close()
            made = [[task.partitionId()], [f"tokens-{name}.arrow"], [f"rows-{name}.arrow"], [writer.total]]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["part", "tokens", "rows", "n_tokens"])

    return sorted_docs.mapInArrow(lean(run, tools=True), "part int, tokens string, rows string, n_tokens long")


def read_token_files(manifest: DataFrame, folder: str, length: int = SEQUENCE) -> DataFrame:
    """doc_id, start (over all files), n_tokens, ids_crc32 of every document, from the files alone."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    placed = manifest.withColumn("before", F.coalesce(before, F.lit(0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_folder(folder)
        local = isinstance(store, pafs.LocalFileSystem)
        for f in frames:
            for tokens, rows, before in zip(f["tokens"], f["rows"], f["before"]):
                source = pa.memory_map(f"{root}/{tokens}") if local else store.open_input_file(f"{root}/{tokens}")
                file = SequenceFile(source, length)
                with store.open_input_file(f"{root}/{rows}") as row_source:
                    index = ipc.open_file(row_source)
                    for k in range(index.num_record_batches):
                        r = index.get_batch(k).to_pandas()
                        r["ids_crc32"] = [crc(file.ids(int(a), int(n))) for a, n in zip(r["start"], r["n_tokens"])]
                        r["start"] += before
                        yield r.astype({"doc_id": "Int64"})

    wide = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return wide.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Write all documents' ids to token files and return what the files hold of each document.

    Null texts are empty (the end id only). Null doc_ids come first, rows of equal doc_id in the
    order of a hash of their texts. An empty table writes no file and gives no rows; other columns are not
    read. The files stay in ``folder`` (one of the shared folder's if not given).
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    manifest = written(write_token_files(docs, folder, path, end_id, length), "token-manifest")
    return read_token_files(manifest, folder, length)
