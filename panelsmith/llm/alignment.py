"""Aligning the tokens of two tokenizers by a dangling-suffix transducer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import small_batches, written
from panelsmith.llm.tokens import gather

HOT_PAIRS = 1 << 16  # a pair may be hot if it has more than this part of all links; so there are no more hot pairs
_KEPT = 400_000  # parts that a worker remembers
_MOVES = 1_000_000  # transitions that it remembers
_PIECE = 1 << 20  # characters of a long text that are cut into parts at once
_LINKS = 1 << 21  # links whose pairs are counted at once
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_KINDS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class SuffixTransducer:
    """Reads two token sequences of the same bytes, always from the side that lags.

    A state is the side that leads and the bytes it has ahead of the other (the dangling suffix); state 0 has
    none. Transitions are remembered by state and token, so bytes are compared once for each pair of them.
    Each return to state 0 closes a group.
    """

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.tokens = (left, right)
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # 1: left leads; 0: right does, or none
        self.places = {(0, b""): 0}
        self.leads, self.moves, self.known = [0], [{}], 0

    def _move(self, state: int, token: int) -> int:
        leads, ahead = self.states[state]
        read = self.tokens[leads][token]
        if read.startswith(ahead):
            new = (1 - leads, read[len(ahead) :])
        elif ahead.startswith(read):
            new = (leads, ahead[len(read) :])
        else:
            new = (0, None)
        if not new[1]:
            new = (0, new[1])
        if new[1] is None:
            to = -1
        elif (to := self.places.setdefault(new, len(self.states))) == len(self.states):
            self.states.append(new)
            self.leads.append(new[0])
            self.moves.append({})
        self.moves[state][token] = to
        self.known += 1
        return to

    def groups(self, left: list[int], right: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of each side are read when each group closes; None if their bytes are not the same."""
        if self.known > _MOVES:
            self._forget()
        leads, moves, ends = self.leads, self.moves, []
        left, right = [*left, -1], [*right, -1]
        i = j = state = 0
        while True:
            if leads[state]:
                token = right[j]
                j += 1
            else:
                token = left[i]
                i += 1
            if token < 0:
                break
            to = moves[state].get(token)
            state = self._move(state, token) if to is None else to
            if not state:
                ends.append((i, j))
            elif state < 0:
                return None
        return ends if not state and j == len(right) - 1 else None


class Aligner:
    """Two tokenizers over one text, with a memory for parts.

    Texts are cut before single spaces and line feeds between two characters that are not white space. Both pre-tokenizers begin
    a token there: the byte-level one by its pattern, the other because no piece has a space after another character, or a
    line feed (checked). So a part is encoded, and read by the transducer from state 0 to state 0, once for as long as it is
    remembered; when the memory is full, the half that was seen least is forgotten.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of, names = _byte_of(), self.a.get_vocab()
        bytes_a = [b""] * (1 + max(names.values()))
        for name, i in names.items():
            bytes_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece has a space after another character, or a line feed: texts cannot be cut there")
        self.space = pieces.index("▁")
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = SuffixTransducer(bytes_a, bytes_b)
        self.lengths = np.array([len(x) for x in bytes_a], np.int64)
        self.names = [str(i) for i in range(max(len(bytes_a), len(bytes_b)))]
        self.shift = max(1, (len(bytes_b) - 1).bit_length())
        self.bits = self.shift + (len(bytes_a) - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of a and b, groups, 1 if the bytes are not the text's
        self.seen = np.zeros(0, np.int64)
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget the half of the parts that were seen least since the last time."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[: len(self.seen) // 2])
        names = list(self.places)
        self.pairs = gather(self.pairs, self.starts[keep], self.counts[keep, 2])
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.places = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.counts, self.seen = self.counts[keep], np.zeros(len(keep), np.int64)
        self.starts = np.cumsum(self.counts[:, 2]) - self.counts[:, 2]

    def _unlike(self, parts: list[str], ids: list[list[int]]) -> set[int]:
        """The parts whose bytes are not those of their ids of a."""
        of, flat = self.transducer.tokens[0], [i for a in ids for i in a]
        if b"".join([of[i] for i in flat]) == "".join(parts).encode():
            ends = np.cumsum(self.lengths[np.array(flat, np.int64)])
            counts = np.cumsum([len(a) for a in ids])
            sizes = np.cumsum(pc.binary_length(pa.array(parts, pa.large_string())).to_numpy())
            if np.array_equal(ends[counts - 1], sizes):
                return set()
        return {k for k, (p, a) in enumerate(zip(parts, ids)) if b"".join([of[i] for i in a]) != p.encode()}

    def _learn(self, parts: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        spaced = [p[0] == " " for p in parts]
        ids_b = self.b.encode([p[1:] if s else p for p, s in zip(parts, spaced)], num_threads=1)
        counts, pairs, names, shift, unlike = [], [], self.names, self.shift, self._unlike(parts, ids_a)
        for k, (a, b, s) in enumerate(zip(ids_a, ids_b, spaced)):
            if not s:  # the space that B adds to a text is not a part's
                b = b[1:] if b[0] == self.space else [self.space]
            ends = self.transducer.groups(a, b)
            bad = ends is None or k in unlike
            said, i, j = [], 0, 0
            for x, y in ends if not bad else ():
                said.append(f"{names[a[i]] if x == i + 1 else ','.join([names[t] for t in a[i:x]])}|{names[b[j]] if y == j + 1 else ','.join([names[t] for t in b[j:y]])}")
                pairs.append(a[x - 1] << shift | b[y - 1])
                i, j = x, y
            self.groups.append(";".join(said))
            counts.append((len(a), len(b), len(said), bad))
        self.places.update(zip(parts, range(len(self.places), len(self.groups))))
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64).reshape(-1, 4)])
        self.seen = np.concatenate([self.seen, np.zeros(len(parts), np.int64)])
        self.pairs = np.concatenate([self.pairs, np.array(pairs, np.int64)])
        self.starts = np.cumsum(self.counts[:, 2]) - self.counts[:, 2]

    def _places(self, parts: list[str]) -> np.ndarray:
        if len(self.places) > _KEPT:
            self._shrink()
        if new := set(parts).difference(self.places):
            self._learn(sorted(new))
        at = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        self.seen += np.bincount(at, minlength=len(self.seen))
        return at

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """Of each text: (tokens of a, tokens of b, groups), the groups' text, and its links: ``times << bits | pair`` of each pair of ids.

        Texts without tokens on either side, or whose tokens have other bytes than the text, have zeros and nothing.
        """
        held: list[list[str]] = []
        size = 0
        for t in texts:
            if held and size + len(t or "") > _PIECE:
                yield from self._some(held)
                held, size = [], 0
            if len(t or "") > _PIECE:
                yield self._long(t)
            else:
                held.append(_CUT.split(" " + t) if t else [])
                size += len(t or "")
        yield from self._some(held)

    def _some(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        at = self._places([p for t in texts for p in t])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[at], axis=0)])
        sums = sums[ends] - sums[ends - sizes]
        doc = np.repeat(np.arange(len(texts)), sizes)
        links = self.counts[at, 2]
        keys = np.repeat(doc, links) << self.bits | gather(self.pairs, self.starts[at], links)
        keys, times = np.unique(keys, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << self.bits)
        codes = times.astype(np.int64) << self.bits | keys & ((1 << self.bits) - 1)
        places = at.tolist()
        for k, (total, end, n) in enumerate(zip(sums, ends.tolist(), sizes.tolist())):
            if total[3]:
                yield np.zeros(3, np.int64), "", codes[:0]
            else:
                yield total[:3], ";".join([self.groups[p] for p in places[end - n : end]]), codes[cuts[k] : cuts[k + 1]]

    def _long(self, text: str) -> tuple[np.ndarray, str, np.ndarray]:
        """A long text, a piece after the other, each ending where a part ends."""
        text = " " + text
        at, total, groups, links, good = 0, np.zeros(3, np.int64), [], {}, True
        while at < len(text):
            cut = _CUT.search(text, at + _PIECE)
            stop = cut.start() if cut else len(text)
            ((counts, said, codes),) = self._some([_CUT.split(text[at:stop])])
            good &= bool(counts[0])
            total = total + counts
            groups.append(said)
            for c in codes.tolist():
                pair = c & ((1 << self.bits) - 1)
                links[pair] = links.get(pair, 0) + (c >> self.bits)
            at = stop
        if not good:
            return np.zeros(3, np.int64), "", np.zeros(0, np.int64)
        return total, ";".join(groups), np.array([n << self.bits | p for p, n in sorted(links.items())], np.int64)


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The aligned token groups of every whole text of ``doc_id, text``.

    A is a byte-level tokenizer over a space and the text, B a SentencePiece model over the text, to which it adds the
    space; special tokens' strings are plain text. Returns ``row`` (a number of its own), ``doc_id, n_a, n_b, n_groups, groups``
    (``a1,a2|b1;a3|b2,b3``) and ``links``: for each different pair of ids that end together ``times << bits | a << shift | b``.
    Null and empty texts, and those whose tokens have other bytes, have zeros, an empty string and no links. Repeated rows are
    rows of their own; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)

        def batch(rows: list, made: list) -> pa.RecordBatch:
            counts = np.array([c for c, _, _ in made], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(x) for _, _, x in made])])
            links = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x for _, _, x in made)])))
            columns = [*(pa.array(x, pa.int64()) for x in zip(*rows)), *(pa.array(counts[:, k]) for k in range(3)), pa.array([g for _, g, _ in made], pa.string()), links]
            return pa.record_batch(columns, names=[k.split()[0] for k in _KINDS.split(", ")])

        for f in batches:
            rows, made, size = [], [], 0
            keys = zip(f.column("row").to_pylist(), f.column("doc_id").to_pylist())
            for key, x in zip(keys, both.align(f.column("text").to_pylist())):
                rows.append(key)
                made.append(x)
                size += int(x[0].sum())
                if size > _LINKS:
                    yield batch(rows, made)
                    rows, made, size = [], [], 0
            if rows:
                yield batch(rows, made)

    return small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, _KINDS)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document of :func:`align`: counts, a digest of its groups, and how its links stand in the whole corpus.

    A pair's count is how many links hold it in all documents. Pairs with over 1 / ``HOT_PAIRS`` of all links are at most
    ``HOT_PAIRS``, so they are broadcast with their counts; all others meet their counts by a join, in which no pair is hot. The
    best count of each id of B is broadcast too: it has a row an id of the vocabulary.
    """
    both = aligner(path_a, path_b)
    bits, shift = both.bits, both.shift
    digests = align(docs, path_a, path_b).withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")
    digests = written(digests, "alignments")
    code = F.col("code")
    each = digests.select("row", F.explode("links").alias("code")).select("row", code.bitwiseAND(F.lit((1 << bits) - 1)).alias("pair"), F.shiftright("code", bits).alias("n"))
    counts = written(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << shift) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # at most a row an id of B
    marked = counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    marked = written(marked, "pair-ranks")
    least = (counts.agg(F.sum("count")).first()[0] or 0) / HOT_PAIRS
    hot, rest = F.broadcast(marked.where(F.col("count") > least)), marked.where(F.col("count") <= least)
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    known = each.join(hot, "pair").groupBy("row").agg(*sums)
    other = each.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair").groupBy("row").agg(*sums)
    found = known.unionByName(other).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return digests.join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
