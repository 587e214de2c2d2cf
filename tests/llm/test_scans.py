"""License templates, token alignment and periodic runs, each against a plain computation of the same thing."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsmith.llm import alignment, licenses, periods
from panelsmith.llm.tokens import public_tokenizer

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    """The small table, null and empty texts, repeated rows, a null key, and columns of clashing names."""
    odd = [(7, None), (8, ""), (9, " \n"), (9, " \n"), (None, "Under the MIT License under the mit license"), (10, "▁x"), (11, "a b " * 50), (12, "<|endoftext|> <s> ab " * 9)]
    own = spark.createDataFrame(odd, "doc_id long, text string")
    both = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(own)
    return both.select("*", F.lit(1).alias("row"), F.lit("x").alias("pair"), F.lit(2).alias("count"), F.lit("y").alias("places")).repartition(5)


@pytest.fixture(scope="module")
def texts(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


# ---- licenses


def _plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _plain_base(text):
    words, found = _plain_words(text), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), found


def test_base_places_are_those_of_every_position(docs, texts):
    want = Counter()
    for i, t in texts:
        n, found = _plain_base(t)
        at = [k for k, _ in found]
        want[i, n, len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    got = licenses.license_labels(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels)


def _plain_match(template, words):
    """Whether a template matches all the words, by trying every way through its regions."""
    parts = [p for p in re.split(r"(<<.*?>>)|\s+", template) if p]

    def go(k, i):
        if k == len(parts):
            return i == len(words)
        if parts[k] == "<<beginOptional>>":
            depth, end = 1, k + 1
            while depth:
                depth += {"<<beginOptional>>": 1, "<<endOptional>>": -1}.get(parts[end], 0)
                end += 1
            return go(k + 1, i) or go(end, i)
        if parts[k] == "<<endOptional>>":
            return go(k + 1, i)
        if parts[k].startswith("<<var"):
            a, b = map(int, re.findall(r"\d+", parts[k]))
            return any(go(k + 1, i + n) for n in range(a, b + 1) if i + n <= len(words))
        return i < len(words) and words[i] == parts[k] and go(k + 1, i + 1)

    return go(0, 0)


def test_automaton_is_every_way_through_the_regions():
    rng = random.Random(3)
    templates = [
        "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> a<<endOptional>> b",
        "b <<var;words=0-2>> a",
        "a <<var;words=1-3>> <<beginOptional>>c<<endOptional>> b",
        "<<beginOptional>>c<<endOptional>> a b",
        "c c <<var;words=2-2>> c",
    ]
    automaton = licenses.TemplateAutomaton(templates)
    for _ in range(300):
        words = rng.choices("abcx", k=rng.randint(0, 14))
        want = []
        for t, m in enumerate(templates):
            for i in range(len(words)):
                n = max((n for n in range(1, len(words) - i + 1) if _plain_match(m, words[i : i + n])), default=None)
                want += [(t, i, n)] if n else []
        assert sorted(automaton.match([w.encode() for w in words])) == sorted(want)


def test_templates_need_their_mandatory_wording(spark):
    full = next(t for label, s, t in licenses.TEMPLATES if label == "bsd-3-clause" and s == licenses.FULL)
    plain = re.sub(r"<<var;words=0-1>>", "*", re.sub(r"<<var;words=1-20>>", "Example, Inc.", re.sub(r"<<(begin|end)Optional>>", "", full)))
    texts = [plain.upper(), plain.replace("endorse", "praise"), "Released under the terms of the MIT License.", "Licensed under CC BY-NC 4.0", "licensed under the GNU General Public License, version 3.", "under the MITx license", "SPDX-License-Identifier: Apache-2.0"]
    rows = licenses.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.base_labels) for r in rows] == [("bsd-3-clause", ""), ("", ""), ("mit", ""), ("cc-by-nc", "cc-by-nc"), ("gpl-3", ""), ("", ""), ("apache-2", "")]
    assert [r.score for r in rows] == [1.0, 0.0, 0.5, 0.5, 0.75, 0.0, 0.75]
    for bad in ("<<var;words=0-2>> a", "a <<beginOptional>> b", "a <<endOptional>>", "<<other>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.TemplateAutomaton([bad])


# ---- alignment


def _plain_alignment(both, text):
    """Groups from the sets of offsets where tokens end."""
    none = (0, 0, "", [])
    if not text:
        return none
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    left, right = ([of[i] for i in ids] for of, ids in zip(both.transducer.tokens, (a, b)))
    if b"".join(left) != (full := (" " + text).encode()) or b"".join(right) != full:
        return none
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (left, right)]
    common = sorted(set(ends[0]) & set(ends[1]))
    at = [[0, *(e.index(c) + 1 for c in common)] for e in ends] if len(text) < 3000 else [[0, *(np.searchsorted(e, common) + 1).tolist()] for e in ends]
    said = [",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m])) for i, j, k, m in zip(at[0], at[0][1:], at[1], at[1][1:])]
    return len(a), len(b), ";".join(said), [(a[j - 1], b[m - 1]) for j, m in zip(at[0][1:], at[1][1:])]


def test_alignment_is_that_of_common_ends(docs, texts, monkeypatch):
    both = alignment.aligner(*PATHS)
    plain = [(i, *_plain_alignment(both, t)) for i, t in texts]
    counts = Counter(p for *_, links in plain for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for i, n_a, n_b, said, links in plain:
        got = [counts[p] for p in links]
        digest = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
        want[i, n_a, n_b, len(links), len(links), sum(c == best[b] for c, (_, b) in zip(got, links)), sum(got), digest] += 1
    for hot in (alignment.HOT_PAIRS, 40):  # with few hot pairs most counts are joined
        monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
        assert Counter(map(tuple, alignment.align_documents(docs, *PATHS).collect())) == want


def test_aligner_is_the_same_in_pieces_and_when_it_forgets(monkeypatch):
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "the", "The", "don't", "12", "3.5", "a_b", "...", "<|endoftext|>", "<s>", "<0x41>", "é", "é", "İ", "日本", "😀", "Ⅷ", "ing", "un", "▁", "\x00", "ﬁ", "﻿"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(1500)] + ["", " ", "\n", None]
    both = alignment.Aligner(*PATHS)
    want = [_plain_alignment(both, t) for t in texts]
    for piece, kept, moves in ((1 << 20, 400_000, 1_000_000), (30, 200, 300)):
        for name, value in (("_PIECE", piece), ("_KEPT", kept), ("_MOVES", moves)):
            monkeypatch.setattr(alignment, name, value)
        for (n_a, n_b, said, links), (total, groups, codes) in zip(want, both.align(texts)):
            assert (n_a, n_b, said) == (*total[:2].tolist(), groups)
            held = {(c & (1 << both.bits) - 1): c >> both.bits for c in codes.tolist()}
            assert held == Counter(a << both.shift | b for a, b in links)


def test_transducer_closes_groups_on_an_empty_residual():
    t = alignment.SuffixTransducer([b"ab", b"c", b"abc", b"\xe2\x82"], [b"a", b"bc", b"abcab", b"c", b"\xe2"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)]
    assert t.groups([2, 0, 1], [2, 3]) == [(2, 1), (3, 2)]
    assert t.groups([2, 1], [0, 1, 3]) == [(1, 2), (2, 3)]
    assert t.groups([0], [1]) is None and t.groups([0], [0]) is None and t.groups([], [0]) is None and t.groups([3], [4, 0]) is None
    assert t.groups([], []) == []


# ---- periodic runs


def _plain_runs(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_every_period():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(6):
            w = []
            while len(w) < rng.randint(0, 90):
                w += ([rng.randint(0, 2) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9))[: rng.randint(1, 40)]
            texts.append(w)
        found = periods.find_runs([np.array(w, np.int64) for w in texts])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [_plain_runs(w) for w in texts]
    assert periods.find_runs([]) == []


def _plain_periods(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = _plain_runs(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), *top, runs and 1000 * top[1] // top[2] or None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_run_digests_are_those_of_plain_loops(docs, texts, monkeypatch):
    short = [(i, t) for i, t in texts if len(t or "") < 6000]
    want = Counter(_plain_periods(i, t) for i, t in short)
    some = docs.where("text is null or length(text) < 6000")
    got = Counter(map(tuple, periods.run_digests(some).collect()))
    assert got == want and any(n for _, n, *_ in want)
    assert Counter(map(tuple, periods.periodic_runs(some).select("doc_id", "collapsed").collect())) == Counter((i, " ".join(_collapsed(t))) for i, t in short)


def _collapsed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    gone = {k for s, n, p in _plain_runs(w) for k in range(s + p, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def test_runs_of_a_long_text_that_is_one_run():
    words = np.tile(np.arange(7), 3000)
    (found,) = periods.find_runs([words])
    assert found.tolist() == [[0, 21000, 7]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for made in (licenses.license_labels(none), alignment.align_documents(none, *PATHS), periods.run_digests(none)):
        assert made.count() == 0
