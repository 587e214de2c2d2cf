"""Near copies of the pipeline: every pair of the similarity is linked, however far its fingerprints are apart."""

import numpy as np
import pytest

import corpus_pipeline as pipe
from panelsmith.llm import simhash

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def _copies(rng, n):
    """Texts of n words whose edits are scattered, in one run, at the end, or one text repeated."""
    word = lambda: f"w{rng.integers(100_000)}"
    base = [word() for _ in range(n)]
    out = [base]
    for size in (n // 50, n // 20, n // 12, n // 10, n // 9, n // 6):
        at = int(rng.integers(0, n - size))
        out.append(base[:at] + [word() for _ in range(size)] + base[at + size :])
        out.append(base + [word() for _ in range(2 * size)])
        out.append(base[: n - size])
        out.append(base + [*("same words again and again".split())] * (size * 3))
        out.append([word() if rng.random() < size / n / 4 else w for w in base])
    return [" ".join(x) for x in out]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    head = " ".join(f"common{i}" for i in range(12))
    made = [x for n in (40, 90, 300, 300) for x in _copies(rng, n)] + [None, "", "two words", "two  WORDS", "one two three four five six"]
    return made + [f"{head} {' '.join(f'z{rng.integers(9999)}' for _ in range(30))}" for _ in range(40)]


def _links(texts):
    seen = [(simhash.simhash(x, 3), np.unique(simhash.shingle_hashes(x, 5))) for x in texts]
    for i, a in enumerate(seen):
        for j in range(i):
            d, same = (a[0] ^ seen[j][0]).bit_count(), simhash.jaccard(a[1], seen[j][1])
            if d <= 2 or same >= 0.8:
                yield i, j, d


def _roots(texts):
    root, far = list(range(len(texts))), 0
    for i, j, d in _links(texts):
        far += d > 11
        x, y = root[i], root[j]
        if x != y:
            root = [min(x, y) if r == max(x, y) else r for r in root]
    return root, far


@pytest.mark.parametrize("small", [False, True])
def test_all_similar_pairs_link(spark, texts, monkeypatch, small):
    """Against links of all pairs; also with small blocks."""
    if small:
        monkeypatch.setattr(simhash.similar_links, "__defaults__", (4,))
        monkeypatch.setattr(simhash.ring_candidates, "__defaults__", (simhash.WIDE_BITS, 5))
    root, far = _roots(texts)
    assert far > 20
    df = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in enumerate(texts)], KIND)
    if small:
        got = dict(simhash.near_copy_groups(df.select("doc_id", "text"), "doc_id").collect())
        assert len({(root[i], got[i]) for i in got}) == len(set(root)) == len(set(got.values()))
    else:
        assert sorted(r.doc_id for r in pipe.near_dedup(spark, df, "").collect()) == sorted(set(root))


def test_links_of_a_large_group_grow_with_its_rows(spark):
    """A group of copies whose edits differ makes fewer links than texts in its blocks, and few between them."""
    rng, made = np.random.default_rng(6), {}
    base = [f"w{rng.integers(100_000)}" for _ in range(60)]
    for n in (1000, 4000):
        texts = []
        for _ in range(n):
            x = list(base)
            x[int(rng.integers(60))] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(x))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = simhash.written(simhash.profiles(df, "doc_id", 3, 5, 0.8), "profiles")
        links = simhash.similar_links(df, rows, "doc_id", 5, 0.8)
        made[n] = links.count()
        root = simhash.components(links).select("component").distinct().collect()
        assert len(root) == 1
    assert made[1000] == 999 and made[4000] <= 4000 + 4**2


def test_rows_of_a_large_group_are_shipped_once(spark, monkeypatch):
    """Near copies are joined by pivots: their sets are dealt once and a few times a block; only what pivots leave apart is dealt by pairs of blocks."""
    rng = np.random.default_rng(16)
    base = [f"w{rng.integers(100_000)}" for _ in range(60)]
    shipped = []
    deal, pairs = simhash.in_blocks, simhash.block_pairs
    monkeypatch.setattr(simhash, "in_blocks", lambda *a: shipped.append(("in", (x := deal(*a)).count())) or x)
    monkeypatch.setattr(simhash, "block_pairs", lambda df, bucket, *a: (shipped.append(("pairs", x.count())) if bucket == ["component"] else None, x)[1] if (x := pairs(df, bucket, *a)) else x)
    for n in (2000, 4000):
        texts = [" ".join(f"new{k}" if j == k % 60 else w for j, w in enumerate(base)) for k in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        shipped.clear()
        rows = simhash.written(simhash.profiles(df, "doc_id", 3, 5, 0.8), "profiles")
        links = simhash.similar_links(df, rows, "doc_id", 5, 0.8)
        assert len(simhash.components(links).select("component").distinct().collect()) == 1
        assert [k for k, _ in shipped] == ["in"] and n <= shipped[0][1] <= n + simhash.PIVOTS * (n // simhash.SET_ROWS + 1)


def test_overlaps_are_those_of_pairs():
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))).astype(np.uint64) for _ in range(30)]
    o = simhash.Overlaps(sets)
    for x, a in enumerate(sets):
        assert o.shared(x).tolist() == [len(np.intersect1d(a, b)) for b in sets] if len(a) else True


def test_spanning():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n = int(rng.integers(1, 40))
        near = rng.random((n, n)) < 0.04
        near |= near.T
        group, side = rng.integers(0, n, n), rng.integers(0, 2, n)
        for s in (None, side):
            a, b = simhash.spanning(lambda x, c: c[near[x, c]], group, s)
            assert len(a) < n and all(near[x, y] and (s is None or s[x] != s[y]) for x, y in zip(a, b))
            i, j = np.nonzero(near & (True if s is None else side[:, None] != side[None, :]))
            gi, gj = np.nonzero(group[:, None] == group[None, :])
            want, got = (simhash.forest(np.concatenate([x, gi]), np.concatenate([y, gj])) for x, y in ((i, j), (a, b)))
            assert dict(zip(*want)) == dict(zip(*got))


def test_prefixes_meet(texts):
    """Whatever the common shingles are taken to be, pairs of the similarity share enough of their prefixes."""
    sets = [np.unique(simhash.shingle_hashes(x, 5)) for x in texts]
    pool, rng = np.unique(np.concatenate(sets)), np.random.default_rng(4)
    for size in (0, 50, 2000):
        known = np.sort(rng.choice(pool, min(size, len(pool)), replace=False))
        common = known, rng.integers(3, 99, len(known))
        cut = [simhash.prefix(x, common, 0.8) for x in sets]
        for i, a in enumerate(sets):
            for j in range(i):
                if len(a) and simhash.jaccard(a, sets[j]) >= 0.8:
                    small, large = (i, j) if len(a) <= len(sets[j]) else (j, i)
                    assert len(np.intersect1d(cut[small][: simhash.prefix_sizes(len(sets[small]), 0.8)[1]], cut[large]))


def test_wide_fingerprints_of_similar_sets_are_near():
    """However large the sets, and far from the bound for unlike ones."""
    rng, worst = np.random.default_rng(8), 0
    for n in (5, 6, 10, 20, 40, 300, 2000):
        for _ in range(150):
            keep = rng.integers(0, 1 << 63, n).astype(np.uint64)
            cut = n // 10
            pairs = [(keep[: -(-4 * n // 5)], keep), (keep[cut:], keep[: n - cut])]
            for a, b in pairs:
                if simhash.jaccard(np.sort(a), np.sort(b)) >= 0.8:
                    worst = max(worst, int(np.bitwise_count(simhash.wide_simhash(a) ^ simhash.wide_simhash(b)).sum()))
    assert 60 < worst <= simhash.WIDE_BITS - 5


def test_ring_near_is_the_full_check():
    rng = np.random.default_rng(9)
    draw = lambda: rng.integers(0, 1 << 32, (3000, 8), dtype=np.uint32)
    for diff in (np.uint32(1) << rng.integers(0, 32, (3000, 8), dtype=np.uint32), draw() & draw() & draw(), draw() & draw(), draw()):
        for bits in (3, 8, 20, 32, 64, 80):
            assert (simhash.ring_near(diff, bits) == (np.bitwise_count(diff).sum(axis=1) <= bits)).all()
