"""Operators against plainer computations of the same thing, and against columns of clashing names."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelsmith.llm import common, html, language, mixing, packing, sharding, simhash, tokens, toxicity, vectors
from panelsmith.llm.common import block_pairs, components, fresh, spread_join
from panelsmith.llm.fingerprints import BINS, fingerprint_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_shards_are_those_of_the_highest_score(docs):
    every = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("s"))
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.col("s")), 11) + 0.5) / F.lit(2.0**53)
    scored = every.withColumn("v", -1 / F.log(u))
    best = {n: dict(scored.where(F.col("s") < n).groupBy("doc_id").agg(F.max_by("s", "v")).collect()) for n in (24, 25)}
    for r in sharding.shard_documents(docs).collect():
        assert (r.shard, r.grown_shard) == (best[24][r.doc_id], best[25][r.doc_id])


def test_pieces_are_those_of_the_plain_library(docs):
    path = tokens.public_tokenizer("byte_bpe_50k.json")
    model = tokens.encoder(path).model
    ids = {r.doc_id: np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    seen = {}
    first, again = (sorted(map(tuple, packing.pack_documents(docs, path).collect())) for _ in range(2))
    assert first == again
    for doc_id, start, length, crc, total, _, _ in first:
        assert seen.get(doc_id, 0) == start and total == len(ids[doc_id]) and crc == zlib.crc32(ids[doc_id][start : start + length])
        seen[doc_id] = start + length
    assert seen == {i: len(x) for i, x in ids.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_plain_library(name):
    """On texts of odd white space, marks, letters and special tokens, also when its memory is full."""
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "the", "The", "don't", "'s", "12", "3.5", "a_b", "x-y", "...", "!!", "(", ")", "***", "<|endoftext|>", "<|", "|>", "é", "é", "İ", "ß", "日本", "😀", "Ⅷ", "²", "‍", "ing", "un"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(1500)] + ["", " ", "\n"]
    import pyarrow as pa

    own = tokens.Encoder(tokens.public_tokenizer(name))
    assert own.cuts
    want = [e.ids for e in own.model.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 400):
        ids, sizes = own.encode(pa.array(texts[at : at + 400], pa.large_string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want[at : at + 400]
        own._forget()


def test_filled_bins_hold_the_least_hash(docs):
    """From a row a shingle: the bin is the top bits of its hash, the value the low bits of the least one."""
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")).where("size(w) >= 5")
    rows = words.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.slice("w", i + 1, 5))).alias("s"))
    h = F.xxhash64(*[F.xxhash64(F.col("s")[k]) for k in range(5)])
    least = rows.select("doc_id", h.alias("h"), (F.shiftright(h, 56) + BINS // 2).alias("bin")).groupBy("doc_id", "bin").agg(F.min("h").alias("h"))
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    n = 0
    for r in least.collect():
        assert int(got[r.doc_id].fingerprint[2 * r.bin : 2 * r.bin + 2], 16) == r.h & 255
        n += 1
    assert n > 1000
    by_id = sorted(got, reverse=True)
    texts = dict(docs.select("doc_id", "text").collect())
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    wrong = [abs(got[i].near_next - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i, j in zip(by_id, [*by_id[1:], by_id[0]]) if len(sets[i]) > 40 < len(sets[j])]
    assert wrong and np.mean(wrong) < 0.02


def test_recall_of_planted_vectors(spark):
    """Pairs at cosine 0.90 to 0.95 in two dimensions of embedding; brute force finds all of them."""
    rng = np.random.default_rng(5)
    rows, at, planted = [], 0, {}
    for dim in (16, 96):
        for cos in (0.901, 0.92, 0.95):
            a = rng.normal(size=(200, dim))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b = rng.normal(size=a.shape)
            b -= (b * a).sum(1, keepdims=True) * a
            b /= np.linalg.norm(b, axis=1, keepdims=True)
            for x, y in zip(a, cos * a + np.sqrt(1 - cos**2) * b):
                rows += [(at, x.tolist()), (at + 1, y.tolist())]
                planted[at] = cos
                at += 2
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = [got[i].n_links >= 1 and got[i + 1].component_id <= i for i in planted]
    assert np.mean(found) >= 0.99


def test_decoding_is_the_least_weighted_loss():
    rng = np.random.default_rng(6)
    for n in (2, 3, 5, 9):
        codes = language.code_matrix(n, 31, 0)
        m = language.LanguageModel(tuple("abcdefghi"[:n]), codes, None, None, rng.random(codes.shape[1]) + 0.1, language.Settings())
        for _ in range(30):
            said = rng.normal(size=codes.shape[1])
            loss = [sum(t * np.log(1 + np.exp(-c * s)) for c, s, t in zip(row, said, m.trust)) for row in codes]
            lang, score, ambiguous = language.decode(said, m)
            assert lang == m.languages[int(np.argmin(loss))] and 1 / n - 1e-9 <= score <= 1
            two = sorted(loss)[:2]
            assert ambiguous == (two[1] - two[0] < m.settings.margin * codes.shape[1])


def test_every_language_and_whole_texts_are_learned(spark):
    rng = np.random.default_rng(7)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)] for _ in range(300)]
    rows = [(f"l{k:03d}", " ".join(rng.choice(w, 30))) for k, w in enumerate(words)] + [("l000", "same row " * 3)] * 3000
    df = spark.createDataFrame([(lang, text) for lang, text in rows], "lang string, text string")
    model = language.learn(df, language.Settings(sample_rows=300, slots=512, rounds=3))
    assert len(model.languages) == 300
    text = "a" * 30_000 + " zz"
    whole = np.concatenate(language.grams(language.code_points(text), 512))
    assert np.allclose(language.samples(text, 512)[0], np.bincount(whole, minlength=512) / len(whole), atol=1e-6)


def test_trees_are_walked_as_they_split():
    rng = np.random.default_rng(8)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.7)).astype(float)
    model = toxicity.boost(x, y, toxicity.Settings(trees=20))
    raw = model.raw(x)
    for row, said in zip(x[:50], raw):
        total = model.base
        for split, cut, value in model.trees:
            at = 0
            while 2 * at + 2 < len(split) and split[at] >= 0:
                at = 2 * at + 1 + int(np.searchsorted(model.edges[split[at]], row[split[at]], side="right") > cut[at])
            total += value[at]
        assert total == pytest.approx(said)
    assert np.mean((raw > 0) == (y > 0.5)) > 0.95


def test_isotonic_is_the_least_squares_fit():
    """Max over starts of the min over ends of means, away from the two ends, which carry a prior row."""
    rng = np.random.default_rng(9)
    for _ in range(20):
        y = (rng.random(30) < np.linspace(0.1, 0.9, 30)).astype(float)
        xs, ys = toxicity.isotonic(np.arange(30.0), y)
        said = np.interp(np.arange(30.0), xs, ys)
        want = [max(min(y[i : j + 1].mean() for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
        inner = [k for k in range(30) if want[0] < want[k] < want[-1]]
        assert np.allclose(said[inner], np.array(want)[inner])


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_LINKS", 0)  # links go through the joins
    rows = [(k % 7 if k % 3 else 1, k) for k in range(3000)] + [(99, k) for k in range(5)]
    df, names = spark.createDataFrame(rows, "k long, v long"), spark.createDataFrame([(k, f"n{k}") for k in range(7)], "k long, name string")
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(df, names, "k", how).select("k", "v", "name").collect())) == sorted(map(str, df.join(names, "k", how).select("k", "v", "name").collect()))
    star = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(k, k + 5000) for k in range(1, 500)], "a long, b long")
    got = components(star)
    assert got.count() == 3498 and got.where("component <> 0").count() == 0
    met = block_pairs(df.select("k", "v"), ["k"], "v", 100)
    sizes = met.groupBy("k", "lo", "hi").count().agg(F.max("count")).first()[0]
    assert sizes < 300
    a, b = (met.select("k", "lo", "hi", F.col("v").alias(c), F.col("side").alias(f"s{c}")) for c in "ab")
    pairs = a.join(b, ["k", "lo", "hi"]).where("(lo = hi and a < b) or (lo < hi and sa = 0 and sb = 1)").selectExpr("k", "least(a, b) as a", "greatest(a, b) as b")
    want = sum(n * (n - 1) // 2 for n in dict(df.groupBy("k").count().collect()).values())
    assert pairs.count() == pairs.distinct().count() == want


CLASH = "doc_id long, text string, lang string, source string, `_said` string, score string, `_score` string, key string, text_key string, copies string, nth string, `_tag` string, node string, root string, fp string"


def test_columns_of_clashing_names(spark, docs):
    rows = [(k, t, "en", "a", *"abcdefghijk") for k, t in enumerate(["one two three four five six", "one two three four five six", "", None, "un deux trois quatre cinq"])]
    df = spark.createDataFrame(rows, CLASH)
    assert fresh(df, "_tag", "new", "NODE") == ["__tag", "new", "_NODE"]
    said = language.identify(df, None)
    assert said.count() == 5 and [c for c in said.columns if c == "score"] == ["score"] and dict(said.dtypes)["score"] == "double" and "_said" in said.columns
    model = toxicity.ToxicityModel({}, 0.0, np.zeros((len(toxicity.FEATURES), 32)))
    assert toxicity.toxicity(df, model).where("predicted = 0 and _score = 'c'").count() == 5
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
    taken = mixing.take_copies(df)
    assert taken.columns == df.columns and taken.where("key = 'd' and nth = 'g'").count() == taken.count() == mixing.mix_documents(df).agg(F.sum("copies")).first()[0]
    pages = spark.createDataFrame([(1, "<article><p>It is a page.</p></article>", "x", "y")], "page_id long, html string, Text string, `_main` string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "html", "_main", "text"] and got.first().text == "It is a page."


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "one two three", "a", k) for k in range(7)] + [(2, "four five", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(3)
    counts = dict(mixing.take_copies(df).where("doc_id = 1").groupBy("other").count().collect())
    total = mixing.mix_documents(df).where("doc_id = 1").agg(F.sum("copies")).first()[0]
    assert sum(counts.values()) == total and max(counts.values()) - min(counts.get(k, 0) for k in range(7)) <= 1


def test_language_fit_holds_one_copy_of_its_rows():
    """The driver fits: beside the rows it is given, it holds them once, not several times."""
    rng = np.random.default_rng(4)
    parts = [rng.random((2, 4096), np.float32) for _ in range(400)]
    given = sum(p.nbytes for p in parts)
    tracemalloc.start()
    model = language.fit(parts, [("de", "en")[k % 2] for k in range(400)], language.Settings(rounds=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ("de", "en") and peak < 1.5 * given


def test_memory_of_workers():
    """Texts are encoded in pieces that take little, however large the batch; a task of another stage drops the tokenizer, one of its own keeps it."""
    path = tokens.public_tokenizer("byte_bpe_50k.json")
    rng = np.random.default_rng(2)
    words = np.array([f"word{k}" for k in range(2000)])
    texts = pa.array([" ".join(rng.choice(words, 1000)) for _ in range(1000)])
    model = tokens.encoder(path)
    tracemalloc.start()
    sizes = [len(ids) for ids in tokens.encode(texts, path, 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes[:3] == [len(model.model.encode(t.as_py(), add_special_tokens=False).ids) + 1 for t in texts[:3]] and len(sizes) == 1000
    assert peak < 60 << 20, peak
    assert list(common.lean(lambda x: (2 * k for k in x), tools=True)(iter([1, 2]))) == [2, 4] and tokens.encoder.cache_info().currsize
    assert list(common.lean(lambda x: (2 * k for k in x))(iter([1, 2]))) == [2, 4] and not tokens.encoder.cache_info().currsize
