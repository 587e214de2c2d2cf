"""Toxicity: boosted trees over dense features, calibrated by isotonic regression."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import fresh, lean, small_batches, written
from panelsmith.llm.language import in_fold

SEED_LEXICON = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash disgusting clown imbecile fool".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted tú ti tus vos".split())
_LEET = str.maketrans("0134578@$!|+", "oieastbasiit")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\w)(?:\w[\s.\-_*]+){3,}\w(?!\w)")
_STEMS = (4, 5, 6)
FEATURES = (
    "hits_per_100", "log_hits", "weight_per_100", "top_weight", "stem_hits_per_100", "log_stem_hits", "seed_per_100", "log_obfuscated",
    "near_second_person", "second_person_per_100", "capitals", "shouted_words", "exclamations", "punctuation", "symbols_in_words", "long_repeats", "log_words",
)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled documents that are learned from, and so the terms of the lexicon."""

    sample_rows: int = 12_000
    least_documents: int = 3
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    window: int = 5
    seed: int = 23


def plain(token: str) -> tuple[str, bool]:
    """(the word a token stands for, whether it was obfuscated): lower case, digits and signs read as letters."""
    low = token.lower()
    if low.isalpha():
        return low, False
    core = _EDGES.sub("", low)
    if core.isalpha() or core.isdigit() or not core:
        return core, False
    return _INSIDE.sub("", core.translate(_LEET)), True


def terms(word: str) -> list[str]:
    """The lexicon keys of a word: itself and the stems that are shorter than it."""
    return [word, *[word[:n] + "-" for n in _STEMS if len(word) > n]]


class Lexicon(dict):
    """token -> (word weight, stem weight, seed, obfuscated, second person); None for plain words. Forgets when large."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str):
        word, hidden = plain(token)
        w = self.weights
        own, stem = w.get(word, 0.0), max((w.get(k, 0.0) for k in terms(word)[1:]), default=0.0)
        seed, second = word in SEED_LEXICON, word in SECOND_PERSON
        value = (own, stem, seed, hidden, second) if own or stem or seed or second else None
        if len(self) > 300_000:
            self.clear()
        self[token] = value
        return value


def features(text: str | None, lexicon: Lexicon, window: int) -> list[float]:
    text = text or ""
    tokens = text.split()
    if sum(len(t) == 1 for t in tokens) > 3:
        tokens += [_INSIDE.sub("", m) for m in _SPACED.findall(text)]
    n = max(1, len(tokens))
    found = [(i, v) for i, v in enumerate(map(lexicon.__getitem__, tokens)) if v is not None]
    hits = [(i, v) for i, v in found if v[0] or v[1] or v[2]]
    you = np.array([i for i, v in found if v[4]])
    near = 0
    if len(you):
        at = np.array([i for i, _ in hits], int)
        pos = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(pos, len(you) - 1)] - at), np.abs(you[np.maximum(pos - 1, 0)] - at))
        near = int((gap <= window).sum())
    own = [v[0] for _, v in hits if v[0]]
    stem = [v[1] for _, v in hits if v[1]]
    weight = sum(max(v[0], v[1]) for _, v in hits)
    chars = max(1, len(text))
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = raw[raw < 128].astype(np.uint8)
    kinds = np.bincount(small, minlength=128)
    capitals = kinds[65:91].sum()
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    same = raw[1:] == raw[:-1]
    repeats = (same[1:] & same[:-1]).sum() if len(same) > 1 else 0
    return [
        100 * len(own) / n, np.log1p(len(own)), 100 * weight / n, max([0.0, *own, *stem]), 100 * len(stem) / n, np.log1p(len(stem)), 100 * sum(v[2] for _, v in hits) / n,
        np.log1p(sum(v[3] for _, v in hits)), np.log1p(near), 100 * len(you) / n, capitals / chars, sum(t.isupper() and len(t) > 2 for t in tokens) / n, kinds[33] / chars,
        marks / chars, (kinds[42] + kinds[36] + kinds[64]) / chars, repeats / chars, np.log1p(len(tokens)),
    ]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    base: float
    edges: np.ndarray  # features x bin edges
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by heap position
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.0]))
    settings: Settings = Settings()

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, col, side="right") for e, col in zip(self.edges, x.T)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)
        return self.base + sum((_leaf(tree, binned) for tree in self.trees), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def _leaf(tree, binned: np.ndarray) -> np.ndarray:
    split, cut, value = tree
    at = np.zeros(len(binned), int)
    for _ in range(int(np.log2(len(split) + 1)) - 1):
        inner = split[at] >= 0
        right = binned[np.arange(len(at)), np.maximum(split[at], 0)] > cut[at]
        at = np.where(inner, 2 * at + 1 + right, at)
    return value[at]


def boost(x: np.ndarray, y: np.ndarray, settings: Settings) -> ToxicityModel:
    """Second-order boosting of small trees for the logistic loss, over quantile bins."""
    prior = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    edges = np.stack([_edges(c, settings.bins) for c in x.T])
    model = ToxicityModel({}, float(np.log(prior / (1 - prior))), edges, settings=settings)
    binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], axis=1)
    said, size, width = np.full(len(y), model.base), (1 << (settings.depth + 1)) - 1, settings.bins + 1
    for _ in range(settings.trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-said))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        split, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(y), int)
        for node in range(size):
            rows = np.nonzero(at == node)[0]
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -settings.rate * gs / (hs + 1.0)
            if 2 * node + 2 >= size or len(rows) < 8:
                continue
            best = (1e-3, -1, 0)
            for f in range(x.shape[1]):
                b = binned[rows, f]
                gl, hl = np.bincount(b, g[rows], width).cumsum()[:-1], np.bincount(b, h[rows], width).cumsum()[:-1]
                gain = np.where((hl > 0.5) & (hs - hl > 0.5), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                split[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        model.trees.append((split, cut, value))
        said = said + _leaf(model.trees[-1], binned)
    return model


def _edges(c: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges of a feature: just above zero, then quantiles of what is above."""
    above = c[c > 0]
    e = np.concatenate([[1e-12], np.quantile(above, np.linspace(0, 1, bins - 1)) if len(above) else np.full(bins - 1, 1e-12)])
    return np.sort(e)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to raw (pool adjacent violators), one prior row at each end."""
    if not len(raw):
        return np.array([-6.0, 6.0]), np.array([0.0, 1.0])
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, lowest raw, highest raw
    for r, v in zip(raw[order], y[order]):
        blocks.append([float(v), 1.0, r, r])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    xs, ys = [], []
    for k, (s, n, low, high) in enumerate(blocks):
        mean = (s + 0.5 * (k == len(blocks) - 1)) / (n + 0.5 * (k in (0, len(blocks) - 1)))
        xs += [low] if low == high else [low, high]
        ys += [mean] if low == high else [mean, mean]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def learn_lexicons(rows: DataFrame, settings: Settings) -> list[dict[str, float]]:
    """Words and stems that mark toxic documents, with their log odds, from ``text, toxic, half``.

    Three lexicons: without half 0, without half 1, and of all rows. Candidates come from toxic
    documents; clean documents are then counted for candidates only. Tasks count before anything
    is shuffled.
    """
    columns = rows.select("text", "toxic", "half")

    def count(known: frozenset[str] | None):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                seen = (Counter(), Counter())
                for t, half in zip(f["text"], f["half"]):
                    words = {plain(x)[0] for x in (t or "").split()}
                    own = {k for w in words if w for k in terms(w)}
                    seen[half].update(own if known is None else own & known)
                every = list({*seen[0], *seen[1]})
                if every:
                    yield pd.DataFrame({"term": every, "n0": [seen[0][t] for t in every], "n1": [seen[1][t] for t in every]})

        return run

    def counted(kept: DataFrame, known: frozenset[str] | None) -> DataFrame:
        found = kept.mapInPandas(lean(count(known)), "term string, n0 long, n1 long")
        return found.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    sizes = {(int(r[0]), int(r[1])): r[2] for r in columns.groupBy("toxic", "half").count().collect()}
    # all terms of several toxic documents: the sample bounds them
    frequent = counted(columns.where("toxic = 1"), None).where(F.col("n0") + F.col("n1") >= settings.least_documents)
    held = {r[0]: (r[1], r[2]) for r in frequent.collect()}
    clean = counted(columns.where("toxic = 0"), frozenset(held))
    other = {r[0]: (r[1], r[2]) for r in clean.collect()}  # at most as many terms as candidates
    out = []
    for halves in ((1,), (0,), (0, 1)):
        total = [sum(sizes.get((toxic, h), 0) for h in halves) for toxic in (0, 1)]
        weight = {}
        for t, by_half in held.items():
            n, m = (sum(x[h] for h in halves) for x in (by_half, other.get(t, (0, 0))))
            odds = np.log((n + 0.5) / (total[1] + 1)) - np.log((m + 0.5) / (total[0] + 1))
            if n >= min(settings.least_documents, 2) and odds > 1.5 and n > m:
                weight[t] = float(odds)
        out.append(weight)
    return out


def learn(rows: DataFrame, settings: Settings = Settings()) -> ToxicityModel:
    """Fit on a bounded sample of ``doc_id, text, toxic, draw`` (see :func:`labelled`).

    The sample is drawn row by row, so repeated rows cannot flood it, and holds about ``sample_rows``
    rows whatever the table's size. Each half of it is described by a lexicon of the other half, so that trees and
    calibration learn what a lexicon is worth on unseen texts; three quarters give the trees, a
    quarter the calibration. The final lexicon is of all rows. Without labels of both kinds the
    model says the share of toxic labels.
    """
    n = small_batches(rows).count()
    half, part = (F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + k)), F.lit(m)).cast("int") for k, m in ((1, 2), (2, 4)))
    sample = rows.where(F.col("draw") < F.lit(settings.sample_rows / max(n, 1))).select("doc_id", "text", "toxic", half.alias("half"), part.alias("part"))
    sample = written(sample, "toxicity-sample")
    lexicons = learn_lexicons(sample, settings)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Lexicon(w) for w in lexicons[:2]]
        for f in frames:
            x = [features(t, known[h], settings.window) for t, h in zip(f["text"], f["half"])]
            if x:
                yield pd.DataFrame({"doc_id": f["doc_id"], "part": f["part"], "toxic": f["toxic"], "x": x})

    dense = sample.mapInPandas(lean(run), "doc_id long, part int, toxic int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(dense["x"].tolist()).reshape(-1, len(FEATURES))
    y, trees = dense["toxic"].to_numpy(float), (dense["part"] > 0).to_numpy()
    model = boost(x[trees], y[trees], settings)
    model.weights = lexicons[2]
    model.knots = isotonic(model.raw(x[~trees]), y[~trees]) if model.trees and 0 < y[~trees].sum() < (~trees).sum() else (np.array([0.0]), np.array([y.mean() if len(y) else 0.0]))
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5), from the whole of each text.

    Null and empty texts have the score of a text without words. Every row is returned, with all
    its columns; score and predicted take the place of columns of their names.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees, bounded by the settings

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = share.value
        lexicon = Lexicon(m.weights)
        for texts in frames:
            x = np.array([features(t, lexicon, m.settings.window) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(m.score(x))

    scored = F.pandas_udf(lean(run), "double")
    (score,) = fresh(docs, "_score")
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return small_batches(docs).withColumn(score, scored(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in names], F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted")
    )


def labelled(docs: DataFrame, labels: DataFrame, seed: int = Settings.seed) -> DataFrame:
    """doc_id, text, toxic, draw of the documents that have a label, outside the held-out fold; one label per document (the larger).

    ``draw`` is a random number of each row, so a sample by it is drawn before texts are shuffled.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.where(~in_fold("doc_id", 5, 0)).select("doc_id", "text", F.rand(seed).alias("draw")).join(known, "doc_id")


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels are learned outside the held-out fold only. Repeated rows are returned as often; an
    empty table gives no rows; other columns are not read.
    """
    model = learn(labelled(docs, labels), settings)
    rows = docs.select("doc_id", "text", in_fold("doc_id", 5, 0).alias("held_out"))
    return toxicity(rows, model).drop("text")
