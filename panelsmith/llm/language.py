"""Language identification by error-correcting output codes over hashed character n-grams."""

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsmith.llm.common import fresh, lean, small_batches

UNDETERMINED = "und"
_SPACE = 32
_PIECE = 1 << 18  # code points of a text that are scored at once


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds what is learned from: so many rows in all, with their whole texts."""

    slots: int = 4096
    sample_rows: int = 1200
    rounds: int = 120
    ridge: float = 1e-3
    most_bits: int = 31
    margin: float = 0.05
    seed: int = 17


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # slots x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding; sums to the number of bits
    settings: Settings


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    """Lower-case letters of the text; every run of anything else is one space, also at both ends."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([_SPACE], np.where(letters()[codes], codes, _SPACE), [_SPACE])).astype(np.uint32)
    return codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]


def grams(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of all 1-, 2- and 3-grams."""
    c = codes.astype(np.uint64)
    out = []
    for n in (1, 2, 3):
        h = np.full(max(0, len(c) - n + 1), n, np.uint64)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h % np.uint64(slots)).astype(np.int64))
    return out


def gram_shares(codes: np.ndarray, slots: int) -> np.ndarray:
    """The share of each slot in all grams of a text, counted piece by piece."""
    total = np.zeros(slots)
    for at in range(0, len(codes), _PIECE):
        for found in grams(codes[max(0, at - 2) : at + _PIECE], slots):
            total += np.bincount(found, minlength=slots)
    return total / max(1.0, total.sum())


def margins(text: str, model: LanguageModel) -> np.ndarray | None:
    """What each bit's classifier says of the whole text; None if it has no letter."""
    codes = code_points(text)
    if len(codes) < 2 or not (codes != _SPACE).any():
        return None
    return gram_shares(codes, model.settings.slots) @ model.weights + model.bias


def samples(text: str, slots: int) -> np.ndarray:
    """The shares of a whole text and of a short piece of it, which a hash of the text chooses."""
    rng = np.random.default_rng(crc32(text.encode("utf-8", "surrogatepass")))
    short = int(rng.integers(20, 200))
    at = int(rng.integers(0, max(1, len(text) - short)))
    return np.array([gram_shares(code_points(part), slots) for part in (text, text[at : at + short])], np.float32)


def code_matrix(n: int, most: int, seed: int) -> np.ndarray:
    """Codewords of n languages: all ways to split few of them in two, else random splits far apart."""
    if n < 2:
        return np.ones((n, 0))
    if (1 << (n - 1)) - 1 <= most:
        bits = np.arange(1, 1 << (n - 1))
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, most))
        m[:, np.abs(m.sum(0)) == n] = rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0))[:, None]
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = m, d
    return best


def fit(parts: list[np.ndarray], langs: list[str], settings: Settings = Settings()) -> LanguageModel:
    """Learn one logistic classifier per codeword bit from the :func:`samples` of texts.

    A fifth of the rows is left out to measure each bit: its accuracy above chance is its weight
    in decoding.
    The driver holds one copy of the numbers: ``parts`` is emptied as its rows are taken over.
    """
    names = tuple(sorted(set(langs)))
    codes = code_matrix(len(names), settings.most_bits, settings.seed)
    bits = codes.shape[1]
    if not bits:
        return LanguageModel(names, codes, np.zeros((settings.slots, 0)), np.zeros(0), np.zeros(0), settings)
    place = {x: k for k, x in enumerate(names)}
    which = np.repeat([place[lang] for lang in langs], [len(p) for p in parts])
    held = np.arange(len(which)) // 2 % 5 == 0 if len(which) >= 40 else np.zeros(len(which), bool)
    ends = np.cumsum([0, *[len(p) for p in parts]])
    x, at, away = np.empty((len(which), settings.slots), np.float32), 0, int((~held).sum())
    for k in range(len(parts)):  # rows that are learned from come first, so they are a view; a part is dropped once it is copied
        own = held[ends[k] : ends[k + 1]]
        new, old = parts[k][~own], parts[k][own]
        x[at : at + len(new)], x[away : away + len(old)] = new, old
        at, away, parts[k] = at + len(new), away + len(old), None
    which, xt, xh = np.concatenate([which[~held], which[held]]), x[:at], x[at:]
    held = np.arange(len(which)) >= at
    mean = xt.mean(0)
    scale = np.concatenate([xt[:, c : c + 256].std(0) for c in range(0, settings.slots, 256)]) + 1e-4
    for c in range(0, len(x), 64):
        x[c : c + 64] = (x[c : c + 64] - mean) / scale
    share = np.bincount(which[~held], minlength=len(names)).astype(float)
    importance = (1 / np.maximum(share, 1))[which[~held]]
    importance = (importance / importance.sum())[:, None].astype(np.float32)
    y = codes[which[~held]].astype(np.float32)
    w, bias, step = np.zeros((settings.slots, bits), np.float32), np.zeros(bits, np.float32), np.zeros((settings.slots + 1, bits), np.float32)
    size = np.concatenate([(xt[c : c + 64] ** 2).sum(1) for c in range(0, len(xt), 64)])
    rate = np.float32(4.0 / max(1.0, float(size.mean())))
    for _ in range(settings.rounds):
        pull = -y / (1 + np.exp(np.clip(y * (xt @ w + bias), -30, 30))) * importance
        step = 0.9 * step - rate * np.vstack([xt.T @ pull + settings.ridge * w, pull.sum(0, keepdims=True)])
        w, bias = w + step[:-1], bias + step[-1]
    trust = np.ones(bits)
    if held.any():
        right = (np.sign(xh @ w + bias) == codes[which[held]]).mean(0)
        trust = np.maximum(right - 0.5, 0.01)
        trust *= bits / trust.sum()
    w = (w / scale[:, None]).astype(np.float64)
    return LanguageModel(names, codes, w, bias - mean @ w, trust, settings)


def decode(said: np.ndarray, model: LanguageModel) -> tuple[str, float, bool]:
    """(language, score, ambiguous): the codeword of the least weighted logistic loss."""
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    loss = (np.logaddexp(0, -model.codes * said) * model.trust).sum(1)
    best, second = np.argsort(loss, kind="stable")[:2]
    odds = np.exp(loss[best] - loss)
    return model.languages[best], float(1 / odds.sum()), bool(loss[second] - loss[best] < model.settings.margin * model.codes.shape[1])


def learn(rows: DataFrame, settings: Settings = Settings()) -> LanguageModel | None:
    """Fit on a bounded sample of ``text, lang``, as many rows of each language as ``sample_rows`` allows, and at least one.

    Rows are drawn one by one, so repeated rows count as often as they occur; tasks count the grams
    of whole texts, and only these counts reach the driver. Every language that has rows is
    learned: the driver holds their names and codewords. None where no row has a language and a text.
    """
    usable = small_batches(rows).where("lang is not null and text is not null").select("text", "lang")
    counts = dict(usable.groupBy("lang").count().collect())  # one row a language
    if not counts:
        return None
    each = max(1, settings.sample_rows // len(counts))
    rates = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (1.3 * each + 20) / n))])
    drawn = usable.withColumn("draw", F.rand(settings.seed)).where(F.col("draw") < F.element_at(rates, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))  # of the few rows drawn
    drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= each)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"lang": f["lang"], "nth": f["nth"], "shares": [samples(t, settings.slots).tobytes() for t in f["text"]]})

    sample = drawn.select("text", "lang", "nth").mapInPandas(lean(count), "lang string, nth int, shares binary").toArrow()  # at most sample_rows
    keys = sorted(zip(sample["lang"].to_pylist(), sample["nth"].to_pylist(), range(len(sample))))
    shares = sample["shares"]
    del sample
    parts = [np.frombuffer(shares[k].as_buffer(), np.float32).reshape(-1, settings.slots) for *_, k in keys]  # no copy
    del shares
    return fit(parts, [lang for lang, *_ in keys], settings)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous, from the whole of each text.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything where
    there is no model. Every row is returned, with all its columns; the new ones take the place of
    columns of their names.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)  # at most slots x bits numbers

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = share.value
        for texts in frames:
            out = []
            for t in texts:
                said = margins(t, m) if m is not None and t else None
                out.append((UNDETERMINED, 0.0, False) if said is None else decode(said, m))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    labelled = F.pandas_udf(lean(run), "lang_pred string, score double, ambiguous boolean")
    (said,) = fresh(docs, "_said")
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    return small_batches(docs).withColumn(said, labelled(F.col(f"`{text}`"))).select(*[F.col(f"`{c}`") for c in names], f"{said}.*")


def in_fold(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key's text, modulo ``parts``, is ``part`` (null keys count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def identify_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document.

    Learns from the text and lang of documents outside the held-out fold only. Repeated rows are
    returned as often; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", "text", "lang", in_fold("doc_id", 4, 2).alias("held_out"))
    model = learn(rows.where("not held_out"), settings)
    return identify(rows.drop("lang"), model).drop("text")
