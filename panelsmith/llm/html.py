"""Main text of web pages: a bidirectional LSTM labels every block by its tag path and words, in the context of the whole page."""

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsmith.llm.common import small_batches

PATH_SLOTS, WORD_SLOTS, NUMBERS = 4096, 64, 8
INPUTS = PATH_SLOTS + WORD_SLOTS + NUMBERS
DEPTH = 3  # tags of a path, from the leaf, that are read with their depth
HIDDEN = 24
_ROWS = 8192  # block vectors that are in memory at once, a page at least

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template title head iframe svg select datalist textarea".split())
_CLOSED = _SILENT - {"head"}  # silent only if an end tag follows
_END = re.compile(f"</({'|'.join(sorted(_CLOSED))})", re.IGNORECASE)
_LABELS = frozenset("title select option".split())  # their own text is never main, though no end tag follows
_IN_SELECT = frozenset("option optgroup hr button legend div span script template".split())  # start tags that leave a select open
_HEAD = frozenset("html head title meta link script style base basefont bgsound noframes template noscript".split())  # tags that leave a head open
_CLOSES_P = _BLOCK - frozenset("button label option select textarea".split())
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@lru_cache(maxsize=4096)
def _slots(word: str) -> tuple[int, ...]:
    """Two slots of a word, so that an unknown one that shares a slot with a telling one is not taken for it."""
    return tuple(crc32(w.encode("utf-8", "replace")) % PATH_SLOTS for w in (word, f"{word}\n"))


class Blocks(HTMLParser):
    """The leaf blocks of a page in page order: (path of tags and their class and id words, text, characters in links, tag).

    A path has the innermost ``DEPTH`` tags and, of those outside, each that adds a slot, with the words that add one; so
    it is bounded however deep a page nests, and its slots are those of the whole path. Words of html and body tags tell nothing.
    """

    def __init__(self, page: str = ""):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, tuple[int, ...]]] = []
        self.adding: list[int] = []  # where tags that add slots are in the stack
        self.held: Counter[int] = Counter()  # slots of the open tags
        self.at: list[int] = []  # where block tags are in the stack
        self.open: Counter[str] = Counter()
        self.ends = Counter(t.lower() for t in _END.findall(page))  # end tags still to come
        self.found: list[tuple[str, str, int, str]] = []
        self.text: list[str] = []
        self.linked = 0
        self.silent = self.links = 0

    def _break(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text and self._block() not in _LABELS:
                inner = max(0, len(self.stack) - DEPTH)
                outer = self.adding[: bisect_left(self.adding, inner)]
                path = "/".join(self.stack[k][1] for k in (*outer, *range(inner, len(self.stack))))
                self.found.append((path, text, self.linked, self._block()))
            self.text, self.linked = [], 0

    def _block(self) -> str:
        """The innermost open block tag."""
        return self.stack[self.at[-1]][0] if self.at else ""

    def _pop(self, k: int) -> None:
        """Close what is open from place ``k`` of the stack."""
        while len(self.stack) > k:
            tag, path, slots = self.stack.pop()
            if self.adding and self.adding[-1] == len(self.stack):
                self.adding.pop()
            self.held.subtract(slots)
            self.open[tag] -= 1
            self.silent -= path.startswith("!")
            self.links -= tag == "a"
        while self.at and self.at[-1] >= k:
            self.at.pop()

    def _end_head(self) -> None:
        """Close a head whose end tag is left out, unless a tag inside it is still open."""
        if self.stack and self.stack[-1][0] == "head":
            self._pop(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD:
            self._end_head()
        if tag == "br":
            self.text.append(" ")
        if tag in _BLOCK:
            self._break()
            closes = _SELF.get(tag, set())
            while (t := self._block()) in closes or (t == "p" and tag in _CLOSES_P) or (t in ("head", "title") and tag == "body") or (t in ("select", "option") and tag not in _IN_SELECT):
                self._pop(self.at[-1])
        if tag in _VOID:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower().replace("-", " ").replace("_", " ").split()
        silent = tag in _SILENT and (tag == "head" or self.ends[tag] > 0)
        if tag in _BLOCK:
            self.at.append(len(self.stack))
        before = set(_slots(f"<{tag}"))
        adds, kept = any(not self.held[k] for k in before), []
        for name in () if tag in ("html", "body") else names:
            if any(k not in before and not self.held[k] for k in _slots(name)):
                kept.append(name)
            before.update(_slots(name))
        if adds or kept:
            self.adding.append(len(self.stack))
        self.held.update(before)
        self.stack.append((tag, "!" * silent + ".".join([tag, *kept]), tuple(before)))
        self.open[tag] += 1
        self.silent += silent
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in _CLOSED:
            self.ends[tag] -= 1
        if tag in _BLOCK:
            self._break()
        if not self.open[tag]:
            return
        least = self.at[-1] if self.at and tag not in _BLOCK else 0  # an inline end tag closes nothing outside its block
        for k in range(len(self.stack) - 1, least - 1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data):
        pass


def blocks(page: str | None) -> list[tuple[str, str, int, str]]:
    parser = Blocks(page or "")
    parser.feed(page or "")
    parser.close()
    parser._break()
    return parser.found


@lru_cache(maxsize=4096)
def _path_slots(path: str) -> tuple[int, ...]:
    """Slots of every tag with its depth from the leaf (up to 3) and of every tag and name word of the path."""
    parts = [p.split(".") for p in path.split("/")]
    words = {f"{len(parts) - k}>{p[0]}" for k, p in enumerate(parts) if len(parts) - k <= DEPTH} | {x for p in parts for x in (f"<{p[0]}", *p[1:])}
    return tuple(sorted({k for w in words for k in _slots(w)}))


def vectors(found: list[tuple[str, str, int, str]]) -> np.ndarray:
    """Hashed words and numbers of each block."""
    x = np.zeros((len(found), WORD_SLOTS + NUMBERS), np.float32)
    for k, (_, text, linked, tag) in enumerate(found):
        words = text.split(" ")
        slots = np.array([crc32(w.lower().encode("utf-8", "replace")) for w in words], np.int64) % WORD_SLOTS
        x[k, :WORD_SLOTS] = 3 * np.bincount(slots, minlength=WORD_SLOTS) / len(words)
        n = len(text)
        x[k, WORD_SLOTS:] = (
            np.log1p(n) / 4, min(1.0, linked / n), text[-1] in ".!?:;\"'", sum(map(text.count, ".,;")) / len(words), k == 0, k == len(found) - 1, tag in ("h1", "h2", "h3", "h4"), n < 25,
        )
    return x


def path_vectors(paths: list[str]) -> np.ndarray:
    x = np.zeros((len(paths), PATH_SLOTS), np.float32)
    for k, path in enumerate(paths):
        x[k, list(_path_slots(path))] = 1
    return x


class Labeller:
    """One LSTM reads the blocks forwards, one backwards; a logistic unit reads both states."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.15, (INPUTS, 4 * h)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, 1)).astype(np.float32)
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, z_all: np.ndarray, live: np.ndarray, d: str, keep: bool):
        """States of one direction. z_all: steps x pages x weighted inputs of the gates; padded steps leave the state as it is."""
        h = np.zeros((z_all.shape[1], HIDDEN), np.float32)
        c, out, past = h.copy(), np.zeros((*z_all.shape[:2], HIDDEN), np.float32), []
        for t in range(len(z_all)) if d == "f" else range(len(z_all) - 1, -1, -1):
            z = z_all[t] + h @ self.p[f"h{d}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = live[t][:, None]
            tanh = np.tanh(new)
            if keep:
                past.append((t, h, c, i, f, o, g, tanh))
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[t] = h
        return out, past

    def logits(self, pages: list[list[tuple[str, str, int, str]]]) -> np.ndarray:
        """steps x pages. Blocks of one path share the weighted input of it."""
        places = {path: k for k, path in enumerate(dict.fromkeys(b[0] for p in pages for b in p))}
        tags = path_vectors(list(places))
        x, live = padded([vectors(p) for p in pages])
        at, _ = padded([np.array([[places[b[0]]] for b in p], np.int64) for p in pages])
        z = []
        for d in "fb":
            w = self.p[f"x{d}"]
            z.append((tags @ w[:PATH_SLOTS])[at[..., 0]] + x @ w[PATH_SLOTS:] + self.p[f"c{d}"])
        both = self._read(np.stack([z[0], z[1][::-1]], axis=1), np.stack([live, live[::-1]], axis=1))
        both = np.concatenate([both[:, 0], both[::-1, 1]], axis=2)
        return (both @ self.p["o"])[..., 0] + self.p["ob"]

    def _read(self, z_all: np.ndarray, live: np.ndarray) -> np.ndarray:
        """States of both directions, step by step together: steps x 2 x pages (see :meth:`_run`, which keeps what training needs)."""
        w, full = np.stack([self.p["hf"], self.p["hb"]]), live.all(axis=(1, 2))
        h = np.zeros((*z_all.shape[1:3], HIDDEN), np.float32)
        c, out = h, np.zeros((*z_all.shape[:3], HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(z_all)):
                z = z_all[t] + h @ w
                gates = 1 / (1 + np.exp(-z[..., : 3 * HIDDEN]))
                new = gates[..., HIDDEN : 2 * HIDDEN] * c + gates[..., :HIDDEN] * np.tanh(z[..., 3 * HIDDEN :])
                now = gates[..., 2 * HIDDEN :] * np.tanh(new)
                if not full[t]:
                    m = live[t][..., None]
                    now, new = np.where(m, now, h), np.where(m, new, c)
                h = out[t] = now
                c = new
        return out

    def _gradients(self, x, live, y, used):
        """Of all weights; ``x`` has the inputs ``used`` only, and so has the gradient of their weights."""
        runs = {d: self._run(x @ self.p[f"x{d}"][used] + self.p[f"c{d}"], live, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        said = 1 / (1 + np.exp(-((both @ self.p["o"])[..., 0] + self.p["ob"])))
        told = live & (y >= 0)
        dz = ((said - y) * told / max(1, told.sum())).astype(np.float32)
        grad = {"o": np.einsum("tbh,tb->h", both, dz)[:, None], "ob": dz.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            dout = dz[..., None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN, 0]
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc, dzs, gh = dh.copy(), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.p[f"h{d}"])
            for t, h0, c0, i, f, o, g, tanh in reversed(runs[d][1]):
                m = live[t][:, None]
                dh = dh + dout[t]
                dn = np.where(m, dc + dh * o * (1 - tanh**2), 0)
                step = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), np.where(m, dh * tanh, 0) * o * (1 - o), dn * i * (1 - g**2)], axis=1)
                dzs[t] = step
                gh += h0.T @ step
                dh = np.where(m, 0, dh) + step @ self.p[f"h{d}"].T
                dc = np.where(m, dn * f, dc)
            grad[f"x{d}"], grad[f"h{d}"], grad[f"c{d}"] = np.einsum("tbi,tbz->iz", x, dzs, optimize=True), gh, dzs.sum((0, 1))
        return grad

    def fit(self, pages: list[tuple[list[str], np.ndarray, np.ndarray]], rounds: int = 6, batch: int = 10, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over shuffled batches of pages (paths, vectors, labels: 1, 0, or -1 where either is right) of like length; the weights are the mean of those of the last two rounds."""
        rng, n = np.random.default_rng(seed), 0
        first, second, mean = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(3))
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][2]))
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        for r in range(rounds):
            for b in rng.permutation(len(batches)):
                x, live = padded([np.concatenate([path_vectors(pages[k][0]), pages[k][1]], axis=1) for k in batches[b]])
                used = np.nonzero(x.any(axis=(0, 1)))[0]
                y = np.zeros(live.shape, np.float32)
                for col, k in enumerate(batches[b]):
                    y[: len(pages[k][2]), col] = pages[k][2]
                n += 1
                for k, g in self._gradients(x[..., used], live, y, used).items():
                    at = used if k[0] == "x" else slice(None)
                    first[k][at] = 0.9 * first[k][at] + 0.1 * g
                    second[k][at] = 0.99 * second[k][at] + 0.01 * g**2
                    self.p[k][at] -= (rate * (1 - r / rounds) * (first[k][at] / (1 - 0.9**n)) / (np.sqrt(second[k][at] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
                    if r >= rounds - 2:
                        mean[k] += self.p[k] / (len(batches) * min(2, rounds))
        self.p = mean

    def label(self, pages: list[list[tuple[str, str, int, str]]]) -> list[np.ndarray]:
        """For each page's blocks, whether each is main text; pages of like length are read together, ``_ROWS`` blocks or one page at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            width = max(1, min(256, _ROWS // len(pages[order[-1]])))
            some, order = order[-width:], order[:-width]
            said = self.logits([pages[k] for k in some]) > 0
            for col, k in enumerate(some):
                out[k] = said[: len(pages[k]), col]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, live = np.zeros((max(map(len, pages)), len(pages), pages[0].shape[1]), pages[0].dtype), np.zeros((max(map(len, pages)), len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, True
    return x, live


_ASIDE = {
    "menu": (("nav", "ul.menu", "div.navbar", "div.main-menu", "div.breadcrumb", "div.topnav", "div.navigation"), "Home About Contact News Products Login Search Archive Topics Help"),
    "header": (("header", "div.header", "div.masthead", "div#top", "div.site-header", "div.branding"), "Daily Site Blog Welcome official since your source"),
    "footer": (("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.bottom"), "© Copyright All rights reserved Privacy Terms Imprint Impressum powered by"),
    "sidebar": (("aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "div.recommended", "section.popular", "div.tags"), "Related Popular Trending More stories Read also Latest posts Tags"),
    "notice": (("div.cookie-notice", "div.notice", "div.consent", "div.banner", "div.gdpr", "div.alert", "div.cookie-banner", "div#cookies"), "We use cookies Accept By continuing you agree to our policy consent"),
    "advert": (("div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div#ad-1", "div.banner-ad", "section.promotion"), "Sponsored Buy now offer only today discount click here best price"),
    "form": (("form", "form.search", "form.newsletter", "div.newsletter", "div.subscribe", "div.login", "div.signup"), "Email Name Send Subscribe Search Password Sign up newsletter Submit"),
    "comments": (("section#comments", "div.comments", "div.comment-list", "section.comments", "ol.comments", "div#disqus", "div.comment", "div.replies"), "says Reply wrote comment on posted ago Great thanks I agree"),
    "share": (("div.share", "div.social", "ul.share-buttons", "div.sharing"), "Share Tweet Facebook Twitter Email Print Follow us"),
}
_MAIN = ("article", "main", "article", "div.content", "div.post", "div.entry-content", "div.article-body", "div#content", "section.story", "div.post-content", "main.container", "article.post", "div.text", "div#main")
_PLAIN = ("div", "div", "div", "section", "div+div", "div+section", "div+div+div", "center", "table+tr+td", "")  # containers that tell nothing; + is nesting
_SYLLABLES = "the of and in re er on an th es st un be ge ver lich ung ein la que de el en os as ción ment eau é ou tion ing ly ble ka mo ri ta lu zo".split()


def sample_page(rng: np.random.Generator) -> tuple[str, list[tuple[str, int]]]:
    """An invented page and (text, 1 if main, -1 if either) of its blocks in page order.

    Main text lies in containers that are named for it, in plain ones, or in such of invented names, and may hold tables,
    preformatted text, lists, figures, quotes and sections; what is not main text has a telling
    name, or is a plain list of links.
    """
    said: list[tuple[str, int]] = []
    own = random.Random(int(rng.integers(1 << 40)))

    def words(n: int, extra: str = "") -> str:
        pool = extra.split()
        return " ".join(own.choice(pool) if pool and own.random() < 0.35 else "".join(own.choices(_SYLLABLES, k=own.randint(1, 4))) for _ in range(n))

    def sentences(n: int) -> str:
        return " ".join(words(int(rng.integers(3, 18))).capitalize() + str(rng.choice([".", ".", ".", "?", ", "])) for _ in range(n)).strip(", ")

    def some_classes() -> str:
        return " ".join(str(rng.choice(("flex", "mt-4", "col", "row", "p-2", "grid", "clearfix", "wide", "left", "inner", "outer"))) if rng.random() < 0.6 else "x" + words(1) for _ in range(int(rng.integers(1, 4))))

    def invented() -> str:
        one = lambda: words(1) if own.random() < 0.6 else "".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=own.randint(2, 8)))
        return " ".join(own.choice("-_").join(one() for _ in range(own.randint(1, 3))) + own.choice(("", "", "__" + one())) for _ in range(own.randint(1, 2)))

    def unseen() -> tuple[str, str]:
        """One to three nested containers of names that say nothing."""
        a = z = ""
        for _ in range(own.choice((1, 1, 2, 3))):
            tag, attr = own.choice(("div", "div", "div", "section", "article", "main")), own.choice(("class", "class", "class", "id"))
            a, z = f'{a}<{tag} {attr}="{invented()}">', f"</{tag}>{z}"
        return a, z

    def opened(kind: str) -> tuple[str, str]:
        a = z = ""
        for one in kind.split("+") if kind else ():
            tag, mark, name = one, "", ""
            for m, attr in (("#", "id"), (".", "class")):
                if m in one:
                    (tag, name), mark = one.split(m), attr
            attrs = {mark: name} if mark else {}
            if rng.random() < 0.25:
                attrs["class"] = (attrs.get("class", "") + " " + some_classes()).strip()
            a += f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">"
            z = f"</{tag}>" + z
        return a, z

    def block(tag: str, text: str, main: int, close: bool = True) -> str:
        said.append((text, main))
        inner = f"<b>{text}</b>" if rng.random() < 0.1 else text
        if rng.random() < 0.1:
            cut = text.split(" ")
            k = int(rng.integers(0, len(cut)))
            inner = " ".join([*cut[:k], f'<a href="/x">{cut[k]}</a>', *cut[k + 1 :]])
        named = f' class="{invented()}"' if own.random() < 0.12 else ""
        return f"<{tag}{named}>{inner}" + (f"</{tag}>" if close else "")

    def linked(extra: str, n: int, tag: str = "li") -> str:
        out = []
        for _ in range(n):
            text = words(int(rng.integers(1, 6)), extra)
            said.append((text, 0))
            out.append(f'<{tag}><a href="/{rng.integers(99)}">{text}</a></{tag}>')
        return "".join(out)

    def side(kind: str) -> str:
        tags, extra = _ASIDE[kind]
        a, z = opened(tags[0] if rng.random() < 0.4 else str(rng.choice(tags)))
        items, style = int(rng.integers(1, 8)) if kind in ("menu", "sidebar", "comments", "footer", "share") else int(rng.integers(1, 4)), rng.random()
        if kind == "comments" and style < 0.35:
            inner, end = opened(str(rng.choice(("article", "li.comment", "div.comment-body", "article.comment", "div"))))
            return a + block("h3", words(int(rng.integers(1, 4)), extra), 0) + "".join(inner + block("p", sentences(int(rng.integers(1, 5))), 0) + end for _ in range(items)) + z
        if kind in ("menu", "share") or (kind in ("sidebar", "footer") and style < 0.5):
            return f"{a}<ul>{linked(extra, items)}</ul>{z}"
        if kind in ("footer", "header", "notice", "advert") and own.random() < 0.4:  # one line of a name and prose
            text = f"{'© ' * (kind == 'footer' and own.random() < 0.7)}{words(1)}{own.choice(('', '.com', '.org', ' ' + words(1)))} {own.choice('·|-—')} {sentences(own.randint(1, 3))}"
            said.append((text, 0))
            return f"{a}{text}{z}"
        if kind in ("advert", "notice", "footer", "header", "comments") and style < 0.6 or (kind == "sidebar" and style < 0.7):
            texts = [sentences(int(rng.integers(1, 5))) if rng.random() < 0.7 else words(int(rng.integers(2, 12)), extra) for _ in range(1 if style < 0.3 else items)]
            if len(texts) == 1:
                said.append((texts[0], 0))
                return f"{a}{texts[0]}{z}"
            return a + "".join(block(str(rng.choice(["p", "div", "p"])), t, 0) for t in texts) + z
        return a + "".join(block(str(rng.choice(["p", "div", "h3", "label", "p"])), words(int(rng.integers(1, 9)), extra), 0) for _ in range(items)) + z

    def some(kinds: tuple[str, ...], chance: float) -> str:
        return "".join(side(k) for k in kinds if rng.random() < chance)

    def table() -> str:
        many = int(rng.integers(2, 5))
        rows = [[words(int(rng.integers(1, 4))) if rng.random() < 0.6 else f"{rng.integers(1000)}" for _ in range(many)] for _ in range(int(rng.integers(1, 6)))]
        head = "<tr>" + "".join(block("th", words(1).capitalize(), 1) for _ in range(many)) + "</tr>" if rng.random() < 0.6 else ""
        return f"<table>{head}" + "".join("<tr>" + "".join(block("td", x, 1) for x in r) + "</tr>" for r in rows) + "</table>"

    def content(n: int) -> str:
        out, close = "", rng.random() < 0.8
        paragraph = "div" if rng.random() < 0.1 else "p"
        for _ in range(n):
            r = rng.random()
            if r < 0.64:
                out += block(paragraph, sentences(int(min(30, rng.geometric(0.25)))), 1, close or paragraph == "div")
            elif r < 0.72:
                out += block(str(rng.choice(("h2", "h2", "h3", "h4"))), words(int(rng.integers(1, 7))).capitalize(), 1)
            elif r < 0.79:
                out += block("p", words(int(rng.integers(1, 5))) + str(rng.choice([".", "", " |"])), 1, close)
            elif r < 0.83:
                listed = str(rng.choice(("ul", "ol")))
                out += f"<{listed}>" + "".join(block("li", words(int(rng.integers(1, 14))), 1) for _ in range(int(rng.integers(1, 6)))) + f"</{listed}>"
            elif r < 0.86:
                out += block("blockquote", sentences(2), 1) if rng.random() < 0.5 else f"<blockquote>{block('p', sentences(2), 1)}</blockquote>"
            elif r < 0.885:
                out += table()
            elif r < 0.905:
                out += block("pre", " ".join(words(int(rng.integers(1, 8))) + " = " + str(rng.integers(99)) + ";" for _ in range(int(rng.integers(1, 6)))), 1)
            elif r < 0.925:
                out += "<dl>" + "".join(block("dt", words(int(rng.integers(1, 3))), 1) + block("dd", words(int(rng.integers(2, 16))), 1) for _ in range(int(rng.integers(1, 5)))) + "</dl>"
            elif r < 0.945:
                out += f"<figure><img src=a>{block('figcaption', words(int(rng.integers(2, 12))).capitalize() + str(rng.choice(('.', ''))), 1)}</figure>"
            elif r < 0.965:
                a, z = opened(str(rng.choice(("section", "div"))))
                out += a + block("h2", words(int(rng.integers(1, 5))).capitalize(), 1) + "".join(block("p", sentences(int(rng.integers(1, 6))), 1) for _ in range(int(rng.integers(1, 4)))) + z
            else:
                out += side(str(rng.choice(["advert", "share", "form", "notice"])))
        return out

    out = "<!DOCTYPE html><html><head><title>x</title></head><body>" + some(("notice", "header", "menu", "advert", "form", "share"), 0.5 if rng.random() < 0.8 else 0.05)
    if rng.random() < 0.1:  # a plain list of links
        out += f"<div>{linked('', int(rng.integers(4, 10)), str(rng.choice(('div', 'p', 'li'))))}</div>"
    wrap = opened(str(rng.choice(["div", "div.wrapper", "div.page", "div#container", "div+div"]))) if rng.random() < 0.5 else ("", "")
    out += wrap[0] + some(("sidebar", "menu", "advert"), 0.15)
    chance = rng.random()
    a, z = unseen() if chance < 0.4 else opened(str(rng.choice(_MAIN if chance < 0.75 else _PLAIN)))
    if rng.random() < 0.15:
        inner = opened(str(rng.choice(_PLAIN[:-1])))
        a, z = a + inner[0], inner[1] + z
    out += a
    if rng.random() < 0.8:
        title = block(str(rng.choice(["h1", "h1", "h2"])), sentences(1) if rng.random() < 0.6 else words(int(rng.integers(1, 8))).capitalize(), 1)
        top = unseen() if own.random() < 0.15 else ("<header>", "</header>") if own.random() < 0.1 else ("", "")
        byline = ""
        if own.random() < 0.2:
            said.append((words(own.randint(2, 6)), -1))
            tag = own.choice(("span", "p", "div"))
            byline = f'<{tag} class="{own.choice(("byline", "author", "date", "meta", invented()))}">{said[-1][0]}</{tag}>'
        out += top[0] + title + byline + top[1]
    out += content(int(min(60, rng.geometric(0.12))))
    if rng.random() < 0.25:
        out += some(("share", "form", "comments"), 0.5)
    out += z + some(("share", "comments", "sidebar", "advert"), 0.3) + wrap[1] + some(("form", "notice", "footer", "menu"), 0.55 if rng.random() < 0.8 else 0.05) + "</body></html>"
    return out, said


@lru_cache(maxsize=2)
def trained(pages: int = 1500, seed: int = 5) -> Labeller:
    """The labeller, trained on invented pages of known layout; the same for the same arguments."""
    rng, data = np.random.default_rng(seed), []
    for _ in range(pages):
        page, said = sample_page(rng)
        found = blocks(page)
        if [t for _, t, _, _ in found] == [" ".join(t.split()) for t, _ in said]:
            data.append(([b[0] for b in found], vectors(found), np.array([m for _, m in said], np.float32)))
    model = Labeller(seed)
    model.fit(data, seed=seed)
    return model


def main_text(found: list[tuple[str, str, int, str]], keep: np.ndarray) -> str:
    return "\n".join(b[1] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, model: Labeller | None = None, html: str = "html") -> DataFrame:
    """``pages`` with text: the main text of each whole page.

    Character references are decoded, white space inside a block becomes one space, main blocks
    are joined by a line feed in page order. Null, empty and unparsable pages, and pages without a
    main block, have an empty text. Every row is returned, with all its columns; ``text`` takes the
    place of a column of that name.
    """
    share = pages.sparkSession.sparkContext.broadcast(model or trained())  # of fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = share.value
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 256):
                found = [blocks(p) for p in batch.iloc[at : at + 256]]
                out += [main_text(f, k) for f, k in zip(found, m.label(found))]
            yield pd.Series(out, dtype="object")

    read = F.pandas_udf(run, "string")
    return small_batches(pages).select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"], read(F.col(f"`{html}`")).alias("text"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text) for every page; repeated rows are returned as often."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
