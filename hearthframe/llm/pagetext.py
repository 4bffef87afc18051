"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, with the path of
tags, classes and ids above them. A bidirectional LSTM in numpy reads the blocks in page order, each as
the mean vector of its hashed path parts, the mean vector of its hashed words, and a few measures, and
labels every block with the whole page in view. It is trained here, on the driver, on invented pages of
many layouts whose blocks are known; the number of pages and rounds is fixed.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.llm.common import fresh, small_batches, table

#: Buckets and sizes of the path and word vectors; measures of a block; units in each direction.
PATHS, PATH_DIM, WORDS, WORD_DIM, MEASURES, UNITS = 4_096, 16, 512, 4, 5, 16
#: Invented pages, rounds over them, pages in a step, step size, seed.
PAGES, ROUNDS, STEP, RATE, SEED = 1_500, 9, 32, 0.01, 11
#: Blocks in a padded batch of pages, about.
AT_ONCE = 16_384

#: HTML elements, from the standard.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head title legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What the start of an element closes if it is open, up to the nearest of the second kind.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NO_P = BLOCK - {"body", "html", "head", "title", "option", "button", "label", "legend", "summary", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "iframe"}

#: Attributes: a quote opens a value only after an equals sign; other values end at white space or the tag's end.
_ATTRS = r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+"
_RAW = "script|style|noscript|template|textarea|svg|iframe"
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(?P<raw>{_RAW})\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS})>|<[!?][^>]*>|<(?P<open>[!?]|/?[a-zA-Z])", re.S | re.I)
_ATTR = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+|\d+")
#: Outermost, and innermost, open elements that a path names, and names of one element, at most.
NEAR, NAMES = 32, 32


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


class _Open:
    """The open elements, with the places of each tag's and of the block-level ones, so nothing is searched for."""

    def __init__(self) -> None:
        self.all: list[tuple[str, tuple[str, ...]]] = []
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.of.setdefault(tag, []).append(len(self.all))
        if tag in BLOCK:
            self.blocks.append(len(self.all))
        self.all.append((tag, names))

    def last(self, tags) -> int:
        """The place of the innermost of these tags, or -1."""
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=-1)

    def pop(self, k: int) -> None:
        """Closes all from place k on."""
        while len(self.all) > k:
            tag, _ = self.all.pop()
            self.of[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def path(self) -> tuple[str, ...]:
        own = self.all if len(self.all) <= 2 * NEAR else self.all[:NEAR] + self.all[-NEAR:]
        return tuple(chain.from_iterable(names for _, names in own))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: white space made one space, character references decoded, empty ones left out.

    The page is gone through once. From a tag on that never ends, all is text.
    """
    out, open_, path, parts, linked, at = [], _Open(), None, [], 0, 0

    def close() -> None:
        nonlocal linked, path
        if path is not None:
            text = " ".join("".join(parts).split())
            out.append(Block(text, path or ("body",), min(linked, len(text))))
        parts.clear()
        path, linked = None, 0

    def said(text: str) -> None:
        nonlocal path, linked
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        if not text.isspace():
            if path is None:
                path = open_.path()
            linked += bool(open_.of.get("a")) and len(text)
        parts.append(text)

    for m in _TOKEN.finditer(page):
        said(page[at : m.start()])
        at = m.start() if m["open"] else m.end()
        if m["open"]:
            break
        tag = m["tag"]
        if not tag:
            if m["raw"] and m["raw"].lower() in BLOCK:
                close()
            continue
        tag = tag.lower()
        if m["end"]:
            k = open_.last((tag,))
            if tag in BLOCK:
                close()
            if k >= 0 and (tag in BLOCK or k > (open_.blocks[-1] if open_.blocks else -1)):
                open_.pop(k)
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            parts.append(" ")
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            k = open_.last(ends)
            if k > open_.last(stops):
                open_.pop(k)
        elif tag in _NO_P and (k := open_.last(("p",))) >= 0:
            open_.pop(k)
        if tag in VOID:
            continue
        names = [tag]
        if m["attrs"]:
            for a in _ATTR.finditer(m["attrs"]):
                found = _PART.findall((a[2] or a[3] or a[4] or "").lower())
                names += (f"{tag}.{x}" for x in found)
                names += (f".{x}" for x in found)
        open_.push(tag, tuple(names[:NAMES]))
    said(page[at:])
    close()
    return out


# --- features and the network ---------------------------------------------------------------------


@functools.lru_cache(maxsize=50_000)
def _path_keys(path: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(crc32(x.encode()) % PATHS for x in (*path, f"leaf:{next(p for p in reversed(path) if '.' not in p)}"))


def _measures(b: Block, k: int, n: int, words: int) -> tuple[float, ...]:
    return np.log1p(words) / 5, b.linked / len(b.text), sum(map(b.text.count, ".,;!?")) / (words + 1), (k + 0.5) / n, len(b.path) / 10


@dataclass
class Input:
    """Blocks of some pages: hashed parts with the block of each, measures, and the blocks of each page."""

    paths: np.ndarray
    path_of: np.ndarray
    words: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray
    sizes: np.ndarray


def _runs(rows: list, parts: Iterator[int]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(parts, np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)


def features(pages: list[list[Block]]) -> Input:
    paths, words, measures = [], [], []
    for page in pages:
        for k, b in enumerate(page):
            own = b.text.lower().encode("utf-8", "surrogatepass").split()
            paths.append(_path_keys(b.path))
            words.append(own)
            measures.append(_measures(b, k, len(page), len(own)))
    keys, owner = _runs(words, map(crc32, chain.from_iterable(words)))
    return Input(*_runs(paths, chain.from_iterable(paths)), keys % WORDS, owner, np.array(measures, np.float32).reshape(-1, MEASURES), np.array([len(p) for p in pages], np.int64))


def _mean(table_: np.ndarray, keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
    return np.stack([np.bincount(owner, table_[keys, d], n) for d in range(table_.shape[1])], 1).astype(np.float32) / size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over blocks, with its vectors. Weights are named arrays."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        wide = PATH_DIM + WORD_DIM + MEASURES
        draw = lambda *shape: rng.normal(0, 0.3 if len(shape) == 2 and shape[0] >= WORDS else 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = {"path": draw(PATHS, PATH_DIM), "word": draw(WORDS, WORD_DIM), "out": draw(2 * UNITS + wide, 1), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.w |= {f"{d}x": draw(wide, 4 * UNITS), f"{d}h": draw(UNITS, 4 * UNITS), f"{d}c": np.repeat(np.array([0, 1, 0, 0], np.float32), UNITS)}

    def _lstm(self, x: np.ndarray, d: str, learns: bool) -> tuple[np.ndarray, list]:
        """x (pages, blocks, inputs) -> outputs, and if it learns what the way back needs."""
        pages, n, _ = x.shape
        h, c, out, kept = np.zeros((pages, UNITS), np.float32), np.zeros((pages, UNITS), np.float32), np.empty((pages, n, UNITS), np.float32), []
        given = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        for t in range(n):
            z = given[:, t] + h @ self.w[f"{d}h"]
            i, f, o, g = _sigmoid(z[:, :UNITS]), _sigmoid(z[:, UNITS : 2 * UNITS]), _sigmoid(z[:, 2 * UNITS : 3 * UNITS]), np.tanh(z[:, 3 * UNITS :])
            before, c = c, f * c + i * g
            if learns:
                kept.append((h, before, c, i, f, o, g))
            h = o * np.tanh(c)
            out[:, t] = h
        return out, kept

    def _back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dx = np.empty_like(x)
        dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        for t in reversed(range(x.shape[1])):
            h, before, c, i, f, o, g = kept[t]
            dh = dh + dout[:, t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[f"{d}x"] += x[:, t].T @ dz
            grad[f"{d}h"] += h.T @ dz
            grad[f"{d}c"] += dz.sum(0)
            dx[:, t] = dz @ self.w[f"{d}x"].T
            dh, dc = dz @ self.w[f"{d}h"].T, dc * f
        return dx

    def _padded(self, given: Input) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The blocks' inputs; their places in (pages, blocks) from the front and, reversed, from the back."""
        n = len(given.measures)
        flat = np.concatenate([_mean(self.w["path"], given.paths, given.path_of, n), _mean(self.w["word"], given.words, given.word_of, n), given.measures], 1)
        page = np.repeat(np.arange(len(given.sizes)), given.sizes)
        at = np.arange(n) - np.repeat(np.cumsum(given.sizes) - given.sizes, given.sizes)
        return flat, page, at, np.repeat(given.sizes, given.sizes) - 1 - at

    def run(self, given: Input, labels: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
        """The probability of each block to be main text; with labels also the gradients of the mean log loss."""
        flat, page, at, turned = self._padded(given)
        shape = (len(given.sizes), int(given.sizes.max(initial=0)), flat.shape[1])
        front, back = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        front[page, at], back[page, turned] = flat, flat
        hf, kf = self._lstm(front, "f", labels is not None)
        hb, kb = self._lstm(back, "b", labels is not None)
        seen = np.concatenate([hf[page, at], hb[page, turned], flat], 1)
        p = _sigmoid(seen @ self.w["out"] + self.w["bias"])[:, 0]
        if labels is None:
            return p, {}
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        dz = ((p - labels) / len(p))[:, None].astype(np.float32)
        grad["out"], grad["bias"] = seen.T @ dz, dz.sum(0)
        dseen = dz @ self.w["out"].T
        df, db = np.zeros_like(hf), np.zeros_like(hb)
        df[page, at], db[page, turned] = dseen[:, :UNITS], dseen[:, UNITS : 2 * UNITS]
        dflat = self._back(front, "f", kf, df, grad)[page, at] + self._back(back, "b", kb, db, grad)[page, turned] + dseen[:, 2 * UNITS :]
        for name, keys, owner, lo, size in (("path", given.paths, given.path_of, 0, PATH_DIM), ("word", given.words, given.word_of, PATH_DIM, WORD_DIM)):
            each = dflat[:, lo : lo + size] / np.maximum(np.bincount(owner, minlength=len(dflat)), 1)[:, None]
            np.add.at(grad[name], keys, each[owner])
        return p, grad


# --- training pages -------------------------------------------------------------------------------


class _Layout:
    """An invented page, and whether each of its blocks is main text."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []
        self.syllables = [rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouyéö") + rng.choice(["", "n", "r", "s", "t"]) for _ in range(30)]
        #: How elements are named on this page: by what they are, not at all, or by codes that mean nothing.
        self.naming = rng.choices(["own", "none", "code"], [0.74, 0.1, 0.16])[0]
        self.named = self.naming == "own"
        self.codes: dict[str, str] = {}
        self.plain = rng.random() < 0.2

    def words(self, lo: int, hi: int) -> str:
        out = ["".join(self.rng.choices(self.syllables, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(lo, hi))]
        text = " ".join(w + self.rng.choice(["", "", "", "", ",", "."]) for w in out).capitalize()
        return text + self.rng.choice([".", ".", "", " &amp; more."])

    def tag(self, tag: str, names: list[str], body) -> None:
        name = self.called(tag, names)
        tag = "div" if self.plain and tag in ("nav", "header", "aside", "footer", "section", "article", "main") and (name or not self.named) else tag
        attr = f' {self.rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        self.parts.append(f"<{tag}{attr}>")
        body()
        self.parts.append(f"</{tag}>")

    def called(self, tag: str, names: list[str]) -> str:
        """One of the names, nothing, or a code, the same one for the same names on a page."""
        if self.named:
            return self.rng.choice(names) if names else ""
        if self.naming == "none":
            return ""
        key = f"{tag} {names[-1:]}"
        if key not in self.codes:
            self.codes[key] = self.rng.choice(["css-", "sc-", "jsx-", "x", "_"]) + "".join(self.rng.choices("abcdefghijkmnpqrstuvwxyz0123456789", k=self.rng.randint(2, 7)))
        return self.codes[key]

    def leaf(self, tag: str, text: str, main: bool, close: bool = True) -> None:
        name = self.called(tag, []) if self.naming == "code" else ""
        self.parts.append(f"<{tag}" + f' class="{name}"' * bool(name) + f">{text}" + f"</{tag}>" * close)
        self.labels.append(main)

    def links(self, lo: int, hi: int) -> None:
        self.parts.append("<ul>")
        for _ in range(self.rng.randint(lo, hi)):
            self.leaf("li", f'<a href="/{self.rng.randint(1, 99)}">{self.words(1, 3)}</a>', False)
        self.parts.append("</ul>")

    def menu(self) -> None:
        if self.rng.random() < 0.15:
            row = self.rng.choice([" | ", " ", "<br>"]).join(f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(self.rng.randint(1, 6)))
            self.leaf(self.rng.choice(["div", "center", "p", "nav"]), row, False)
            return
        tag, names = self.rng.choice([("nav", ["", "", "main-nav"]), ("div", ["menu", "navbar", "top-menu", "breadcrumb", "navigation"]), ("header", ["", "site-header"])])
        self.tag(tag, names, lambda: self.links(1, 8))

    def header(self) -> None:
        self.tag(self.rng.choice(["header", "header", "div"]), ["header", "site-header", "masthead", "top-bar", "page-header"], lambda: self.leaf(self.rng.choice(["div", "p", "span", "h2"]), self.words(1, 6), False))

    def short(self, tag: str, names: list[str]) -> None:
        if self.rng.random() < 0.5:
            self.tag(tag, names, lambda: self.leaf("p", self.words(2, 40), False))
        else:
            self.tag(tag, names, lambda: (self.parts.append(self.words(2, 25)), self.labels.append(False)))

    def advert(self) -> None:
        self.short(self.rng.choice(["div", "div", "aside", "section"]), ["ad", "ad", "ads", "advert", "advertisement", "banner-ad", "sponsored", "promo", "ad-box"])

    def notice(self) -> None:
        self.short(self.rng.choice(["div", "section"]), ["cookie-notice", "notice", "consent", "cookie-banner", "alert", "gdpr", "popup", "newsletter", "subscribe", "paywall"])

    def side(self) -> None:
        tag, names = self.rng.choice([("aside", ["", "sidebar", "widget"]), ("div", ["sidebar", "widget", "related", "side", "trending", "share", "social", "tags"])])
        self.tag(tag, names, lambda: (self.leaf(self.rng.choice(["h2", "h3", "h3", "h4"]), self.words(1, 6), False), self.links(1, 5) if self.rng.random() < 0.6 else self.leaf("p", self.words(5, 40), False)))

    def form(self) -> None:
        names = ["", "search", "login", "contact", "signup"]
        self.tag("form", names, lambda: (self.leaf(self.rng.choice(["label", "label", "h3", "p"]), self.words(1, 6), False), self.leaf(self.rng.choice(["button", "p", "div"]), self.words(1, 6), False)))

    def comments(self) -> None:
        def one() -> None:
            if self.rng.random() < 0.2:
                self.leaf("b", self.words(1, 3), False)
                self.parts[-1:] = [f"<div>{self.parts[-1]}</div>"]
            self.tag(self.rng.choice(["div", "li", "article", "article"]), ["comment", "reply", "comment-body"], lambda: [self.leaf("p", self.words(3, 60), False) for _ in range(self.rng.randint(1, 2))])

        def every() -> None:
            if self.rng.random() < 0.3:
                self.leaf(self.rng.choice(["h2", "h3", "h4"]), self.words(1, 6), False)
            for _ in range(self.rng.randint(1, 4)):
                one()

        if self.rng.random() < 0.3:
            for _ in range(self.rng.randint(1, 4)):
                one()
        else:
            self.tag(self.rng.choice(["div", "section", "ol"]), ["comments", "comment-list", "discussion", "responses", "reader-comments"], every)

    def foot(self) -> None:
        if self.rng.random() < 0.15:
            made = f"{self.rng.choice(['&copy;', 'Copyright', 'Copyright &copy;'])} {self.words(1, 12)}"
            if self.rng.random() < 0.5:
                self.tag("div", ["", "", "bottom"], lambda: self.leaf(self.rng.choice(["p", "div"]), made, False))
            else:
                self.leaf(self.rng.choice(["div", "p", "center", "address"]), made, False)
            return
        tag, names = self.rng.choice([("footer", ["", "", "site-footer"]), ("div", ["footer", "copyright", "bottom", "legal", "site-footer"])])
        self.tag(tag, names, lambda: (self.parts.append(f"&copy; {self.words(1, 20)}"), self.labels.append(False)) if self.rng.random() < 0.7 else self.links(1, 5))

    def bare(self) -> None:
        """A story in one block, or in nameless ones, its paragraphs parted by line breaks."""
        if self.rng.random() < 0.5:
            self.leaf("h1", self.words(2, 14), True)
        if self.rng.random() < 0.2:
            self.parts.append("<hr>" + "<br><br>".join(self.words(20, 90) for _ in range(self.rng.randint(1, 5))) + "<hr>")
            self.labels.append(True)
            return
        for _ in range(self.rng.choice([1, 1, 2, 4])):
            self.leaf(self.rng.choice(["div", "div", "p"]), "<br><br>".join(self.words(20, 90) for _ in range(self.rng.randint(1, 4))), True)

    def story(self) -> None:
        if self.rng.random() < 0.8:
            self.leaf(self.rng.choice(["h1", "h1", "h2"]), self.words(2, 14), True)
        for _ in range(self.rng.randint(1, 14)):
            kind = self.rng.random() * (1 if self.named else 0.93)
            if kind < 0.7:
                self.leaf("p", self.words(*self.rng.choice([(1, 1), (1, 6), (4, 40), (4, 40), (20, 140), (20, 140)])), True, self.rng.random() < 0.9)
            elif kind < 0.715:
                rows = ["".join(f"<{t}>{self.words(1, 5)}</{t}>" for t in [self.rng.choice(["td", "td", "th"])] * 2) for _ in range(self.rng.randint(1, 3))]
                self.parts.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
                self.labels += [True] * (2 * len(rows))
            elif kind < 0.725:
                self.parts.append(f"<dl><dt>{self.words(1, 5)}</dt><dd>{self.words(3, 30)}</dd></dl><figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>")
                self.labels += [True] * 3
            elif kind < 0.8:
                self.leaf("p", f"<b>{self.words(2, 40)}<br>", True, False)
            elif kind < 0.85:
                self.leaf(self.rng.choice(["h2", "h3", "h4", "blockquote", "pre", "div"]), self.words(2, 30), True)
            elif kind < 0.9:
                self.parts.append("<ul>")
                for _ in range(self.rng.randint(1, 4)):
                    self.leaf("li", self.words(2, 20), True)
                self.parts.append("</ul>")
            elif kind < 0.92:
                self.leaf("p", f'{self.words(2, 20)} <a href="/x">{self.words(1, 4)}</a>', True)
            elif kind < 0.93:
                self.leaf("p", f'<a href="/x">{self.words(6, 30)}</a>', True)
            elif kind < 0.96:
                self.advert()
            else:
                self.rng.choice([self.form, self.notice, self.side])()
        if self.named and self.rng.random() < 0.12:
            self.comments()

    def main(self) -> None:
        if self.rng.random() < 0.06:
            row = self.rng.choice([" ", "<br>"]).join(f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(self.rng.randint(1, 6)))
            self.parts.append(f"<table><tr><td>{row}</td><td>")
            self.labels.append(False)
            self.story()
            self.parts.append("</td></tr>")
            if self.rng.random() < 0.5:
                self.parts.append(f"<tr><td>{self.rng.choice(['&copy;', 'Copyright'])} {self.words(1, 8)}</td></tr>")
                self.labels.append(False)
            self.parts.append("</table>")
            return
        if self.rng.random() < 0.12:
            if self.rng.random() < 0.5:
                self.bare()
            else:
                self.tag(self.rng.choice(["div", "article", "main"]), ["", "", "content"], self.bare)
            return
        tag, names = self.rng.choice([("article", ["", "", "post"]), ("article", ["", "story"]), ("main", ["", "content"]), ("div", ["content", "post-body", "entry-content", "article-body", "main-content", "story", "text", "post", "entry", "prose", "body-text"]), ("section", ["content", "article", "entry"])])
        if self.rng.random() < 0.3:
            self.tag(self.rng.choice(["main", "div"]), ["", "content", "main", "container", "wrapper", "page"], lambda: self.tag(tag, names, self.story))
        else:
            self.tag(tag, names, self.story)


def invented(n: int, seed: int) -> tuple[list[str], list[list[bool]]]:
    """Pages of random layouts, and for each of their blocks whether it is main text."""
    pages, labels = [], []
    for k in range(n):
        rng = random.Random(seed * 1_000_003 + k)
        page = _Layout(rng)
        page.parts.append("<!DOCTYPE html><html><head><meta charset='utf-8'>")
        page.leaf("title", page.words(2, 12), False)
        page.parts.append("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        top = [page.menu, page.header, page.advert, page.notice, page.side, page.form] if page.named else [page.menu, page.form, page.menu]
        for part in rng.sample(top, rng.randint(0, min(4, len(top)))):
            part()
        page.main()
        end = [page.comments, page.side, page.advert, page.form, page.notice, page.menu] if page.named else [page.menu, page.form, page.menu]
        for part in rng.sample(end, rng.randint(0, 3)):
            part()
        if rng.random() < 0.85:
            page.foot()
        page.parts.append("</body></html>")
        pages.append("".join(page.parts))
        labels.append(page.labels)
    return pages, labels


@functools.lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller after ROUNDS rounds of Adam over PAGES invented pages."""
    pages, labels = invented(PAGES, SEED)
    parsed = [blocks(p) for p in pages]
    model, rng = Labeller(SEED), np.random.default_rng(SEED)
    m, v = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2))
    step = 0
    for turn in range(ROUNDS):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), STEP):
            part = order[lo : lo + STEP]
            _, grad = model.run(features([parsed[k] for k in part]), np.array([x for k in part for x in labels[k]], np.float32))
            step += 1
            rate = RATE * (0.3 if turn >= ROUNDS - 2 else 1)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                model.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


# --- the operator ---------------------------------------------------------------------------------


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page: the blocks labelled so, in page order, by two line feeds."""
    parsed = [blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * len(parsed[order[hi]]) <= AT_ONCE:
            hi += 1
        p, _ = model.run(features([parsed[k] for k in order[lo:hi]]))
        at = 0
        for k in order[lo:hi]:
            own = p[at : at + len(parsed[k])]
            at += len(parsed[k])
            out[k] = "\n\n".join(b.text for b, x in zip(parsed[k], own, strict=True) if x >= 0.5)
        lo = hi
    return out


def page_texts(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """pages (html, ...) -> with text, the main text of the whole html, in place of html.

    A null or empty page, or one without main text, gives an empty text; unclosed and misplaced tags are
    taken as browsers do, about; rows keep their other columns, and a column text is replaced. Repeated
    rows stay; an empty table gives an empty one.
    """
    model = pages.sparkSession.sparkContext.broadcast(model or trained())
    found = fresh("found", small_batches(pages).columns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = []
            for lo in range(0, len(b), 512):
                texts += extract(b.slice(lo, 512).to_pylist(), model.value)
            yield pa.array(texts, pa.string())

    out = pages.select("*", F.arrow_udf(run, "string")("html").alias(found))
    return out.select(*(c for c in pages.columns if c not in ("html", "text")), F.col(found).alias("text"))


def op5(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page."""
    return page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
