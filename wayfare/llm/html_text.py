"""Main-text extraction from HTML by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags). Each block has a vector: learned embeddings of its
tag path (tags, class and id words of all ancestors), the mean of learned embeddings of its hashed words, and a few
measures. A bidirectional LSTM in numpy reads the blocks of the whole page and labels each as main text or not. The
network is trained here, on pages that a seeded generator makes from many layouts; no page of a table is learned from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import in_small_batches, one_blas_thread

if TYPE_CHECKING:
    import pandas as pd  # elsewhere only where frames are made: workers that read Arrow do without it

PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 2048, 2048, 24, 8, 7, 24
PAGES, EPOCHS, LOT, RATE = 3600, 5, 32, 0.01
#: Blocks of pages read at once by the network.
AT_ONCE = 60_000
#: Word and tag hashes that a worker keeps.
CACHE = 400_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Of these, the one whose raw text is shown.
_SHOWN_RAW = "xmp"
#: Elements whose text is never shown: what is not rendered, the head, and choices of forms.
_HIDDEN = frozenset("template select datalist head".split())
#: Start tags that can stand in a head; any other ends one that is open.
_IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head html".split())
#: What an opening tag ends: elements up to the nearest of them, unless one of the second set stands between.
_SCOPE = frozenset("table td th ul ol dl div article section main aside nav header footer form body blockquote fieldset figure".split())
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@lru_cache(maxsize=CACHE)
def _hash(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % buckets


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[int, ...]:
    """Path features of one element: its tag, and each word of its class, id and role, alone and with the tag."""
    out = [_hash("t:" + tag, PATH_BUCKETS)]
    if attributes:
        for m in _ATTR.finditer(attributes):
            for w in _TOKEN.findall(m[2] or m[3] or m[4] or ""):
                out += [_hash("c:" + w.lower(), PATH_BUCKETS), _hash(f"c:{tag}.{w.lower()}", PATH_BUCKETS)]
    return tuple(out)


#: A tag path: that of the parent (None at the root) and the path features of the last element.
Path = tuple["Path | None", tuple[int, ...]]


def blocks(html: str) -> list[tuple[str, Path, int]]:
    """(text, path, characters inside links) of each leaf block with text, in page order. Paths share their beginnings, so
    that a page takes time and memory in proportion to its length however deep its elements are nested."""
    out: list[tuple[str, Path, int]] = []
    names: list[str] = []
    paths: list[Path] = []
    outer: list[str] = []  # the nearest element that isn't inline, at each depth
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, hidden, at, end = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, (paths[-1] if paths else None, (_hash("p:" + (outer[-1] if outer else ""), PATH_BUCKETS),)), linked))
        linked = 0

    def text_of(raw: str) -> None:
        nonlocal linked
        if not hidden:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if opened.get("a"):
                linked += len(raw)

    def cut(n: int) -> None:
        nonlocal hidden
        while len(names) > n:
            tag = names.pop()
            opened[tag] -= 1
            hidden -= tag in _HIDDEN
            paths.pop()
            outer.pop()

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            text_of(html[at:])
            break
        if m.start() > at:
            text_of(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag not in _INLINE and tag not in ("script", "style"):
                flush()
            if opened.get(tag):
                n = len(names) - 1
                while names[n] != tag:
                    n -= 1
                cut(n)
            elif tag == "p":
                flush()
            continue
        if names and names[-1] == "head" and tag not in _IN_HEAD:
            flush()
            cut(len(names) - 1)
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE and tag not in ("script", "style"):
            flush()
            ends, stops = _ENDS.get(tag, ({"p"}, _SCOPE))
            if tag == "body":
                ends = {"head"}
            for i in range(len(names) - 1, -1, -1):
                if names[i] in ends:
                    cut(i)
                    break
                if names[i] in stops:
                    break
        if tag in _VOID or attributes.endswith("/") and tag in ("path", "circle"):
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            if tag == _SHOWN_RAW and not hidden:
                parts.append(html[at : close.start() if close else end])
                flush()
            if close is None:
                break
            at = html.find(">", close.start()) + 1 or end
            continue
        names.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
        paths.append((paths[-1] if paths else None, _element(tag, attributes)))
        outer.append(tag if tag not in _INLINE else outer[-1] if outer else "")
        hidden += tag in _HIDDEN
    flush()
    return out


def _measures(text: str, linked: int, place: float, words: int) -> tuple[float, ...]:
    n = len(text)
    return (np.log1p(n) / 6, np.log1p(words) / 5, min(1.0, linked / n), float(text[-1] in ".!?:;…"), sum(map(text.count, "0123456789")) / n, place, (text.count("|") + text.count("·") + text.count("©")) / n)


class _Tree:
    """The paths of blocks as one tree; the vector of a path is the sum of its elements' features."""

    def __init__(self):
        self.at: list[int] = []  # node of each block
        self._number: dict[int, int] = {}
        self._kept: list[Path] = []  # keeps the cells alive, so that their ids stay theirs
        self._parent: list[int] = []
        self._depth: list[int] = []
        self._feature: list[int] = []
        self._first: list[int] = []

    def add(self, path: Path) -> None:
        chain = []
        while path is not None and id(path) not in self._number:
            chain.append(path)
            path = path[0]
        for cell in reversed(chain):
            above = self._number[id(cell[0])] if cell[0] is not None else -1
            self._number[id(cell)] = len(self._parent)
            self._kept.append(cell)
            self._depth.append(self._depth[above] + 1 if above >= 0 else 0)
            self._parent.append(above)
            self._first.append(len(self._feature))
            self._feature += cell[1]
        self.at.append(self._number[id(chain[0] if chain else path)])

    def close(self) -> None:
        self.parent, self.feature, self.first = (np.array(x, dtype=np.int64) for x in (self._parent, self._feature, self._first))
        depth = np.array(self._depth, dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]  # nodes that have a parent, by depth
        del self._number, self._kept, self._parent, self._depth, self._feature, self._first

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(weights[self.feature], self.first, axis=0)
        for nodes in self.levels:
            out[nodes] += out[self.parent[nodes]]
        return out[self.at]

    def gradient(self, by_block: np.ndarray, out: np.ndarray) -> np.ndarray:
        """out, to which the slopes of all features are added."""
        by_node = np.zeros((len(self.parent), by_block.shape[1]))
        np.add.at(by_node, self.at, by_block)
        for nodes in reversed(self.levels):
            np.add.at(by_node, self.parent[nodes], by_node[nodes])
        np.add.at(out, self.feature, np.repeat(by_node, np.diff(np.append(self.first, len(self.feature))), axis=0))
        return out


@dataclass
class Network:
    """weights: path and word embeddings, then for each direction input, recurrent and bias of the gates, then the output."""

    weights: dict[str, np.ndarray]

    def inputs(self, pages: list[list[tuple]]) -> tuple[np.ndarray, tuple]:
        """Block vectors of all pages one after another, and what the gradient needs."""
        tree, word, word_at, measured = _Tree(), [], [], []
        for page in pages:
            for i, (text, path, linked) in enumerate(page):
                tree.add(path)
                words = text.lower().split(" ")
                word_at.append(len(word))
                word += [_hash(w, WORD_BUCKETS) for w in words]
                measured.append(_measures(text, linked, i / max(1, len(page) - 1), len(words)))
        word, word_at = (np.array(x, dtype=np.int64) for x in (word, word_at))
        n_words = np.diff(np.append(word_at, len(word)))
        tree.close()
        p = tree.sums(self.weights["path"])
        w = np.add.reduceat(self.weights["word"][word], word_at, axis=0) / n_words[:, None]
        return np.concatenate([p, w, np.array(measured)], axis=1), (tree, word, word_at, n_words)

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Probability of main text for each block; keep: also the states of all steps."""
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        live = [int(np.searchsorted(-lengths[order], -t, side="left")) for t in range(int(lengths.max()))]
        hidden, kept = np.zeros((len(x), 2 * HIDDEN)), []
        for d, name in enumerate(("forward", "backward")):
            gates_in = x @ self.weights[name + ".in"] + self.weights[name + ".bias"]
            h, c = np.zeros((len(lengths), HIDDEN)), np.zeros((len(lengths), HIDDEN))
            steps = []
            for t, n in enumerate(live):
                at = firsts[order[:n]] + (t if d == 0 else lengths[order[:n]] - 1 - t)
                g = gates_in[at] + h[:n] @ self.weights[name + ".back"]
                s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
                i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
                before_h, before_c = h[:n], c[:n]
                c = f * before_c + i * u
                squashed = np.tanh(c)
                h = o * squashed
                hidden[at, d * HIDDEN : (d + 1) * HIDDEN] = h
                if keep:
                    steps.append((at, i, f, o, u, before_h, before_c, squashed))
            kept.append(steps)
        z = hidden @ self.weights["out"] + self.weights["out.bias"]
        return 1 / (1 + np.exp(-z[:, 0])), hidden, kept

    def gradient(self, x, seen, lengths, truth) -> dict[str, np.ndarray]:
        p, hidden, kept = self.run(x, lengths, keep=True)
        dz = ((p - truth) / len(truth))[:, None]
        out = {"out": hidden.T @ dz, "out.bias": dz.sum(axis=0)}
        dh_all, dx = dz @ self.weights["out"].T, np.zeros_like(x)
        for d, name in enumerate(("forward", "backward")):
            back = self.weights[name + ".back"]
            dgates, dback = np.zeros((len(x), 4 * HIDDEN)), np.zeros_like(back)
            dh, dc = np.zeros((0, HIDDEN)), np.zeros((0, HIDDEN))
            for at, i, f, o, u, before_h, before_c, squashed in reversed(kept[d]):
                own_h, own_c = dh_all[at, d * HIDDEN : (d + 1) * HIDDEN].copy(), np.zeros((len(at), HIDDEN))
                own_h[: len(dh)] += dh
                own_c[: len(dc)] += dc
                own_c += own_h * o * (1 - squashed**2)
                dg = np.concatenate([own_c * u * i * (1 - i), own_c * before_c * f * (1 - f), own_h * squashed * o * (1 - o), own_c * i * (1 - u**2)], axis=1)
                dgates[at] = dg
                dback += before_h.T @ dg
                dh, dc = dg @ back.T, own_c * f
            out |= {name + ".in": x.T @ dgates, name + ".bias": dgates.sum(axis=0), name + ".back": dback}
            dx += dgates @ self.weights[name + ".in"].T
        tree, word, word_at, n_words = seen
        out["path"], out["word"] = tree.gradient(dx[:, :PATH_DIM], np.zeros_like(self.weights["path"])), np.zeros_like(self.weights["word"])
        np.add.at(out["word"], word, np.repeat(dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / n_words[:, None], n_words, axis=0))
        return out

    def labels(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """Probability of main text of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        full = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        lot: list[int] = []
        size = 0
        for i in [*full, None]:
            if lot and (i is None or size + len(pages[i]) > AT_ONCE):
                lengths = np.array([len(pages[k]) for k in lot])
                p, _, _ = self.run(self.inputs([pages[k] for k in lot])[0], lengths)
                for k, part in zip(lot, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
                    out[k] = part
                lot, size = [], 0
            if i is not None:
                lot.append(i)
                size += len(pages[i])
        return out

    def extract(self, pages: list[str]) -> list[str]:
        cut = [blocks(p) for p in pages]
        return [" ".join(b[0] for b, p in zip(page, probability, strict=True) if p >= 0.5) for page, probability in zip(cut, self.labels(cut), strict=True)]


# Training pages. Every generated text begins with one of two private-use characters, which give its label and are taken out.
_MAIN, _REST = "", ""
#: Words of page furniture, in some languages.
_FURNITURE = "Home About Contact Login Register Search Menu Subscribe Newsletter Privacy Policy Terms Cookies Accept Share Tweet Print Related Popular Recent Tags Archive Next Previous Copyright Rights Reserved Advertisement Sponsored Comments Reply Leave Email Password Submit Sitemap Help Accueil Connexion Rechercher Abonnez Mentions Startseite Anmelden Suche Impressum Datenschutz Inicio Buscar Contacto Suscribirse Aviso".split()
_LAYOUT = {
    "nav": ["nav", "nav class=menu", "div class=menu", "div id=navbar", "ul class=nav", "div class=topnav", "div class='main-menu'", "div class=navigation", "nav role=navigation", "div class=breadcrumbs", "ol class=breadcrumb", "div class=pagination", "div class=toc", "div id=menu", "ul class=links", "td class=menu", "td class=nav"],
    "header": ["header", "div class=header", "div id=header", "header class='site-header'", "div class=masthead", "div class=topbar", "div role=banner", "div class=branding"],
    "footer": ["footer", "div class=footer", "div id=footer", "footer class='site-footer'", "div id=colophon", "div role=contentinfo", "div class='footer-links'", "div class=copyright", "div class=legal"],
    "side": ["aside", "div class=sidebar", "div id=sidebar", "aside class=widget", "div class=widget", "div id=secondary", "div class='right-column'", "div role=complementary", "section class=widgets", "div class=rail", "td class=sidebar", "td class=left"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "ins class=adsbygoogle", "div class=advertisement", "aside class=sponsored", "div class=promo", "div id='banner-ad'", "section class=promotion", "div class='ad-slot'", "p class=ad", "div class=sponsor"],
    "notice": ["div class=notice", "div class='cookie-notice'", "div id=cookies", "div class=consent", "div role=alert", "div class=banner", "div class=alert", "section class=gdpr", "div class=popup", "div class=modal", "p class=notice", "div class=disclaimer", "div class=message", "div role=dialog"],
    "form": ["form", "form class=search", "form id=login", "form class=newsletter", "div class='subscribe-form'", "form action=/x", "fieldset", "form class='comment-form'", "div class=signup"],
    "share": ["div class=share", "ul class=social", "div class='social-links'", "div class=sharing", "div class=follow"],
    "related": ["div class=related", "section class=related", "div class=recommended", "aside class=related", "ul class=popular", "div class='more-stories'", "section class=trending", "div class=teasers"],
    "comments": ["section class=comments", "div id=comments", "div class='comment-list'", "ol class=commentlist", "div class=discussion", "section id=comments", "div class=replies", "div class='user-comments'", "ul class=comments", "div class=reviews", "div id=disqus"],
    "main": ["article", "main", "div class=content", "div id=content", "div class=post", "div class='entry-content'", "section class=article", "div class='article-body'", "div id=main", "div class=story", "article class=post", "div class=text", "div itemprop=articleBody", "section", "td", "div role=main", "div class=page", "article id=post", "div class=body", "div class=prose"],
    "wrap": ["div", "div class=container", "div class=wrapper", "div id=page", "div class=row", "section", "div class=col", "div class=inner", "div id=wrap"],
}


class _Maker:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        letters = ["aeiou", "bcdfghjklmnprstvwz", "éèüöñçäßóí", "авекинорст"]
        self.sounds = ["".join(rng.choice(list(letters[int(k)]), 1)[0] for k in rng.choice([0, 1, 1, 0, 2] if rng.random() < 0.9 else [3], int(rng.integers(1, 4)))) for _ in range(40)]
        self.ending = str(rng.choice(["", "", "", "", " |", "!!", "%%%"]))

    def one(self, of) -> str:
        return str(of[int(self.rng.integers(len(of)))])

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, low: int, high: int) -> str:
        n, out = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1)))), []
        while len(out) < n:
            s = ["".join(self.one(self.sounds) for _ in range(int(self.rng.integers(1, 4)))) + self.ending for _ in range(min(n - len(out), int(self.rng.integers(2, 14))))]
            s[0] = s[0].capitalize()
            out += [*s[:-1], s[-1] + "."]
        return " ".join(out)

    def bit(self) -> str:
        """A few words as they stand in running text."""
        words = self.prose(6, 12).split(" ")
        at = int(self.rng.integers(len(words)))
        return " ".join(words[at : at + int(self.rng.integers(1, 4))])

    def words(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high + 1))
        return " ".join(self.one(_FURNITURE) if self.chance(0.4) else "".join(self.one(self.sounds) for _ in range(2)) for _ in range(n))

    def put(self, tag: str, inner: str) -> str:
        name = tag.split(" ")[0]
        return f"<{tag}>{inner}</{name}>" + ("\n" if self.chance(0.3) else "")

    def rest(self, kind: str) -> str:
        tag, r = self.one(_LAYOUT[kind]), self.rng
        link = lambda: f"<a href=/x>{_REST}{self.words(1, 4) if self.chance(0.5) else self.bit()}</a>"
        line = lambda: _REST + (self.prose(2, 40) if self.chance(0.6) else self.words(1, 9))
        if kind in ("nav", "share", "related") or kind in ("side", "header", "footer") and self.chance(0.45):
            n = int(r.integers(2, 9))
            shape = self.one(["list", "list", "row", "teaser"])
            if shape == "list":
                inner = self.put("ul", "".join(f"<li>{link()}</li>" for _ in range(n))) if not tag.startswith(("ul", "ol")) else "".join(f"<li>{link()}</li>" for _ in range(n))
            elif shape == "row":
                inner = " ".join(link() for _ in range(n))
            else:
                inner = "".join(self.put("div", self.put(self.one(["h3", "h4"]), link()) + (self.put("p", line()) if self.chance(0.6) else "")) for _ in range(int(r.integers(1, 5))))
            if self.chance(0.4):
                inner = self.put(self.one(["h2", "h3", "h4", "p", "strong"]), _REST + self.words(1, 3)) + inner
        elif kind == "form":
            inner = "".join(self.one([f"<label>{_REST}{self.words(1, 3)}</label><input name=x>", f"<p>{line()}</p>", f"<button>{_REST}{self.words(1, 2)}</button>", f"<div>{line()}</div>", f"<select><option>{self.words(1, 1)}</option></select>"]) for _ in range(int(r.integers(1, 5)))) + f"<button>{_REST}{self.words(1, 2)}</button>"
        elif kind == "comments":
            item = "li class=comment" if tag.startswith(("ol", "ul")) else self.one(["div class=comment", "article class=comment", "div class=reply", "div"])
            inner = self.put(self.one(["h2", "h3"]), _REST + self.words(1, 3)) * self.chance(0.6) + "".join(self.put(item, (self.put(self.one(["b", "cite", "div class=author", "span"]), _REST + self.words(1, 2)) if self.chance(0.6) else "") + self.put("p", _REST + self.prose(3, 60))) for _ in range(int(r.integers(1, 6)))) + (self.rest("form") if self.chance(0.3) else "")
        elif kind in ("ad", "notice", "footer", "header", "side"):
            inner = line() if self.chance(0.5) else "".join(self.put(self.one(["p", "p", "div", "h3", "span"]), line()) for _ in range(int(r.integers(1, 4)))) + (self.put("button", _REST + self.words(1, 2)) if kind == "notice" and self.chance(0.5) else "")
            if kind == "header" and self.chance(0.5):
                inner = self.put(self.one(["h1", "h2", "p", "div class=logo"]), _REST + self.words(1, 4)) + inner
            if kind == "footer" and self.chance(0.5):
                inner = f"{_REST}&copy; {self.words(1, 4)} " + inner
        return self.put(tag, inner)

    def body_of_article(self) -> str:
        text = lambda a, b: _MAIN + self.prose(a, b)
        title = self.put(self.one(["h1", "h1", "h2"]), text(1, 12))
        out = [self.put("header", title) if self.chance(0.15) else title] * self.chance(0.85)
        for _ in range(int(np.exp(self.rng.uniform(0, np.log(30))))):
            x = self.rng.random()
            if x < 0.46:
                out.append(f"<p>{text(1, 150)}</p>")
            elif x < 0.58:
                out.append(f"<p>{text(1, 5)}</p>")
            elif x < 0.62:
                out.append(f"<p>{text(1, 60)} <a href=/x>{self.bit()}</a> {self.prose(1, 20)}</p>")
            elif x < 0.70:
                out.append(f"<p><b>{text(1, 60)}<br>")
            elif x < 0.76:
                out.append(self.put(self.one(["h2", "h3", "h4"]), text(1, 9)))
            elif x < 0.82:
                out.append(self.put(self.one(["ul", "ol"]), "".join(f"<li>{text(1, 25)}</li>" for _ in range(int(self.rng.integers(1, 7))))))
            elif x < 0.86:
                out.append(self.put("blockquote", f"<p>{text(3, 60)}</p>"))
            elif x < 0.88:
                out.append(self.put("table", "".join("<tr>" + "".join(self.put(self.one(["td", "td", "th"]), text(1, 3)) for _ in range(3)) + "</tr>" for _ in range(int(self.rng.integers(1, 4))))))
            elif x < 0.90:
                out.append(self.put("figure", "<img src=x>" + self.put("figcaption", text(2, 20))))
            elif x < 0.92:
                out.append(self.put(self.one(["pre", "div", "dl", "section"]), text(2, 60)))
            else:
                out.append(self.rest(self.one(["ad", "ad", "share", "related", "notice", "form", "side", "nav"])))
        if self.chance(0.3):
            out.append(f"<p>{text(1, 6)}</p>")
        return "".join(out)

    def page(self) -> str:
        before = [self.rest(k) for k in ("notice", "header", "nav", "nav", "ad", "form", "side", "notice") if self.chance(0.45)]
        after = [self.rest(k) for k in ("share", "related", "comments", "side", "ad", "form", "nav", "footer", "footer", "notice") if self.chance(0.45)]
        if self.chance(0.08):
            before, after = [], []
        if self.chance(0.5):
            self.rng.shuffle(before)
        main = self.put(self.one(_LAYOUT["main"]), self.body_of_article()) if self.chance(0.92) else self.body_of_article()
        if self.chance(0.3):
            main = self.put(self.one(_LAYOUT["main"]), main + (after.pop(0) if after and self.chance(0.6) else ""))
        inner = [*before, main, *after]
        if self.chance(0.5):
            i = int(self.rng.integers(len(inner) + 1))
            inner = [*inner[:i], self.put(self.one(_LAYOUT["wrap"]), "".join(inner[i:]))]
        body = "".join(inner) if self.chance(0.6) else self.put(self.one(_LAYOUT["wrap"]), "".join(inner))
        return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}</body></html>"


def _labelled(rng: np.random.Generator) -> tuple[list[tuple], np.ndarray]:
    page, truth = [], []
    for text, path, linked in blocks(_Maker(rng).page()):
        clean = " ".join(text.replace(_MAIN, "").replace(_REST, "").split())
        if clean:
            page.append((clean, path, min(linked, len(clean))))
            truth.append(float(_MAIN in text))
    return page, np.array(truth)


def generated(n: int, seed: int) -> list[tuple[list[tuple], np.ndarray]]:
    rng = np.random.default_rng(seed)
    made = (_labelled(rng) for _ in range(n))
    return [m for m in made if m[0]]


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = 11) -> Network:
    """The labeller, trained by Adam on generated pages; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    size = PATH_DIM + WORD_DIM + MEASURES
    weights = {"path": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.05, (WORD_BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "out.bias": np.zeros(1)}
    for name in ("forward", "backward"):
        weights |= {name + ".in": rng.normal(0, 0.2, (size, 4 * HIDDEN)), name + ".back": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), name + ".bias": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
    net, data = Network(weights), generated(pages, seed)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    with one_blas_thread():
        for epoch in range(EPOCHS):
            lots = np.array_split(rng.permutation(len(data)), max(1, len(data) // LOT))
            for done, lot in zip(np.linspace(0, 1, len(lots)), lots, strict=True):
                own = [data[i] for i in lot]
                x, seen = net.inputs([p for p, _ in own])
                grad = net.gradient(x, seen, np.array([len(p) for p, _ in own]), np.concatenate([y for _, y in own]))
                step += 1
                rate = RATE * max(0.03, 1 - (epoch + done) / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g**2 - second[k])
                    weights[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return net


def extract(pages: DataFrame, network: Network | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks labelled as main, in page order, joined by one space), n_chars.

    Null or empty html, and pages without a main block, give an empty text. Repeated rows are read one by one; an empty
    table gives no rows; other columns are ignored. One pass over whole pages, no shuffle.
    """
    net = network or trained()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": net.extract(list(part["html"]))})

    chosen = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return in_small_batches(chosen).mapInPandas(read, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
