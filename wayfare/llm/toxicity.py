"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is the index. Terms are all words of at least two of its texts and their beginnings of
a few lengths; nothing else is cut. A vector holds sqrt(tf) x idf x relevance: relevance is the square root of the term's
log-likelihood ratio G2 between toxic and other texts, shrunk smoothly (never to nothing) where few texts speak for it.
Examples stand in an inverted index whose posting lists are cut into blocks of similar examples, with the largest weight
of each list in each block; these give every example an upper bound, and only examples whose bound reaches the k-th best
are looked at, so neighbours are those of the full product. Neighbours vote with weights that fall with distance; votes are
calibrated by isotonic regression on cross-fitted votes: each half of the examples is scored by an index of the other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import Trained, held_out, in_small_batches, one_blas_thread, release, sampled_rows, trained

#: Labelled rows (by hash of doc_id) that the model is fitted on, and bytes of their texts: the documented bounds.
SAMPLE, SAMPLE_BYTES = 6000, 32 << 20
#: Jaccard similarity, over runs of four words, at which two examples of one label count as copies.
SAME = 0.8
#: Neighbours, and examples in a block of a posting list.
NEIGHBOURS, BLOCK = 9, 8
#: Lengths of word beginnings that are terms, and least texts of the sample that have a term.
PREFIXES, LEAST_TEXTS = (3, 5, 7), 2
#: A term's G2 counts as G2^2 / (G2 + SHRINK).
SHRINK = 20.0
THRESHOLD = 0.3
#: Stops the weight of an equal vector from being infinite.
NEAR = 0.02
#: Texts from which a list has block maxima; those of a DENSE-th of the examples stand as rows. Texts scored at once.
LONG_LIST, DENSE, LOT = 256, 24, 128
#: Entries whose dense weights are multiplied at once.
COLUMNS = 1024
#: By how much sums of single precision may be wrong.
SLACK = 1e-5
#: Words whose terms a worker keeps; all are dropped when there are more.
CACHE = 300_000

_WORD = re.compile(r"[^\W\d_]+")
#: For texts of Latin-1, which are split as bytes, several times faster: its letters stay and all else becomes a space.
_LETTERS = bytes(i if _WORD.fullmatch(chr(i)) else 32 for i in range(256))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters of the whole text."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def term_counts(words: list[str]) -> Counter:
    """Occurrences of each word, and of each beginning ("^" and its letters) of longer words."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[w] += n
        for p in PREFIXES:
            if len(w) > p:
                out["^" + w[:p]] += n
    return out


def distinct(rows: Iterable[tuple[int, list[str], int]]) -> Iterator[tuple[int, list[str], int]]:
    """Rows (key, words, label) without near copies: a row goes only if an earlier one that stayed has the same label and at
    least SAME of the runs of four words that either has. Rows to compare share one of 8 pairs of least hashes; rows that share
    one and are less alike, or have another label, all stay."""
    seen: dict[tuple[int, int, int], list[int]] = {}
    stayed: list[tuple[np.ndarray, int]] = []
    rng = np.random.default_rng(16)
    factor, shift = rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, 16, dtype=np.uint64)
    for row in rows:
        w, label = row[1], row[2]
        prints = np.unique(np.array([zlib.crc32(" ".join(w[i : i + 4]).encode()) for i in range(max(1, len(w) - 3))], dtype=np.uint64))
        least = [int(((prints * f + s) >> np.uint64(20)).min()) for f, s in zip(factor, shift, strict=True)]
        keys = [(b, least[2 * b], least[2 * b + 1]) for b in range(8)]
        alike = False
        for i in {i for k in keys for i in seen.get(k, ()) if stayed[i][1] == label}:
            other = stayed[i][0]
            common = len(np.intersect1d(prints.astype(np.uint32), other, assume_unique=True))
            alike = alike or common >= SAME * (len(prints) + len(other) - common)
        if not alike:
            for k in keys:
                seen.setdefault(k, []).append(len(stayed))
            stayed.append((prints.astype(np.uint32), label))
            yield row


def relevance(a: np.ndarray, b: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Square root of the shrunk G2 of terms that a toxic and b other texts have; 1 for all if one class has no text."""
    n = n_toxic + n_clean
    if not n_toxic or not n_clean:
        return np.ones(len(a))
    g = np.zeros(len(a))
    for seen, size in ((a, n_toxic), (b, n_clean)):
        for observed, share in ((seen, (a + b) / n), (size - seen, 1 - (a + b) / n)):
            expected = size * share
            g += np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    g = np.maximum(2 * g, 1e-3)
    return np.sqrt(g * g / (g + SHRINK))


class _Numbers(dict):
    """Numbers keys as they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


@dataclass
class Index:
    """Examples by entry (similar ones stand together, BLOCK make a block) and three kinds of inverted lists of their terms:
    those of a DENSE-th of the examples are rows of weights, those of LONG_LIST give the largest weight in each block, and
    shorter ones are postings. forward_* hold the examples' vectors for the exact products."""

    terms: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # idf x relevance of each term
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kind: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int8))  # of each term's list: 0 short, 1 long, 2 dense
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # of each long or dense list
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))  # by row and entry
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))  # by row and block
    post_at: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # first posting of each short list
    post_entry: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    post_weight: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    forward_at: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # first term of each entry
    forward_term: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    forward_weight: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    long_at: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # first long list that has each entry
    long_row: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    long_weight: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    prior: float = 0.0
    read: int = 0  # entries whose exact product was taken, and all entries of the queries: for tests
    offered: int = 0
    _starts: dict[str, int] = field(default_factory=dict, repr=False)  # terms that are word beginnings, without "^"
    _words: _Numbers = field(default_factory=_Numbers, repr=False)
    _word_at: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64), repr=False)
    _word_term: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32), repr=False)
    _scratch: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        """What is sent to workers; they make the lists from the forward vectors."""
        return {k: getattr(self, k) for k in ("terms", "weight", "ids", "toxic", "forward_at", "forward_term", "forward_weight", "curve", "prior")}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)
        self.arrange()

    def arrange(self) -> None:
        """Makes the lists of all kinds from the forward vectors."""
        n, n_terms = len(self.ids), len(self.weight)
        self._starts = {t[1:]: i for t, i in self.terms.items() if t[0] == "^"}
        term, weight = self.forward_term, self.forward_weight  # millions of values: copies of all are few and short-lived
        entry = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.forward_at))
        size = np.bincount(term, minlength=n_terms)
        self.kind = np.where(size >= np.maximum(LONG_LIST, n / DENSE), 2, np.where(size >= LONG_LIST, 1, 0)).astype(np.int8)
        self.row = np.zeros(n_terms, dtype=np.int32)
        for kind in (1, 2):
            self.row[self.kind == kind] = np.arange((self.kind == kind).sum())
        self.dense = np.zeros(((self.kind == 2).sum(), n), dtype=np.float32)
        self.block_max = np.zeros(((self.kind == 1).sum(), -(-n // BLOCK)), dtype=np.float32)
        of = self.kind[term]
        self.dense[self.row[term[of == 2]], entry[of == 2]] = weight[of == 2]
        long = of == 1
        np.maximum.at(self.block_max, (self.row[term[long]], entry[long] // BLOCK), weight[long])
        self.long_row, self.long_weight, self.long_at = self.row[term[long]], weight[long], np.searchsorted(entry[long], np.arange(n + 1))
        short = np.flatnonzero(of == 0)
        short = short[np.argsort(term[short], kind="stable")]
        self.post_entry, self.post_weight, self.post_at = entry[short], weight[short], np.searchsorted(term[short], np.arange(n_terms + 1))

    def _numbered(self, words: Collection[str]) -> np.ndarray:
        """A number of each word; _word_at and _word_term list the known terms of a number."""
        known = self._words
        if len(known) > CACHE:
            known.clear()
        n = len(known)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        if known.new:
            flat, ends, get, start = [], [], self.terms.get, self._starts.get
            for w in known.new:
                # A text with a word or beginning has all shorter beginnings of it: where one is unknown, so is all that is longer.
                size = len(w)
                for p in PREFIXES:
                    if size <= p:
                        found = get(w)
                        break
                    found = start(w[:p])
                    if found is None:
                        break
                    flat.append(found)
                else:
                    found = get(w)
                if found is not None:
                    flat.append(found)
                ends.append(len(flat))
            used = int(self._word_at[n])
            self._word_at, self._word_term = _room(self._word_at, len(known) + 1), _room(self._word_term, used + len(flat))
            self._word_at[n + 1 : len(known) + 1] = np.array(ends, dtype=np.int64) + used
            self._word_term[used : used + len(flat)] = flat
            known.new.clear()
        return out

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms in ascending order and their weights, of unit length."""
        counts = Counter(words)
        word = self._numbered(counts)
        posts, size = _runs(self._word_at[word], self._word_at[word + 1])
        at, back = np.unique(self._word_term[posts], return_inverse=True)
        times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        return self.weighed(at, np.bincount(back, weights=np.repeat(times, size), minlength=len(at)))

    def weighed(self, at: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.sqrt(times) * self.weight[at]
        return at, w / np.sqrt((w**2).sum()) if len(w) else w

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k entries of the largest cosine, best first, ties to the smaller doc_id, and their cosines.

        Every entry has a bound: what its dense and short lists give and, for long ones, the block's largest weights. The
        best 2k bounds set a threshold; entries whose bound reaches it get their long lists' weights instead, and those that
        still reach it the exact product. All but this are of single precision, SLACK wide.
        """
        n, n_blocks = len(self.ids), self.block_max.shape[1]
        if not n:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in vectors]
        common, long = np.zeros((len(vectors), len(self.dense)), dtype=np.float32), np.zeros((len(vectors), len(self.block_max)), dtype=np.float32)
        for i, (at, w) in enumerate(vectors):
            kind = self.kind[at]
            common[i, self.row[at[kind == 2]]] = w[kind == 2]
            long[i, self.row[at[kind == 1]]] = w[kind == 1]
        some = np.flatnonzero(common.any(axis=0))
        few, known, in_block = common[:, some], np.empty((len(vectors), n), dtype=np.float32), long @ self.block_max
        for i in range(0, n, COLUMNS):
            known[:, i : i + COLUMNS] = few @ self.dense[some, i : i + COLUMNS]
        out = []
        for (at, w), sums, mine, most in zip(vectors, known, long, in_block, strict=True):
            if not len(at):
                out.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
                continue
            short = np.flatnonzero(self.kind[at] == 0)
            posts, size = _runs(self.post_at[at[short]], self.post_at[at[short] + 1])
            sums = sums + np.bincount(self.post_entry[posts], weights=np.repeat(w[short], size) * self.post_weight[posts], minlength=n)
            bound = sums + np.repeat(most, BLOCK)[:n]
            entries = np.argpartition(-bound, min(2 * k, n - 1))[: 2 * k]
            near = sums[entries] + self._in_long(mine, entries)
            if n > len(entries):
                floor = np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else -1.0
                bound[entries] = -2.0
                rest = np.flatnonzero(bound >= floor - SLACK)
                entries, near = np.append(entries, rest), np.append(near, sums[rest] + self._in_long(mine, rest))
            self.read += len(entries)
            self.offered += n
            if len(entries) > k:
                entries = entries[near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * SLACK]
            cosines = self._products(at, w, entries)
            best = np.lexsort((self.ids[entries], -cosines))[:k]
            out.append((entries[best], cosines[best]))
        return out

    def _in_long(self, mine: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """What the long lists give to entries."""
        if not len(self.long_row):
            return np.zeros(len(entries))
        posts, size = _runs(self.long_at[entries], self.long_at[entries + 1])
        return np.bincount(np.repeat(np.arange(len(entries)), size), weights=mine[self.long_row[posts]] * self.long_weight[posts], minlength=len(entries))

    def _products(self, at: np.ndarray, w: np.ndarray, entries: np.ndarray) -> np.ndarray:
        if self._scratch is None:
            self._scratch = np.zeros(len(self.weight), dtype=np.float32)
        self._scratch[at] = w
        starts, ends = self.forward_at[entries].tolist(), self.forward_at[entries + 1].tolist()
        out = [(self._scratch.take(self.forward_term[i:j]) * self.forward_weight[i:j]).sum(dtype=np.float64) for i, j in zip(starts, ends, strict=True)]
        self._scratch[at] = 0.0
        return np.round(np.array(out), 12)

    def vote(self, entries: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1.0 / (1.0 - np.minimum(cosines, 1.0) + NEAR)
        return float((weight * self.toxic[entries]).sum() / weight.sum())

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[str]]]:
        """Of each text the calibrated score, doc_id of the three nearest examples, and the five heaviest terms."""
        if not hasattr(self, "_names"):
            self._names = list(self.terms)
        lots = list(dict.fromkeys(texts))
        if len(lots) < len(texts):
            of = dict(zip(lots, self.scores(lots), strict=True))
            return [of[t] for t in texts]
        out: list[tuple[float, list[int], list[str]]] = []
        for i in range(0, len(texts), 8 * LOT):
            vectors = [self.vector(words_of(t)) for t in texts[i : i + 8 * LOT]]
            found: list = [None] * len(vectors)
            # Texts of one language stand in one lot, which then has fewer of the common terms.
            alike = sorted(range(len(vectors)), key=lambda j: int(vectors[j][0][np.argmax(vectors[j][1] * (self.kind[vectors[j][0]] == 2))]) if len(vectors[j][0]) else -1)
            for j in range(0, len(alike), LOT):
                for k, near in zip(alike[j : j + LOT], self.nearest([vectors[k] for k in alike[j : j + LOT]]), strict=True):
                    found[k] = near
            votes = np.array([self.vote(*near) if len(near[0]) else 0.0 for near in found])
            values = np.clip(np.interp(votes, *self.curve), 0.0, 1.0).tolist()
            for (at, w), (entries, _), value in zip(vectors, found, values, strict=True):
                if len(entries):
                    heavy = np.argpartition(-w, min(5, len(w) - 1))[:5]
                    out.append((value, self.ids[entries[:3]].tolist(), [self._names[t] for t in at[heavy[np.argsort(-w[heavy], kind="stable")]].tolist()]))
                else:
                    out.append((self.prior, [], []))
        return out


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """held, or a copy at least twice as long if it has no room for size values."""
    return held if len(held) >= size else np.append(held, np.zeros(max(size, 2 * len(held), 1024) - len(held), dtype=held.dtype))


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to its end, one run after another, and the runs' lengths."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit, as points to interpolate between; each pool is shrunk by one observation of the mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, sum of x
    for i in order:
        pools.append([float(y[i]), 1.0, float(x[i])])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, w, s = pools.pop()
            p = pools[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2] + s
    mean = float(y.mean()) if len(y) else 0.0
    return np.array([s / w for _, w, s in pools]), np.array([(m * w + mean) / (w + 1) for m, w, _ in pools])


def _near_each_other(lists: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """An order of examples in which similar ones stand together: halved again and again along the direction of most spread of
    a random projection of their vectors."""
    rng = np.random.default_rng(1)
    axes = rng.standard_normal((n_terms, 24)).astype(np.float32)
    points = np.stack([w.astype(np.float32) @ axes[at] if len(at) else np.zeros(24, dtype=np.float32) for at, w in lists])
    out: list[np.ndarray] = []

    def halve(at: np.ndarray) -> None:
        if len(at) <= BLOCK:
            out.append(at)
            return
        centred = points[at] - points[at].mean(axis=0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = at[np.argsort(along, kind="stable")]
        half = -(-(len(at) // 2) // BLOCK) * BLOCK
        halve(order[:half])
        halve(order[half:])

    with one_blas_thread():
        halve(np.arange(len(lists)))
    return np.concatenate(out)


def _indexed(rows: list[tuple[int, np.ndarray, np.ndarray, int]], names: list[str]) -> Index:
    """The index of rows (doc_id, terms by number, times, 0 or 1); names: of all numbers."""
    n, y = len(rows), np.array([r[3] for r in rows], dtype=np.float64)
    if not n:
        return Index()
    df, a = (np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *[r[1] for r in rows if r[3] or all_rows]]), minlength=len(names)).astype(np.float64) for all_rows in (True, False))
    kept = np.flatnonzero(df >= min(LEAST_TEXTS, n))
    number = np.full(len(names), -1, dtype=np.int64)
    number[kept] = np.arange(len(kept))
    index = Index({names[t]: i for i, t in enumerate(kept.tolist())}, prior=float(y.mean()))
    df, a = df[kept], a[kept]
    index.weight = (np.log(n / np.maximum(df, 1)) + 0.01) * relevance(a, df - a, int(y.sum()), int(n - y.sum()))
    lists = []
    for _, terms, times, _ in rows:
        at = number[terms]
        there = np.flatnonzero(at >= 0)
        there = there[np.argsort(at[there])]
        lists.append(index.weighed(at[there], times[there]))
    order = _near_each_other(lists, len(kept))
    index.ids, index.toxic = np.array([rows[i][0] for i in order], dtype=np.int64), y[order]
    sizes = np.array([len(lists[i][0]) for i in order])
    term, weight = (np.concatenate([lists[i][c] for i in order]) for c in (0, 1))
    del lists
    index.forward_at, index.forward_term, index.forward_weight = np.append(0, np.cumsum(sizes)), term.astype(np.int32), weight.astype(np.float32)
    del term, weight
    index.arrange()
    return index


def build(rows: list[tuple[int, str, int]]) -> Index:
    """An index of labelled texts (doc_id, text, 0 or 1), without near copies of the same label; without rows, one that scores 0."""
    chosen = [(k, np.fromiter(map(hash, term_counts(words)), dtype=np.int64)) for k, words, _ in distinct((k, words_of(t or ""), y) for k, (_, t, y) in enumerate(rows))]
    value, times = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[h for _, h in chosen]]), return_counts=True)
    often = set(value[times >= min(LEAST_TEXTS, len(chosen))].tolist())  # terms of one text alone are never numbered
    chosen = [k for k, _ in chosen]
    numbers: dict[str, int] = {}
    read = []
    for k in chosen:
        doc_id, text, y = rows[k]
        counts = {t: n for t, n in term_counts(words_of(text or "")).items() if hash(t) in often}
        terms = np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), dtype=np.int32, count=len(counts))
        read.append((doc_id, terms, np.fromiter(counts.values(), dtype=np.int32, count=len(counts)), int(y)))
    names = list(numbers)
    del numbers, often
    side = np.array([zlib.crc32(f"half {r[0]}".encode()) & 1 for r in read], dtype=np.int64)
    votes, truth = [], []
    for s in (0, 1):
        other = _indexed([r for r, h in zip(read, side, strict=True) if h != s], names)
        number = np.array([other.terms.get(t, -1) for t in names], dtype=np.int64)
        mine = [r for r, h in zip(read, side, strict=True) if h == s]
        for i in range(0, len(mine), LOT):
            vectors = []
            for _, terms, times, _ in mine[i : i + LOT]:
                at = number[terms]
                there = np.flatnonzero(at >= 0)
                there = there[np.argsort(at[there])]
                vectors.append(other.weighed(at[there], times[there]))
            for (*_, y), found in zip(mine[i : i + LOT], other.nearest(vectors), strict=True):
                if len(found[0]):
                    votes.append(other.vote(*found))
                    truth.append(float(y))
        del other, number
    index = _indexed(read, names)
    if votes:
        index.curve = isotonic(np.array(votes), np.array(truth))
    return index


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Index | Trained:
    """An index, built in one task, of at most sample labelled rows of at most sample_bytes together, by hash of doc_id, none of them held out.

    An id with several labels counts as toxic if one says so; of an id with several texts the least is read.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return trained(sampled_rows(docs.select("doc_id", "text"), known, sample, sample_bytes), lambda rows: build([(i, t, min(1, max(0, y))) for i, t, y in rows]))


def keep_clean(docs: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold; a null text counts as empty."""
    shared = _shared(docs, index)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        release()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            good = [s[0] < threshold for s in index.scores([t or "" for t in texts.to_pylist()])]
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return in_small_batches(docs).mapInArrow(clean, docs.schema)


def _shared(docs: DataFrame, index: Index) -> Broadcast:
    """The index, sent once to each worker; its size is bound by SAMPLE and SAMPLE_BYTES."""
    return docs.sparkSession.sparkContext.broadcast(index)


def score(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, neighbours, terms. One pass over whole texts, no shuffle.

    A text without known terms (null, empty) gets the share of toxic examples as its score and no neighbours. Without
    labelled rows every score is 0. Repeated rows are scored one by one; an empty table gives no rows; other columns,
    whatever their names, are no input.
    """
    shared = _shared(docs, index)

    kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        release()
        for batch in batches:
            got = list(zip(*index.scores(batch.column("text").to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *[pa.array(c, t) for c, t in zip(got, kinds, strict=True)]], ["doc_id", "held_out", "score", "neighbours", "terms"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = in_small_batches(read).mapInArrow(scored, "doc_id long, held_out boolean, score double, neighbours array<long>, terms array<string>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "terms")
