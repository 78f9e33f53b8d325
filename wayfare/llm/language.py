"""Language identification by a linear-chain conditional random field over words.

Each word's emission is a sum of weights of its affixes, character n-grams and lexicon entries; learned transitions join
neighbouring words, so that switches of language inside a text are found by forward-backward. The model is trained on
code-switched sequences spliced from a bounded sample of labelled documents. Long texts are chains like any other: the
recursion runs over fixed-size chunks of all texts of a batch at once, first as products of transfer matrices, then
between chunks, then inside them, which gives the marginals of the undivided chain.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import SLICE, Trained, held_out, in_small_batches, one_blas_thread, release, sampled_rows, trained

if TYPE_CHECKING:
    import pandas as pd  # elsewhere only where frames are made: workers that read Arrow do without it

#: Labelled documents (by hash of doc_id) that the model is fitted on, bytes of their texts, and spliced sequences made of them:
#: the documented bounds.
SAMPLE, SAMPLE_BYTES, SEQUENCES = 2000, 16 << 20, 4000
BUCKETS = 1 << 16
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.25, 1e-5
#: Words that stand at least so often in the sample have entries of their own.
LEXICON_COUNT, LEXICON_SIZE = 4, 20_000
CHUNK = 32
#: Emissions that a worker keeps; all are dropped when there are more.
CACHE = 150_000
#: Words of whole texts that are worked on at once.
AT_ONCE = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters of the whole text, lower-cased; runs of numbers like fractions, which hold no letter, are none."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str, lexicon: dict[str, str]) -> list[str]:
    w = f"^{word}$"
    n = len(w)
    out = ["<" + word[:k] for k in range(1, min(4, len(word)) + 1)] + [">" + word[-k:] for k in range(1, min(4, len(word)) + 1)]
    out += [w[i : i + 2] for i in range(n - 1)] + [w[i : i + 3] for i in range(n - 2)]
    if word in lexicon:
        out += ["=" + word, "~" + lexicon[word]]
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains that stand one after another in emit (positive scores, words x labels), and each chain's first row.

    step: positive transition scores. Chains are cut into chunks of CHUNK words for the recursion only.
    """
    n_labels = emit.shape[1]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    per = -(-lengths // CHUNK)
    chain = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(CHUNK, lengths[chain] - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    at, size, head = (firsts[chain] + nth * CHUNK)[order], size[order], (nth == 0)[order]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    active = [int(np.searchsorted(-size, -j, side="left")) for j in range(CHUNK + 1)]  # chunks of over j words

    def norm(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)

    # Transfer matrix of each chunk: from the label before it to its last label.
    through = np.where(head[:, None, None], np.eye(n_labels)[None], step[None]) * emit[at][:, None, :]
    through = norm(through)
    for j in range(1, CHUNK):
        n = active[j]
        if not n:
            break
        through[:n] = norm((through[:n].reshape(-1, n_labels) @ step).reshape(n, n_labels, n_labels) * emit[at[:n] + j][:, None, :])
    before, after = np.full((len(order), n_labels), 1.0 / n_labels), np.full((len(order), n_labels), 1.0 / n_labels)
    start = np.cumsum(per) - per
    for c in range(1, int(per.max(initial=0))):
        live = np.flatnonzero(per > c)
        last, here = place[start[live] + c - 1], place[start[live] + c]
        before[here] = norm(np.einsum("ni,nij->nj", before[last], through[last]))
    for c in range(int(per.max(initial=0)) - 2, -1, -1):
        live = np.flatnonzero(per > c + 1)
        here, following = place[start[live] + c], place[start[live] + c + 1]
        after[here] = norm(np.einsum("nij,nj->ni", through[following], after[following]))
    out = np.empty_like(emit)
    alpha = np.where(head[:, None], 1.0, before @ step) * emit[at]
    alpha = norm(alpha)
    out[at] = alpha
    for j in range(1, CHUNK):
        n = active[j]
        if not n:
            break
        alpha = norm((alpha[:n] @ step) * emit[at[:n] + j])
        out[at[:n] + j] = alpha
    beta = after.copy()
    for j in range(CHUNK - 1, -1, -1):
        n, longer = active[j], active[j + 1]
        if not n:
            continue
        if longer:
            beta[:longer] = norm((beta[:longer] * emit[at[:longer] + j + 1]) @ step.T)
        out[at[:n] + j] = norm(out[at[:n] + j] * beta[:n])
    return out, firsts


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS x labels
    step: np.ndarray  # log transitions
    lexicon: dict[str, str]
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _grams: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_grams": {}, "_table": None}

    def _rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of the emission table for words; new words are added to it."""
        if len(self._rows) > CACHE or len(self._grams) > 4 * CACHE:
            self._rows, self._grams, self._table = {}, {}, None
        known = self._rows
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            grams, flat, starts = self._grams, [], []
            for w in new:
                starts.append(len(flat))
                for g in features(w, self.lexicon):
                    b = grams.get(g)
                    if b is None:
                        b = grams[g] = zlib.crc32(g.encode()) % BUCKETS
                    flat.append(b)
            scores = np.add.reduceat(self.weights[np.array(flat)], np.array(starts), axis=0)
            emit = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
            n = len(known)
            if self._table is None or n + len(new) > len(self._table):
                grown = np.empty((max(2 * n, n + len(new), 1024), len(self.langs)))
                if n:
                    grown[:n] = self._table[:n]
                self._table = grown
            self._table[n : n + len(new)] = emit
            known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words of non-empty texts, each text's first row, and lengths."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        rows = self._rows_of([w for t in texts for w in t])
        step = np.exp(self.step - self.step.max())
        found, firsts = forward_backward(self._table[rows], lengths, step)
        return found, firsts, lengths

    def tag(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, marginal) of each word of a text."""
        words = words_of(text)
        if not words or not self.langs:
            return []
        found, _, _ = self.marginals([words])
        return [(w, self.langs[i], float(m[i])) for w, m, i in zip(words, found, found.argmax(axis=1), strict=True)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language with the greatest mean marginal over a text's words, and that mean; und and 0 without letters."""
        out = [("und", 0.0)] * len(texts)
        lot: list[int] = []
        split: list[list[str]] = []
        size = 0
        for i, t in enumerate([*texts, ""]):
            if lot and (i == len(texts) or size > AT_ONCE):
                found, firsts, lengths = self.marginals(split)
                mean = np.add.reduceat(found, firsts, axis=0) / lengths[:, None]
                for k, m in zip(lot, mean, strict=True):
                    out[k] = self.langs[int(m.argmax())], float(min(1.0, m.max()))
                lot, split, size = [], [], 0
            words = words_of(t) if self.langs else []
            if words:
                lot.append(i)
                split.append(words)
                size += len(words)
        return out


def train(rows: list[tuple[int, str, str]], sequences: int = SEQUENCES, seed: int = 7) -> Model:
    """A model of labelled texts (doc_id, text, lang), by Adagrad on the likelihood of spliced sequences."""
    rows = [(i, words_of(t), lang) for i, t, lang in rows]
    rows = [r for r in rows if r[1]]
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), {})
    k = len(langs)
    by_word: dict[str, Counter] = {}
    for _, words, lang in rows:
        for w in set(words):
            by_word.setdefault(w, Counter())[lang] += 1
    common = sorted(((sum(c.values()), w) for w, c in by_word.items()), reverse=True)[:LEXICON_SIZE]
    lexicon = {w: by_word[w].most_common(1)[0][0] if by_word[w].most_common(1)[0][1] >= 0.9 * n else "" for n, w in common if n >= LEXICON_COUNT}
    rng = np.random.default_rng(seed)
    of = [[r for r in rows if r[2] == lang] for lang in langs]
    vocab: dict[str, int] = {}
    chains, truths = [], []
    for _ in range(sequences):
        ids, ys = [], []
        for _ in range(int(rng.integers(1, 6))):
            y = int(rng.integers(k))
            words = of[y][int(rng.integers(len(of[y])))][1]
            n = int(rng.integers(3, 19))
            s = int(rng.integers(max(1, len(words) - n + 1)))
            part = words[s : s + n]
            ids += [vocab.setdefault(w, len(vocab)) for w in part]
            ys += [y] * len(part)
        chains.append(np.array(ids))
        truths.append(np.array(ys))
    flat, starts = [], []
    for w in vocab:
        starts.append(len(flat))
        flat += [zlib.crc32(g.encode()) % BUCKETS for g in features(w, lexicon)]
    flat, starts = np.array(flat), np.array(starts + [len(flat)])
    counts = np.diff(starts)
    weights, sums = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-3)
    step, step_sums = np.zeros((k, k)), np.full((k, k), 1e-3)
    with one_blas_thread():
        for _ in range(EPOCHS):
            for lot in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // BATCH)):
                ids, ys = np.concatenate([chains[i] for i in lot]), np.concatenate([truths[i] for i in lot])
                lengths = np.array([len(chains[i]) for i in lot], dtype=np.int64)
                own, back = np.unique(ids, return_inverse=True)
                spans = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
                buckets, edges = flat[spans], np.concatenate([[0], np.cumsum(counts[own])[:-1]])
                scores = np.add.reduceat(weights[buckets], edges, axis=0)
                emit = (np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30)[back]
                a = np.exp(step - step.max())
                gamma, firsts = forward_backward(emit, lengths, a)
                wrong = -gamma
                wrong[np.arange(len(ys)), ys] += 1
                by_word_grad = np.zeros((len(own), k))
                np.add.at(by_word_grad, back, wrong)
                touched, inverse = np.unique(buckets, return_inverse=True)
                grad = np.zeros((len(touched), k))
                np.add.at(grad, inverse, np.repeat(by_word_grad, counts[own], axis=0))
                grad = grad / len(lot) - DECAY * weights[touched]
                sums[touched] += grad**2
                weights[touched] += RATE * grad / np.sqrt(sums[touched])
                # Expected transitions from neighbouring marginals and emissions of the whole chain.
                inner = np.ones(len(ys), dtype=bool)
                inner[firsts] = False
                b = np.flatnonzero(inner)
                pair = _pairs(emit, lengths, firsts, a, b)
                expected = pair.sum(axis=0)
                seen = np.zeros((k, k))
                np.add.at(seen, (ys[b - 1], ys[b]), 1)
                g = (seen - expected) / len(lot)
                step_sums += g**2
                step += RATE * g / np.sqrt(step_sums)
    return Model(langs, weights, step, lexicon)


def _pairs(emit: np.ndarray, lengths: np.ndarray, firsts: np.ndarray, step: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Marginals of the label pairs (t - 1, t) for the rows t in inner: plain recursion over padded chains."""
    n, longest, k = len(lengths), int(lengths.max()), emit.shape[1]
    at = firsts[:, None] + np.minimum(np.arange(longest)[None], lengths[:, None] - 1)
    e = emit[at]
    alpha, beta = np.zeros((n, longest, k)), np.ones((n, longest, k))
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        x = (alpha[:, t - 1] @ step) * e[:, t]
        alpha[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        x = (beta[:, t + 1] * e[:, t + 1]) @ step.T
        x = np.where((t + 1 < lengths)[:, None], x, 1.0)
        beta[:, t] = x / x.sum(axis=1, keepdims=True)
    chain = np.searchsorted(firsts, inner, side="right") - 1
    t = inner - firsts[chain]
    out = alpha[chain, t - 1][:, :, None] * step[None] * (e[chain, t] * beta[chain, t])[:, None, :]
    return out / out.sum(axis=(1, 2), keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | Trained:
    """A model, trained in one task, of at most sample documents with a language and a text, of at most sample_bytes together, by hash of doc_id, none
    of them held out. Of an id with several languages or texts the least is read."""
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return trained(sampled_rows(texts, known.groupBy("doc_id").agg(F.min("lang").alias("label")), sample, sample_bytes), train)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.35) -> DataFrame:
    """The rows of docs, with all their columns, whose language is a learned one with a mean marginal of at least least."""

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            good = [lang != "und" and s >= least for i in range(0, len(texts), SLICE) for lang, s in model.predict([t or "" for t in texts.slice(i, SLICE).to_pylist()])]
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return in_small_batches(docs).mapInArrow(identified, docs.schema)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. One pass over whole texts, no shuffle.

    A text that is null or has no letter (numbers like fractions or circled digits are none) is und with score 0, as is every text where no labelled document was there to
    learn from. Equal means go to the language first in order. Repeated rows are judged one by one; an empty table gives
    no rows; other columns are no input.
    """

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            got = model.predict(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_small_batches(read).mapInPandas(judged, "doc_id long, held_out boolean, lang_pred string, score double")
