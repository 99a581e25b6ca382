"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on word presence. Each later model also gets the
earlier categories' probabilities; while training, those are out-of-fold predictions, by models whose words were chosen
without the fold as well, so a later model learns from probabilities as unsure as it will see. Categories are columns of
the label table. The table at hand has one of toxicity and one of quality: low quality is the chain's first link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import CHUNK_BYTES, RangeHash, map_arrow, pick, pieces, slices, texts_of, unit_hash

#: Labelled documents used to fit, about; chosen by a hash of doc_id.
MAX_TRAIN = 12000
#: Words that the models may use, chosen by how much they tell about the label in the training sample.
VOCABULARY = 4096
#: Root of a word's likelihood ratio, about its distance from chance in standard errors.
LEAST_TELL = 3.5
FOLDS = 3
#: Label columns in the order of the chain, and the value that counts as the category.
CATEGORIES = (("quality", 0), ("toxic", 1))
_LETTER = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _LETTER[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each word; here words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:] = _LETTER[raw]
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = flips[0::2], flips[1::2]
    at = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return RangeHash(_LOWER[raw]).of(starts, ends), np.searchsorted(at, starts, "right") - 1


def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs, sorted: text index, word hash. A long text is read in pieces."""
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        h = np.unique(np.concatenate([np.unique(words([p])[0]) for p in pieces(texts[0])]))
        return np.zeros(len(h), np.int64), h
    h, owner = words(texts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    return owner[first], h[first]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Linear:
    """Logistic regression on sparse 0/1 features and a few dense ones, by full-batch Adam."""

    def __init__(self, size: int, dense: int):
        self.w, self.d, self.b = np.zeros(size), np.zeros(dense), 0.0

    def margin(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.w[col], len(dense)) + dense @ self.d + self.b

    def fit(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.15, decay: float = 2e-4) -> Linear:
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        theta = [self.w, self.d, np.array([self.b])]
        m, s = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        for t in range(1, steps + 1):
            g = (_sigmoid(self.margin(row, col, dense)) - y) * weight
            grads = [np.bincount(col, g[row], len(self.w)) + decay * self.w, dense.T @ g + decay * self.d, np.array([g.sum()])]
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                s[i] = 0.99 * s[i] + 0.01 * gr * gr
                theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-9)
            self.w, self.d, self.b = theta[0], theta[1], float(theta[2][0])
        return self


def telling(row: np.ndarray, col: np.ndarray, y: np.ndarray, size: int, most: int) -> np.ndarray:
    """The words (numbers below ``size``) that tell most about labels ``y``, sorted: at most ``most``, each with a likelihood ratio of ``LEAST_TELL``."""
    seen, with_ = np.bincount(col, minlength=size), np.bincount(col, y[row], size)
    share = min(max(y.mean(), 1e-9), 1 - 1e-9)
    other, some = seen - with_, np.maximum(seen, 1)
    # root of the likelihood ratio of the word's own share of the category against the sample's
    ratio = with_ * np.log(np.maximum(with_, 1e-9) / (some * share)) + other * np.log(np.maximum(other, 1e-9) / (some * (1 - share)))
    tells = np.sqrt(np.maximum(0, 2 * ratio))
    best = np.argsort(-tells, kind="stable")[:most]
    return np.sort(best[tells[best] >= LEAST_TELL])


class Link:
    """One category's model: its words and a linear model on them and on the earlier categories' probabilities."""

    def __init__(self, row: np.ndarray, col: np.ndarray, seen: np.ndarray, y: np.ndarray, size: int, most: int):
        self.words = telling(row, col, y, size, most)
        self.model = Linear(len(self.words), seen.shape[1]).fit(*self.known(row, col), seen, y)

    def known(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.words, col)
        at[at == len(self.words)] = 0
        hit = self.words[at] == col if len(self.words) else np.zeros(len(col), bool)
        return row[hit], at[hit]

    def predict(self, row: np.ndarray, col: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return _sigmoid(self.model.margin(*self.known(row, col), seen))


class Chain:
    """A chain over ``categories``; each link sees words and all earlier categories' probabilities."""

    def __init__(self, categories: list[str]):
        self.categories, self.links = categories, []

    def fit(self, row: np.ndarray, col: np.ndarray, labels: np.ndarray, size: int, vocabulary: int = VOCABULARY, folds: int = FOLDS) -> Chain:
        """row, col: distinct (document, word) pairs, words as numbers below ``size``; labels: (documents, categories), NaN where unknown.

        Earlier categories enter as out-of-fold probabilities, documents without the label as predicted by the model of all others.
        """
        n = len(labels)
        fold, seen = np.arange(n) % folds, np.zeros((n, 0))
        for k in range(labels.shape[1]):
            known = ~np.isnan(labels[:, k])

            def part(on: np.ndarray, of: np.ndarray = row, k: int = k, seen: np.ndarray = seen) -> Link:
                number = np.cumsum(on) - 1
                return Link(number[of[on[of]]], col[on[of]], seen[on], labels[on, k], size, vocabulary)

            whole = part(known)
            self.links.append(whole)
            if k + 1 < labels.shape[1]:
                out = whole.predict(row, col, seen)
                for f in range(folds):
                    held = known & (fold == f)
                    if held.any() and (known & (fold != f)).any():
                        out[held] = part(known & (fold != f)).predict(row, col, seen)[held]
                seen = np.column_stack([seen, out])
        return self

    def predict(self, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        seen = np.zeros((n, 0))
        for link in self.links:
            seen = np.column_stack([seen, link.predict(row, col, seen)])
        return seen


class Scorer:
    """A chain with the hashes of the words that its links use."""

    def __init__(self, chain: Chain, names: np.ndarray):
        used = np.unique(np.concatenate([x.words for x in chain.links])) if len(names) else np.zeros(0, np.int64)
        for link in chain.links:
            link.words = np.searchsorted(used, link.words)
        self.chain, self.names = chain, names[used]

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, categories)."""
        owner, h = counts(texts)
        at = np.searchsorted(self.names, h)
        at[at == len(self.names)] = 0
        known = self.names[at] == h if len(self.names) else np.zeros(len(h), bool)
        return self.chain.predict(owner[known], at[known], len(texts))


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[tuple[str, int], ...] = CATEGORIES, max_train: int = MAX_TRAIN, vocabulary: int = VOCABULARY) -> Scorer:
    """Fit on documents with a label of the last category: (doc_id, the categories' columns).

    A category's label is 1 where its column has the given value. Null labels are unknown; of several labels of a document the
    larger mean side wins (ties: 1). About ``max_train`` labelled documents are used, chosen by a hash of doc_id.
    """
    own = pick(labels, "doc_id", *[c for c, _ in categories]).filter(F.col("doc_id").isNotNull())
    sides = [(F.avg((F.col(c) == v).cast("double")) >= 0.5).cast("double").alias(f"_y{i}") for i, (c, v) in enumerate(categories)]
    y = own.groupBy("doc_id").agg(*sides).filter(F.col(f"_y{len(categories) - 1}").isNotNull())
    rate = min(1.0, max_train / max(1, y.count()))
    chosen = F.broadcast(y.filter(unit_hash("doc_id", seed=6) < rate))
    rows = pick(docs, "doc_id", "text").filter(unit_hash("doc_id", seed=6) < rate).join(chosen, "doc_id")
    given = [f"_y{i}" for i in range(len(categories))]

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = texts_of(b.column(0)), []
        for lo, hi in slices(texts):
            owner, h = counts(texts[lo:hi])
            ends = np.searchsorted(owner, np.arange(hi - lo + 1))
            out += [h[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *b.columns[1:]], ["h", *given])

    got = map_arrow(rows.select("text", *given), encode, f"h binary, {', '.join(f'{g} double' for g in given)}").toArrow()
    bags = sorted(zip(got["h"].to_pylist(), *(map(lambda v: -1.0 if v is None else v, got[g].to_pylist()) for g in given), strict=True))
    chain = Chain([c for c, _ in categories])
    if not bags:
        empty = np.empty(0, np.int64)
        return Scorer(chain.fit(empty, empty, np.zeros((1, len(categories))), 0), np.empty(0, np.uint64))
    row = np.repeat(np.arange(len(bags)), [len(b[0]) // 8 for b in bags])
    names, col = np.unique(np.frombuffer(b"".join(b[0] for b in bags), np.uint64), return_inverse=True)
    marks = np.array([b[1:] for b in bags])
    return Scorer(chain.fit(row, col, np.where(marks < 0, np.nan, marks), len(names), vocabulary), names)


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs``, a probability p_<category> for each category, and ``toxic`` (the last one at 0.5 or more), for whole texts.

    Null and empty texts have no words and so the models' values without features; a score never depends on anything but the text.
    """
    keep = keep or ["doc_id"]
    docs, names = pick(docs, *keep, "text"), [f"p_{c}" for c in scorer.chain.categories]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(len(keep)))
        p = np.concatenate([scorer.predict(texts[lo:hi]) for lo, hi in slices(texts)])
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array((p[:, -1] >= 0.5).astype(np.int32))], [*keep, *names, "toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_arrow(docs, run, f"{schema}, {', '.join(f'{n} double' for n in names)}, toxic int")
