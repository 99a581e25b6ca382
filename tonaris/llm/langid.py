"""Language identification by rank-order n-gram profiles.

Profiles: the most frequent 1- to 3-grams of letters in each language's training texts, by rank. A text is
ranked the same way; its out-of-place distance to a profile is the sum of rank differences, an n-gram that
the profile lacks counting as the profile's length. The nearest profile wins, ties by name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonaris.llm.common import CHUNK_BYTES, map_arrow, pick, pieces, unit_hash

#: N-grams in a profile and in a document's ranking.
PROFILE = 300
#: Training texts of each language, about; chosen by a hash of doc_id.
MAX_TRAIN = 3000
#: Languages whose rates stand in the plan as literals; the rates of more are a small table. Profiles of all are on the driver.
MAX_LITERALS = 500
UNKNOWN = "und"
_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else the space."""
    table = np.full(0x110000, 32, np.int64)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = 1
    at = np.flatnonzero(table == 1)
    table[at] = at
    return table


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text; words are padded with a space, none crosses words. A long text is read in pieces."""
    if len(text) <= CHUNK_BYTES:
        return _ngrams(text)
    codes, counts = zip(*(_ngrams(p.decode("utf-8", "surrogatepass")) for p in pieces(text.encode("utf-8", "surrogatepass"))), strict=True)
    names, where = np.unique(np.concatenate(codes), return_inverse=True)
    return names, np.bincount(where, np.concatenate(counts), len(names)).astype(np.int64)


def _ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, two = c[c != 32], (c[:-1] << _BITS) | c[1:]
    three = ((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Languages' profiles: a sorted table of n-grams with the rank each has in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in self.names] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), size, np.int32)
        for i, k in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, np.array(profiles[k], np.int64))] = np.arange(len(profiles[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Name and score in [0, 1]: how much nearer the best profile is than the next; ``und``, 0 without letters or profiles."""
        codes, counts = ngrams(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == top
        r = self.ranks[:, np.where(known, at, len(self.codes))]
        d = np.where(r == self.size, self.size, np.abs(r - np.arange(len(top)))).sum(axis=1) / (self.size * len(top))
        best = int(np.argmin(d))
        other = np.delete(d, best).min() if len(d) > 1 else 1.0
        return self.names[best], float(min(1.0, max(0.0, (other - d[best]) / other if other > 0 else 0.0)))


def fit(labelled: DataFrame, size: int = PROFILE, max_train: int = MAX_TRAIN) -> Profiles:
    """Profiles from rows (doc_id, text, lang); null languages and null texts are left out.

    About ``max_train`` rows of each language are used, chosen by a hash of doc_id (all if there are fewer).
    """
    known = pick(labelled, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = dict(map(tuple, known.groupBy("lang").count().toLocalIterator()))
    # rates stand in the filter, so that texts are drawn where they are read; a language under the limit is taken whole
    large = {name: max_train / n for name, n in sizes.items() if n > max_train}
    draw = unit_hash("doc_id", seed=4)
    if len(large) <= MAX_LITERALS:
        cut = [F.lit(x) for pair in large.items() for x in pair]
        rate = F.coalesce(F.element_at(F.create_map(*cut), F.col("lang")), F.lit(1.0)) if cut else F.lit(1.0)
        sample = known.filter(draw < rate).select("lang", "text")
    else:
        rates = known.sparkSession.createDataFrame(list(large.items()), "lang string, _rate double")
        sample = known.join(F.broadcast(rates), "lang", "left").filter(draw < F.coalesce("_rate", F.lit(1.0))).select("lang", "text")

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = total.setdefault(lang, {})
                codes, counts = ngrams(text)
                for g, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    mine[g] = mine.get(g, 0) + n
        for lang, mine in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())], ["lang", "gram", "n"])

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_r") <= size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "_r").toLocalIterator():
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(profiles, size)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score for every whole text; null texts and texts without a letter are ``und``, 0."""
    keep = keep or ["doc_id"]
    docs = pick(docs, *keep, "text")
    fields = docs.select(*keep).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.predict(t.as_py()) for t in b.column(len(keep))]
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_arrow(docs.select(*keep, "text"), run, f"{schema}, lang_pred string, score double")
