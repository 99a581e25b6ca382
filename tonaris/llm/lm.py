"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

A text's tokens are its words (A-Z lower-cased) and one end token. The probability of a token is that of its
class, given the tokens before it, times that of the token within its class, given them as well:

* The most frequent words of the training tokens and the end token are the shortlist, sorted by their last two bytes and cut
  into classes of ``MEMBERS``. All other words are one class, whose members are ``MEMBERS`` cells by the word's hash.
* P(class | history) and P(member | class, history) are softmaxes over sums of hashed feature rows: the previous word, the
  previous two words, and for classes the word before the previous one (a skip feature); for members the class is hashed in.
* A word of the shortlist is a member. Within a cell, P(word | cell) is add-one smoothed over the cell's training words, with
  one place for unknown words.

Feature rows grow with the training tokens up to ``MOST_ROWS``. Weights are trained by distributed gradient updates: in each
round every learner runs AdaGrad mini-batches on its share of the training texts, from the same weights; their updates are
added up in a tree and averaged by row, weighted by use. Each training text is used in exactly one round. Counts are exact,
over all training texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import CHUNK_BYTES, Tokens, map_arrow, materialise, mix, pick, pieces, slices, texts_of, unit_hash

CLASSES, MEMBERS = 32, 32
#: The class of the words outside the shortlist.
REST = CLASSES - 1
#: Training tokens for each feature row, and bounds on the number of rows of each of the two softmax levels.
TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS = 2048, 1 << 15, 1 << 18
ROUNDS = 2
#: Tokens of a mini-batch.
BATCH = 2048
#: Training tokens of one learner for each feature row, so that its updates are smaller than its texts; and the least number of learners.
LEARNER_TOKENS_PER_ROW, LEAST_LEARNERS = 64, 12
#: Words whose counts are broadcast (12 bytes each), the most frequent ones; texts meet the counts of the others in a shuffle.
BROADCAST_WORDS = 2_000_000
_EDGE = np.uint64(0xA0761D6478BD642F)
_END_ENDING = 0
_BLOCK = 4096
_NEVER = np.float32(-1e30)
_ONES = np.ones(MEMBERS, np.float32)


class Stream:
    """Tokens of several texts with end tokens: hash and ending of each; ``first`` and ``count`` by text. A long text is read in pieces."""

    def __init__(self, texts: list[bytes]):
        if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
            parts = [self._words(Tokens([p])) for p in pieces(texts[0])]
            h, ending = (np.concatenate(x) for x in zip(*parts, strict=True))
            count = np.array([len(h)])
        else:
            t = Tokens(texts)
            (h, ending), count = self._words(t), t.count
        at_end = np.cumsum(count) + np.arange(len(texts))
        word = np.ones(len(h) + len(texts), bool)
        word[at_end] = False
        self.h = np.full(len(word), _EDGE, np.uint64)
        self.h[word] = h
        self.ending = np.full(len(word), _END_ENDING, np.int64)
        self.ending[word] = ending
        self.count = count + 1
        self.first = np.cumsum(self.count) - self.count

    @staticmethod
    def _words(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        last = t.data[t.ends - 1].astype(np.int64)
        before = np.where(t.ends - t.starts > 1, t.data[np.maximum(t.ends - 2, 0)], 0).astype(np.int64)
        return t.hashes(), before * 256 + last

    def histories(self) -> np.ndarray:
        """Hashes of the three features of each token, (3, tokens); histories begin with an edge mark."""
        one = np.concatenate([[_EDGE], self.h[:-1]])
        one[self.first] = _EDGE
        two = np.concatenate([[_EDGE], one[:-1]])
        two[self.first] = _EDGE
        return np.stack([mix(one), mix(one * np.uint64(3) + mix(two)), mix(two ^ np.uint64(0x5851F42D4C957F2D))])


def count_words(texts: DataFrame) -> DataFrame:
    """``h, ending, c`` over all tokens of all rows (end tokens too), partial sums taken before the shuffle."""

    def run(batches):
        h, e, c, size = [], [], [], 0

        def merged():
            hh = np.concatenate(h)
            names, first, where = np.unique(hh, return_index=True, return_inverse=True)
            return names, np.concatenate(e)[first], np.bincount(where, np.concatenate(c)).astype(np.int64)

        def batch():
            names, endings, counts = merged()
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(endings), pa.array(counts)], ["h", "ending", "c"])

        for b in batches:
            rows = texts_of(b.column(0))
            for lo, hi in slices(rows):
                s = Stream(rows[lo:hi])
                names, first, counts = np.unique(s.h, return_index=True, return_counts=True)
                h.append(names)
                e.append(s.ending[first])
                c.append(counts)
                size += len(names)
                if size > 2_000_000:
                    names, endings, counts = merged()
                    h, e, c, size = [names], [endings], [counts], len(names)
                    if size > 1_000_000:
                        yield batch()
                        h, e, c, size = [], [], [], 0
        if h:
            yield batch()

    return texts.select("text").mapInArrow(run, "h long, ending long, c long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


class Shape:
    """Which class and member each word is, and how many feature rows there are; ``names`` (sorted hashes) and ``place`` of the shortlist."""

    def __init__(self, shortlist: list[tuple[int, int, int]], cells: dict[int, tuple[int, int]], n: int, v: int):
        """shortlist: (hash, ending, count) of each word; cells: training tokens and distinct words of each cell of the rest."""
        ordered = sorted(shortlist, key=lambda x: (x[1], x[0]))
        h = np.array([x[0] for x in ordered], np.uint64)
        order = np.argsort(h)
        self.names, self.place = h[order], order.astype(np.int32)
        self.n, self.v = n, v
        self.rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << math.ceil(math.log2(max(1, n / TOKENS_PER_ROW)))))
        self.cell_tokens, self.cell_words = np.zeros(MEMBERS), np.zeros(MEMBERS)
        for k, (tokens, kinds) in cells.items():
            self.cell_tokens[k], self.cell_words[k] = tokens, kinds
        share = np.zeros((CLASSES, MEMBERS))
        share.reshape(-1)[: len(ordered)] = [x[2] for x in ordered]
        share[REST] = self.cell_tokens + 1
        with np.errstate(divide="ignore"):
            of_class = np.log(share.sum(axis=1) / share.sum())
            within = np.log(share / np.maximum(share.sum(axis=1, keepdims=True), 1))
        #: Row 0: biases of the classes; row 1 + c: of the members of class c. What does not exist never happens.
        self.bias = np.maximum(np.concatenate([of_class[None, :], within]), _NEVER).astype(np.float32)

    def targets(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each token."""
        place = (REST * MEMBERS + (h >> np.uint64(59)).astype(np.int32)).astype(np.int32)
        if len(self.names):
            at = np.searchsorted(self.names, h)
            at[at == len(self.names)] = 0
            place = np.where(self.names[at] == h, self.place[at], place)
        return place // MEMBERS, place % MEMBERS

    def samples(self, s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two softmax samples for each token, its class and its member: feature rows of both (2, 2 tokens) and of classes only (tokens),
        bias rows and outcomes."""
        shift, past = np.uint64(64 - int(math.log2(self.rows))), s.histories()
        cls, member = self.targets(s.h)
        inside = mix(past[:2] + (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = np.stack([past[:2] >> shift, (inside >> shift) + np.uint64(self.rows)], axis=2).astype(np.int32).reshape(2, -1)
        at = np.stack([np.zeros_like(cls), cls + 1], axis=1).reshape(-1).astype(np.uint8)
        return x, (past[2] >> shift).astype(np.int32), at, np.stack([cls, member], axis=1).reshape(-1)


def _batches(made: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """Samples in runs of ``BATCH`` tokens."""
    x, skip, at, y = made
    for lo in range(0, len(skip), BATCH):
        hi = lo + BATCH
        yield x[:, 2 * lo : 2 * hi], skip[lo:hi], at[2 * lo : 2 * hi], y[2 * lo : 2 * hi]


def _margins(w: np.ndarray, bias: np.ndarray, x: np.ndarray, skip: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log weights of all outcomes, none so large that its exponential overflows."""
    z = w.take(x[0], axis=0)
    z += w.take(x[1], axis=0)
    z[::2] += w.take(skip, axis=0)
    z += bias.take(at, axis=0)
    if z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    return z


class _Learner:
    def __init__(self, w: np.ndarray, bias: np.ndarray, rate: float = 1.0):
        self.w, self.bias, self.rate = w.copy(), bias.copy(), rate
        self.used, self.used_b = np.zeros(len(w), np.float32), np.zeros(len(bias), np.float32)
        self.square, self.square_b = np.full(len(w), 1e-2, np.float32), np.full(len(bias), 1e-2, np.float32)

    def update(self, x: np.ndarray, skip: np.ndarray, at: np.ndarray, y: np.ndarray) -> None:
        """One AdaGrad step on a mini-batch; rows that it does not touch stay as they are."""
        z = _margins(self.w, self.bias, x, skip, at)
        g = np.exp(z, out=z)
        g *= (1 / (g @ _ONES))[:, None]
        g[np.arange(len(y)), y] -= 1
        for rows in x:
            self._step(self.w, self.square, self.used, rows, g)
        self._step(self.w, self.square, self.used, skip, g[::2])
        self._step(self.bias, self.square_b, self.used_b, at, g)

    def _step(self, table: np.ndarray, square: np.ndarray, used: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable" if rows.dtype == np.uint8 else None)
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        names, n = rows[first], np.diff(np.concatenate([first, [len(rows)]])).astype(np.float32)
        grad = np.add.reduceat(g.take(order, axis=0), first, axis=0)
        total = square.take(names) + np.einsum("ij,ij->i", grad, grad) / (n * np.float32(grad.shape[1]))
        square[names] = total
        grad *= (np.float32(-self.rate / 3) / np.sqrt(total * n))[:, None]
        grad += table.take(names, axis=0)
        table[names] = grad
        used[names] += n


def _changed(block: int, before: np.ndarray, after: np.ndarray, used: np.ndarray):
    """Touched rows of a table in blocks: number, rows, changes times uses, uses."""
    for lo in range(0, len(before), _BLOCK):
        rows = np.flatnonzero(used[lo : lo + _BLOCK])
        if len(rows):
            at = rows + lo
            change = (after[at] - before[at]) * used[at][:, None]
            yield block + lo // _BLOCK, rows.astype(np.int32).tobytes(), change.tobytes(), used[at].tobytes()


_UPDATE = "block int, part int, rows binary, change binary, used binary"
_NAMES = ["block", "part", "rows", "change", "used"]


def _add(last: bool):
    """Sums of the updates of each (block, part) that a task gets; ``last``: averages by use instead."""

    def run(batches):
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, part, rows, change, used in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total, uses = sums.setdefault((k, part), (np.zeros((_BLOCK, MEMBERS), np.float32), np.zeros(_BLOCK, np.float32)))
                at = np.frombuffer(rows, np.int32)
                total[at] += np.frombuffer(change, np.float32).reshape(-1, MEMBERS)
                uses[at] += np.frombuffer(used, np.float32)
        for (k, part), (total, uses) in sums.items():
            at = np.flatnonzero(uses)
            change = total[at] / uses[at][:, None] if last else total[at]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0 if last else part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), change, uses[at]))], _NAMES)

    return run


def train(texts: DataFrame, shape: Shape, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2 * rows, MEMBERS) and biases (1 + CLASSES, MEMBERS), from all rows (doc_id, text)."""
    spark = texts.sparkSession
    w, bias, blocks = np.zeros((2 * shape.rows, MEMBERS), np.float32), shape.bias, 2 * shape.rows // _BLOCK
    learners = max(LEAST_LEARNERS, math.ceil(shape.n / rounds / (LEARNER_TOKENS_PER_ROW * shape.rows)))
    fan = math.ceil(math.sqrt(learners))
    for r in range(rounds):
        part = texts.filter(F.floor(unit_hash("doc_id", seed=9) * rounds) == r).select("text").coalesce(learners)
        shared = spark.sparkContext.broadcast((w, bias))

        def learn(batches, shared=shared):
            w, bias = shared.value
            model = None
            for b in batches:
                model, rows = model or _Learner(w, bias), texts_of(b.column(0))
                for lo, hi in slices(rows, 1 << 19):
                    for batch in _batches(shape.samples(Stream(rows[lo:hi]))):
                        model.update(*batch)
            if model is None:
                return
            task = TaskContext.get().partitionId() % fan
            for before, after, used, start in ((w, model.w, model.used, 0), (bias, model.bias, model.used_b, blocks)):
                for k, rows, change, uses in _changed(start, before, after, used):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([rows], pa.binary()), pa.array([change], pa.binary()), pa.array([uses], pa.binary())], _NAMES)

        n = min(blocks + 1, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        total = part.mapInArrow(learn, _UPDATE).repartition(n, "block", "part").mapInArrow(_add(False), _UPDATE).repartition(n, "block").withColumn("part", F.lit(0)).mapInArrow(_add(True), _UPDATE)
        w, bias = w.copy(), bias.copy()
        for row in total.toLocalIterator():
            at, change = np.frombuffer(row["rows"], np.int32), np.frombuffer(row["change"], np.float32).reshape(-1, MEMBERS)
            if row["block"] == blocks:
                bias[at] += change
            else:
                w[at + row["block"] * _BLOCK] += change
        shared.unpersist()
    return w, bias


class Model:
    """Trained weights and the counts of the most frequent words (sorted hashes, counts), or None."""

    def __init__(self, shape: Shape, w: np.ndarray, bias: np.ndarray, words: tuple[np.ndarray, np.ndarray] | None):
        self.shape, self.w, self.bias, self.words = shape, w, bias, words

    def softmax_score(self, s: Stream) -> np.ndarray:
        """log10 of P(class | history) P(member | class, history) of each token, in sparse batches."""
        out = []
        for x, skip, at, y in _batches(self.shape.samples(s)):
            z = _margins(self.w, self.bias, x, skip, at)
            mine = z[np.arange(len(z)), y]
            out.append((mine - np.log(np.exp(z, out=z) @ _ONES)).reshape(-1, 2).sum(axis=1, dtype=np.float64) / math.log(10))
        return np.concatenate(out)

    def within(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(token | member) for counts c: 0 on the shortlist."""
        cls, member = self.shape.targets(h)
        return np.where(cls == REST, np.log10((c + 1.0) / (self.shape.cell_tokens[member] + self.shape.cell_words[member] + 1.0)), 0.0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.shape.n + self.shape.v + 1.0))

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of words, 0 for those not held here."""
        names, c = self.words or ((), ())
        if not len(names):
            return np.zeros(len(h), np.int64)
        at = np.searchsorted(names, h)
        at[at == len(names)] = 0
        return np.where(names[at] == h, c[at], 0)


def _frequent(words: DataFrame, v: int, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: all from a count on, taken from a histogram of counts in steps of an eighth of a doubling."""
    if v <= most:
        return words
    step = F.floor(F.log2("c") * 8).cast("int")
    seen, least = 0, None
    for row in words.groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect():  # some 500 rows at most
        seen += row["count"]
        if seen > most:
            break
        least = row["k"]
    return words.filter(step >= least) if least is not None else words.limit(0)


def fit(training: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of counts (h, ending, c), from all rows (doc_id, text) of ``training``; null texts are empty."""
    training = pick(training, "doc_id", "text")
    words = materialise(count_words(training), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    edge = int(_EDGE.astype(np.int64))
    top = words.filter(F.col("h") != edge).orderBy(F.desc("c"), "h").limit(REST * MEMBERS - 1).collect()
    end = words.filter(F.col("h") == edge).collect()
    listed = [(r["h"] % (1 << 64), r["ending"], r["c"]) for r in [*top, *end]]
    chosen = words.sparkSession.createDataFrame([(r["h"],) for r in [*top, *end]], "h long")
    others = words.join(F.broadcast(chosen), "h", "left_anti").groupBy(F.shiftrightunsigned("h", 59).cast("int").alias("k")).agg(F.sum("c"), F.count("*"))
    # without training texts the end token is still a member
    shape = Shape(listed or [(int(_EDGE), _END_ENDING, 1)], {k: (a, b) for k, a, b in others.collect()}, n, v)
    w, bias = train(training, shape, rounds)
    got = _frequent(words, v, BROADCAST_WORDS).select("h", F.least("c", F.lit(2**31 - 1)).cast("int").alias("c")).toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return Model(shape, w, bias, (h[order], c[order])), words


_OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, words: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_tokens, n_known, train_tokens, base_score and score for every whole text.

    A null text is empty: one end token. Without training rows all counts are 0 and scores are those of the smoothing alone.
    Counts of the model's own words are looked up where the text is read; if there are more words, those the model does not
    hold go through a shuffle as (row, word) and meet their counts there.
    """
    keep = keep or ["doc_id"]
    docs = pick(docs, *keep, "text")
    shared, shape = docs.sparkSession.sparkContext.broadcast(model), model.shape
    whole = model.words is not None and len(model.words[0]) == shape.v
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts, out, rare, rares = shared.value, texts_of(b.column(len(keep))), [], [], []
        for lo, hi in slices(texts):
            s = Stream(texts[lo:hi])
            uniq, where = np.unique(s.h, return_inverse=True)
            count = m.counts(uniq)
            sums = lambda x: np.add.reduceat(x, s.first)  # noqa: B023, E731
            within, base = m.within(uniq, count)[where], m.base(count)[where]
            if not whole:  # words that others know are left to the shuffle
                unsure = (count == 0)[where]
                within[unsure] = base[unsure] = 0
                owner, of = np.repeat(np.arange(hi - lo), s.count)[unsure], where[unsure]
                pair, tf = np.unique(owner * len(uniq) + of, return_counts=True)
                rare.append((uniq[pair % len(uniq)], tf))
                rares.append(np.bincount(pair // len(uniq), minlength=hi - lo))
            out.append((s.count, sums((count > 0).astype(np.int64)[where]), sums(base), sums(m.softmax_score(s) + within)))
        n, known, base, total = (np.concatenate(x) for x in zip(*out, strict=True))
        made = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), m.shape.n, np.int64)), pa.array(base), pa.array(total)]
        names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not whole:
            h, tf = (np.concatenate(x) for x in zip(*rare, strict=True))
            rows = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(tf, pa.int64()), pa.array(m.shape.targets(h)[0] == REST)], ["h", "tf", "rest"])
            made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(rares))]), pa.int32()), rows))
            names.append("_rare")
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names)

    if whole:
        return map_arrow(docs, run, f"{fields}, {_OUT}")
    scored = map_arrow(docs, run, f"{fields}, {_OUT}, _rare array<struct<h:long,tf:long,rest:boolean>>")
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    flat = scored.select("_row", F.explode("_rare").alias("_x")).select("_row", F.col("_x.h").alias("h"), F.col("_x.tf").alias("tf"), F.col("_x.rest").alias("rest"))
    sizes = F.array(*[F.lit(float(a + b + 1)) for a, b in zip(shape.cell_tokens, shape.cell_words, strict=True)])
    c, tf = F.coalesce("c", F.lit(0)), F.col("tf")
    within = F.when(F.col("rest"), F.log10((c + 1) / F.element_at(sizes, F.shiftrightunsigned("h", 59).cast("int") + 1))).otherwise(0.0)
    sums = flat.join(words.select("h", "c"), "h", "left").groupBy("_row").agg(
        F.sum(F.when(c > 0, tf).otherwise(0)).alias("_known"),
        F.sum(tf * F.log10((c + 1) / F.lit(float(shape.n + shape.v + 1)))).alias("_base"),
        F.sum(tf * within).alias("_within"),
    )
    more = lambda x: F.coalesce(x, F.lit(0))
    out = scored.drop("_rare").join(sums, "_row", "left")
    return out.select(*keep, "n_tokens", (F.col("n_known") + more("_known")).cast("long").alias("n_known"), "train_tokens", (F.col("base_score") + more("_base")).alias("base_score"), (F.col("score") + more("_within")).alias("score"))
