"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded (statistics of its bytes and
words, then a tanh layer); gated attention gives it a weight; the weighted mean of the encodings is scored
by a logistic unit. Only document labels are used to learn; all layers are trained together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import CHUNK_BYTES, RangeHash, Tokens, aside, map_arrow, pick, pieces, slices, texts_of, unit_hash

PASSAGE = 64
#: Labelled documents used to fit, about; chosen by a hash of doc_id.
MAX_TRAIN = 6000
_HASHED = 24
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!?", "|", "#*$%&@^~", "<>{}[]()", "-_=+/\\", ":;'\"`"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.int64)
    for i, chars in enumerate(_CLASSES):
        table[[ord(c) for c in chars]] = i
    table[128:] = len(_CLASSES) + 1
    return table


_CLASS_OF = _class_table()
_N_CLASSES = len(_CLASSES) + 2
FEATURES = _N_CLASSES + 8 + _HASHED


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the number of passages of each text; a text without words has one row of zeros but for the constant.

    A long text is read in pieces of whole passages.
    """
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        rows, rest, some = [], b"", False
        for piece in pieces(texts[0]):
            rest += piece
            t = Tokens([rest], lower=False)
            whole = (len(t.starts) - 1) // PASSAGE * PASSAGE
            if whole > 0:
                cut = int(t.starts[whole])
                rows.append(_passages([rest[:cut]])[0])
                rest, some = rest[cut:], True
        if rest.strip() or not some:
            rows.append(_passages([rest])[0])
        return np.concatenate(rows), np.array([sum(map(len, rows))])
    return _passages(texts)


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    t = Tokens(texts, lower=False)
    n_pass = np.maximum(1, -(-t.count // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n_pass)])
    out = np.zeros((base[-1], FEATURES), np.float32)
    out[:, _N_CLASSES + 7] = 1
    if not len(t.starts):
        return out, n_pass
    within = np.arange(len(t.starts)) - np.repeat(t.first, t.count)
    owner = np.repeat(base[:-1], t.count) + within // PASSAGE
    words = np.bincount(owner, minlength=base[-1]).astype(np.float64)
    some = np.maximum(words, 1)
    # bytes belong to the passage of the last word that began before them in their text, those ahead of its first word to none
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    edges = np.concatenate([t.text_starts[:-1], t.text_starts[1:] - 1, t.starts[first]])
    values = np.concatenate([np.full(2 * len(texts), base[-1]), owner[first]])
    order = np.argsort(edges, kind="stable")
    of_byte = np.repeat(values[order], np.diff(np.concatenate([edges[order], [len(t.data)]])))
    classes = np.bincount(of_byte * _N_CLASSES + _CLASS_OF[t.data], minlength=(base[-1] + 1) * _N_CLASSES).reshape(-1, _N_CLASSES)[:-1]
    length = np.maximum(classes.sum(axis=1, keepdims=True), 1)
    out[:, :_N_CLASSES] = np.sqrt(classes / length)
    h = RangeHash(t.data).of(t.starts, t.ends)
    sizes = (t.ends - t.starts).astype(np.float64)
    mean = np.bincount(owner, sizes, base[-1]) / some
    square = np.bincount(owner, sizes * sizes, base[-1]) / some
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    fresh = np.concatenate([[True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])])
    distinct = np.bincount(oo[fresh], minlength=base[-1])
    k = _N_CLASSES
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(square - mean**2, 0)) / 5
    out[:, k + 2] = np.bincount(owner, same, base[-1]) / some
    out[:, k + 3] = distinct / some
    out[:, k + 4] = np.log1p(words) / 4
    out[:, k + 5] = np.bincount(owner, sizes == 1, base[-1]) / some
    out[:, k + 6] = np.bincount(owner, sizes > 15, base[-1]) / some
    signed = np.where(h & np.uint64(1 << 40), 1.0, -1.0)
    hashed = np.bincount(owner * _HASHED + ((h >> np.uint64(20)) % np.uint64(_HASHED)).astype(np.int64), signed, base[-1] * _HASHED)
    out[:, k + 8 :] = hashed.reshape(-1, _HASHED) / np.sqrt(some)[:, None] / 2
    return out, n_pass


def _sum_runs(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)


class AttentionMIL:
    """h = tanh(xE); weights softmax(w . (tanh(hV) * sigmoid(hU))); score sigmoid(c . sum(a h) + b)."""

    def __init__(self, features: int = FEATURES, hidden: int = 24, gate: int = 12, seed: int = 1):
        rng = np.random.default_rng(seed)
        def start(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"E": start(features, hidden), "V": start(hidden, gate), "U": start(hidden, gate), "w": start(gate, 1), "c": start(hidden, 1), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -40, 40)))
        e = np.exp(np.clip((v * u) @ p["w"], -40, 40))[:, 0]
        a = e / np.repeat(_sum_runs(e, n), n)
        z = _sum_runs(a[:, None] * h, n)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -40, 40)))[:, 0]
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y}

    def gradient(self, f: dict[str, np.ndarray], n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        dy = ((f["y"] - label) / len(label))[:, None]
        dz = np.repeat(dy @ p["c"].T, n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(_sum_runs(f["a"] * da, n), n))
        dg = ds[:, None] @ p["w"].T
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        return {"E": f["x"].T @ (dh * (1 - f["h"] ** 2)), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ ds[:, None], "c": f["z"].T @ dy, "b": dy.sum(axis=0)}

    def fit(self, x: np.ndarray, n: np.ndarray, label: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> AttentionMIL:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        ends = np.cumsum(n)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, t = np.random.default_rng(2), 0
        for epoch in range(epochs):
            order = rng.permutation(len(n))
            for lo in range(0, len(n), batch):
                bags = order[lo : lo + batch]
                rows = np.concatenate([np.arange(ends[i] - n[i], ends[i]) for i in bags])
                g = self.gradient(self.forward(x[rows], n[bags]), n[bags], label[bags])
                t += 1
                step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k in self.p:
                    d = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.999 * s[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.forward(x, n)["y"]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> AttentionMIL:
    """Fit on documents that have a quality label; pass only rows that may be learned from.

    Labels: (doc_id, quality). Null labels are left out; of several labels of a document the larger mean side
    wins (ties: 1). About ``max_train`` labelled documents are used, chosen by a hash of doc_id, so the driver
    holds a bounded sample. Without any label, or with one class only, the model scores about that class's share.
    """
    y = pick(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    rate = min(1.0, max_train / max(1, y.count()))
    chosen = F.broadcast(y.filter(unit_hash("doc_id", seed=1) < rate))
    rows = pick(docs, "doc_id", "text").filter(unit_hash("doc_id", seed=1) < rate).join(chosen, "doc_id").select("text", "_y")

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, xs, ns = texts_of(b.column(0)), [], []
        for lo, hi in slices(texts):
            x, n = passages(texts[lo:hi])
            xs.append(x)
            ns.append(n)
        x, n = np.concatenate(xs), np.concatenate(ns)
        ends = np.cumsum(n)
        return pa.RecordBatch.from_arrays([pa.array([x[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary()), b.column(1)], ["x", "y"])

    got = map_arrow(rows, encode, "x binary, y double").toArrow()
    model = AttentionMIL()
    if got.num_rows == 0:
        return model
    bags = sorted(zip(got["x"].to_pylist(), got["y"].to_pylist(), strict=True))
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b, _ in bags]).astype(np.float64)
    n = np.array([len(b) // (4 * FEATURES) for b, _ in bags])
    return model.fit(x, n, np.array([y for _, y in bags]))


def score(docs: DataFrame, model: AttentionMIL) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1, higher: label 1 likelier; replaces a column of that name in any case).

    Whole texts are scored; null and empty texts are bags of one blank passage. Nothing but the text is used.
    """
    own = [c for c in docs.columns if c.lower() != "score"]
    inner = aside(docs, "text")
    inner = inner.select([i for i, c in zip(inner.columns, docs.columns, strict=True) if c.lower() != "score"])
    names = inner.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(names.index("text")))
        parts = [model.score(*passages(texts[lo:hi])) for lo, hi in slices(texts)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts))], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    return map_arrow(inner, run, f"{schema}, score double").toDF(*own, "score")


def accept(docs: DataFrame, model: AttentionMIL, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more; all columns stay, whatever their names."""
    inner = aside(docs, "text")
    return score(inner, model).filter(F.col("score") >= least).select(inner.columns).toDF(*docs.columns)
