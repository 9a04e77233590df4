"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from the shares of its words and of
its pairs of neighbouring words in ``HASHED`` hash buckets, beside what can be counted in one pass over its
bytes (shares of character classes, shapes and repetition of its words), by a tanh layer. Gated attention,
softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of a bag; the weighted mean of their codes
goes to a logistic output. All weights are learned jointly by Adam from the labels of documents only; no
passage has a label.

The training set is bounded: ``TRAIN_DOCS`` labelled documents at most, the first by a hash of their id,
outside the held-out fold, and of the longer ones the first ``TRAIN_PASSAGES`` passages by a hash. Only these passages'
counts (not texts) come to the driver. Scoring covers every word of every document: texts are looked at in pieces of
whole passages of about ``_PIECE`` bytes, and what is kept of a piece are its passages' codes (about a byte for each byte
of text); a single word is never cut.

Cases: null and empty texts, and texts without words, are bags of one passage of zeros and get the score
of such a bag. Equal texts get equal scores. Labels that are null, or rows repeated in the labels (the
highest wins), are handled; without labels of both kinds the score is the share of label 1, or 0.5.
Null doc_ids count as empty text for the fold. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc, map_columns

PASSAGE = 64
TRAIN_DOCS = 2000
HIDDEN = 16
EPOCHS = 150
THRESHOLD = 0.3

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ".", ",", "!", "|", "?;:'\"()-/_")
_CLASS = np.full(256, len(_CLASSES), np.uint8)  # other ASCII
for _i, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(_CLASS, [0, 1, _N_CLASSES - 1])
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(64)], np.uint64)
#: Buckets of the words and pairs of words.
HASHED = 128
FEATURES = _N_CLASSES + 10 + HASHED
#: Passages of a training document at most.
TRAIN_PASSAGES = 256
#: Bytes of text looked at together.
_PIECE = 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: About as many whole passages as a piece holds, from a place in a long text on.
_SOME = re.compile(rb"[\x09-\x0d ]*(?:[^\x09-\x0d ]+[\x09-\x0d ]+){%d}" % (_PIECE // (8 * PASSAGE) * PASSAGE))


def encode(texts: list) -> list[np.ndarray]:
    """For each text its passages' features, an array of passages times FEATURES."""
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in mapped(texts, lambda table: table)]


def mapped(texts: list, work: Callable[[np.ndarray], np.ndarray]) -> list[list[np.ndarray]]:
    """``work`` over the passages' features of each text, piece by piece."""
    out: list[list[np.ndarray]] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        found = _encode(held) if held else []
        if found:
            edges = np.cumsum([0, *map(len, found)])
            done = work(np.concatenate(found))
            out.extend([done[a:b]] for a, b in zip(edges, edges[1:], strict=False))
        held, size = [], 0

    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) > _PIECE:
            flush()
            parts, at = [], 0
            while at < len(raw):
                found = _SOME.match(raw, at)
                end = found.end() if found else len(raw)
                if raw[at:end].strip() or not parts:
                    parts.append(work(_encode([raw[at:end]])[0]))
                at = end
            out.append(parts)
            continue
        held.append(raw)
        size += len(raw)
        if size > _PIECE:
            flush()
    flush()
    return out


def _encode(raws: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    doc_at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return [np.zeros((1, FEATURES), np.float32) for _ in raws]
    stop = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    length = stop - at
    doc = np.searchsorted(doc_at, at, "right") - 1
    words_of = np.bincount(doc, minlength=len(raws))
    rank = np.arange(len(at)) - np.concatenate(([0], np.cumsum(words_of)))[doc]
    opens = rank % PASSAGE == 0
    passage = np.cumsum(opens) - 1
    n = int(passage[-1]) + 1
    # A passage's bytes go up to the next passage or the end of its text.
    begin = at[opens]
    end = np.minimum(np.concatenate((begin[1:], [len(data)])), doc_at[doc[opens] + 1] - 1)
    spans = end - begin
    which = np.repeat(np.arange(n), spans)
    inside = np.arange(len(which)) + np.repeat(begin - np.concatenate(([0], np.cumsum(spans)[:-1])), spans)
    counts = np.bincount(which * _N_CLASSES + _CLASS[data[inside]], minlength=n * _N_CLASSES).reshape(n, -1)
    # Words by a polynomial hash of their first bytes.
    place = np.minimum(_places(len(data), at), 63)
    mixed = np.where(space, 0, data).astype(np.uint64) * _POWERS[place]
    codes = np.add.reduceat(mixed, at)
    letters = np.add.reduceat(_LETTER[data].astype(np.int64), at)
    same = np.zeros(len(at), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (rank[1:] > 0)
    near = same.copy()
    near[2:] |= (codes[2:] == codes[:-2]) & (rank[2:] > 1)
    key = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)))
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    distinct = np.bincount((key[fresh] >> np.uint64(32)).astype(np.int64), minlength=n)
    words = np.bincount(passage, minlength=n)

    def share(x: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=x, minlength=n) / words

    mean = share(length)
    cols = [
        mean / 10,
        np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean**2, 0)) / 10,
        share(same),
        share(near),
        distinct / words,
        share(letters == 0),
        share(_CLASS[data[at]] == 1),
        share(length > 12),
        share(length < 4),
        np.log1p(words) / 5,
    ]
    shift = np.uint64(64 - (HASHED - 1).bit_length())
    pairs = (codes[1:] * np.uint64(31) + codes[:-1]) * _GOLD
    joined = rank[1:] % PASSAGE > 0
    bucket = np.concatenate((codes * _GOLD >> shift, pairs[joined] >> shift)).astype(np.int64)
    hashed = np.bincount(np.concatenate((passage, passage[1:][joined])) * HASHED + bucket, minlength=n * HASHED).reshape(n, -1) / words[:, None]
    table = np.concatenate((counts / np.maximum(spans, 1)[:, None], np.stack(cols, 1), hashed), 1).astype(np.float32)
    per_doc = np.bincount(doc[opens], minlength=len(raws))
    edges = np.concatenate(([0], np.cumsum(per_doc)))
    empty = np.zeros((1, FEATURES), np.float32)
    return [table[edges[i] : edges[i + 1]] if per_doc[i] else empty for i in range(len(raws))]


def _places(n: int, at: np.ndarray) -> np.ndarray:
    """How far each byte is from the start of its word."""
    begin = np.zeros(n, np.int64)
    begin[at] = at
    return np.arange(n) - np.maximum.accumulate(begin)


class Model:
    """The learned weights. ``prior`` alone is used where there was nothing to learn."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray], prior: float | None = None) -> None:
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def codes(self, table: np.ndarray) -> np.ndarray:
        """The codes of passages by their features."""
        return np.tanh(((table - self.mean) / self.scale) @ self.weights["W"] + self.weights["b"]).astype(np.float32) if self.prior is None else np.zeros((len(table), 1), np.float32)

    def scores(self, texts: list) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        bags = [np.concatenate(x) if len(x) > 1 else x[0] for x in mapped(texts, self.codes)]
        sizes = np.array([len(b) for b in bags])
        return _pooled(np.concatenate(bags).astype(np.float64), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, self.weights)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(x: np.ndarray, at: np.ndarray, sizes: np.ndarray, w: dict) -> dict:
    return _pooled(np.tanh(x @ w["W"] + w["b"]), at, sizes, w)


def _pooled(h: np.ndarray, at: np.ndarray, sizes: np.ndarray, w: dict) -> dict:
    """Gated attention over the codes ``h`` of bags that begin ``at`` and have ``sizes`` passages."""
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    s = (t * g) @ w["w"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, at), sizes))
    a = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def gradient(x: np.ndarray, at: np.ndarray, sizes: np.ndarray, labels: np.ndarray, w: dict) -> dict:
    """Of the mean cross-entropy, by the weights."""
    f = _forward(x, at, sizes, w)
    err = (f["p"] - labels) / len(labels)
    dz = np.repeat(err[:, None] * w["c"], sizes, axis=0)
    da = (dz * f["h"]).sum(1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at), sizes))
    gate = ds[:, None] * w["w"]
    dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "d": err.sum()}


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN, decay: float = 1e-4, seed: int = 5) -> Model:
    """Fit encoder, attention and output together; full batches, so the order of documents doesn't matter."""
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(labels.mean()) if len(bags) else 0.5)
    sizes = np.array([len(b) for b in bags])
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    scale[-HASHED:] *= HASHED**0.5  # together they weigh no more than a few of the others
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,), "d": ()}
    w = {k: rng.normal(0, 0.3 if k != "W" else 0.1, s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    m1, m2 = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}
    for step in range(1, epochs + 1):
        grad = gradient(x, at, sizes, labels, w)
        for k in w:
            g = grad[k] + decay * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w[k] = w[k] - 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id) -> F.Column:
    return doc_crc(doc_id) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learn from ``labels`` (doc_id, quality) of the documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    bags = map_columns(texts, ["doc_id", "label", "text"], "bag binary", lambda: lambda ts: {"bag": [_sampled(b).tobytes() for b in encode(ts)]})
    rows = sorted(bags.collect())
    return train([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.label for r in rows], float))


def _sampled(bag: np.ndarray) -> np.ndarray:
    """``TRAIN_PASSAGES`` passages of a bag at most, by a fixed permutation."""
    return bag if len(bag) <= TRAIN_PASSAGES else bag[np.sort(np.random.default_rng(len(bag)).permutation(len(bag))[:TRAIN_PASSAGES])]


def scored(docs: DataFrame, model: Model, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """(doc_id, score) for each row of ``docs``, or ``columns`` and the score, called ``name``."""

    def make() -> Callable:
        return lambda texts: {name: model.scores(texts).tolist() if texts else []}

    keep = columns or ["doc_id"]
    return map_columns(docs, [*(c for c in keep if c != "text"), "text"], f"`{name}` double", make, "text" in keep)


def predicted(score: str = "score", threshold: float = THRESHOLD) -> F.Column:
    return F.when(F.col(score) >= threshold, 1).otherwise(0)
