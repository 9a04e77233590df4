"""Language identification of mixed text: script ranges, word scores, and Viterbi with a switching penalty.

The model is a table of hashed character n-grams (1 to 4, with word edges), naive Bayes over the learned
languages. It is fitted to ``TRAIN_DOCS`` labelled documents at most, the first by a hash of their id,
outside the held-out fold; executors count n-grams, and only the counts, of fixed size, come to the driver.
A word's script (ranges of code points) narrows its candidates to the languages that were seen in that
script. The words of a text then get one label each by the best path over their scores, less ``SWITCH`` for
each change of label; runs of one label are spans.

If staying with the best single label can't be improved by any detour (no run of words gains more than a
detour must pay at least), that path is the best and the full recursion is left out; results are equal.

Cases: null text, and text without a letter, gives ``und``, score 0 and no span. Long texts are read whole.
Equal texts get equal results. Ties go to the label that sorts first. Null ids and repeated rows stay. With
nothing to learn from every text is ``und``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import CACHE_SIZE
from .common import doc_crc, map_columns

TRAIN_DOCS = 3000
BUCKETS = 1 << 15
GRAMS = 4
SWITCH = 12.0
#: What neighbouring n-grams share is counted several times; scores are scaled down for it.
SCALE = 0.4
UNKNOWN = "und"
#: Characters of texts handled together.
_PIECE = 1 << 20

_WORDS = re.compile(r"[^\W\d_]+").findall
_WORD_SPANS = re.compile(r"[^\W\d_]+").finditer

#: First and last code points of scripts; what is in none of them is script 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
_NAMES = sorted({s[0] for s in SCRIPTS})
_STARTS = np.array([s[1] for s in SCRIPTS])
_STOPS = np.array([s[2] for s in SCRIPTS])
_KINDS = np.array([_NAMES.index(s[0]) + 1 for s in SCRIPTS])
N_SCRIPTS = len(_NAMES) + 1


def script_of(points: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_STARTS, points, "right") - 1, 0)
    return np.where((points >= _STARTS[at]) & (points <= _STOPS[at]), _KINDS[at], 0)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lower-cased words: n-gram buckets, the word of each, and each word's script (that of its first letter)."""
    points = np.frombuffer(("\2" + "\3\2".join(words) + "\3").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.flatnonzero(points == 2)
    word = np.cumsum(points == 2) - 1
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, GRAMS + 1):
        m = len(points) - n + 1
        h = h[:m] * np.uint64(0x100000001B3) + (points[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        inside = word[:m] == word[n - 1 :]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed[inside] >> np.uint64(49)).astype(np.int64))
        owners.append(word[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners), script_of(points[begin + 1].astype(np.int64))


class Model:
    """Log-probabilities by bucket and language, and which scripts a language was seen in."""

    def __init__(self, langs: list[str], table: np.ndarray, seen: np.ndarray) -> None:
        self.langs, self.table, self.seen = langs, table, seen

    @classmethod
    def fitted(cls, counts: dict[str, np.ndarray]) -> Model:
        """From each language's counts of buckets, followed by those of words by script."""
        langs = sorted(counts)
        grid = np.stack([counts[x][:BUCKETS] for x in langs], 1).astype(float) if langs else np.zeros((BUCKETS, 0))
        scripts = np.stack([counts[x][BUCKETS:] for x in langs], 1).astype(float) if langs else np.zeros((N_SCRIPTS, 0))
        share = np.log((grid + 0.1) / (grid + 0.1).sum(0))
        seen = scripts > 0.001 * np.maximum(scripts.sum(0), 1)
        seen[~seen.any(1)] = True  # a script of no language leaves all of them
        return cls(langs, (share - share.mean(1, keepdims=True)).astype(np.float32) if langs else share.astype(np.float32), seen)

    def scores(self, words: list[str]) -> np.ndarray:
        if not self.langs:
            return np.zeros((len(words), 0), np.float32)
        bucket, owner, script = grams(words)
        order = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[order], np.arange(len(words)))
        got = np.add.reduceat(self.table[bucket[order]], at, axis=0) * SCALE
        got -= got.max(1, keepdims=True)
        return np.where(self.seen[script], got, got.min(1, keepdims=True) - SWITCH).astype(np.float32)


class Labeller:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model, switch: float = SWITCH) -> None:
        self.model, self.switch = model, switch
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)), np.float32)
        self.used = self.held = 0

    def learn(self, words: set[str]) -> None:
        """Score new words; words of marks without a letter get -1."""
        fresh = sorted(w for w in words if w not in self.at)
        if self.held > CACHE_SIZE:
            self.at, self.used, self.held = {}, 0, 0
            fresh = sorted(words)
        self.held += sum(map(len, fresh)) + 256 * len(fresh)
        letters = []
        for w in fresh:
            if w.isalpha() or any(c.isalpha() for c in w):
                self.at[w] = self.used + len(letters)
                letters.append(w)
            else:
                self.at[w] = -1
        if letters:
            need = self.used + len(letters)
            if need > len(self.rows):
                self.rows = np.concatenate((self.rows[: self.used], np.zeros((max(need, 2 * len(self.rows)) - self.used, self.rows.shape[1]), np.float32)))
            self.rows[self.used : need] = self.model.scores(letters)
            self.used = need

    def labels(self, at: np.ndarray) -> np.ndarray:
        """The best path's label for each of a text's words, given their places in ``rows``."""
        s = self.rows[at]
        total = s.sum(0, dtype=np.float64)
        best = int(total.argmax())
        if s.shape[1] == 1:
            return np.zeros(len(s), np.int64)
        others = np.delete(s, best, 1).max(1).astype(np.float64)
        gain = np.concatenate(([0.0], np.cumsum(others - s[:, best])))
        if (gain - np.minimum.accumulate(gain)).max() <= self.switch:
            return np.full(len(s), best)
        return self._viterbi(s)

    def _viterbi(self, s: np.ndarray) -> np.ndarray:
        k, switch = s.shape[1], self.switch
        value = s[0].tolist()
        came = []
        for row in s[1:].tolist():
            top = max(value)
            lead, jump = value.index(top), top - switch
            back = [i if v >= jump else lead for i, v in enumerate(value)]
            came.append(back)
            value = [(v if v >= jump else jump) + x for v, x in zip(value, row, strict=True)]
        path = [max(range(k), key=lambda i: (value[i], -i))]
        for back in reversed(came):
            path.append(back[path[-1]])
        return np.array(path[::-1])

    def predict(self, texts: list) -> list[tuple[str, float, int]]:
        """(label, its share of the letters, number of spans) of each text."""
        out: list[tuple[str, float, int]] = []
        held: list[list[str]] = []
        size = 0
        for t in texts:
            held.append(_WORDS(t.lower()) if t else [])
            size += len(t or "")
            if size > _PIECE:
                out += self._predict(held)
                held, size = [], 0
        return out + self._predict(held)

    def _predict(self, held: list[list[str]]) -> list[tuple[str, float, int]]:
        self.learn(set().union(*held) if held else set())
        out = []
        for words in held:
            at = np.array([self.at[w] for w in words], np.int64) if words else np.zeros(0, np.int64)
            real = at >= 0
            if not self.model.langs or not real.any():
                out.append((UNKNOWN, 0.0, 0))
                continue
            size = np.fromiter(map(len, words), np.int64, len(words))[real]
            labels = self.labels(at[real])
            share = np.bincount(labels, weights=size, minlength=len(self.model.langs))
            top = int(share.argmax())
            out.append((self.model.langs[top], float(share[top] / share.sum()), int(1 + (labels[1:] != labels[:-1]).sum())))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, label) of the runs of one label, in code points of the text."""
        found = [(m.start(), m.end(), m.group().lower()) for m in _WORD_SPANS(text or "")]
        self.learn({w for _, _, w in found})
        found = [f for f in found if self.at[f[2]] >= 0]
        if not found or not self.model.langs:
            return []
        labels = self.labels(np.array([self.at[w] for _, _, w in found])).tolist()
        out: list[tuple[int, int, str]] = []
        for (a, b, _), k in zip(found, labels, strict=True):
            lang = self.model.langs[k]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], b, lang)
            else:
                out.append((a, b, lang))
        return out


def held_out(doc_id: Column) -> Column:
    return doc_crc(doc_id) % 4 == 2


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learn from ``text`` and ``lang`` of the documents outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text").repartition(4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in _WORDS(text.lower()) if any(c.isalpha() for c in w)]
                if words:
                    bucket, _, script = grams(words)
                    into = sums.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    into[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    into[BUCKETS:] += np.bincount(script, minlength=N_SCRIPTS)
        yield pa.RecordBatch.from_pylist([{"lang": k, "n": v.tobytes()} for k, v in sums.items()], pa.schema([("lang", pa.string()), ("n", pa.binary())]))

    counts: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, n binary").collect():
        counts[row.lang] = counts.get(row.lang, 0) + np.frombuffer(row.n, np.int64)
    return Model.fitted(counts)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) for each row."""

    def make() -> Callable:
        labeller = Labeller(model)

        def work(texts: list) -> dict:
            got = labeller.predict(texts)
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "n_spans": [g[2] for g in got]}

        return work

    return map_columns(docs, ["doc_id", "text"], "lang_pred string, score double, n_spans long", make)


def labelled_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): a row for each span."""

    def make() -> Callable:
        labeller = Labeller(model)
        return lambda texts: {"spans": [[{"start": a, "end": b, "lang": x} for a, b, x in labeller.spans(t)] for t in texts]}

    return map_columns(docs, ["doc_id", "text"], "spans array<struct<start:bigint,end:bigint,lang:string>>", make).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
