"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

The base patterns (an assignment to a telling name, an access key, a long hex run) always give spans.
Beside them every run of 20 or more token characters is a candidate of its text. For a candidate the
encoding is inferred (hex, base 32, base 36, base 64, ...), and three tests ask whether its symbols look
drawn from that alphabet at random: chi-squared uniformity, the runs test (runs of one class of characters, or
in an alphabet of one class of its lower or upper half), and serial correlation at lag one. Their p-values, as square roots of -2 log p, are combined by the
linear discriminant between drawn words and random draws of the encoding and length; the sum is small for
what looks random.

A secret is what the tests do not reject, so it is not their own p-values that false discoveries are
controlled by, but how rarely *words* come out as random: the p-value of a candidate is the share of word-like
tokens of its encoding and length whose sum is that small or smaller. It is found by importance sampling,
half from a model of words (letter frequencies and changes of character class) and half from random
draws, so that small shares are exact to a few per cent; lengths are rounded down to a class, which makes
shares larger. The shares of a text's candidates, weighted by length with mean weight 1, go through the
Benjamini-Hochberg step-up at level ``FDR``. What overlaps a base span is not reported again.

Cases: null and empty texts have no spans. Equal texts give equal spans. Long texts are scanned whole;
memory is in proportion to the text at hand. Null doc_ids and repeated rows are kept as they are; an
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20
FDR = 0.01
MASK = "[secret]"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_NAMES = re.compile(rb"passw|secret|token|api_?key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Bytes that base patterns' long runs and candidates are made of.
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True

#: Encodings from the narrowest on: what fits, its symbols in order of their values, and the classes of characters without which a narrower one fits.
_ALPHABETS = [(re.compile(p), symbols, needs) for p, symbols, needs in (
    (r"[0-9]+\Z", "0123456789", ()),
    (r"[0-9a-f]+\Z", "0123456789abcdef", (0,)),
    (r"[0-9A-F]+\Z", "0123456789ABCDEF", (1,)),
    (r"[a-z]+\Z", "abcdefghijklmnopqrstuvwxyz", ()),
    (r"[A-Z2-7]+=*\Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (1,)),
    (r"[0-9a-z]+\Z", "0123456789abcdefghijklmnopqrstuvwxyz", (0, 2)),
    (r"[0-9A-Z]+\Z", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 2)),
    (r"[A-Za-z0-9]+\Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (0, 1)),
    (r"[A-Za-z0-9_=-]+\Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (3,)),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", (3,)),
)]
_NEEDS = {symbols: needs for _, symbols, needs in _ALPHABETS}

# The percentage of each letter in running text, the mean of common Latin-script languages.
_LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.7, 1.4, 3.2, 4.2, 14.5, 1.4, 1.9, 3.0, 7.6, 0.4, 0.7, 4.2, 2.7, 8.0, 6.6, 2.2, 0.5, 6.6, 7.0, 7.2, 3.6, 1.0, 1.1, 0.3, 1.0, 0.7), strict=True))


def _class_of(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


#: How likely a class of character is to follow another in words and identifiers, by (before, after): lower, upper, digit, other.
_FOLLOWS = ((0.79, 0.07, 0.03, 0.11), (0.66, 0.22, 0.03, 0.09), (0.12, 0.08, 0.55, 0.25), (0.5, 0.15, 0.3, 0.05))


#: Tokens drawn for a null distribution, of each kind; candidates of 20 to 256 characters have classes of lengths.
DRAWS = 10_000
#: Drawn tokens that are judged at once, which bounds memory; results don't depend on it.
PIECE = 1000
LENGTHS = (20, 22, 24, 26, 28, 30, 32, 36, 40, 48, 56, 64, 80, 96, 128, 192, 256)


def encoding(token: str) -> str:
    """The symbols of the narrowest alphabet that the token fits, in order of their values."""
    return next(symbols for pattern, symbols, _ in _ALPHABETS if pattern.match(token))


def erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x.tolist()), float, len(x))


def p_values(v: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Chi-squared, runs and serial-correlation p-values (rows x 3) of rows of values: are they a uniform draw? ``groups``: that of each value."""
    (m, n), k = v.shape, len(groups)
    seen = np.zeros((m, k))
    np.add.at(seen, (np.arange(m)[:, None], v), 1)
    chi2 = ((seen - n / k) ** 2).sum(1) * k / n
    d = k - 1  # Wilson and Hilferty's cube root
    p_uniform = 0.5 * erfc(((chi2 / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) / math.sqrt(2))
    kind = groups[v]
    share = np.bincount(groups) / k
    q = 1 - (share**2).sum()
    runs = (kind[:, 1:] != kind[:, :-1]).sum(1)
    var = (n - 1) * q * (1 - q) + 2 * (n - 2) * ((share * (1 - share) ** 2).sum() - q * q)
    p_runs = erfc(np.abs(runs - (n - 1) * q) / math.sqrt(2 * var))
    x = v - v.mean(1, keepdims=True)
    total = (x * x).sum(1)
    serial = np.where(total > 0, (x[:, 1:] * x[:, :-1]).sum(1) / np.maximum(total, 1e-9), 1.0)
    p_serial = erfc(np.abs(serial + 1 / n) * math.sqrt(n / 2))
    return np.stack([p_uniform, p_runs, p_serial], 1)


def surprises(p: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(np.maximum(p, 1e-300)))


class Words:
    """Word-like tokens over an alphabet: a chain of character classes, and letters by frequency."""

    def __init__(self, symbols: str) -> None:
        self.kind = np.array([_class_of(c) for c in symbols])
        weight = np.array([_LETTERS[c.lower()] if c.isalpha() else 1.0 for c in symbols])
        self.classes = np.unique(self.kind)
        self.share = np.array([w / weight[self.kind == k].sum() for w, k in zip(weight, self.kind, strict=True)])
        follows = np.array(_FOLLOWS)[np.ix_(self.classes, self.classes)]
        self.follows = follows / follows.sum(1, keepdims=True)
        self.place = np.searchsorted(self.classes, self.kind)
        self.groups = self.place if len(self.classes) > 1 else (np.arange(len(symbols)) >= len(symbols) / 2).astype(np.int64)

    def draw(self, m: int, n: int, rng: np.random.Generator) -> np.ndarray:
        at = np.empty((m, n), np.uint8)
        at[:, 0] = rng.integers(0, len(self.classes), m)
        upto = self.follows.cumsum(1)
        for i in range(1, n):
            at[:, i] = np.minimum((rng.random(m)[:, None] > upto[at[:, i - 1]]).sum(1), len(self.classes) - 1)
        out = np.empty((m, n), np.uint8)
        for c in range(len(self.classes)):
            mine = np.flatnonzero(self.place == c)
            hit = at == c
            out[hit] = rng.choice(mine, hit.sum(), p=self.share[mine])
        return out

    def log_p(self, v: np.ndarray) -> np.ndarray:
        kinds = self.place[v]
        return np.log(self.share)[v].sum(1) + np.log(self.follows)[kinds[:, :-1], kinds[:, 1:]].sum(1) - math.log(len(self.classes))

    def narrowest(self, v: np.ndarray, needs: tuple) -> np.ndarray:
        """Whether a token has the classes without which a narrower alphabet fits it."""
        kinds = self.kind[v]
        return np.all([np.ones(len(v), bool), *((kinds == c).any(1) for c in needs)], axis=0)


@lru_cache(maxsize=1000)
def null(symbols: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups of symbols, how the tests are weighed for tokens of ``n`` symbols, the weighed sums of drawn tokens, ascending, and the share of words up to each."""
    rng, k, words = np.random.default_rng([n, len(symbols), sum(map(ord, symbols))]), len(symbols), Words(symbols)
    drawn, passed = [], []
    for draw in (lambda m: words.draw(m, n, rng), lambda m: rng.integers(0, k, (m, n))):
        kept, tried, got = [], 0, 0
        while got < DRAWS and tried < 50 * DRAWS:
            v = draw(DRAWS)
            v = v[words.narrowest(v, _NEEDS[symbols])].astype(np.uint8)
            kept.append(v)
            tried, got = tried + DRAWS, got + len(v)
        drawn.append(np.concatenate(kept)[:DRAWS])
        passed.append(max(got, 1) / tried)
    both, (m_words, m_random) = np.concatenate(drawn), map(len, drawn)
    pieces = [both[i : i + PIECE] for i in range(0, len(both), PIECE)]
    log_w, log_u = np.concatenate([words.log_p(x) for x in pieces]) - math.log(passed[0]), -n * math.log(k) - math.log(passed[1])
    weight = 1 / (np.exp(np.minimum(log_u - log_w, 700)) * m_random + m_words)
    found = surprises(np.concatenate([p_values(x.astype(np.int64), words.groups) for x in pieces]))
    a, b = found[:m_words], found[m_words:]
    spread = sum(np.cov(x.T) for x in (a, b) if len(x) > 3) + 1e-6 * np.eye(3)
    weighed = np.linalg.solve(spread, a.mean(0) - b.mean(0)) if len(a) and len(b) else np.ones(3)
    sums = found @ weighed
    order = np.argsort(sums)
    return words.groups, weighed, sums[order], np.minimum(1.0, np.cumsum(weight[order]))


def word_share(token: str) -> float:
    """The share of word-like tokens that look as random as ``token`` or more so."""
    symbols = encoding(token)
    if symbols.isdigit():
        return 1.0  # numbers are drawn alike, so digits alone say nothing
    place = {c: i for i, c in enumerate(symbols)}
    v = np.array([place[c] for c in token if c in place])
    n = max((x for x in LENGTHS if x <= len(v)), default=0)
    if not n:
        return 1.0
    groups, weighed, sums, share = null(symbols, n)
    at = int(np.searchsorted(sums, (surprises(p_values(v[None, :], groups)) @ weighed)[0], "right"))
    return float(share[at - 1]) if at else 1 / DRAWS**2


def accepted(candidates: list[str]) -> list[bool]:
    """The step-up over the candidates of one text, weighted by length."""
    m = len(candidates)
    mean = sum(map(len, candidates)) / m if m else 1.0
    scored = sorted((word_share(token) * mean / len(token), i) for i, token in enumerate(candidates))
    keep = max((k for k, (q, _) in enumerate(scored, 1) if q <= FDR * k / m), default=0)
    chosen = {i for _, i in scored[:keep]}
    return [i in chosen for i in range(m)]


def _long_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the runs of 20 or more token bytes."""
    stops = np.flatnonzero(~_TOKEN[np.frombuffer(raw, np.uint8)])
    edges = np.concatenate(([-1], stops, [len(raw)]))
    at = np.flatnonzero(np.diff(edges) > SHORTEST)
    return list(zip((edges[at] + 1).tolist(), edges[at + 1].tolist(), strict=True))


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all secrets in code points, sorted."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    if _NAMES.search(raw.lower()):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    runs = _long_runs(raw)
    if not runs:
        return sorted(found)
    if len(raw) != len(text):
        place = np.concatenate((np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1, [len(text)]))
        runs = [(int(place[a]), int(place[b])) for a, b in runs]
    tokens = []
    for a, b in runs:
        piece = text[a:b]
        found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(piece) if m.end() - m.start() >= 20]
        found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(piece) if m.end() - m.start() >= 24]
        tokens.append(piece)
    found.sort()
    for (a, b), yes in zip(runs, accepted(tokens), strict=True):
        if yes and not any(s < b and e > a for s, _, e in found):
            found.append((a, 3, b))
    return sorted(found)


def listed(some: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in some)


def masked(text: str | None) -> str | None:
    """The text with each stretch that secrets cover replaced by ``MASK``."""
    some = spans(text)
    if not some:
        return text
    out, at, upto = [], 0, -1
    for a, _, b in some:
        if a >= upto:
            out += [text[at:a], MASK]
        at = upto = max(upto, b)
    return "".join(out) + text[at:]


def _make_scan() -> Callable:
    def work(texts: list) -> dict:
        got = [spans(t) for t in texts]
        out = {f"n_{kind}": [sum(k == i for _, k, _ in s) for s in got] for i, kind in enumerate(KINDS)}
        base = [listed([x for x in s if x[1] < 3]) for s in got]
        return out | {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [listed(s) for s in got]}

    return work


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans."""
    return map_columns(docs, ["doc_id", "text"], "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", _make_scan)


def _make_mask() -> Callable:
    return lambda texts: {"text": [masked(t) for t in texts]}


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``MASK``; n_chars, if there, is counted anew. No row goes."""
    names = docs.columns
    rest = [c for c in names if c != "text"]
    out = map_columns(docs, [*rest, "text"], "text string", _make_mask)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))
    return out.select(*names)
