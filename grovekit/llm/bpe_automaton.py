"""Byte-pair encoding as an automaton over last tokens.

A sequence of tokens is the byte-pair encoding of its text exactly if each token encodes to itself and
each two neighbours, encoded together, stay those two. So each prefix of a text has one last token, found
from the last tokens of shorter prefixes; no merge list has to be replayed over the text. In the
(max, +) semiring this is a path problem whose edges weigh 0 (allowed) or minus infinity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

#: Bytes, taken as 256 and the characters of each entry, that a cache holds before it is emptied.
CACHE_SIZE = 3 << 25


class Automaton:
    """Over str or bytes. ``tokens``: those that merges can make, and single symbols. ``rank(joined, left)``: lower merges first, None never."""

    def __init__(self, tokens: set, rank: Callable) -> None:
        self.tokens, self.rank = tokens, rank
        self.longest = max(map(len, tokens), default=1)
        self._pairs: dict = {}
        #: By token, how it is merged; bounded by the vocabulary.
        self._merges: dict = {}
        self._held = 0
        #: By its first four symbols, how long a token may be, longest first.
        lengths: dict = {}
        for t in tokens:
            if len(t) > 3:
                lengths.setdefault(t[:4], set()).add(len(t))
        self._ahead = {t: (*sorted(found, reverse=True), 3, 2, 1) for t, found in lengths.items()}

    def merged(self, s) -> list:
        """The encoding of a short ``s`` by merging, lowest rank and then leftmost first."""
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i] + parts[i + 1], parts[i])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merging(self, token) -> tuple:
        """How ``token`` is merged when it stands alone: the ranks in their order, its first and its last part before each of
        them and after all, and whether one part is left."""
        got = self._merges.get(token)
        if got is None:
            parts, ranks = [token[i : i + 1] for i in range(len(token))], []
            firsts, lasts = [parts[0]], [parts[-1]]
            while True:
                found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i] + parts[i + 1], parts[i])) is not None]
                if not found:
                    break
                r, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                ranks.append(r)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            got = ([*ranks, math.inf], firsts, lasts, len(parts) == 1)
            if token in self.tokens:
                self._merges[token] = got
        return got

    def _apart(self, before, token) -> bool:
        """Whether merging ``before + token`` leaves those two.

        Until a merge reaches over the border, each side is merged as if alone, so it is enough to run both in step, the
        lower rank first, and to look whether the parts at the border would merge sooner; of equal ranks the leftmost is first.
        """
        ranks, _, lasts, whole = self._merging(before)
        ranks2, firsts, _, whole2 = self._merging(token)
        i = j = 0
        x, y = lasts[0], firsts[0]
        across = self.rank(x + y, x)
        while whole and whole2:
            a, b = ranks[i], ranks2[j]
            if across is not None and across < a and across <= b:
                return False
            if a == b == math.inf:
                return True
            if a <= b:
                i += 1
                if lasts[i] == x:
                    continue
                x = lasts[i]
            else:
                j += 1
                if firsts[j] == y:
                    continue
                y = firsts[j]
            across = self.rank(x + y, x)
        return False

    def follows(self, before, token) -> bool:
        """Whether ``token`` may come right after ``before`` (empty: at the start)."""
        key = (before, token)
        got = self._pairs.get(key)
        if got is None:
            if self._held > CACHE_SIZE:
                self._pairs.clear()
                self._held = 0
            self._held += len(before) + len(token) + 256
            got = self._pairs[key] = self._apart(before, token) if before else self._merging(token)[3]
        return got

    def lasts(self, s, before=None, at: int = 0, upto: int | None = None) -> list:
        """For each position of ``s`` the length of the last token of the prefix that ends there, from ``at`` on.

        The path starts at ``at`` with the token ``before`` (None: nothing before). 0: no path ends there.
        """
        n = len(s) if upto is None else upto
        out = [0] * (n + 1)
        tokens, longest, pairs = self.tokens, self.longest, self._pairs
        empty = s[:0]
        for i in range(at + 1, n + 1):
            for j in range(max(at, i - longest), i):
                if j != at and not out[j]:
                    continue
                t = s[j:i]
                if t in tokens or i - j == 1:
                    b = (before or empty) if j == at else s[j - out[j] : j]
                    ok = pairs.get((b, t))
                    if ok or (ok is None and self.follows(b, t)):
                        out[i] = i - j
                        break
        return out

    def path(self, s) -> list:
        """The encoding of ``s``: depth first, longest token first; a place that leads nowhere is left for good,
        as all paths to it share their last token."""
        n, tokens, pairs, ahead = len(s), self.tokens, self._pairs, self._ahead
        if not n:
            return []
        starts, before, dead = [0], s[:0], set()
        i, tried = 0, iter(ahead.get(s[:4], (3, 2, 1)))
        waiting = []
        while True:
            for length in tried:
                e = i + length
                if e > n or e in dead:
                    continue
                t = s[i:e]
                if t in tokens or length == 1:
                    ok = pairs.get((before, t))
                    if ok or (ok is None and self.follows(before, t)):
                        break
            else:
                dead.add(starts.pop())
                tried, i = waiting.pop(), starts[-1]
                before = s[starts[-2] : i] if len(starts) > 1 else s[:0]
                continue
            starts.append(e)
            if e == n:
                return [s[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            waiting.append(tried)
            before, i = t, e
            tried = iter(ahead.get(s[i : i + 4], (3, 2, 1)))
