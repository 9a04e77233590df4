"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers, compiled from the tokenizer's file, work one after the other.

* ``compile_transducer``: the splitting pattern over character classes. Its transitions say where a word begins
  (before this character, or before the one before it).
* ``WordTransducer``: the byte-pair merges over bytes. A state holds what the rest of a word can still depend on: the
  longest suffix that may go on to a token, the last token at each place of it, and how many tokens
  fewer each place has than the end. A transition on a byte is annotated with the tokens it adds, which
  may be none or negative where tokens merge; the sum along a word is its number of tokens. States and transitions
  are compiled when first taken, and a word's whole way from the start is kept as one transition.

All texts of a batch form one tape; a reset leads from every state to the start. The tape is cut into
chunks, and a chunk's state map tells for every state at its left where it ends. Maps are composed by a parallel
prefix scan (doubling); with each chunk's entry state known, all chunks run again at once and write out their
cuts. A text over ``LONG`` characters becomes chunk rows dealt over the cluster: their state maps are scanned
in the same way, then each chunk counts its whole words by itself and hands on what comes before its first cut
and after its last; these fragments, joined, are the words across borders.

A special string inside a text is one token and separates what is around it, as the library does by default.

Cases: null and empty texts have 0 tokens. Memory is bounded by a chunk and by the longest single word, and the
caches by the characters they hold. Null ids and repeated rows stay; an empty
table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import CACHE_SIZE, Automaton
from .common import checkpointed, map_columns

LIMIT = 512
#: Characters of a chunk of the tape, of a block of texts, and of a text that is not cut into rows.
CHUNK = 256
BLOCK = 1 << 20
LONG = 1 << 18

# Classes of characters. The letters by which contractions go on are classes of their own.
LETTER, SHORT, R_OR_V, E, L, NUMBER, BLANK, SPACE, QUOTE, OTHER, RESET = range(11)
# States. START: a word begins with the next character.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, ONE_BLANK, BLANKS, ONE_SPACE, SPACES, AT_QUOTE, QUOTE_R_V, QUOTE_L, CONTRACTED = range(12)
STATES = 12
_LETTERS = (LETTER, SHORT, R_OR_V, E, L)
HERE, BACK = 1, 2

# Unicode white space but for the blank.
_WHITE = (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cuts) by state and class; cuts are HERE and BACK, or both."""
    to, cut = np.zeros((STATES, 11), np.uint8), np.zeros((STATES, 11), np.uint8)
    begin = {c: IN_LETTERS for c in _LETTERS} | {NUMBER: IN_NUMBER, BLANK: ONE_BLANK, SPACE: ONE_SPACE, QUOTE: AT_QUOTE, OTHER: IN_OTHER}
    joined = begin | {QUOTE: IN_OTHER}  # after a blank that belongs to the word
    for state in range(STATES):
        for c, first in begin.items():
            to[state, c], cut[state, c] = first, HERE
        to[state, RESET], cut[state, RESET] = START, HERE
    # Characters that go on with the word at hand.
    for c in _LETTERS:
        to[IN_LETTERS, c], cut[IN_LETTERS, c] = IN_LETTERS, 0
    to[IN_NUMBER, NUMBER], cut[IN_NUMBER, NUMBER] = IN_NUMBER, 0
    for state in (IN_OTHER, AT_QUOTE):
        for c in (QUOTE, OTHER):
            to[state, c], cut[state, c] = IN_OTHER, 0
    # A blank belongs to the word after it; of more white space only the last blank does.
    for c, first in joined.items():
        if c not in (BLANK, SPACE):
            to[ONE_BLANK, c], cut[ONE_BLANK, c] = first, 0
            to[BLANKS, c], cut[BLANKS, c] = first, BACK
            cut[SPACES, c] = BACK | HERE
    for state in (ONE_BLANK, BLANKS, ONE_SPACE, SPACES):
        to[state, BLANK], cut[state, BLANK] = BLANKS, 0
        to[state, SPACE], cut[state, SPACE] = SPACES, 0
    # Contractions begin with a quote at the start of a word; if none comes of it, the quote stands alone.
    to[AT_QUOTE, SHORT], cut[AT_QUOTE, SHORT] = CONTRACTED, 0
    to[AT_QUOTE, R_OR_V], cut[AT_QUOTE, R_OR_V] = QUOTE_R_V, 0
    to[AT_QUOTE, L], cut[AT_QUOTE, L] = QUOTE_L, 0
    for state, last in ((QUOTE_R_V, E), (QUOTE_L, L)):
        for c in begin:
            cut[state, c] |= BACK
        cut[state, RESET] |= BACK
        for c in _LETTERS:
            cut[state, c] = BACK
        to[state, last], cut[state, last] = CONTRACTED, 0
    return to, cut


def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[list(_WHITE)] = SPACE
    table[32], table[39] = BLANK, QUOTE
    table[[ord(c) for c in "stmd"]] = SHORT
    table[[ord(c) for c in "rv"]], table[ord("e")], table[ord("l")] = R_OR_V, E, L
    return table


class WordTransducer:
    """Byte-pair encoding of words as a transducer whose transitions carry emitted-token counts."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.prefixes = {t[:i] for t in automaton.tokens for i in range(len(t))}
        self._clear()

    def _clear(self) -> None:
        #: State 0 is the start. ``states``: (suffix, last token at each place of it, tokens that the place has more than the end).
        self.states: list[tuple] = [(b"", (b"",), (0,))]
        self.ids = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.words: dict[str, int] = {"": 0}
        self.held = self.held_words = 0

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state, and the tokens that the byte adds."""
        got = self.moves[state].get(byte)
        return got if got is not None else self._compiled(state, byte)

    def _compiled(self, state: int, byte: int) -> tuple[int, int]:
        suffix, lasts, more = self.states[state]
        seen = suffix + bytes([byte])
        n, tokens, follows = len(seen), self.automaton.tokens, self.automaton.follows
        # The last token of the longer prefix is the one that may follow the last token in front of it.
        at = next(i for i in range(n) if (seen[i:] in tokens or i == n - 1) and follows(lasts[i], seen[i:]))
        added = more[at] + 1
        keep = next(i for i in range(n + 1) if seen[i:] in self.prefixes)
        new = (seen[keep:], (*lasts, seen[at:])[keep:], tuple(m - added for m in (*more, added))[keep:])
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
            self.held += 16 * len(new[0]) + 512
        got = self.moves[state][byte] = (to, added)
        return got

    def tokens_of(self, word: str) -> int:
        """The sum of counts along a word."""
        if self.held > 2 * CACHE_SIZE:
            self._clear()
        elif self.held_words > CACHE_SIZE:
            self.words, self.held_words = {"": 0}, 0
        state, total, moves = 0, 0, self.moves
        for byte in word.encode("utf-8", "surrogatepass"):
            got = moves[state].get(byte)
            state, added = got if got is not None else self._compiled(state, byte)
            total += added
        self.words[word] = total
        self.held_words += len(word) + 256
        return total


class Counter:
    """A tokenizer file's transducers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE tokenizer without a normaliser is needed")
        shown = _byte_letters()
        raw = lambda token: bytes(shown[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        automaton = Automaton({a + b for a, b in ranks} | {bytes([i]) for i in range(256)}, lambda joined, left: ranks.get((left, joined[len(left) :])))
        self.byte_pairs = WordTransducer(automaton)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.to, self.cut = compile_transducer()
        self.classes = class_table()

    def tokens_of(self, word: str) -> int:
        """How many tokens a word emits."""
        got = self.byte_pairs.words.get(word)
        return self.byte_pairs.tokens_of(word) if got is None else got

    def maps(self, tape: np.ndarray) -> np.ndarray:
        """The state map of a whole tape: where each state at its left leads."""
        n = len(tape)
        rest = np.arange(STATES, dtype=np.uint8)
        if n >= CHUNK:
            lanes = n // CHUNK
            rest = self._prefixes(np.ascontiguousarray(tape[: lanes * CHUNK].reshape(lanes, CHUNK).T))[-1]
        for c in tape[n - n % CHUNK :].tolist():
            rest = self.to[rest, c]
        return rest

    def _prefixes(self, steps: np.ndarray) -> np.ndarray:
        """Of chunks, the columns of ``steps``: where each state at the tape's left leads at the end of each chunk."""
        lanes, flat = steps.shape[1], self.to.ravel()
        maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
        for c in steps:
            maps = flat[maps.astype(np.int16) * 11 + c[:, None]]
            if (maps == maps[:, :1]).all():  # all states have met in every chunk; one run stands for all
                break
        if (maps == maps[:, :1]).all():
            state = np.zeros(lanes, np.uint8)
            for c in steps:
                state = flat[state.astype(np.int16) * 11 + c]
            maps = np.repeat(state[:, None], STATES, 1)
        return scanned(maps)

    def run(self, tape: np.ndarray, start: int = START) -> tuple[np.ndarray, bool]:
        """Where words begin on a tape of classes that starts in ``start``, and whether one begins at the character before it."""
        n = len(tape)
        lanes = -(-n // CHUNK)
        padded = np.full(lanes * CHUNK, RESET, np.uint8)
        padded[:n] = tape
        steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        flat, cut = self.to.ravel(), self.cut.ravel()
        maps = self._prefixes(steps)
        state = np.concatenate(([start], maps[:-1, start])).astype(np.uint8)
        cuts = np.empty((CHUNK, lanes), np.uint8)
        for t, c in enumerate(steps):
            at = state.astype(np.int16) * 11 + c
            cuts[t] = cut[at]
            state = flat[at]
        marks = cuts.T.ravel()[:n]
        begins = (marks & HERE) > 0
        begins[:-1] |= (marks[1:] & BACK) > 0
        return begins, bool(n and marks[0] & BACK)

    def counts(self, texts: list) -> list[int]:
        """Tokens of each text; None counts as empty."""
        total = [0] * len(texts)
        parts: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for k, piece in enumerate(self._pieces(text or "")):
                total[i] += k > 0
                if piece:
                    parts.append((i, piece))
                    size += len(piece)
            if size > BLOCK:
                self._count(parts, total)
                parts, size = [], 0
        self._count(parts, total)
        return total

    def _pieces(self, text: str) -> list[str]:
        """What is around the special strings."""
        pieces = [text]
        for s in self.special:
            if s in text:
                pieces = [q for p in pieces for q in p.split(s)]
        return pieces

    def _tape(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _count(self, parts: list[tuple[int, str]], total: list[int]) -> None:
        if not parts:
            return
        # A reset after each text; the character there is in no word.
        tape = self._tape("\0".join(t for _, t in parts) + "\0")
        ends = np.cumsum([len(t) + 1 for _, t in parts])
        tape[ends - 1] = RESET
        begins, _ = self.run(tape)
        begins[0] = begins[ends[:-1]] = True
        at = np.flatnonzero(begins)
        low, tokens_of = 0, self.byte_pairs.words.get
        edges = np.searchsorted(at, ends)
        for (i, text), end, k0, k1 in zip(parts, ends.tolist(), np.concatenate(([0], edges[:-1])).tolist(), edges.tolist(), strict=True):
            cuts = (at[k0:k1] - low).tolist()
            if cuts[-1] == len(text):
                cuts.pop()
            for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
                word = text[a:b]
                n = tokens_of(word)
                total[i] += self.tokens_of(word) if n is None else n
            low = end

    def part(self, text: str, start: int, tail: str = "") -> tuple[str | None, int, str, bool]:
        """Of a chunk entered in ``start``: what comes before its first cut (None: it has none), the tokens of its whole words, what comes after its last, and whether it took the character before it.

        ``tail`` is the character before the chunk. It is counted with the chunk if a word begins there.
        """
        begins, back = self.run(self._tape(text), start)
        at = np.flatnonzero(begins).tolist()
        if taken := back and bool(tail):
            text, at = tail + text, [0, *(x + 1 for x in at)]
        if not at:
            return None, 0, text, taken
        return text[: at[0]], sum(self.tokens_of(text[a:b]) for a, b in zip(at, at[1:], strict=False)), text[at[-1] :], taken


def scanned(maps: np.ndarray) -> np.ndarray:
    """Composed state maps, by doubling: after it row i leads from the left of the first to the right of the i-th."""
    maps, hop = maps.copy(), 1
    while hop < len(maps):
        maps[hop:] = np.take_along_axis(maps[hop:], maps[:-hop].astype(np.intp), 1)
        hop *= 2
    return maps


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _loaded(path: str, _held: dict = {}) -> Counter:  # noqa: B006 one for each Python worker
    if path not in _held:
        _held[path] = Counter(path)
    return _held[path]


def _long_counts(texts: DataFrame, path: str, long: int) -> DataFrame:
    """(row, n_tokens) of long texts (row, text): chunks as rows, their maps scanned, their counts and fragments joined."""
    special = "|".join(re.escape(s) for s in _loaded(path).special)
    pieces = F.split("text", special, -1) if special else F.array("text")
    pieces = texts.select("row", F.posexplode(pieces).alias("piece", "text"))
    n = F.length("text")
    cut = pieces.select("row", "piece", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / F.lit(long)) - 1).cast("int"))).alias("part"))
    low = F.col("part") * long
    cut = cut.select("row", "piece", "part", F.when(low > 0, F.expr(f"substring(text, part * {long}, 1)")).otherwise("").alias("tail"), F.expr(f"substring(text, part * {long} + 1, {long})").alias("text"))
    chunks = checkpointed(cut.repartition("row", "piece", "part"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(path)
        for batch in batches:
            found = [counter.maps(counter._tape(t)).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.binary())], ["row", "piece", "part", "map"])

    def entries(pdf):
        pdf = pdf.sort_values("part")
        ends = scanned(np.stack([np.frombuffer(m, np.uint8) for m in pdf["map"]]))[:, START]
        return pdf[["row", "piece", "part"]].assign(start=[START, *ends[:-1].tolist()])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(path)
        for batch in batches:
            rows = batch.to_pylist()
            found = [counter.part(r["text"], r["start"], r["tail"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in rows], kind) for c, kind in (("row", pa.int64()), ("piece", pa.int32()), ("part", pa.int32()))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.bool_())],
                ["row", "piece", "part", "head", "n", "last", "taken"],
            )

    def joined(pdf):
        import pandas as pd

        counter, total = _loaded(path), 0
        for _, parts in pdf.sort_values(["piece", "part"]).groupby("piece"):
            open_: list[str] = []
            for head, n, last, taken in zip(parts["head"], parts["n"], parts["last"], parts["taken"], strict=True):
                if taken and open_:
                    open_[-1] = open_[-1][:-1]
                if head is not None:
                    total += counter.tokens_of("".join([*open_, head])) + int(n)
                    open_ = []
                open_.append(last)
            total += counter.tokens_of("".join(open_))
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "n": [total + int(pdf["piece"].max())]})

    starts = chunks.select("row", "piece", "part", "text").mapInArrow(mapped, "row long, piece int, part int, map binary").groupBy("row", "piece").applyInPandas(entries, "row long, piece int, part int, start int")
    key = ["row", "piece", "part"]
    parts = chunks.join(starts, key).select(*key, "start", "tail", "text").mapInArrow(counted, "row long, piece int, part int, head string, n long, last string, taken boolean")
    return parts.groupBy("row").applyInPandas(joined, "row long, n long")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, long: int = LONG) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row."""
    path = path or default_path()

    def make() -> Callable:
        counter = _loaded(path)
        return lambda texts: {"n_tokens": counter.counts(texts)}

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    kept = docs.select("doc_id", n_bytes.alias("n_bytes"), "text", F.coalesce(F.length("text") > long, F.lit(False)).alias("giant"))
    found = map_columns(kept.where("not giant"), ["doc_id", "n_bytes", "text"], "n_tokens long", make)
    giants = checkpointed(kept.where("giant").select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text"))
    if not giants.isEmpty():
        counts = checkpointed(_long_counts(giants.select("row", "text"), path, long))
        found = found.unionByName(giants.join(counts, "row").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
