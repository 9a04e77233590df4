"""SentencePiece encoding and decoding by a max-plus scan over chunks.

Encoding is a best path through the lattice of pieces, over the (max, +) semiring. The public vocabulary
file is a byte-pair model; its encoding is the one path whose neighbouring pieces are compatible (see
bpe_automaton), so edges weigh 0 or minus infinity, and results equal the library's.

A text over ``CHUNK`` characters is split into chunks that are rows of their own, dealt over the cluster.
The state at a chunk's border is the piece that ends at or reaches over it. Each chunk yields the matrix
of best weights from the states of its left border to those of its right border (``transfer``). Matrices
are combined by the max-plus product, which is associative; the final state then fixes every border's
state, going backwards, and each chunk is backtraced on its own. Where a chunk has a place that no piece can span (such as
before a space), all its left states meet there, so it is scanned once and not once for each state.

Decoding joins the pieces, resolves byte pieces, and drops the space that encoding puts in front.

Cases: null text gives null ids; empty text no ids. Characters outside the vocabulary become byte pieces.
Invalid surrogates don't occur in Spark strings. Very long texts are never held but for their chunks and
their row of ids. Null doc_ids and repeated rows give a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import CACHE_SIZE, Automaton
from .common import checkpointed, map_columns

#: Characters of a chunk.
CHUNK = 1 << 16
SPACE = "▁"
NONE = -np.inf


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary file, the automaton over its pieces, and caches of encoded words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in ids}
        score = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = Automaton(set(self.id_of), lambda joined, _: score.get(joined))
        self.reach = self.automaton.longest
        self.pieces = [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())]
        for i in range(sp.get_piece_size()):
            if sp.is_control(i):
                self.pieces[i] = b""
            elif sp.is_byte(i):
                self.pieces[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        joint = {(a, b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE and a != SPACE for a, b in joint):
            raise ValueError("pieces must not have a space after another character")
        self.joint = joint
        self.lone = "".join(c for c in "\n\r\t" if not any(c in pair for pair in joint))
        self.words = re.compile(self._word_pattern()).findall
        self._codes = _Memo(self._word, 3 * CACHE_SIZE // 2)
        self._parts = _Memo(self._part, CACHE_SIZE // 4)

    def _word_pattern(self) -> str:
        """Runs of letters, runs of anything else, each with the spaces before it, and runs of ``lone``: no piece spans two of them.

        A letter that some piece joins to another kind of character counts as one of that kind.
        """
        letter, others = re.compile(r"[^\W\d_]").match, ""
        pairs = [(a, b) for a, b in self.joint if a != SPACE]
        while mixed := {a if letter(a) else b for a, b in pairs if bool(letter(a)) != bool(letter(b))}:
            others += re.escape("".join(sorted(mixed)))
            letter = re.compile(rf"[^\W\d_{others}]").match
        lone = re.escape(self.lone)
        return rf"{SPACE}*[^\W\d_{others}]+|{SPACE}*(?:[^\w{SPACE}{lone}]+|[\d_{others}]+)+|{SPACE}+" + (f"|[{lone}]+" if lone else "")

    def ids_of(self, token: str) -> list[int]:
        """The ids of a piece, or the byte pieces of a character that isn't one."""
        got = self.id_of.get(token)
        return [got] if got is not None else [self.byte_id[b] for b in token.encode("utf-8", "surrogatepass")]

    def cuts(self, s: str) -> list[int]:
        """The places in ``s`` that no piece can span."""
        joint = self.joint
        return [i for i, pair in enumerate(zip(s, s[1:], strict=False), 1) if pair not in joint]

    def _part(self, part: str) -> bytes:
        out, id_of = array("i"), self.id_of
        for token in self.automaton.path(part):
            got = id_of.get(token)
            if got is not None:
                out.append(got)
            else:
                out.extend(self.ids_of(token))
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        cuts = self.cuts(word)
        if not cuts:
            return self._part(word)
        at, out = 0, []
        for cut in [*cuts, len(word)]:
            out.append(self._parts[word[at:cut]])
            at = cut
        return b"".join(out)

    def encode(self, normal: str) -> np.ndarray:
        """The ids of a normalised text or of a part that begins and ends where no piece can span."""
        return np.frombuffer(b"".join(map(self._codes.__getitem__, self.words(normal))), np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return raw[1:] if raw[:1] == " " else raw

    # The scan over chunks. A text here is normalised; a border's states are (a, b): the piece over a characters before it and b after.

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """The pieces that could end at or reach over the border between ``left`` and ``right``."""
        tokens, reach = self.automaton.tokens, self.reach
        return [(a, b) for a in range(1, min(reach, len(left)) + 1) for b in range(min(reach - a, len(right)) + 1) if a + b == 1 or left[len(left) - a :] + right[:b] in tokens]

    def transfer(self, text: str, begin: int, end: int) -> np.ndarray:
        """Weights from the states at ``begin`` to those at ``end`` of a text that holds what is around them.

        At the very start or end of the text there is one state, that of no piece.
        """
        into = self.states(text[:begin], text[begin:]) if begin else [(0, 0)]
        out = self.states(text[:end], text[end:]) if end < len(text) else [(0, 0)]
        m = np.full((len(into), len(out)), NONE)
        cut = self._first_cut(text, begin, end)
        shared = self._lasts(text, cut, end + self.reach) if cut is not None else None
        for i, (a, b) in enumerate(into):
            if cut is not None:
                if begin + b <= cut and self._reaches(text, begin, a, b, cut):
                    m[i] = self._ends(text, shared, cut, end, out)
            else:
                lasts = self.automaton.lasts(text, text[begin - a : begin + b], begin + b, min(len(text), end + self.reach))
                m[i] = self._ends_from(lasts, begin + b, (a, b), begin, end, out)
        return m

    def _first_cut(self, text: str, begin: int, end: int) -> int | None:
        return next((i for i in range(max(begin, 1), min(end, len(text) - 1) + 1) if (text[i - 1], text[i]) not in self.joint), None) if begin else 0

    def _last_cut(self, text: str, begin: int, end: int) -> int:
        return next(i for i in range(min(end, len(text) - 1), begin - 1, -1) if i == begin or (text[i - 1], text[i]) not in self.joint)

    def _reaches(self, text: str, begin: int, a: int, b: int, cut: int) -> bool:
        """Whether a path leads from a state at ``begin`` to the place ``cut``."""
        return begin + b == cut or self.automaton.lasts(text, text[begin - a : begin + b], begin + b, cut)[cut] > 0

    def _lasts(self, text: str, cut: int, upto: int) -> tuple[int, list]:
        """The last cut before ``upto``'s border and the last tokens from there on."""
        end = upto - self.reach
        at = self._last_cut(text, cut, end)
        stop = min(len(text), upto)
        part = self.automaton.lasts(text[at:stop])
        return at, part

    def _ends(self, text: str, shared: tuple[int, list], cut: int, end: int, out: list) -> list[float]:
        at, lasts = shared
        if out == [(0, 0)]:
            return [0.0]
        got = []
        for a, b in out:
            p = end + b - at
            got.append(0.0 if (p == 0 and end - a < at) or (0 < p < len(lasts) and lasts[p] == a + b) else NONE)
        # A border that is itself a cut is reached by the one piece that ends there.
        if at == end and end > cut:
            back = self._last_cut(text, cut, end - 1)
            last = self.automaton.lasts(text[back:end])[-1]
            got = [0.0 if (b == 0 and a == last) else NONE for a, b in out]
        elif at == end:
            got = [0.0 if b == 0 else NONE for _, b in out]
        return got

    def _ends_from(self, lasts: list, start: int, state: tuple, begin: int, end: int, out: list) -> list[float]:
        if out == [(0, 0)]:
            return [0.0 if end == start or lasts[end] else NONE]
        return [0.0 if (end + b < len(lasts) and lasts[end + b] == a + b and end + b > start) or (end + b == start and a + b == sum(state)) else NONE for a, b in out]

    def backtrace(self, text: str, begin: int, end: int, into: tuple[int, int], out: tuple[int, int]) -> np.ndarray:
        """The ids of the pieces that start at or after ``begin``, between two states."""
        start, stop = begin + into[1], end + out[1]
        if start >= stop:
            return np.zeros(0, np.int32)
        cuts = [i for i in range(start + 1, stop) if (text[i - 1], text[i]) not in self.joint]
        first, last = (cuts[0], cuts[-1]) if cuts else (stop, stop)
        before = text[begin - into[0] : start] if sum(into) and not (start and (text[start - 1], text[start]) not in self.joint) else None
        head = self._walk(self.automaton.lasts(text, before, start, first), text, start, first)
        if not cuts:
            return head
        return np.concatenate((head, self.encode(text[first:last]), self.encode(text[last:stop])))

    def _walk(self, lasts: list, text: str, start: int, stop: int) -> np.ndarray:
        ids: list[int] = []
        while stop > start:
            ids[:0] = self.ids_of(text[stop - lasts[stop] : stop])
            stop -= lasts[stop]
        return np.array(ids, np.int32)


class _Memo(dict):
    """A cache of a function's results, bounded by the characters of its keys."""

    def __init__(self, f: Callable, most: int) -> None:
        super().__init__()
        self.f, self.most, self.held = f, most, 0

    def __missing__(self, key):
        if self.held > self.most:
            self.clear()
            self.held = 0
        self.held += len(key) + 256
        got = self[key] = self.f(key)
        return got


def normal(text: str) -> str:
    """The text as pieces see it: a space in front, and spaces as a visible mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def resolve(matrices: list[np.ndarray]) -> list[int]:
    """The state at each border: prefix products forwards, then the best state backwards."""
    forward = [matrices[0]]
    for m in matrices[1:]:
        forward.append(plus(forward[-1], m))
    at = [int(forward[-1][0].argmax())]
    for k in range(len(matrices) - 1, 0, -1):
        at.append(int((forward[k - 1][0] + matrices[k][:, at[-1]]).argmax()))
    return [0, *at[::-1]]


def _loaded(path: str, _held: dict = {}) -> Pieces:  # noqa: B006 one for each Python worker
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _make_encode(path: str, decoded: bool) -> Callable:
    def make() -> Callable:
        pieces = _loaded(path)

        def work(texts: list) -> dict:
            ids = [None if t is None else pieces.encode(normal(t)) for t in texts]
            return {"ids": ids} | ({"decoded_sha256": [None if x is None else _digest(pieces.decode(x.tolist())) for x in ids]} if decoded else {})

        return work

    return make


def _chunk_columns(giants: DataFrame, chunk: int, reach: int) -> DataFrame:
    """A row for each chunk of a normalised text: row, part, parts, begin, end, around (with what is ``reach`` about it)."""
    # Positions count the normalised text, which has one character more in front.
    n = F.length("text") + 1
    cut = giants.withColumn("n", n).withColumn("parts", F.ceil(n / F.lit(chunk)).cast("int"))
    cut = cut.select("row", "n", "parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "text")
    low = F.greatest(F.lit(0), F.col("part") * chunk - reach)
    cut = cut.withColumn("low", low).withColumn("high", F.least("n", (F.col("part") + 1) * chunk + reach))
    around = F.expr(f"concat(if(low = 0, '{SPACE}', ''), replace(substring(text, if(low = 0, 1, low), high - low - if(low = 0, 1, 0)), ' ', '{SPACE}'))")
    return cut.select("row", "part", (F.col("part") * chunk - F.col("low")).alias("begin"), (F.least("n", (F.col("part") + 1) * chunk) - F.col("low")).alias("end"), (F.col("low") == 0).alias("first"), (F.col("high") == F.col("n")).alias("final"), around.alias("around"))


def encode_giants(giants: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(row long, text) to (row, ids), by chunks: transfer matrices, their combination, and backtracing."""
    reach = Pieces(path).reach
    chunks = checkpointed(_chunk_columns(giants, chunk, reach).repartition("row", "part"))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append({"row": r["row"], "part": r["part"], "m": pickle.dumps(pieces.transfer(r["around"], r["begin"], r["end"]))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("part", pa.int32()), ("m", pa.binary())]))

    def combine(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        at = resolve([pickle.loads(m) for m in pdf.m])
        return pd.DataFrame({"row": pdf.row, "part": pdf.part, "into": at[:-1], "out": at[1:]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, begin, end = r["around"], r["begin"], r["end"]
                into = (0, 0) if r["first"] and not begin else pieces.states(text[:begin], text[begin:])[r["into"]]
                leave = (0, 0) if end == len(text) else pieces.states(text[:end], text[end:])[r["out"]]
                out.append({"row": r["row"], "part": r["part"], "ids": pieces.backtrace(text, begin, end, into, leave)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    borders = chunks.mapInArrow(transfers, "row long, part int, m binary").groupBy("row").applyInPandas(combine, "row long, part int, into int, out int")
    parts = chunks.join(borders, ["row", "part"]).mapInArrow(traced, "row long, part int, ids array<int>")
    return parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, columns: list[str] | None = None, decoded: bool = False, name: str = "ids") -> DataFrame:
    """``columns`` (doc_id) of each row and ``ids array<int>``, called ``name``, as the library's encode gives them.

    ``decoded`` adds decoded_sha256: the ids are decoded again where they are made, and the text's digest kept.
    """
    path, columns = path or default_model(), columns or ["doc_id"]
    is_giant = F.length("text") > chunk
    added = "ids array<int>" + ", decoded_sha256 string" * decoded
    # The columns travel as one struct, so none of them meets a name used here.
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"), "text", is_giant.alias("giant"))
    small = map_columns(kept.where(~F.coalesce("giant", F.lit(False))), ["kept", "text"], added, _make_encode(path, decoded))
    giants = checkpointed(kept.where("giant").select(F.monotonically_increasing_id().alias("row"), "kept", "text"))
    if not giants.isEmpty():
        ids = checkpointed(encode_giants(giants.select("row", "text"), path, chunk))
        made = decode(ids, path, ["row"], True) if decoded else ids
        small = small.unionByName(giants.select("row", "kept").join(made, "row").drop("row"))
    return small.select("kept.*", F.col("ids").alias(name), *(["decoded_sha256"] if decoded else []))


def decode(encoded: DataFrame, path: str | None = None, columns: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``columns`` (doc_id) and the ``text`` of each row's ids; with ``digest`` the ids and decoded_sha256 instead."""
    path, columns = path or default_model(), columns or ["doc_id"]

    def make() -> Callable:
        pieces = _loaded(path)
        if digest:
            return lambda rows: {"decoded_sha256": [None if r is None else _digest(pieces.decode(r)) for r in rows]}
        return lambda rows: {"text": [None if r is None else pieces.decode(r) for r in rows]}

    return map_columns(encoded, [*columns, "ids"], "decoded_sha256 string" if digest else "text string", make, digest)
