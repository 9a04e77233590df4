"""Whole repositories as arrays in one task: ids stay in Arrow, commits are numbers, parents one flat array.

A commit costs a few numbers besides its id, so a repository of millions of commits fits in a task. Small
repositories share a graph. Results leave in batches of ``CHUNK`` rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows in a batch of results.
CHUNK = 20_000
#: Rows up to which whole repositories are gathered in one graph.
TOGETHER = 20_000
#: Ids that are hashed or looked up at a time.
STEP = 1 << 14
#: Bytes that the sets of roots of one pass may take.
SET_BYTES = 48 << 20


class Texts:
    """Texts end to end in one buffer, without the batches that they came in."""

    def __init__(self) -> None:
        self.data, self.sizes, self.nulls = bytearray(), array("i"), array("q")

    def add(self, texts: pa.Array) -> None:
        if texts.null_count:
            self.nulls.frombytes((np.flatnonzero(texts.is_null().to_numpy(zero_copy_only=False)) + len(self.sizes)).tobytes())
            texts = texts.fill_null("")
        offsets, data = _buffers(texts)
        self.data += data[offsets[0] : offsets[-1]].data
        self.sizes.frombytes(np.diff(offsets).astype(np.int32).tobytes())

    def array(self) -> pa.Array:
        n, large, valid = len(self.sizes), len(self.data) > np.iinfo(np.int32).max, None
        offsets = _sums(self.sizes, np.int64 if large else np.int32)
        if self.nulls:
            there = np.ones(n, bool)
            there[np.frombuffer(self.nulls, np.int64)] = False
            valid = pa.py_buffer(np.packbits(there, bitorder="little"))
        return pa.Array.from_buffers(pa.large_string() if large else pa.string(), n, [valid, pa.py_buffer(offsets), pa.py_buffer(self.data)], len(self.nulls))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of texts, and the bytes that these point into."""
    kind, (_, offsets, data) = np.int64 if pa.types.is_large_string(texts.type) else np.int32, texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    return offsets, np.frombuffer(data or b"", np.uint8)


def _sums(sizes: array, kind: type = np.int32) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, kind)
    np.cumsum(np.frombuffer(sizes, np.int32), out=out[1:])
    return out


class Rows:
    """Rows of whole repositories as they come: (repo, commit_id, parents, other columns); batches are copied and let go."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.n, self.repos, self.codes = 0, {}, array("i")
        self.ids, self.parents, self.counts, self.columns = Texts(), Texts(), array("i"), {}

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        self.n += batch.num_rows
        repo, ids, lists = batch.columns[:3]
        repo = repo.dictionary_encode("encode")
        known = np.array([self.repos.setdefault(x, len(self.repos)) for x in repo.dictionary.to_pylist()], np.int32)
        self.codes.frombytes(known[repo.indices.to_numpy()].tobytes())
        self.ids.add(ids)
        self.counts.frombytes(pc.list_value_length(lists).fill_null(0).cast(pa.int32()).to_numpy().tobytes())
        self.parents.add(pc.list_flatten(lists))
        for name, column in zip(batch.schema.names[3:], batch.columns[3:], strict=True):
            self.columns.setdefault(name, []).append(column.take(pa.array(np.arange(len(column), dtype=np.int32))))

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        out = cls()
        for batch in table.to_batches():
            out.add(batch)
        return out


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows of whole repositories from batches in which each repository's rows (its name is column 0) are neighbours."""
    rows, last = Rows(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        cuts = (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
        if rows.n and batch.column(0)[0].as_py() != last:
            cuts = [0, *cuts]
        at = 0
        for c in cuts:
            if rows.n + c - at >= TOGETHER:
                rows.add(batch.slice(at, c - at))
                yield rows
                rows, at = Rows(), c
        rows.add(batch.slice(at))
        last = batch.column(0)[-1].as_py()
    if rows.n:
        yield rows


def numbers(x: np.ndarray) -> array:
    """As ``array``, of which single elements are read faster."""
    out = array("i")
    out.frombytes(np.ascontiguousarray(x, np.int32).tobytes())
    return out


def bits_of(x: int) -> int:
    """A set from its packed form."""
    return x if x >= 0 else 1 << ~x


class Graph:
    """Commits 0 to n - 1, by repository and id; ``parents[starts[c]:starts[c + 1]]`` are those of commit c that are in the table."""

    def __init__(self, rows: Rows | pa.Table) -> None:
        """``rows`` are used up."""
        rows = Rows.of(rows) if isinstance(rows, pa.Table) else rows
        self._names, codes = pa.array(list(rows.repos), pa.string()), pa.Array.from_buffers(pa.int32(), rows.n, [None, pa.py_buffer(rows.codes)])
        ids, flat, offsets = rows.ids.array(), rows.parents.array(), _sums(rows.counts)
        self._columns = {name: pa.chunked_array(some).combine_chunks() for name, some in rows.columns.items()}
        rows.clear()
        before, after = (codes.slice(0, len(codes) - 1), ids.slice(0, len(ids) - 1)), (codes.slice(1), ids.slice(1))
        if not pc.all(pc.or_(pc.greater(after[0], before[0]), pc.and_(pc.equal(after[0], before[0]), pc.greater_equal(after[1], before[1]))), skip_nulls=False).as_py():
            by = pc.sort_indices(pa.table({"r": codes, "c": ids}), sort_keys=[("r", "ascending"), ("c", "ascending")])
            flat, offsets = self._chosen(flat, offsets, by)
            codes, ids, self._columns = codes.take(by), ids.take(by), {name: x.take(by) for name, x in self._columns.items()}
            before, after = (codes.slice(0, len(codes) - 1), ids.slice(0, len(ids) - 1)), (codes.slice(1), ids.slice(1))
        twice = pc.and_(pc.equal(after[0], before[0]), pc.equal(after[1], before[1]))
        if pc.any(twice).as_py():  # of repeated commits one row stays
            last = pa.array(np.flatnonzero(np.append(~twice.fill_null(False).to_numpy(zero_copy_only=False), True)))
            flat, offsets = self._chosen(flat, offsets, last)
            codes, ids, self._columns = codes.take(last), ids.take(last), {name: x.take(last) for name, x in self._columns.items()}
        del before, after, twice
        self.n, self.ids, self.codes = len(ids), ids, codes
        index, found = self._index(), array("i")
        for i in range(0, self.n, STEP):
            ends = offsets[i : i + STEP + 1]
            of = np.repeat(np.arange(i, i + len(ends) - 1), np.diff(ends))
            found.frombytes(self._place(index, of, flat.slice(ends[0], ends[-1] - ends[0])).tobytes())
        del index, flat
        there = np.frombuffer(found, np.int32) >= 0
        if not there.all():
            offsets = np.append(np.int32(0), np.cumsum(there, dtype=np.int32))[offsets]
            found = numbers(np.frombuffer(found, np.int32)[there])
        self.starts, self.parents = numbers(offsets), found

    @staticmethod
    def _chosen(flat: pa.Array, offsets: np.ndarray, of: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The lists of the rows ``of``, end to end."""
        of = of.to_numpy()
        sizes = np.diff(offsets)[of]
        ends = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
        return flat.take(pa.array(np.repeat(offsets[of] - ends[:-1], sizes) + np.arange(ends[-1]))), ends

    def _hashes(self, ids: pa.Array, codes: np.ndarray) -> np.ndarray:
        """A number for each id of a repository; equal ids have equal numbers, others hardly ever."""
        offsets, data = _buffers(ids)
        data = data[offsets[0] : offsets[-1]].astype(np.uint64)
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        powers = np.cumprod(np.full(int(sizes.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
        data += np.uint64(1)
        data *= powers[np.arange(len(data)) - np.repeat(offsets[:-1], sizes)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data)))
        out = sums[offsets[1:]] - sums[offsets[:-1]] + codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(32)
        return out * np.uint64(0xFF51AFD7ED558CCD)

    @property
    def _bits(self) -> np.uint64:
        """The low bits of the index, which say whose a hash is."""
        return np.uint64(max(1, (self.n - 1).bit_length()))

    def _index(self) -> np.ndarray:
        """The upper bits of the commits' hashes, each with its commit's number below them, in order."""
        codes, out, bits = self.codes.to_numpy(), np.empty(self.n, np.uint64), self._bits
        for i in range(0, self.n, STEP):
            hashes = self._hashes(self.ids.slice(i, STEP), codes[i : i + STEP])
            out[i : i + STEP] = hashes >> bits << bits | np.arange(i, i + len(hashes), dtype=np.uint64)
        out.sort()
        return out

    def _place(self, index: np.ndarray, of: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Numbers of the commits ``ids`` in the repositories of the commits ``of``, -1 where there is none. Hashes find them, ids are compared."""
        codes, out, bits = self.codes.to_numpy(), np.full(len(ids), -1, np.int32), self._bits
        for i in range(0, len(ids), STEP):
            asked, mine = ids.slice(i, STEP), codes[of[i : i + STEP]]
            want = self._hashes(asked, mine) >> bits
            at, left = np.searchsorted(index, want << bits), np.arange(len(asked))
            while len(left := left[(at[left] < self.n) & (index[np.minimum(at[left], self.n - 1)] >> bits == want[left])]):
                c = (index[at[left]] & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int32)
                ours, theirs = (x.take(pa.array(k)).cast(pa.large_string()) for x, k in ((self.ids, c), (asked, left)))
                same = pc.equal(ours, theirs).fill_null(False).to_numpy(zero_copy_only=False) & (codes[c] == mine[left])
                out[i + left[same]] = c[same]
                left = left[~same]
                at[left] += 1
        return out

    def column(self, name: str) -> pa.Array:
        return self._columns[name]

    def flags(self, name: str) -> bytes:
        """A boolean column, a byte for each commit; null counts as false."""
        return self.column(name).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()

    def encoded(self, name: str, value: str) -> tuple[array, int]:
        """A text column as numbers, equal for equal texts, and the number of ``value`` (-2 if it is nowhere)."""
        x = self.column(name).dictionary_encode("encode")
        return numbers(x.indices.to_numpy()), next(iter(pc.indices_nonzero(pc.equal(x.dictionary, value)).to_pylist()), -2)

    def empty(self, name: str) -> bytes:
        """Whether a text column is empty, a byte for each commit; null is not."""
        return pc.equal(self.column(name), "").fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()

    def as_parent(self, name: str) -> bytearray:
        """A byte for each of ``parents``: whether a column has the same value there as in the commit itself, null being one."""
        x, parents, out = self.column(name), np.frombuffer(self.parents, np.int32), bytearray()
        of = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(np.frombuffer(self.starts, np.int32)))
        for i in range(0, len(parents), STEP):
            a, b = x.take(pa.array(parents[i : i + STEP])), x.take(pa.array(of[i : i + STEP]))
            same = pc.or_(pc.equal(a, b).fill_null(False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out += same.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
        return out

    def found(self, name: str) -> array:
        """A column of ids of the same repository as numbers, -1 where there is none."""
        return numbers(self._place(self._index(), np.arange(self.n), self.column(name)))

    def named(self, of: np.ndarray | list | array) -> pa.Array:
        """Ids of commits; -1 is null."""
        of = np.asarray(of, np.int64)
        return self.ids.take(pa.array(of, mask=of < 0))

    def repos(self, of: np.ndarray | list | array) -> pa.Array:
        return self._names.take(self.codes.take(pa.array(np.asarray(of, np.int64))))

    def listed(self, of: list[int], sizes: list[int]) -> pa.Array:
        """Lists of ids, of the given sizes."""
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), self.named(of))

    @cached_property
    def order(self) -> array:
        """Parents before children, without recursion."""
        starts, parents, done, out, stack = self.starts, self.parents, bytearray(self.n), array("i"), array("i")
        for start in range(self.n):
            if not done[start]:
                stack.append(start)
            while stack:
                x = stack.pop()
                if x < 0:
                    out.append(~x)
                elif not done[x]:
                    done[x] = 1
                    stack.append(~x)
                    for k in range(starts[x + 1] - 1, starts[x] - 1, -1):
                        if not done[parents[k]]:
                            stack.append(parents[k])
        place = np.empty(self.n, np.int32)
        place[np.frombuffer(out, np.int32)] = np.arange(self.n, dtype=np.int32)
        ends, of = np.frombuffer(starts, np.int32), np.frombuffer(parents, np.int32)
        for i in range(0, self.n, STEP):
            some = ends[i : i + STEP + 1]
            if (place[of[some[0] : some[-1]]] >= np.repeat(place[i : i + STEP], np.diff(some))).any():
                raise ValueError("a commit is its own ancestor")
        return out

    @cached_property
    def seq(self) -> array:
        """One more than the highest parent's, 0 for roots."""
        starts, parents, seq = self.starts, self.parents, numbers(np.zeros(self.n))
        for c in self.order:
            top = -1
            for k in range(starts[c], starts[c + 1]):
                if seq[parents[k]] > top:
                    top = seq[parents[k]]
            seq[c] = top + 1
        return seq

    @cached_property
    def levels(self) -> array:
        """All commits by ``seq``: parents first, and soon after each commit what needs it."""
        return numbers(np.argsort(np.frombuffer(self.seq, np.int32), kind="stable"))

    @cached_property
    def last_use(self) -> array:
        """The place in ``levels`` of each commit's last child, -1 where there is none."""
        place = np.empty(self.n, np.int32)
        place[np.frombuffer(self.levels, np.int32)] = np.arange(self.n, dtype=np.int32)
        last = np.full(self.n, -1, np.int32)
        np.maximum.at(last, np.frombuffer(self.parents, np.int32), np.repeat(place, np.diff(np.frombuffer(self.starts, np.int32))))
        return numbers(last)

    @cached_property
    def widest(self) -> int:
        """The most commits that, at some place of ``levels``, are still to be used."""
        last = np.frombuffer(self.last_use, np.int32)
        change = np.zeros(self.n + 1, np.int64)
        change[: self.n] += last[np.frombuffer(self.levels, np.int32)] >= 0
        np.subtract.at(change, last[last >= 0], 1)
        return int(change.cumsum().max())

    @cached_property
    def ranks(self) -> tuple[array, array, int]:
        """Each root's rank among its repository's, -1 for others; the numbers of roots by repository and rank; and the most roots of a repository."""
        roots = np.flatnonzero(np.diff(np.frombuffer(self.starts, np.int32)) == 0)
        of = self.codes.to_numpy()[roots]
        first = np.searchsorted(of, of)  # commits are sorted by repository
        rank = np.full(self.n, -1, np.int64)
        rank[roots] = np.arange(len(roots)) - first
        return numbers(rank), numbers(roots), int(rank.max(initial=-1)) + 1

    def root_sets(self, low: int = 0, width: int | None = None) -> Iterator[tuple[int, int]]:
        """(commit, the bits of its roots of ranks ``low`` to ``low + width - 1``), by ``levels``."""
        return ((c, bits_of(x)) for c, x in self.packed_sets(low, width))

    def packed_sets(self, low: int = 0, width: int | None = None) -> Iterator[tuple[int, int]]:
        """``root_sets`` as they are held until their last use: a single root is ~ its bit's place, and of equal sets that meet one is held."""
        starts, parents, last, rank = self.starts, self.parents, self.last_use, self.ranks[0]
        width = self.ranks[2] if width is None else width
        held: list = [None] * self.n
        for i, c in enumerate(self.levels):
            a, b = starts[c], starts[c + 1]
            if a == b:
                bits = ~(rank[c] - low) if low <= rank[c] < low + width else 0
            else:
                bits = held[parents[a]]
                for k in range(a + 1, b):
                    more = held[parents[k]]
                    if more is not bits and more != bits:
                        both = bits_of(bits) | bits_of(more)
                        bits = more if both == bits_of(more) else bits if both == bits_of(bits) else both
                for k in range(a, b):
                    if last[parents[k]] == i:
                        held[parents[k]] = None
            if last[c] >= 0:
                held[c] = bits
            yield c, bits

    def root_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each commit, how many roots it reaches, and that of the smallest id.

        Sets are made for so many roots at a time that those in use keep to ``SET_BYTES``: more roots take more passes, not more memory.
        """
        starts, parents, (rank, roots, most) = self.starts, self.parents, self.ranks
        count, lowest = numbers(np.zeros(self.n)), numbers(np.arange(self.n))
        for c in self.levels:
            if starts[c] < starts[c + 1]:
                lowest[c] = min(lowest[parents[k]] for k in range(starts[c], starts[c + 1]))
        width = max(256, 8 * SET_BYTES // max(1, self.widest))
        for low in range(0, most, width):
            for c, bits in self.root_sets(low, width):
                count[c] += bits.bit_count()
        return np.frombuffer(count, np.int32), np.frombuffer(lowest, np.int32)

    def reached(self, tips: Iterable[int]) -> bytearray:
        """A byte for each commit: whether ``tips`` reach it."""
        starts, parents, seen, stack = self.starts, self.parents, bytearray(self.n), array("i", tips)
        while stack:
            c = stack.pop()
            if not seen[c]:
                seen[c] = 1
                stack.extend(p for p in parents[starts[c] : starts[c + 1]] if not seen[p])
        return seen


def chunks(of: np.ndarray | array) -> Iterator[np.ndarray]:
    for at in range(0, len(of), CHUNK):
        yield np.asarray(of[at : at + CHUNK])


def fold(commits: DataFrame, columns: list[str], schema: str, work: Callable[[Graph], Iterable[list]]) -> DataFrame:
    """Each repository's graph handed to ``work``, which gives lists of Arrow arrays, the columns of ``schema``."""
    made = T._parse_datatype_string(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(made)
        for graph in map(Graph, whole(batches)):  # the rows that a graph is made of are not held beside it
            arrays = None
            for arrays in work(graph):
                yield pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type) for x, f in zip(arrays, want, strict=True)], schema=want)
            del graph, arrays  # before the next one is gathered
            pa.default_memory_pool().release_unused()

    return commits.select("repo", "commit_id", "parents", *columns).repartition("repo").sortWithinPartitions("repo", "commit_id").mapInArrow(run, schema)
