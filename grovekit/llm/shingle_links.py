"""The near-duplicate operator's wide form: all texts linked at a five-word-shingle Jaccard similarity of 0.8 or more.

A SimHash alone can't be the join key here. At similarity 0.8 two fingerprints differ in about 15 % of their
bits, so that a pigeonring chain has six equal bits to offer, whatever the width. So the pigeonring of
``simhash_ring`` finds what is closest, and an exact similarity join finds the rest:

1. Texts become sets of 64-bit shingle hashes. Equal sets form a class, so that copies cost one row.
2. Cheap candidates: classes whose 64-bit SimHashes (of the five-word shingles) the pigeonring links, and
   classes that share a min-hash band, each compared with one pivot of its fingerprint or band. Checked on
   the full sets, they form first components, so that a large group of near copies is not compared pair by pair.
3. The rest is found by a prefix filter, which loses no pair: if two sets have a Jaccard similarity of t or
   more, then in any order of all shingles the first n - ceil(t n) + 1 of each have one in common. The order
   is by a count of the shingles over the whole table in a table of fixed size, the rare ones first; what the
   counts are changes how many candidates there are, and nothing else. Pairs of one component, of sizes too
   far apart, or with too few shingles left are no candidates.
4. A candidate falls if the parities of its shingles by bucket differ in more buckets than a pair of
   similarity 0.8 has different shingles, which no similar pair does. What stays is checked on the full sets.

The result is the components of all similar pairs. A key's rows, a few dozen bytes each, are held in a task.

Cases: words are as in ``simhash_ring`` (A-Z lower-cased, between ASCII white space); a text of fewer than six
words is one shingle; null and empty texts, and those without words, are one class and linked to no other. Null
doc_ids get their class's component; a component of null ids only is null. Repeated rows stay rows. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_ring
from .common import checkpointed, components, map_columns

WORDS = 5
SEED = 42
#: Buckets of the shingle counts, as a power of two.
COUNT_BITS = 16
#: Min-hash bands and the values in one: at similarity 0.8, 0.98 of the pairs share a band.
BANDS = 4
ROWS = 2
#: Bits of the bitmap of the texts whose sets are compared, as a power of two (512 KB).
MARK_BITS = 22
#: Buckets of the parities, as a power of two (64 bytes a class).
PARITY_BITS = 9
_BLOCK = 1 << 15
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's five-word shingles, ascending and without repeats."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    k = min(WORDS, n)
    starts = np.concatenate(([0], ends[: n - k] + 1)).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two such sets is 0.8 or more, without rounding."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _parity(h: np.ndarray) -> bytes:
    """A bit for each bucket, set if it has an odd number of the set's shingles."""
    at = (h >> np.uint64(64 - PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def _bands(h: np.ndarray) -> list[int]:
    from xxhash import xxh64_intdigest

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _BLOCK):
        low = np.minimum(low, ((h[at : at + _BLOCK, None] ^ _XOR) * _ODD).min(axis=0))
    found = (xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS))
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _simhash(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        counts += simhash_ring._bit_counts(h[at : at + _BLOCK])
    return simhash_ring._signed(sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(h))))


def _key(h: np.ndarray) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(h.tobytes())


def _counts(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each bucket occur, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(seen, _bucket(shingles(t)), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(1 << COUNT_BITS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def _marker(counts: np.ndarray) -> Callable:
    def make() -> Callable:
        def work(texts: list) -> dict:
            out: dict = {k: [] for k in ("set_key", "n", "weight", "parity", "fp", "bands", "prefix")}
            for h in map(shingles, texts):
                often = counts[_bucket(h)]
                out["set_key"].append(_key(h))
                out["n"].append(len(h))
                out["weight"].append(float(np.log1p(often).mean()) if len(h) else 0.0)
                out["parity"].append(_parity(h))
                out["fp"].append(_simhash(h))
                out["bands"].append(_bands(h) if len(h) else [])
                out["prefix"].append(h[np.lexsort((h, often))[: prefix_length(len(h))]].tobytes() if len(h) else b"")
            return out

        return work

    return make


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, n, parity_u, parity_v) the pairs that may be similar: 0.8 leaves at most n / 9 shingles that one of two sets has."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint64) for i in (3, 4))
        odd = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        yield batch.select(["u", "v"]).filter(pa.array(9 * odd <= batch.column(2).to_numpy()))


def _checked(docs: DataFrame, marked: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (u, v) of classes that are similar, by their full sets."""
    brief = [marked.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "uv"]
    alike = "4 * greatest(n_u, n_v) <= 5 * least(n_u, n_v)"  # or one set is too small to hold 0.8 of both
    pairs = checkpointed(pairs.join(brief[0], "u").join(brief[1], "v").where(alike).select("u", "v", F.expr("n_u + n_v").alias("n"), "parity_u", "parity_v").mapInArrow(_possible, "u long, v long"))
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    asked = checkpointed(classes.select("node", "set_key", "text_key").join(nodes, "node", "left_semi"))
    first = F.col("text_key").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = asked.select(F.shiftright(first, 6).alias("word"), F.pmod(first, F.lit(64)).cast("int").alias("bit"))
    bits = np.zeros(1 << (MARK_BITS - 6), np.int64)
    for r in words.select("word", F.expr("shiftleft(1L, bit)").alias("set")).groupBy("word").agg(F.bit_or("set").alias("set")).collect():
        bits[r.word] = r["set"]
    marks = bits.tobytes()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the texts whose mark is set; what is only marked by chance falls in the join."""
        held = np.frombuffer(marks, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << MARK_BITS) - 1)
            found = [shingles(t) for t in batch.column(1).filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, found), pa.string()), pa.array([h.tobytes() for h in found], pa.binary())], ["set_key", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yes = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(yes)

    whole = docs.select("text_key", "text").mapInArrow(sets, "set_key string, hashes binary").groupBy("set_key").agg(F.first("hashes").alias("hashes"))
    whole = checkpointed(whole.join(asked, "set_key").select("node", "hashes"))
    left = whole.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = whole.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    return checkpointed(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, component, n, prefix) to one row for each shingle of the prefix, with its place."""
    for batch in batches:
        keys = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        sizes = np.array([len(k) for k in keys], np.int64)
        at = pa.array(np.repeat(np.arange(len(keys)), sizes))
        places = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]) if len(sizes) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *(batch.column(i).take(at) for i in range(3)), pa.array(places)], ["key", "node", "component", "n", "place"])


def _key_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among the rows (key, node, component, n, place) of each key; rows come sorted by key."""
    held: list[np.ndarray] = []
    key_was = None

    def found() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.argsort(rows[2], kind="stable")]
        node, component, n, place = rows
        stops = np.searchsorted(n, 5 * n // 4, "right")
        us, vs = [], []
        for i in range(len(n) - 1):
            s = slice(i + 1, int(stops[i]))
            left = 1 + np.minimum(n[i] - place[i] - 1, n[s] - place[s] - 1)
            others = node[s][(component[s] != component[i]) & (9 * left >= 4 * (n[i] + n[s]))]
            if len(others):
                us.append(np.minimum(others, node[i]))
                vs.append(np.maximum(others, node[i]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(1, 5)])
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        # Keys with one row need no look, but for the first and last of the batch, which may go on.
        for g in np.unique(np.concatenate(([0], np.flatnonzero(np.diff(cuts) > 1), [len(cuts) - 2]))).tolist():
            a, b = int(cuts[g]), int(cuts[g + 1])
            if int(keys[a]) != key_was:
                if held and sum(x.shape[1] for x in held) > 1:
                    yield from found()
                key_was, held = int(keys[a]), []
            held.append(rows[:, a:b])
    if held and sum(x.shape[1] for x in held) > 1:
        yield from found()


def _pairs(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _ring_pairs(classes: DataFrame) -> DataFrame:
    """Candidates (u, v) by the pigeonring: classes of one fingerprint with its pivot, and pivots of linked fingerprints."""
    marked = classes.where("n > 0").select("fp", "weight", "node")
    pivots = marked.groupBy("fp").agg(F.max(F.struct("weight", "node")).alias("top")).select("fp", F.col("top.node").alias("pivot"))
    alike = marked.join(pivots, "fp").where("node <> pivot").select(*_pairs("node", "pivot"))
    ends = [pivots.select(F.col("fp").alias(x), F.col("pivot").alias(f"at_{x}")) for x in "uv"]
    return alike.unionByName(simhash_ring.links(pivots.select("fp")).join(ends[0], "u").join(ends[1], "v").select(*_pairs("at_u", "at_v")))


def _band_pairs(classes: DataFrame) -> DataFrame:
    """Candidates (u, v): classes that share a band, with its pivot, the most usual member: of edited copies, that of the fewest edits."""
    banded = classes.select("node", "weight", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("many")).where("many > 1").select("band", F.col("top.node").alias("pivot"))
    return banded.join(pivots, "band").where("node <> pivot").select(*_pairs("node", "pivot"))


def text_key() -> Column:
    """A hash of ``text``; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, component, component_id): the smallest doc_id reachable over pairs of similarity 0.8 or more.

    ``text_key`` tells rows apart that share an id. ``component`` numbers the components, which ids don't where they repeat.
    """
    texts = docs.select("doc_id", text_key().alias("text_key"), "text")
    added = "set_key string, n int, weight double, parity binary, fp long, bands array<long>, prefix binary"
    # The wide columns stay in this table; a class is named by one row of it.
    marked = checkpointed(map_columns(texts, ["doc_id", "text_key", "text"], added, _marker(_counts(texts))).withColumn("row", F.monotonically_increasing_id()))
    alike = marked.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("row", "text_key", "n", "weight", "fp", "bands")).alias("first"))
    classes = checkpointed(alike.select("set_key", "rep", F.col("first.row").alias("node"), *[f"first.{c}" for c in ("text_key", "n", "weight", "fp", "bands")]))

    first = _checked(texts, marked, classes, _ring_pairs(classes).unionByName(_band_pairs(classes)).distinct())

    named = classes.where("n > 0").join(components(first), "node", "left").select("node", F.coalesce("component", "node").alias("component"), "n")
    prefixes = named.join(marked.select(F.col("row").alias("node"), "prefix"), "node").select("node", "component", "n", "prefix")
    keyed = prefixes.mapInArrow(_spread, "key long, node long, component long, n int, place int").repartition("key").sortWithinPartitions("key")
    rest = _checked(texts, marked, classes, keyed.mapInArrow(_key_pairs, "u long, v long").distinct())

    joined = classes.select("node", "set_key", "rep").join(components(first.unionByName(rest)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = joined.join(smallest, "component").select("set_key", "component", "component_id")
    return marked.select("doc_id", "text_key", "set_key").join(named, "set_key").select("doc_id", "text_key", "component", "component_id")
