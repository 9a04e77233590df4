"""SimHash near-duplicates: pigeonring candidate filtering, exact links at 2 or fewer differing bits.

Texts become 64-bit fingerprints of their 3-word shingles. Equal fingerprints form a class, so that
copies cost one row. For the links between classes a fingerprint is cut into ``SEGMENTS`` segments on a
ring. If two fingerprints differ in ``tau`` bits or fewer, then from some segment on, every chain of k
consecutive segments holds at most k * tau / SEGMENTS differences (the pigeonring principle). The first
segments of such a chain are therefore equal, which gives the join key; the longer prefixes prune within
a key before the full Hamming check. A key's candidates are compared in their task and only a spanning
forest of the links found leaves it, never all pairs. A key with over ``crowd`` fingerprints is not
compared: its fingerprints go to an exact path whose work is linear, in which two fingerprints are linked
if flipping one bit or none of each gives the same value. No partner is dropped on either path.

Cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other.
Null doc_ids get a fingerprint and their class's component; a component of null ids only is null.
Repeated rows stay, one result row each. An empty table gives an empty result. Columns other than
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, map_columns

SHINGLE = 3
TAU = 2
SEGMENTS = 16
SEED = 42
#: Distinct fingerprints of one key that are compared with each other; beyond it the linear path is taken.
CROWD = 256
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space, 3-word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    total, counts = n - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)], np.uint64)
        counts += _bit_counts(h)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > total)))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, the lowest first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _make() -> Callable:
    def work(texts: list) -> dict:
        return {"fp": [_signed(fingerprint(t)) for t in texts]}

    return work


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs``."""
    return map_columns(docs, ["doc_id", "text"], "fp long", _make)


def _ring_edges(tau: int, segments: int, crowd: int) -> Callable:
    width = 64 // segments
    #: For each whole budget, the longest chain that may hold no more differences.
    limits = {int(k * tau / segments): k for k in range(1, segments + 1)}
    masks = [(b, np.uint64((1 << (k * width)) - 1) if k * width < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)) for b, k in limits.items()]

    def links(fps: np.ndarray, turned: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        root = list(range(len(fps)))
        for i in range(len(fps) - 1):
            diff = turned[i + 1 :] ^ turned[i]
            ok = np.ones(len(diff), bool)
            for most, mask in masks:  # chains first, the full Hamming distance last
                ok &= np.bitwise_count(diff & mask) <= most
                if not ok.any():
                    break
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(fps[i]), int(fps[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(us: list, vs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

        key_was, held, crowded = None, [], False
        us: list[int] = []
        vs: list[int] = []

        def close() -> None:
            if key_was is None or crowded or len(held) < 2:
                return
            fps = np.array(held, np.int64)
            turn = np.uint64((key_was >> 32) * width)
            raw = fps.view(np.uint64)
            turned = (raw >> turn) | (raw << (np.uint64(64) - turn)) if turn else raw
            for a, b in links(fps, turned):
                us.append(a)
                vs.append(b)

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            # Keys with one row need no look, but for the first and last of the batch, which may go on.
            for g in np.unique(np.concatenate(([0], np.flatnonzero(sizes > 1), [len(sizes) - 1]))).tolist() if len(keys) else []:
                a, b = int(cuts[g]), int(cuts[g + 1])
                key, more = int(keys[a]), fps[a:b].tolist()
                if key != key_was:
                    close()
                    key_was, held, crowded = key, [], False
                if not crowded and len(held) + len(more) > crowd:
                    crowded = True
                    us += held
                    vs += held
                if crowded:
                    us += more
                    vs += more
                    held = []
                else:
                    held += more
            if len(us) > 10_000:
                yield found(us, vs)
                us.clear()
                vs.clear()
        close()
        yield found(us, vs)

    return run


def _rotations(fps: DataFrame, tau: int, segments: int) -> DataFrame:
    """(key, fp): for each ring position the segments that a chain from there must have equal."""
    width = 64 // segments
    equal = next(k for k in range(1, segments + 1) if k * tau >= segments) - 1
    r = F.col("r") * width
    turned = f"case when r = 0 then fp else shiftrightunsigned(fp, r * {width}) | shiftleft(fp, 64 - r * {width}) end"
    exploded = fps.select("fp", F.explode(F.expr(f"sequence(0, {segments - 1})")).alias("r"))
    return exploded.select(F.expr(f"shiftleft(cast(r as bigint), 32) | (({turned}) & {(1 << min(equal * width, 32)) - 1}L)").alias("key"), "fp")


def links(fps: DataFrame, tau: int = TAU, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of the distinct ``fp`` with ``tau`` or fewer differing bits."""
    keyed = _rotations(fps, tau, segments).repartition("key").sortWithinPartitions("key")
    found = checkpointed(keyed.mapInArrow(_ring_edges(tau, segments, crowd), "u long, v long"))
    crowds = found.where("u = v").select(F.col("u").alias("fp")).distinct()
    # Two values are within 2 bits exactly if they meet after a flip of one bit or none; 65 values meet in one at most.
    assert tau == 2, "the linear path is that for 2 bits"
    flips = crowds.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("met"))
    stars = flips.groupBy("met").agg(F.min("fp").alias("low"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("u"), F.col("low").alias("v")).where("u <> v")
    return found.where("u <> v").unionByName(stars)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id reachable over links of 2 or fewer bits."""
    marked = checkpointed(fingerprints(docs))
    classes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = components(links(classes.select("fp")))
    joined = nodes.withColumnRenamed("node", "fp").join(classes, "fp")
    smallest = joined.groupBy("component").agg(F.min("rep").alias("low"))
    moved = joined.join(smallest, "component").select("fp", "low")
    named = classes.join(moved, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
