"""Document fingerprints: a canonical exact digest.

Canonical text: NFKC, full case folding, NFKC again (folding can leave it), runs of white space as one
space, none at the ends. Its UTF-8 bytes are hashed to 128 bits by xxHash (XXH3). Rows with equal hashes
form a bucket, and inside a bucket the canonical bytes themselves are compared, so texts that only share
a hash part ways: ``exact_groups`` groups by hash and bytes, the bytes compressed. Equal bytes compress
equally, and grouping merges copies before the shuffle, so a large group of copies costs a row a task.

A first pass (``prepared``) keeps the digest of each row, and only that. It says which digests repeat; bytes are
compared for these alone.

An exact digest has two likenesses: 1 for equal digests and 0 for others.

Cases: a null text is taken as empty; empty texts have the digest of no bytes. Equal texts have equal
digests. Rows that share a doc_id follow each other in a fixed order of their packed texts. Null doc_ids come first. Repeated
rows stay rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_columns

#: Rows aimed at in a range of doc_ids, and the number of ranges at most. Ranges are sorted and walked, never held.
RANGE_ROWS = 2000
RANGES = 1 << 16
#: The bitmap of repeated fingerprints has two to this power bits (512 KB), however many rows there are.
BITS = 22
#: Classes of copies up to which they are broadcast; a row is under 200 bytes, so this is at most 20 MB.
BROADCAST_ROWS = 100_000


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest_of(canon: bytes) -> str:
    from xxhash import xxh3_128_hexdigest

    return xxh3_128_hexdigest(canon)


def fingerprint(text: str | None, digest: Callable = digest_of) -> str:
    return digest(canonical(text).encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row."""
    return map_columns(docs, ["doc_id", "text"], "fingerprint string", lambda: lambda texts: {"fingerprint": [fingerprint(t) for t in texts]})


def prepared(docs: DataFrame, digest: Callable = digest_of) -> DataFrame:
    """(doc_id, text_key, fingerprint) for each row, written once; ``text_key`` is a hash of the text as it is."""
    return checkpointed(map_columns(_keyed(docs), ["doc_id", "text_key", "text"], "fingerprint string", lambda: lambda texts: {"fingerprint": [fingerprint(t, digest) for t in texts]}))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def repeated(base: DataFrame) -> bytes:
    """``2 ** BITS`` bits, set at the last bits of the text_keys whose fingerprint more than one row of ``prepared`` has."""
    texts = base.groupBy("fingerprint", "text_key").agg(F.count("*").alias("n"))
    many = texts.groupBy("fingerprint").agg(F.sum("n").alias("n")).where("n > 1").select("fingerprint")
    at = F.col("text_key").bitwiseAND(F.lit((1 << BITS) - 1))
    words = texts.join(many, "fingerprint", "left_semi").select(F.shiftright(at, 6).alias("word"), F.pmod(at, F.lit(64)).cast("int").alias("bit"))
    words = words.select("word", F.expr("shiftleft(1L, bit)").alias("set")).groupBy("word").agg(F.bit_or("set").alias("set"))
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.collect():
        bits[r.word] = r["set"]
    return bits.tobytes()


def _marked(marks: bytes, keys: np.ndarray) -> np.ndarray:
    at = keys & ((1 << BITS) - 1)
    return (np.frombuffer(marks, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def exact_groups(docs: DataFrame, base: DataFrame | None = None, marks: bytes | None = None, digest: Callable = digest_of) -> DataFrame:
    """(fingerprint, member, first_doc_id, copies, byte_key): the classes of equal canonical bytes.

    ``member`` numbers the classes that share a fingerprint, 0 but for collisions of the hash. Bytes are
    compared where a fingerprint may be that of several rows, as a bitmap of fixed size says; a fingerprint of a
    single row needs no bytes to be told apart, and its ``byte_key`` may be null. Else that is the bytes' SHA-256.
    """
    base = prepared(docs, digest) if base is None else base
    marks = repeated(base) if marks is None else marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yes = pa.array(_marked(marks, batch.column(1).to_numpy()))
            raws = [canonical(t).encode("utf-8", "surrogatepass") for t in batch.column(2).filter(yes).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(yes), pa.array(map(digest, raws), pa.string()), pa.array(map(pack.compress, raws), pa.binary()), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string())], ["doc_id", "fingerprint", "bytes", "byte_key"])

    compared = _keyed(docs).mapInArrow(run, "doc_id long, fingerprint string, bytes binary, byte_key string")
    classes = compared.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"), F.first("byte_key").alias("byte_key"))
    of = classes.groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("first_doc_id", "copies", "byte_key"))).alias("all"))
    many = of.select("fingerprint", F.posexplode("all").alias("member", "c")).select("fingerprint", "member", "c.first_doc_id", "c.copies", "c.byte_key")
    once = base.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).where("copies = 1")
    once = once.join(many, "fingerprint", "left_anti").select("fingerprint", F.lit(0).alias("member"), "first_doc_id", "copies", F.lit(None).cast("string").alias("byte_key"))
    return many.unionByName(once)


def with_classes(docs: DataFrame, digest: Callable = digest_of) -> DataFrame:
    """``with_edits``, and the first doc_id and the size of each row's class of equal canonical bytes."""
    base = prepared(docs, digest)
    marks = repeated(base)
    classes = checkpointed(exact_groups(docs, base, marks, digest).where("copies > 1").select("fingerprint", "byte_key", "first_doc_id", "copies"))
    small = classes.count() <= BROADCAST_ROWS
    found = with_edits(docs, marks, digest).join(F.broadcast(classes) if small else classes, ["fingerprint", "byte_key"], "left")
    return found.withColumns({"first_doc_id": F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first_doc_id")), "copies": F.coalesce("copies", F.lit(1))}).drop("byte_key")


def edited(text: str, after: str) -> str:
    """The last half of ``text``, rounded down, replaced by as much of the start of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _unpacked(packed: bytes, unpack) -> str:  # noqa: ANN001 a decompressor
    return unpack.decompress(packed).decode("utf-8", "surrogatepass") if packed else ""


def _walker(digest: Callable) -> Callable:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (range, extra, doc_id, marked, packed) sorted by range and place; the row after each is its next document."""
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("byte_key", pa.string())])
        held = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = _unpacked(row["packed"], unpack)
                raw = canonical(text).encode("utf-8", "surrogatepass")
                now = (row["range"], row["extra"], row["doc_id"], text, digest(raw), hashlib.sha256(raw).hexdigest() if row["marked"] else None)
                if held and held[0] == now[0] and not held[1]:
                    change = edited(held[3], now[3])
                    mark = held[4] if change == held[3] else fingerprint(change, digest)
                    out.append({"doc_id": held[2], "n_chars": len(held[3]), "edited_sha256": hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": held[4], "edited_fingerprint": mark, "near_edited": likeness(held[4], mark), "near_next": likeness(held[4], now[4]), "byte_key": held[5]})
                held = now
            yield pa.RecordBatch.from_pylist(out, schema)

    return walk


def _placed(df: DataFrame, cuts: list[int], firsts: dict | None = None) -> DataFrame:
    """``df`` with the ``range`` of each doc_id; with ``firsts`` (range to its first id and the range before) also ``extra``.

    A row that is the first of its range comes a second time then, as an extra of the range before.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("extra", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        for batch in batches:
            ids = batch.column(0)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy()
            at = np.where(none, 0, np.searchsorted(edges, known, "right")).astype(np.int32)
            take, extra, to = np.arange(len(at)), np.zeros(len(at), bool), at
            if firsts:
                has = np.array([firsts[r][0] for r in at.tolist()], bool)
                first = np.array([firsts[r][1] for r in at.tolist()], np.int64)
                lead = np.flatnonzero((has == ~none) & (none | (known == first)))
                take = np.concatenate((take, lead))
                extra = np.concatenate((extra, np.ones(len(lead), bool)))
                to = np.concatenate((at, np.array([firsts[r][2] for r in at[lead].tolist()], np.int32)))
            rows = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int32()), pa.array(extra)], [*batch.schema.names, "range", "extra"])

    return df.mapInArrow(run, schema)


def with_edits(docs: DataFrame, marks: bytes | None = None, digest: Callable = digest_of) -> DataFrame:
    """Each document's digest beside that of its edited text and of the next document, by ascending doc_id.

    The ids are cut into ranges of about ``RANGE_ROWS`` rows, ``RANGES`` at most; the first row of a range
    is also sent to the one before it (that of the first range to the last), so that no range needs to see
    another. Texts cross the network once, compressed. The cuts are quantiles of all ids. ``byte_key`` is given
    where ``marks`` says that a fingerprint may be that of several rows.
    """
    slim = docs.select(F.col("doc_id").cast("bigint"))
    n = max(1, min(RANGES, -(-slim.count() // RANGE_ROWS)))
    cuts = [] if n == 1 else sorted(set(slim.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []))
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    rows = _placed(slim, cuts).groupBy("range").agg(F.min(key).alias("first")).orderBy("range").collect()
    firsts = {r.range: (bool(r.first.has), int(r.first.id), rows[i - 1].range) for i, r in enumerate(rows)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yes = _marked(marks, batch.column(1).to_numpy()) if marks else np.zeros(batch.num_rows, bool)
            packed = [pack.compress(t.encode("utf-8", "surrogatepass")) if t else b"" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(yes), pa.array(packed, pa.binary())], ["doc_id", "marked", "packed"])

    packed = _keyed(docs).mapInArrow(run, "doc_id long, marked boolean, packed binary")
    sent = _placed(packed, cuts, firsts) if firsts else packed.withColumns({"range": F.lit(0), "extra": F.lit(False)})
    ordered = sent.select("range", "extra", "doc_id", "marked", "packed").repartition(F.col("range")).sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "packed")
    return ordered.mapInArrow(_walker(digest), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, byte_key string")
