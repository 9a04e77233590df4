"""What the corpus operators share: reading, Arrow batches, checkpoints and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch: texts are long, so batches are kept short.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to ``rows`` rows, which bounds a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or tempfile.mkdtemp(prefix="grovekit-")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` is called so, whatever the case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage is cut and a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def trimmed() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and one stage's peak would stay beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, columns: list[str], added: str, make: Callable[[], Callable[[list], dict]], keep_last: bool = False) -> DataFrame:
    """``columns`` without the last of them (unless ``keep_last``), which is handed to Python, and ``added`` (a DDL schema).

    ``make`` builds, once in each task, a function from the last column's values of a batch (a list of
    str or None) to a dict of column lists.
    """
    kept = len(columns) - (not keep_last)
    fields = [df.schema[c] for c in columns[:kept]] + list(T._parse_datatype_string(added).fields)
    schema = T.StructType(fields)
    names = [f.name for f in T._parse_datatype_string(added).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(schema)
        trimmed()
        work = make()
        for batch in batches:
            made = work(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [batch.column(i).cast(want.field(i).type) for i in range(kept)]
            arrays += [pa.array(made[n], want.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=want)
        del work
        trimmed()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text, as the train and held-out folds use it; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def forest(batches: Iterator[pa.RecordBatch], flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to a spanning forest of those in this task, never holding over ``flush`` nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def out() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > flush:
            yield out()
            parent.clear()
    yield out()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of edges (u long, v long): each node that has an edge, as (node, component).

    ``component`` is the smallest node of the component. Alternating large-star and small-star steps,
    each a grouped minimum and a join; a round's edges are written to the checkpoint folder. The number
    of rounds grows with the logarithm of a component's size; edges that have not settled after ``rounds`` are an error.
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v").mapInArrow(forest, "u long, v long").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    before, now = None, mark(edges)
    for _ in range(rounds):
        if not now[0] or now == before:
            break
        edges = checkpointed(star(star(edges, True), False))
        before, now = now, mark(edges)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
