"""Path-keyed set algebra of trees: subtract, intersect, overlay, differences and merges.

Trees are rows (tree_id, path, ...). A path is unique in its tree. Sets are by path alone, never by
content; an entry also meets another where one is a directory on the other's path. That rule is an
equi-join over the directories of a path, not a prefix comparison, so nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["tree_id", "path"]


def ancestors(path: Column | str) -> Column:
    """The directories above a path, outermost first; empty for a path at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def dirs(files: DataFrame) -> DataFrame:
    """(tree_id, path) of all directories that hold something."""
    return files.select("tree_id", F.explode(ancestors("path")).alias("path")).distinct()


def _met(a: DataFrame, b: DataFrame, same_source: bool) -> DataFrame:
    """The keys of ``a`` that ``b`` covers. ``same_source``: both are parts of one tree, so no file is the other's directory."""
    keys = b.select(*KEY).distinct()
    if same_source:
        return keys
    above = a.select(*KEY, F.explode(ancestors("path")).alias("dir"))
    under = above.join(keys.withColumnRenamed("path", "dir"), ["tree_id", "dir"], "left_semi").select(*KEY)
    return keys.unionByName(dirs(b)).unionByName(under)


def subtract(a: DataFrame, b: DataFrame, same_source: bool = False) -> DataFrame:
    """Entries of ``a`` that meet none of ``b``."""
    return a.join(_met(a, b, same_source), KEY, "left_anti").select(*a.columns)


def intersect(a: DataFrame, b: DataFrame, same_source: bool = False) -> DataFrame:
    """Entries of ``a``, with its content, that meet one of ``b``."""
    return a.join(_met(a, b, same_source), KEY, "left_semi").select(*a.columns)


def overlay(a: DataFrame, b: DataFrame, same_source: bool = False) -> DataFrame:
    """The union; where entries meet, that of ``a`` stays."""
    return a.unionByName(subtract(b, a, same_source))


def _under_files(files: DataFrame, entries: DataFrame, also: list[str]) -> tuple[DataFrame, DataFrame]:
    """The keys of ``files`` that are directories of ``entries``, and of the entries below them; both agree in ``also``.

    Directories are made distinct before they meet files, so a wide directory is a row and not its entries.
    """
    above = entries.select(*KEY, *also, F.explode(ancestors("path")).alias("dir"))
    met = files.select("tree_id", F.col("path").alias("dir"), *also).join(above.select("tree_id", "dir", *also).distinct(), ["tree_id", "dir", *also], "left_semi")
    below = above.join(met, ["tree_id", "dir", *also], "left_semi").select(*KEY, *also).distinct()
    return met.select("tree_id", F.col("dir").alias("path"), *also), below


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree_id, path, change): 1 for added, -1 for removed, 0 for changed content.

    A file that becomes a directory is only reported as removed; a directory that becomes a file only that file, as added.
    """
    both = a.select(*KEY, F.col("oid").alias("a")).join(b.select(*KEY, F.col("oid").alias("b")), KEY, "full_outer")
    changed = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*KEY, F.when(F.col("a").isNull(), 1).when(F.col("b").isNull(), -1).otherwise(0).alias("change"))
    # An entry below a file of the other side is part of that file's change.
    moved = changed.where("change <> 0")
    _, gone = _under_files(moved.withColumn("change", -F.col("change")), moved, ["change"])
    return changed.join(gone, [*KEY, "change"], "left_anti").select(*KEY, "change")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, favor: str | None = None) -> DataFrame:
    """Three-way merge by file: (tree_id, path, oid, conflict); a side that didn't change gives way to the other.

    Where both changed a path, or one has a file where the other has a directory, there is a conflict; with
    ``favor`` (``ours`` or ``theirs``) a changed path is that side's. In a conflict ``oid`` is ours.
    """
    x = base.select(*KEY, F.col("oid").alias("o"))
    for side, name in ((ours, "a"), (theirs, "b")):
        x = x.join(side.select(*KEY, F.col("oid").alias(name)), KEY, "full_outer")
    o, a, b = F.col("o"), F.col("a"), F.col("b")
    clash = ~(a.eqNullSafe(b) | b.eqNullSafe(o) | a.eqNullSafe(o))
    merged = F.when(a.eqNullSafe(b) | b.eqNullSafe(o), a).when(a.eqNullSafe(o), b).otherwise(b if favor == "theirs" else a)
    rows = x.select(*KEY, merged.alias("oid"), (clash if favor is None else F.lit(False)).alias("conflict")).where(F.col("oid").isNotNull() | F.col("conflict"))
    there = rows.where(F.col("oid").isNotNull())
    over, below = _under_files(there, there, [])
    crossed = over.unionByName(below).distinct().withColumn("crossed", F.lit(True))
    return rows.join(crossed, KEY, "left").select(*KEY, "oid", (F.col("conflict") | F.coalesce("crossed", F.lit(False))).alias("conflict"))


def populate(paths: DataFrame, content: DataFrame) -> DataFrame:
    """Entries of ``content`` moved back to the original path that ``paths`` (tree_id, path, content) records for them."""
    back = paths.select("tree_id", "path", F.col("content").alias("original"))
    return content.join(back, KEY).select("tree_id", F.col("original").alias("path"), *[c for c in content.columns if c not in KEY])
