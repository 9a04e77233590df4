"""Content ids of blobs, trees and commits, computed by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes of entries, as numbers and as they are written in a tree.
BLOB, SYMLINK, TREE, GITLINK = 0o100644, 0o120000, 0o040000, 0o160000


def _object(kind: str, body: Column) -> Column:
    head = F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(body).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), body))


def blob_id(content: Column) -> Column:
    return _object("blob", F.encode(content, "UTF-8"))


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def tree_ids(files: DataFrame, levels: int) -> DataFrame:
    """(tree_id, path, oid) of every directory with entries, "" for the root.

    One grouping a level, from the deepest up; a level's rows are its directories, so work shrinks upwards.
    ``levels`` is the greatest number of components of a path.
    """
    entry = F.concat(F.lower(F.conv(F.col("mode").cast("string"), 10, 8)), F.lit(" "), "name")
    row = F.struct((F.concat("name", F.when(F.col("mode") == TREE, F.lit("/")).otherwise(F.lit("")))).alias("k"), F.concat(F.hex(F.encode(entry, "UTF-8")), F.lit("00"), F.upper("oid")).alias("h"))
    leaves = files.select("tree_id", "path", "mode", "oid").withColumn("d", depth(F.col("path")))
    found, below = None, None
    for level in range(levels, 0, -1):
        here = leaves.where(F.col("d") == level).drop("d")
        if below is not None:
            here = here.unionByName(below.select("tree_id", "path", F.lit(TREE).alias("mode"), "oid"))
        named = here.select("tree_id", F.when(F.col("path").contains("/"), parent_dir(F.col("path"))).otherwise("").alias("dir"), base_name(F.col("path")).alias("name"), "mode", "oid")
        grouped = named.groupBy("tree_id", "dir").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        body = F.unhex(F.array_join(F.transform("rows", lambda r: r["h"]), ""))
        below = grouped.select("tree_id", F.col("dir").alias("path"), _object("tree", body).alias("oid"))
        found = below if found is None else found.unionByName(below)
    return found


def commit_id(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """Id of a commit without extra headers; ``author`` and ``committer`` are written-out identities with their time."""
    lines = F.concat(F.lit("tree "), tree, F.lit("\n"), F.array_join(F.transform(parents, lambda p: F.concat(F.lit("parent "), p, F.lit("\n"))), ""), F.lit("author "), author, F.lit("\ncommitter "), committer, F.lit("\n\n"), message)
    return _object("commit", F.encode(lines, "UTF-8"))
