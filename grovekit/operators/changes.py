"""Change and review metadata: changes, their dependencies, threads, votes, revisions and pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import text
from grovekit.sources.sharing import cut


def changes(commits: DataFrame) -> DataFrame:
    """Commits that carry a change id: (repo, commit_id, change_id, series)."""
    message = F.col("message")
    found = commits.select("repo", "commit_id", text.change_id(message).alias("change_id"), text.change_series(message).alias("series"))
    return found.where(F.col("change_id").isNotNull())


def duplicates(changed: DataFrame) -> DataFrame:
    """Change ids that more than one commit of a repository carries."""
    return changed.groupBy("repo", "change_id").agg(F.count("*").alias("n")).where("n > 1")


def contributing(range_: DataFrame, changed: DataFrame) -> DataFrame:
    """The changes of a range of commits."""
    return range_.join(changed, ["repo", "commit_id"])


def resolve(wanted: DataFrame, changed: DataFrame, refs: DataFrame) -> DataFrame:
    """``wanted`` (name) to commits: by commit id, by reference, or by change id, in this order."""
    a = wanted.join(changed.select(F.col("commit_id").alias("name"), F.col("commit_id").alias("by_id")).distinct(), "name", "left")
    b = a.join(refs.select("name", F.col("oid").alias("by_ref")), "name", "left")
    c = b.join(changed.groupBy(F.col("change_id").alias("name")).agg(F.max("commit_id").alias("by_change")), "name", "left")
    return c.select("name", F.coalesce("by_id", "by_ref", "by_change").alias("commit_id"))


def dependencies(touched: DataFrame, order: str) -> DataFrame:
    """(scope, id, needs): the last earlier change of a scope that touched one of the same keys.

    ``touched`` (scope, id, key, <order>), each key of a change once.
    """
    w = Window.partitionBy("scope", "key").orderBy(order, "id")
    return touched.withColumn("needs", F.lag("id").over(w)).where(F.col("needs").isNotNull()).select("scope", "id", "needs").distinct()


def threads(comments: DataFrame) -> DataFrame:
    """Comments (scope, id, reply_to, ts) with their thread's ``root`` and ``depth``; a join a level, until none is left."""
    level = comments.where(F.col("reply_to").isNull()).select("scope", "id", "ts", F.col("id").alias("root"), F.lit(0).alias("depth"))
    out, depth = level, 0
    while True:
        depth += 1
        up = level.select("scope", F.col("id").alias("reply_to"), "root")
        level = cut(comments.where(F.col("reply_to").isNotNull()).join(up, ["scope", "reply_to"]).select("scope", "id", "ts", "root", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def latest(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value by keys: votes, states of checks and reviews."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by keys, as revisions and comments are dated by the commit that brought them."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def pull_requests(refs: DataFrame) -> DataFrame:
    """(scope, id, head, base) of references (scope, id, kind, oid); without a head or base there is no row."""
    rows = refs.groupBy("scope", "id").agg(F.max(F.when(F.col("kind") == "change", F.col("oid"))).alias("head"), F.max(F.when(F.col("kind") == "base", F.col("oid"))).alias("base"))
    return rows.where(F.col("head").isNotNull() & F.col("base").isNotNull())


def restack(ours: DataFrame, upstream: DataFrame) -> DataFrame:
    """Our changes that upstream doesn't have yet, by change id."""
    return ours.join(upstream.select("change_id").distinct(), "change_id", "left_anti")


def parsed_ref(name: Column) -> Column:
    """A stacked reference's parts: kind (changes, base, heads), scope, author and id."""
    part = lambda i: F.regexp_extract(name, r"^refs/heads/@(changes|base|heads)/([^/]+)/([^/]+)/(.+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("kind"), part(2).alias("scope"), part(3).alias("author"), part(4).alias("id")))


def gerrit_id(content: Column) -> Column:
    from grovekit.functions.hashes import blob_id

    return F.concat(F.lit("I"), blob_id(content))


def known_filters(dirs: DataFrame, workspaces: DataFrame, depth: int = 2) -> DataFrame:
    """(spec): a filter for each workspace and for each directory down to ``depth``."""
    w = workspaces.select(F.concat(F.lit(":workspace="), "path").alias("spec"))
    d = dirs.where(F.size(F.split("path", "/")) <= depth).select(F.concat(F.lit(":/"), "path").alias("spec"))
    return w.unionByName(d).distinct()


def job_levels(inputs: DataFrame, most: int = 100) -> DataFrame:
    """(job, level) of jobs with inputs (job, needs): 0 without inputs, else one more than the highest input's.

    A grouped join for each level of the graph; a job stays in play while its level grows.
    """
    edges = cut(inputs.distinct())
    jobs = edges.select("job").unionByName(edges.select(F.col("needs").alias("job"))).distinct()
    front = jobs.join(edges, "job", "left_anti").select("job", F.lit(0).alias("level"))
    found = front
    for level in range(1, most + 1):
        front = cut(edges.join(front.select(F.col("job").alias("needs")), "needs").select("job").distinct().withColumn("level", F.lit(level)))
        if front.isEmpty():
            return found.groupBy("job").agg(F.max("level").alias("level"))
        found = found.unionByName(front)
    raise ValueError(f"jobs need each other, or over {most} levels deep")
