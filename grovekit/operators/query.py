"""The query API: repositories, revisions, paths and documents over the columnar tables, lazily."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import documents, hashes, text

from . import history, setops, trees, views
from . import search as _search


@dataclass
class Repository:
    """Commits (repo, commit_id, tree, parents, author, message, ...), files of their trees, and references."""

    commits: DataFrame
    files: DataFrame
    references: DataFrame | None = None
    env: trees.Env = field(default_factory=trees.Env)

    def refs(self, pattern: str = "refs/heads/*") -> DataFrame:
        return self.references.where(text.ref_matches(F.col("name"), pattern)).orderBy("name")

    def rev(self, at: str, filter: str = ":/") -> Revision:
        """A commit by id, or by the name of a reference."""
        named = self.references.where((F.col("name") == at) | (F.col("name") == f"refs/heads/{at}")).select("oid").first() if self.references is not None else None
        return Revision(self, named.oid if named else at, filter)


@dataclass
class Revision:
    repository: Repository
    commit: str
    filter: str

    def _commit(self) -> DataFrame:
        return self.repository.commits.where(F.col("commit_id") == self.commit)

    def tree(self) -> DataFrame:
        """The files of the filtered tree."""
        mine = self.repository.files.join(self._commit().select(F.col("tree").alias("tree_id")), "tree_id", "left_semi")
        return trees.apply(self.filter, mine, self.repository.env)

    def viewed(self) -> DataFrame:
        """The repository's commits seen through the filter; see ``views.apply``."""
        return views.apply(self.filter, self.repository.commits, self.repository.files, self.repository.env)

    def _image(self, viewed: DataFrame) -> DataFrame:
        """The commit that shows what this one shows: itself, or the one it is simplified to."""
        at = viewed.where(F.col("commit_id") == self.commit).select("repo", F.col("mapped").alias("commit_id"))
        return viewed.join(at, ["repo", "commit_id"])

    def described(self, form: str = "%Y-%m-%d") -> DataFrame:
        """The filtered commit's hash (its id as written where the written identities are known), author, message and date."""
        c = self._commit()
        if self.filter != ":/":
            viewed = self.viewed()
            c = self._image(viewed)
            if {"author_line", "committer_line"} <= set(viewed.columns):
                c = c.join(views.commit_ids(viewed), ["repo", "commit_id"]).withColumn("commit_id", F.col("view_id"))
        return c.select(F.col("commit_id").alias("hash"), F.col("author.email").alias("author_email"), text.summary(F.col("message")).alias("summary"), "message", text.strftime(F.col("author.ts"), form).alias("date"))

    def rev(self, filter: str = ":/", original: bool = False) -> Revision:
        """The same commit through another filter; with ``original`` the commit that made what this one shows."""
        if not original:
            return Revision(self.repository, self.commit, filter)
        found = self.viewed().where(F.col("commit_id") == self.commit).select("mapped").first()
        if found is None or not found.mapped:
            raise ValueError(f"{self.filter} shows nothing of {self.commit}")
        return Revision(self.repository, found.mapped, filter)

    def parents(self) -> DataFrame:
        """(place, commit_id): the originals of the filtered commit's parents."""
        return self._image(self.viewed()).select(F.posexplode("view_parents").alias("place", "commit_id"))

    def history(self, limit: int = 1, offset: int = 0) -> DataFrame:
        """(place, commit_id): a stretch of the filtered first parents, as originals, this commit's being at place 0."""
        line = history.first_parents(self.viewed(), F.col("commit_id") == self.commit)
        return line.where((F.col("place") >= offset) & (F.col("place") < offset + limit)).select("place", "commit_id")

    def files(self, at: str = "", depth: int | None = None) -> DataFrame:
        return listing(self.tree(), at, depth)

    def dirs(self, at: str = "", depth: int | None = None) -> DataFrame:
        return listing(setops.dirs(self.tree()), at, depth)

    def file(self, path: str) -> DataFrame:
        return self.tree().where(F.col("path") == path)

    def dir(self, path: str) -> DataFrame:
        """The files below a directory; none where there is no such directory."""
        return self.files(path) if path else self.tree()

    def changed_files(self) -> DataFrame:
        """(path, change) against the filtered first parent."""
        first = self._commit().select(F.get("parents", F.lit(0)).alias("commit_id")).join(self.repository.commits, "commit_id").select(F.col("tree").alias("tree_id"))
        before = trees.apply(self.filter, self.repository.files.join(first, "tree_id", "left_semi"), self.repository.env)
        same = lambda df: df.withColumn("tree_id", F.lit(""))
        return setops.diff(same(before), same(self.tree())).select("path", "change")

    def search(self, query: str) -> DataFrame:
        return _search.matches(self.tree(), query).select("path", "line", "text")

    def warnings(self) -> DataFrame:
        mine = self.repository.files.join(self._commit().select(F.col("tree").alias("tree_id")), "tree_id", "left_semi")
        return trees.warnings(self.filter, mine, self.repository.env)

    def document(self, path: str) -> DataFrame:
        """(path, document) of a JSON file; ``{}`` if it can't be read."""
        return self.file(path).select("path", documents.parsed(F.col("content")).alias("document"))


def listing(entries: DataFrame, at: str = "", depth: int | None = None) -> DataFrame:
    """Entries below a directory, down to ``depth`` components of it."""
    below = entries.where(F.col("path").startswith(at + "/")) if at else entries
    if depth is None:
        return below
    return below.where(hashes.depth(F.col("path")) <= depth + (len(at.split("/")) if at else 0))


def marker_counts(markers: DataFrame) -> DataFrame:
    """(commit_id, topic, path, n): lines of markers (commit_id, topic, path, value) at each path and below each directory."""
    counted = markers.withColumn("n", text.line_count(F.col("value")))
    spread = counted.select("commit_id", "topic", F.explode(F.concat(F.array(F.lit("")), setops.ancestors("path"), F.array("path"))).alias("path"), "n")
    return spread.groupBy("commit_id", "topic", "path").agg(F.sum("n").alias("n"))


def merge_markers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Markers of both, each line once: (commit_id, topic, path, id, value)."""
    return old.unionByName(new).dropDuplicates(["commit_id", "topic", "path", "id"])
