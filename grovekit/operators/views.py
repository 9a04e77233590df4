"""A filter applied to whole histories: trees, commits and messages together, and the way back.

Commits (repo, commit_id, tree, parents, author, committer, message); files of all their trees. The distinct
trees are filtered by one plan, whatever the number of commits. What depends on the order of commits is
folded over ids alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.functions import hashes
from grovekit.plans import rewrite
from grovekit.plans.nodes import NOP, FilterError, Node
from grovekit.plans.parser import parse

from . import graphs, history, setops, trees


def _split(f: Node) -> tuple[dict, list[Node]]:
    """Options of the history, and the chain's steps."""
    options: dict = {}
    while f.kind == "meta":
        options = {**dict(f.args[0]), **options}
        f = f.args[1]
    return options, list(f.args) if f.kind == "chain" else [f]


def _nodes(f: Node) -> Iterable[Node]:
    """A filter and all filters within it."""

    def inside(x: object) -> Iterable[Node]:
        if isinstance(x, Node):
            yield from _nodes(x)
        elif isinstance(x, tuple | list):
            for y in x:
                yield from inside(y)

    yield f
    yield from inside(f.args)


def _view(steps: tuple, commits: DataFrame, files: DataFrame, env: trees.Env | None) -> DataFrame:
    """(tree, view) of the commits' trees through the chain of ``steps``."""
    for x in steps:
        if any(y.kind == "pin" for y in _nodes(x)):
            raise FilterError(":pin has no meaning within :squash in this package")
    used = files.join(commits.select(F.col("tree").alias("tree_id")).distinct(), "tree_id", "left_semi")
    view = trees.root_ids(trees.apply(Node("chain", steps) if steps else NOP, used, env))
    return view.select(F.col("tree_id").alias("tree"), F.col("oid").alias("view"))


def apply(f: Node | str, commits: DataFrame, files: DataFrame, env: trees.Env | None = None) -> DataFrame:
    """The history seen through a filter: commits as before, with ``view`` (the tree's id, "" if empty), mapped, kept and view_parents."""
    options, steps = _split(rewrite.optimize(parse(f) if isinstance(f, str) else f))
    known = options.get("history", "").split(",")
    if "no-splice" in known:
        raise FilterError("parents of per-commit filters are not spliced in this package, so no-splice has no meaning")
    own: tuple = ()
    place = 0
    squashed: Column | bool = False
    prune = False
    on_tree: list[Node] = []
    out = commits
    for step in steps:
        if step.kind in ("author", "committer"):
            out = history.rewrite_author(out, step.args[0], step.args[1], step.kind)
        elif step.kind == "message":
            out = _said(out, step, tuple(on_tree), files, env)
        elif step.kind == "squash":
            own, place = (step.args[0], len(on_tree)) if step.args else ((), 0)
            squashed = F.col("commit_id").isin([sha for sha, _ in own]) if step.args else True
        elif step.kind == "prune":
            prune = True
        elif step.kind == "unsign":
            options["gpgsig"] = "remove"
        elif step.kind in ("fold", "rev", "hook", "downstack", "unapply", "embed"):
            raise FilterError(f":{step.kind} has a function of its own in this package")
        elif any(x.kind == "pin" for x in _nodes(step)):
            raise FilterError(":pin needs the first parent's version of a path, a filter for single commits: see by_revision and by_note")
        else:
            on_tree.append(step)
    if options.get("gpgsig") == "remove" and "extra_headers" in out.columns:
        out = out.withColumn("extra_headers", F.filter("extra_headers", lambda h: h["k"] != "gpgsig"))
    if own:
        # Each listed commit has a filter of its own, at the place of the squash in the chain.
        views = None
        for spec in dict.fromkeys(g for _, g in own):
            mine = out.where(F.col("commit_id").isin([sha for sha, g in own if g == spec])).select("repo", "commit_id", "tree")
            seen = _view((*on_tree[:place], spec, *on_tree[place:]), mine, files, env)
            seen = mine.join(seen, "tree").select("repo", "commit_id", "view")
            views = seen if views is None else views.unionByName(seen)
        out = out.join(views, ["repo", "commit_id"], "left")
    else:
        out = out.join(_view(tuple(on_tree), commits, files, env), "tree", "left")
    out = out.withColumn("view", F.coalesce("view", F.lit("")))
    if squashed is True:
        return out.withColumns({"mapped": F.col("commit_id"), "kept": F.lit(True), "view_parents": F.array().cast("array<string>")})
    if squashed is not False:
        kept = history.squash(out, squashed)
        return out.join(kept, ["repo", "commit_id"]).withColumns({"mapped": F.col("commit_id"), "kept": F.lit(True)})
    if prune:
        gone = history.prune_trivial_merges(out).select("repo", "commit_id", F.lit(True).alias("trivial"))
        out = out.join(gone, ["repo", "commit_id"], "left").withColumn("parents", F.when(F.col("trivial"), F.slice("parents", 1, 1)).otherwise(F.col("parents"))).drop("trivial")
    decided = history.simplify(out, "linear" in known, "keep-trivial-merges" in known)
    return out.join(decided, ["repo", "commit_id"])


def commit_ids(viewed: DataFrame) -> DataFrame:
    """(repo, commit_id, view_id): the ids of the kept commits as they are written, parents first.

    Needs ``view``, ``kept``, ``view_parents``, the written identities ``author_line`` and ``committer_line``, and message.
    """

    def work(g: graphs.Graph) -> Iterable[list]:
        kept, views, lists, *texts = g.flags("kept"), *(g.column(c) for c in ("view", "view_parents", "author_line", "committer_line", "message"))
        made: dict = {}
        for c in g.order:
            if kept[c]:
                author, committer, message = (x[c].as_py() for x in texts)
                lines = [f"tree {views[c].as_py() or EMPTY_TREE_ID}", *(f"parent {made[g.codes[c].as_py(), p].hex()}" for p in lists[c].as_py()), f"author {author}", f"committer {committer}"]
                body = ("\n".join(lines) + "\n\n" + message).encode()
                made[g.codes[c].as_py(), g.ids[c].as_py()] = hashlib.sha1(b"commit %d\0" % len(body) + body).digest()
        for x in graphs.chunks(np.flatnonzero(np.frombuffer(kept, np.uint8))):
            yield [g.repos(x), g.named(x), pa.array([made[g.codes[c].as_py(), g.ids[c].as_py()].hex() for c in x.tolist()])]

    return graphs.fold(viewed, ["view", "kept", "view_parents", "author_line", "committer_line", "message"], "repo string, commit_id string, view_id string", work)


#: The id of a tree without entries, and that of no object.
EMPTY_TREE_ID = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
NO_OBJECT = "0" * 40
#: Distinct filters of commits or trees that get a plan each; more are an error, not a longer plan.
MOST_PLANS = 200


def _said(out: DataFrame, step: Node, before: tuple, files: DataFrame, env: trees.Env | None) -> DataFrame:
    """Messages by a template, whose keys show the tree at this place of the chain: ``{#}``, and by path ``{/p}`` and ``{#p}``."""
    template, pattern = step.args
    wanted = dict.fromkeys(re.findall(r"\{([^{}]*)\}", template))
    if not any(k == "#" or k[:1] in ("/", "#") for k in wanted):
        return history.rewrite_message(out, template, pattern)
    names = out.columns
    used = files.join(out.select(F.col("tree").alias("tree_id")).distinct(), "tree_id", "left_semi")
    view = trees.apply(Node("chain", before) if before else NOP, used, env)
    ids = hashes.tree_ids(view, trees.levels_of(view)).select(F.col("tree_id").alias("tree"), "path", "oid")
    shown = view.select(F.col("tree_id").alias("tree"), "path", "oid")
    keys: dict[str, Column] = {}
    for i, key in enumerate(wanted):
        if key == "#":
            found, other = ids.where("path = ''").select("tree", F.col("oid").alias(f"said_{i}")), EMPTY_TREE_ID
        elif key.startswith("/"):
            found, other = view.where(F.col("path") == key[1:]).select(F.col("tree_id").alias("tree"), F.col("content").alias(f"said_{i}")), ""
        elif key.startswith("#"):
            found, other = shown.unionByName(ids).where((F.col("path") == key[1:]) & (F.col("path") != "")).select("tree", F.col("oid").alias(f"said_{i}")), NO_OBJECT
        else:
            continue
        out = out.join(found, "tree", "left")
        keys[key] = F.coalesce(f"said_{i}", F.lit(other))
    return history.rewrite_message(out, template, pattern, keys=keys).select(*names)


def _of_each(chosen: list[tuple[Node, DataFrame]], commits: DataFrame, files: DataFrame, env: trees.Env | None) -> DataFrame:
    """Files (commit_id, path, ...) of commits through filters of their own: (filter, its rows of ``commits``) pairs; pins follow the first parent."""

    def through(f: Node, mine: DataFrame) -> DataFrame:
        at = mine.select("repo", "commit_id", F.col("tree").alias("tree_id"))
        return at.join(trees.apply(f, files.join(at.select("tree_id").distinct(), "tree_id", "left_semi"), env), "tree_id").drop("tree_id")

    out, pinned = None, None
    for f, mine in chosen:
        rows = through(rewrite.without_pins(f, "nop"), mine)
        out = rows if out is None else out.unionByName(rows)
        if any(x.kind == "pin" for x in _nodes(f)):
            held = through(Node("subtract", (rewrite.without_pins(f, "select"), rewrite.without_pins(f, "exclude"))), mine).select("repo", "commit_id", "path")
            pinned = held if pinned is None else pinned.unionByName(held)
    return (out if pinned is None else history.pin(out, pinned, commits)).drop("repo")


def by_revision(rules: list[tuple[str, str, str]], commits: DataFrame, files: DataFrame, env: trees.Env | None = None) -> DataFrame:
    """Files (commit_id, path, ...) of each commit through the filter of the first rule that matches it; without one, unchanged."""
    chosen = history.first_match(commits, [(op, sha, spec) for op, sha, spec in rules])
    specs = [*dict.fromkeys(s for _, _, s in rules), None]
    return _of_each([(parse(spec) if spec else NOP, chosen.where(F.col("chosen").isNull() if spec is None else F.col("chosen") == spec)) for spec in specs], commits, files, env)


def by_note(commits: DataFrame, notes: DataFrame, files: DataFrame, env: trees.Env | None = None) -> DataFrame:
    """As ``by_revision``, with each commit's filter from notes (commit_id, spec); a commit without a note is an error."""
    if not commits.join(notes, "commit_id", "left_anti").isEmpty():
        raise FilterError("a commit has no note")
    specs = [r.spec for r in notes.join(commits, "commit_id", "left_semi").select("spec").distinct().orderBy("spec").limit(MOST_PLANS + 1).collect()]
    if len(specs) > MOST_PLANS:
        raise FilterError(f"over {MOST_PLANS} distinct filters of commits")
    return _of_each([(parse(spec), commits.join(notes.where(F.col("spec") == spec), "commit_id")) for spec in specs], commits, files, env)


def history_of(shown: DataFrame, commits: DataFrame, linear: bool = False, keep_trivial_merges: bool = False) -> DataFrame:
    """The simplified history of commits whose files (commit_id, path, mode, oid) ``by_revision`` or ``by_note`` gave; parents are not spliced."""
    ids = trees.root_ids(shown.withColumnRenamed("commit_id", "tree_id")).select(F.col("tree_id").alias("commit_id"), F.col("oid").alias("view"))
    viewed = commits.join(ids, "commit_id", "left").withColumn("view", F.coalesce("view", F.lit("")))
    return viewed.join(history.simplify(viewed, linear, keep_trivial_merges), ["repo", "commit_id"])


def merge_commits(commits: DataFrame, files: DataFrame, ours: str, theirs: str, favor: str | None = None) -> DataFrame:
    """Two commits merged from their best common ancestor: (tree_id "", path, oid, conflict), as ``setops.merge`` gives it."""
    base = history.merge_bases(commits, F.col("commit_id") == ours, F.col("commit_id") == theirs).select("commit_id")
    trees_of = lambda ids: files.join(commits.join(ids, "commit_id").select(F.col("tree").alias("tree_id")).distinct(), "tree_id", "left_semi").withColumn("tree_id", F.lit(""))
    one = lambda sha: trees_of(commits.where(F.col("commit_id") == sha).select("commit_id"))
    return setops.merge(trees_of(base), one(ours), one(theirs), favor)


def push_back(f: Node | str, pushed: DataFrame, view_files: DataFrame, base_files: DataFrame, env: trees.Env | None = None) -> DataFrame:
    """Files of the base for each pushed commit (commit_id, base_tree): its view mapped back onto that tree."""
    view = view_files.join(pushed.select(F.col("commit_id").alias("tree_id")), "tree_id", "left_semi")
    base = pushed.join(base_files.withColumnRenamed("tree_id", "base_tree"), "base_tree").select(F.col("commit_id").alias("tree_id"), "path", "mode", "oid", "content")
    return trees.unapply(f, view, base, env)


def round_trip_differences(f: Node | str, base: DataFrame, view: DataFrame, env: trees.Env | None = None) -> DataFrame:
    """What is not as pushed after mapping back and viewing again; empty if the law holds."""
    return setops.diff(view, trees.apply(f, trees.unapply(f, view, base, env), env))
