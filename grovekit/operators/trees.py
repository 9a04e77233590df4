"""Filters lowered to DataFrame plans over files (tree_id, path, mode, oid, content).

One plan filters all trees at once. What only selects becomes a condition on ``path`` that reaches the
scan; renames are projections; compositions whose branches read and write apart are plain unions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions import hashes, regexes
from grovekit.functions.globs import glob_regex, literal_prefix
from grovekit.plans import nodes as n
from grovekit.plans import rewrite
from grovekit.plans.nodes import FilterError, Node
from grovekit.plans.parser import parse
from grovekit.sources.sharing import cut

from . import setops

SCHEMA = "tree_id string, path string, mode int, oid string, content string"
COLUMNS = ["tree_id", "path", "mode", "oid", "content"]


@dataclass
class Env:
    """What filters need beside the tree: objects by id, scripts, and the file names of stored filters and links."""

    objects: DataFrame | None = None  # (oid, path, mode, leaf_oid, content): path "" for a blob itself
    scripts: dict[str, Callable[[DataFrame], Node]] = field(default_factory=dict)
    stored_suffix: str = ".filter"
    workspace_file: str = "workspace.filter"
    link_file: str = ".link.filter"


def condition(f: Node, path: Column | None = None) -> Column:
    """The condition on a path that a filter stands for which leaves every entry where it is."""
    path = F.col("path") if path is None else path
    k, a = f.kind, f.args
    if k == "nop":
        return F.lit(True)
    if k == "empty":
        return F.lit(False)
    if k == "glob":
        head = literal_prefix(a[0])
        match = path.rlike(glob_regex(a[0])[:-1] + r"\z")
        return path.startswith(head) & match if head else match
    if k == "file":
        return (path == a[0]) | path.startswith(a[0] + "/")
    if k == "exclude":
        return ~condition(a[0], path)
    if k == "select":
        return condition(a[0], path)
    if k == "compose":
        return reduce(lambda x, y: x | y, (condition(b, path) for b in a), F.lit(False))
    if k == "chain":
        parts, out = list(a), F.lit(True)
        while parts:
            if parts[0].kind == "subdir":
                out = out & path.startswith(parts[0].args[0] + "/")
                del parts[:2]
            else:
                out = out & condition(parts.pop(0), path)
        return out
    raise FilterError(f"{f} is no condition on paths")


def apply(f: Node | str, files: DataFrame, env: Env | None = None) -> DataFrame:
    """The view of every tree of ``files`` through a filter."""
    f = rewrite.optimize(parse(f) if isinstance(f, str) else f)
    return _lower(f, files.select(*COLUMNS), env or Env())


def _lower(f: Node, x: DataFrame, env: Env) -> DataFrame:
    if rewrite.keeps_paths(f):
        return x if f == n.NOP else x.where(condition(f))
    return _LOWER[f.kind](f, x, env) if f.kind in _LOWER else _refuse(f)


def _refuse(f: Node) -> DataFrame:
    raise FilterError(f":{f.kind} works on histories, not on a tree")


def _moved(x: DataFrame, path: Column) -> DataFrame:
    return x.withColumn("path", path)


def _subdir(f: Node, x: DataFrame, env: Env) -> DataFrame:
    at = f.args[0] + "/"
    return _moved(x.where(F.col("path").startswith(at)), F.expr(f"substring(path, {len(at) + 1})"))


def _prefix(f: Node, x: DataFrame, env: Env) -> DataFrame:
    return _moved(x, F.concat(F.lit(f.args[0] + "/"), "path"))


def _file(f: Node, x: DataFrame, env: Env) -> DataFrame:
    dst, src = f.args
    kept = x.where((F.col("path") == src) | F.col("path").startswith(src + "/"))
    return _moved(kept, F.concat(F.lit(dst), F.expr(f"substring(path, {len(src) + 1})")))


def _chain(f: Node, x: DataFrame, env: Env) -> DataFrame:
    return reduce(lambda y, part: _lower(part, y, env), f.args, x)


def _exclude(f: Node, x: DataFrame, env: Env) -> DataFrame:
    return setops.subtract(x, _lower(f.args[0], x, env))


def _select(f: Node, x: DataFrame, env: Env) -> DataFrame:
    return setops.intersect(x, _lower(f.args[0], x, env))


def _subtract(f: Node, x: DataFrame, env: Env) -> DataFrame:
    a, b = f.args
    back = _lower(rewrite.invert(b), _lower(b, x, env), env)
    return setops.subtract(_lower(a, x, env), _lower(a, back, env))


def _compose(f: Node, x: DataFrame, env: Env) -> DataFrame:
    """Every source entry goes to the first branch that shows it; where targets meet, the last branch's entry stays.

    The branches' views are one union, in which entries carry the path they come from. Two windows decide: the
    lowest branch of a source, and the highest at a target. A job over keys alone finds where files meet directories.
    """
    for b in f.args:
        rewrite.invert(b)  # a branch without an inverse has no source to claim
    if rewrite.disjoint([rewrite.source_prefix(b) for b in f.args]) and rewrite.disjoint([rewrite.target_prefix(b) for b in f.args]):
        return reduce(lambda p, q: p.unionByName(q), (_lower(b, x, env) for b in f.args))
    names, source, branch = x.columns, f"source{len(x.columns)}", f"branch{len(x.columns)}"
    traced = x.withColumn(source, F.col("path"))
    views = [_lower(b, traced, env).withColumn(branch, F.lit(i)) for i, b in enumerate(f.args)]
    if not views:
        return x.where(F.lit(False))
    all_ = reduce(lambda p, q: p.unionByName(q), views)
    made = F.when(F.col(source).isNull(), F.col("path"))  # what comes from no entry is dealt by its path
    claimed = F.min(branch).over(Window.partitionBy("tree_id", source, made))
    fresh = all_.withColumn("claim", claimed).where(F.col(source).isNull() | (F.col(branch) == F.col("claim"))).drop("claim", source)
    highest = F.max(branch).over(Window.partitionBy("tree_id", "path"))
    top = fresh.withColumn("highest", highest).where(F.col(branch) == F.col("highest")).drop("highest")
    # Contents are dealt by path alone; directories are counted from keys. Only where a file meets a directory, entries are left.
    keys = top.select("tree_id", "path", branch)
    files = keys.withColumnRenamed("path", "at").groupBy("tree_id", "at").agg(F.max(branch).alias("file"))
    spread = keys.withColumn("at", F.explode(setops.ancestors("path")))
    met = cut(spread.groupBy("tree_id", "at").agg(F.max(branch).alias("below")).join(files, ["tree_id", "at"]))
    if not met.isEmpty():
        under = spread.join(met.select("tree_id", "at", "file"), ["tree_id", "at"]).where(F.col("file") > F.col(branch)).select("tree_id", "path")
        over = met.where(F.col("below") > F.col("file")).select("tree_id", F.col("at").alias("path"))
        top = top.join(under.unionByName(over).distinct(), setops.KEY, "left_anti")
    return top.select(*names)


def _made(rows: DataFrame, x: DataFrame) -> DataFrame:
    """Entries that come from no entry of ``x``, with what else its rows carry left null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(x.schema[c].dataType).alias(c) for c in x.columns])


def _insert(f: Node, x: DataFrame, env: Env) -> DataFrame:
    path, what, kind = f.args
    trees = x.select("tree_id").distinct()
    if kind == "text":
        if not path:
            raise FilterError("a blob can't be the root")
        content = F.lit(what)
        return _made(trees.select("tree_id", F.lit(path).alias("path"), F.lit(hashes.BLOB).alias("mode"), hashes.blob_id(content).alias("oid"), content.alias("content")), x)
    if env.objects is None:
        raise FilterError(f"object {what} is not at hand")
    found = env.objects.where(F.col("oid") == what)
    if found.isEmpty():
        raise FilterError(f"no object {what}")
    at = F.concat_ws("/", *([F.lit(path)] if path else []), F.when(F.col("path") != "", F.col("path")))
    rows = found.select(F.lit(1).alias("one"), at.alias("path"), "mode", F.col("leaf_oid").alias("oid"), "content")
    return _made(trees.withColumn("one", F.lit(1)).join(rows, "one").select(*COLUMNS), x)


def _replace(f: Node, x: DataFrame, env: Env) -> DataFrame:
    text = F.coalesce("content", F.lit(""))
    for pattern, to in f.args:
        java, groups = regexes.unnamed(pattern)
        text = F.regexp_replace(text, F.lit(java), F.lit(regexes.replacement(to, groups)))
    kept = x.where(F.col("mode") != hashes.GITLINK)
    return kept.withColumn("content", text).withColumn("oid", hashes.blob_id(F.col("content")))


def _paths(f: Node, x: DataFrame, env: Env) -> DataFrame:
    is_workspace = hashes.base_name(F.col("path")) == env.workspace_file
    content = F.when(is_workspace, F.concat(F.lit("#"), "path", F.lit("\n"), F.coalesce("content", F.lit("")))).otherwise(F.col("path"))
    return x.where(F.col("mode") != hashes.GITLINK).withColumn("content", content).withColumn("oid", hashes.blob_id(F.col("content")))


def _transpose(f: Node, x: DataFrame, env: Env) -> DataFrame:
    turned = x.groupBy("tree_id", F.col("content").alias("path")).agg(F.max("path").alias("content"), F.max("mode").alias("mode"))
    return _made(turned.withColumn("oid", hashes.blob_id(F.col("content"))), x)


def levels_of(x: DataFrame) -> int:
    return x.agg(F.max(hashes.depth(F.col("path")))).first()[0] or 1


def root_ids(x: DataFrame) -> DataFrame:
    """(tree_id, oid): the id of each tree's root."""
    return hashes.tree_ids(x, levels_of(x)).where("path = ''").select("tree_id", "oid")


def _treeid(f: Node, x: DataFrame, env: Env) -> DataFrame:
    path, inner = f.args
    ids = root_ids(_lower(inner, x, env))
    return _made(ids.select("tree_id", F.lit(path).alias("path"), F.lit(hashes.BLOB).alias("mode"), hashes.blob_id(F.col("oid")).alias("oid"), F.col("oid").alias("content")), x)


def _objectref(f: Node, x: DataFrame, env: Env) -> DataFrame:
    path = f.args[0]
    files = x.where(F.col("path") == path).select("tree_id", "oid")
    below = x.where(F.col("path").startswith(path + "/"))
    trees = hashes.tree_ids(_subdir(n.subdir(path), below, env), max(1, levels_of(below))).where("path = ''").select("tree_id", "oid")
    found = files.unionByName(trees)
    made = found.select("tree_id", F.lit(path).alias("path"), F.lit(hashes.BLOB).alias("mode"), hashes.blob_id(F.col("oid")).alias("oid"), F.col("oid").alias("content"))
    return _made(made, x).unionByName(x.join(found.select("tree_id"), "tree_id", "left_anti").select(*x.columns))


def _objectderef(f: Node, x: DataFrame, env: Env) -> DataFrame:
    """What the object is whose id the file's first line says; an id of no object fails the job."""
    path = f.args[0]
    wanted = x.where(F.col("path") == path).withColumn("want", F.trim(F.substring_index("content", "\n", 1)))
    is_id = F.col("want").rlike(r"^[0-9a-f]{40}\z")
    empty = wanted.where(~is_id).select("tree_id", "path", F.lit(hashes.BLOB).alias("mode"), hashes.blob_id(F.lit("")).alias("oid"), F.lit("").alias("content"))
    objects = env.objects if env.objects is not None else x.sparkSession.createDataFrame([], "oid string, path string, mode int, leaf_oid string, content string")
    o = objects.select(F.col("oid").alias("want"), F.col("path").alias("below"), "mode", F.col("leaf_oid").alias("oid"), "content")
    found = wanted.where(is_id).select("tree_id", "path", "want").join(o, "want", "left")
    below = F.when(F.col("below").isNull(), F.raise_error(F.concat(F.lit("no object "), "want"))).otherwise(F.col("below"))
    at = F.when(below == "", F.col("path")).otherwise(F.concat_ws("/", "path", below))
    return _made(empty.unionByName(found.select("tree_id", at.alias("path"), "mode", "oid", "content")), x)


def _export(f: Node, x: DataFrame, env: Env) -> DataFrame:
    return x.where(F.col("path") != env.link_file)


def _unlink(f: Node, x: DataFrame, env: Env) -> DataFrame:
    """Entries below a link's directory go; the link file stays."""
    at = x.where(hashes.base_name(F.col("path")) == env.link_file).select("tree_id", hashes.parent_dir(F.col("path")).alias("dir"))
    inside = x.where(hashes.base_name(F.col("path")) != env.link_file).select("tree_id", "path", F.explode(setops.ancestors("path")).alias("dir"))
    gone = inside.join(at, ["tree_id", "dir"], "left_semi").select("tree_id", "path").distinct()
    return x.join(gone, setops.KEY, "left_anti")


def _adapt(f: Node, x: DataFrame, env: Env) -> DataFrame:
    """Submodules become link files: path and url are read from the root's .gitmodules."""
    modules = x.where("path = '.gitmodules'").select("tree_id", F.explode(F.expr(r"regexp_extract_all(content, '\\[submodule[^\\[]*', 0)")).alias("m"))
    modules = modules.select("tree_id", F.regexp_extract("m", r"(?m)^\s*path\s*=\s*(.*?)\s*$", 1).alias("path"), F.regexp_extract("m", r"(?m)^\s*url\s*=\s*(.*?)\s*$", 1).alias("url"))
    links = x.where(F.col("mode") == hashes.GITLINK).join(modules, setops.KEY)
    text = F.format_string('remote = "%s"\ncommit = "%s"\nfilter = ":/"\n', "url", "oid")
    made = links.select("tree_id", F.concat("path", F.lit("/" + env.link_file)).alias("path"), F.lit(hashes.BLOB).alias("mode"), hashes.blob_id(text).alias("oid"), text.alias("content"))
    return x.where((F.col("path") != ".gitmodules") & (F.col("mode") != hashes.GITLINK)).unionByName(_made(made, x))


def _link(f: Node, x: DataFrame, env: Env) -> DataFrame:
    """The linked trees' views overlaid at their links. ``env.objects`` holds the linked commits' files by commit id."""
    if env.objects is None:
        return x
    kind = lambda key: F.regexp_extract("content", rf'(?m)^\s*{key}\s*=\s*"(.*)"\s*$', 1)
    at = x.where(hashes.base_name(F.col("path")) == env.link_file).select("tree_id", hashes.parent_dir(F.col("path")).alias("dir"), kind("commit").alias("commit"), kind("filter").alias("spec"))
    out = x
    for (text,) in at.select("spec").distinct().orderBy("spec").collect():  # one plan for each distinct filter
        here = at.where(F.col("spec") == text)
        tree = env.objects.join(here.select(F.col("commit").alias("oid")).distinct(), "oid", "left_semi").select(F.col("oid").alias("tree_id"), "path", "mode", F.col("leaf_oid").alias("oid"), "content")
        view = _lower(rewrite.optimize(parse(text)), tree, env).withColumnRenamed("tree_id", "commit")
        placed = here.drop("spec").join(view, "commit").select("tree_id", F.concat_ws("/", "dir", "path").alias("path"), "mode", "oid", "content")
        out = setops.overlay(out, _made(placed, x))
    return out


def _per_file(x: DataFrame, path: str, build: Callable[[Node], Node], env: Env, own: Node) -> DataFrame:
    """Trees grouped by what the file at ``path`` says: a plan for each distinct filter, and the union of them."""
    texts = x.where(F.col("path") == path).select("tree_id", F.coalesce("content", F.lit("")).alias("spec"))
    out = x.where(F.lit(False))
    for (text,) in texts.select("spec").distinct().orderBy("spec").collect():
        try:
            inner = parse(text)
            rewrite.invert(inner)
        except FilterError:
            inner = n.EMPTY
        mine = x.join(texts.where(F.col("spec") == text), "tree_id", "left_semi").select(*x.columns)
        out = out.unionByName(_lower(rewrite.optimize(build(inner)), mine, env))
    rest = x.join(texts, "tree_id", "left_anti").select(*x.columns)
    return out.unionByName(_lower(own, rest, env))


def _stored(f: Node, x: DataFrame, env: Env) -> DataFrame:
    path = f.args[0] + env.stored_suffix
    return _per_file(x, path, lambda inner: n.compose(n.file(path), inner), env, n.EMPTY)


def _workspace(f: Node, x: DataFrame, env: Env) -> DataFrame:
    at = f.args[0]
    path = f"{at}/{env.workspace_file}"
    return _per_file(x, path, lambda inner: n.compose(n.file(env.workspace_file, path), n.compose(inner, n.subdir(at))), env, n.subdir(at))


def _script(f: Node, x: DataFrame, env: Env) -> DataFrame:
    path, inner = f.args
    if path not in env.scripts:
        raise FilterError(f"no script {path}")
    return _lower(rewrite.optimize(env.scripts[path](_lower(inner, x, env))), x, env)


def _index(f: Node, x: DataFrame, env: Env) -> DataFrame:
    """The trigram index as a tree: the trigram's three characters in hex as directories, then the path."""
    from .search import postings

    hexed = F.array_join(F.transform(F.split("trigram", "", -1), lambda c: F.lower(F.hex(F.encode(c, "UTF-8")))), "/")
    rows = postings(x).select("tree_id", F.concat_ws("/", F.regexp_replace(hexed, "/+$", ""), "path").alias("path"), F.lit(hashes.BLOB).alias("mode"), hashes.blob_id(F.lit("")).alias("oid"), F.lit("").alias("content"))
    return _made(rows, x)


def _same(f: Node, x: DataFrame, env: Env) -> DataFrame:
    return x


_LOWER = {
    "subdir": _subdir, "prefix": _prefix, "file": _file, "chain": _chain, "exclude": _exclude, "select": _select, "subtract": _subtract,
    "compose": _compose, "insert": _insert, "replace": _replace, "paths": _paths, "transpose": _transpose, "treeid": _treeid, "objectref": _objectref,
    "objectderef": _objectderef, "export": _export, "unlink": _unlink, "adapt": _adapt, "link": _link, "stored": _stored, "workspace": _workspace,
    "script": _script, "index": _index, "pin": _same, "author": _same, "committer": _same, "message": _same, "unsign": _same, "prune": _same, "squash": _same,
    "meta": lambda f, x, env: _lower(f.args[1], x, env),
}


def warnings(f: Node | str, files: DataFrame, env: Env | None = None) -> DataFrame:
    """(tree_id, warning) for each branch of a composition that matches nothing."""
    f = parse(f) if isinstance(f, str) else f
    branches = f.args if f.kind == "compose" else (f,)
    trees = files.select("tree_id").distinct()
    rows = [trees.join(apply(b, files, env).select("tree_id").distinct(), "tree_id", "left_anti").select("tree_id", F.lit(f'No match for "{b}"').alias("warning")) for b in branches]
    return reduce(lambda p, q: p.unionByName(q), rows)


def unapply(f: Node | str, view: DataFrame, parent: DataFrame, env: Env | None = None) -> DataFrame:
    """A changed view mapped back onto its base: what the filter shows is replaced, all else stays."""
    f = rewrite.optimize(parse(f) if isinstance(f, str) else f)
    back = rewrite.invert(f)
    hidden = setops.subtract(parent.select(*COLUMNS), apply(back, apply(f, parent, env), env))
    return setops.overlay(apply(back, view, env), hidden)


def original_paths(f: Node | str, files: DataFrame, env: Env | None = None) -> DataFrame:
    """(tree_id, path, original): where each entry of the view comes from; a workspace file says it in its first line."""
    f = parse(f) if isinstance(f, str) else f
    view = apply(n.chain(Node("paths"), f), files, env)
    return view.select("tree_id", "path", F.regexp_replace(F.substring_index("content", "\n", 1), "^#", "").alias("original"))


def repopulated(f: Node | str, full: DataFrame, partial: DataFrame, env: Env | None = None) -> DataFrame:
    """The entries of ``partial``, a view of ``full`` or of a part of it, at the paths they have in ``full``."""
    return setops.populate(original_paths(f, full, env).withColumnRenamed("original", "content"), partial)
