"""Filters on hand-made trees, set algebra, ids, and laws between filters."""

import random

import pytest
from pyspark.sql import functions as F

from grovekit.functions import hashes
from grovekit.operators import query, search, setops, trees
from grovekit.plans.nodes import FilterError
from grovekit.plans.parser import parse
from grovekit.plans.rewrite import optimize


@pytest.fixture(scope="module")
def tree(spark):
    def make(files: dict, tree_id: str = "t", mode: int = hashes.BLOB):
        rows = [(tree_id, p, mode, c) for p, c in files.items()]
        return spark.createDataFrame(rows, "tree_id string, path string, mode int, content string").withColumn("oid", hashes.blob_id(F.col("content"))).select(*trees.COLUMNS)

    return make


def shown(df) -> dict:
    return {r.path: r.content for r in df.collect()}


WS = {"sub1/file1": "contents1", "sub2/file2": "contents1", "ws/workspace.filter": "a/b = :/sub2\nc = :/sub1\n", "ws/c/file1": "ws_content"}


def test_workspace_shadows_on_collision(tree):
    assert shown(trees.apply(":workspace=ws", tree(WS))) == {"a/b/file2": "contents1", "c/file1": "ws_content", "workspace.filter": WS["ws/workspace.filter"]}


def test_compose_claims_and_collisions(tree):
    x = tree({"a/f": "1", "b/f": "2", "b/g": "3"})
    assert shown(trees.apply(":[:/a,:/b]", x)) == {"f": "2", "g": "3"}
    assert shown(trees.apply(":[x=:/a,::a/]", x)) == {"x/f": "1"}
    y = tree({"a/d": "file", "b/d/e": "dir"})
    assert shown(trees.apply(":[:/a,:/b]", y)) == {"d/e": "dir"}
    assert shown(trees.apply(":[:/b,:/a]", y)) == {"d": "file"}


def test_set_algebra_with_files_and_directories(tree):
    a, b = tree({"x": "1", "d/e": "2", "k": "3"}), tree({"x/y": "1", "d": "9"})
    assert shown(setops.subtract(a, b)) == {"k": "3"}
    assert shown(setops.intersect(a, b)) == {"x": "1", "d/e": "2"}
    assert shown(setops.overlay(b, a)) == {"x/y": "1", "d": "9", "k": "3"}
    assert setops.subtract(a, tree({}).limit(0)).count() == 3


def test_ids_of_blobs_and_trees(tree):
    assert tree({"f": "contents1\n"}).first().oid == "a024003ee1acc6bf70318a46e7b6df651b9dc246"
    ids = {r.path: r.oid for r in hashes.tree_ids(tree({"f": "", "d/g": ""}), 2).collect()}
    assert set(ids) == {"", "d"} and len(ids[""]) == 40
    same = {r.oid for r in hashes.tree_ids(tree({"f": "x"}, "one").unionByName(tree({"f": "x"}, "two")), 1).collect()}
    assert len(same) == 1


def test_generative_text_and_objects(tree, spark):
    x = tree(WS)
    assert shown(trees.apply(':[:/sub1,:$n="v"]', x)) == {"file1": "contents1", "n": "v"}
    assert shown(trees.apply(':replace("con(?P<a>t)":"<$a>"):/sub1', x)) == {"file1": "<t>ents1"}
    assert shown(trees.apply(":PATHS:/sub1", x)) == {"file1": "sub1/file1"}
    of = shown(trees.apply(":#t[:/sub1]", x))["t"]
    assert shown(trees.apply(":&sub1", x)) == {"sub1": of}
    objects = spark.createDataFrame([(of, "file1", hashes.BLOB, "a" * 40, "contents1")], "oid string, path string, mode int, leaf_oid string, content string")
    assert shown(trees.apply(":&sub1:#sub1", x, trees.Env(objects=objects))) == {"sub1/file1": "contents1"}
    with pytest.raises(FilterError):
        trees.apply(":$p=" + "0" * 40, x, trees.Env(objects=objects))
    with pytest.raises(FilterError):
        trees.apply(":FOLD", x)


def test_unapply_is_minimal(tree):
    x = tree({"a/f": "1", "a/g": "2", "b/h": "3"})
    view = tree({"f": "new", "n": "4"})
    assert shown(trees.unapply(":/a", view, x)) == {"a/f": "new", "a/n": "4", "b/h": "3"}


def test_submodules_and_links(tree):
    modules = '[submodule "m"]\n\tpath = lib/m\n\turl = https://example.org/m\n'
    x = tree({".gitmodules": modules, "f": "1"}).unionByName(tree({"lib/m": ""}, mode=hashes.GITLINK))
    got = shown(trees.apply(":adapt=submodules", x))
    assert set(got) == {"f", "lib/m/.link.filter"} and "https://example.org/m" in got["lib/m/.link.filter"]
    linked = tree({"l/.link.filter": "x", "l/a": "1", "b": "2"})
    assert set(shown(trees.apply(":unlink", linked))) == {"l/.link.filter", "b"}


def test_rewrites_keep_results(tree):
    rnd = random.Random(3)
    x = tree({f"{a}/{b}/{c}": a + b + c for a in "ab" for b in "xy" for c in "fg"} | {"top": "t"}).cache()
    atoms = [":/a", ":/b/x", ":prefix=p", ":prefix=a", "::a/", "::b/y/", "::top", "::**/f", ":exclude[::a/x/]", ":select[::**/g]"]
    for _ in range(12):
        text = "".join(rnd.choice(atoms) for _ in range(rnd.randint(1, 3)))
        if rnd.random() < 0.5:
            text = f":[{text},{rnd.choice(atoms)}]"
        f = parse(text)
        plain = trees._lower(f, x, trees.Env())
        assert shown(plain) == shown(trees._lower(optimize(f), x, trees.Env())), text


def test_search_and_index(tree):
    x = tree({"sub1/file1": "First Test document", "sub1/file2": "Another document with more \n than \n one line", "sub2/file3": "One more to see what happens"})
    index = search.postings(x)
    for word, want in (("document", 2), ("x", 0), ("e", 4), ("line", 1)):
        plain = {(r.path, r.line) for r in search.matches(x, word).collect()}
        assert len(plain) == want
        assert plain == {(r.path, r.line) for r in search.matches(x, word, index).collect()}
    assert {(r.path, r.line) for r in search.matches(x, "line").collect()} == {("sub1/file2", 3)}
    assert search.new_postings(x, x).count() == 0


def test_query_api(tree, spark):
    files = tree({"a/f": "1\n2", "a/g": '{"k": {"n": [1, 7]}, "s": "v"}'}, "t1").unionByName(tree({"a/f": "1"}, "t0"))
    commits = spark.createDataFrame([("r", "c1", "t1", ["c0"], ("A", "a@b", 0), "Head\n\nbody"), ("r", "c0", "t0", [], ("A", "a@b", 0), "Root")], "repo string, commit_id string, tree string, parents array<string>, author struct<name:string,email:string,ts:long>, message string")
    refs = spark.createDataFrame([("refs/heads/main", "c1"), ("refs/tags/x", "c0")], "name string, oid string")
    repo = query.Repository(commits, files, refs)
    assert [r.name for r in repo.refs().collect()] == ["refs/heads/main"]
    rev = repo.rev("main", ":/a")
    assert rev.described().first().summary == "Head"
    assert {r.path for r in rev.files().collect()} == {"f", "g"} and rev.rev(":/").dirs().first().path == "a"
    assert {(r.path, r.change) for r in rev.changed_files().collect()} == {("f", 0), ("g", 1)}
    from grovekit.functions import documents

    d = rev.document("g")
    row = d.select(documents.integer(F.col("document"), "/k/n/1").alias("n"), documents.string(F.col("document"), "/s").alias("s"), documents.string(F.col("document"), "/nope", "-").alias("m")).first()
    assert (row.n, row.s, row.m) == (7, "v", "-")
