"""Filtered histories against git's own ids, notes, revisions and the way back."""

import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from grovekit.functions import hashes
from grovekit.operators import trees, views
from grovekit.plans.nodes import FilterError

WHO = "A Body <a@example.org> 1112911993 +0000"
COMMITS = [("a", [], {"f1": "1\n", "d/x": "x\n"}), ("b", ["a"], {"f1": "2\n", "d/x": "x\n"}), ("c", ["a"], {"f1": "1\n", "d/x": "y\n", "d/e/z": "z\n"}), ("m", ["b", "c"], {"f1": "2\n", "d/x": "y\n", "d/e/z": "z\n"})]


@pytest.fixture(scope="module")
def repo(spark):
    commits = spark.createDataFrame([("r", k, f"t{k}", ps, WHO, WHO, f"add {k}\n") for k, ps, _ in COMMITS], "repo string, commit_id string, tree string, parents array<string>, author_line string, committer_line string, message string")
    rows = [(f"t{k}", p, hashes.BLOB, c) for k, _, fs in COMMITS for p, c in fs.items()]
    files = spark.createDataFrame(rows, "tree_id string, path string, mode int, content string").withColumn("oid", hashes.blob_id(F.col("content"))).select(*trees.COLUMNS)
    return commits, files


def _git_ids(folder, commits):
    """The same commits made by git."""
    env = os.environ | {"GIT_AUTHOR_NAME": "A Body", "GIT_AUTHOR_EMAIL": "a@example.org", "GIT_COMMITTER_NAME": "A Body", "GIT_COMMITTER_EMAIL": "a@example.org", "GIT_AUTHOR_DATE": "1112911993 +0000", "GIT_COMMITTER_DATE": "1112911993 +0000"}
    git = lambda *a, text=None: subprocess.run(["git", "-C", folder, *a], input=text, env=env, capture_output=True, text=True, check=True).stdout.strip()
    git("init", "-q")
    made = {}
    for k, ps, fs in commits:
        git("read-tree", "--empty")
        for p, c in fs.items():
            git("update-index", "--add", "--cacheinfo", f"100644,{git('hash-object', '-w', '--stdin', text=c)},{p}")
        made[k] = git("commit-tree", git("write-tree"), *[x for p in ps for x in ("-p", made[p])], text=f"add {k}\n")
    return made


@pytest.mark.skipif(shutil.which("git") is None, reason="git is not there")
@pytest.mark.parametrize("spec", [":/", ":prefix=x/y", ":/d"])
def test_ids_equal_gits(repo, tmp_path, spec):
    commits, files = repo
    got = {r.commit_id: r.view_id for r in views.commit_ids(views.apply(spec, commits, files)).collect()}
    if spec == ":/d":  # b doesn't touch d, so the merge has c alone before it and is dropped as well
        want = _git_ids(str(tmp_path), [("a", [], {"x": "x\n"}), ("c", ["a"], {"x": "y\n", "e/z": "z\n"}), ("m", ["a", "c"], {"x": "y\n", "e/z": "z\n"})])
    else:
        at = "" if spec == ":/" else "x/y/"
        want = _git_ids(str(tmp_path), [(k, ps, {at + p: c for p, c in fs.items()}) for k, ps, fs in COMMITS])
    assert got == want


def test_options_squash_and_messages(repo):
    commits, files = repo
    linear = {r.commit_id: (r.kept, r.view_parents) for r in views.apply(':~(history="linear")[:/]', commits, files).collect()}
    assert linear["m"] == (True, ["b"])
    squashed = views.apply(":SQUASH:/d", commits, files).collect()
    assert all(r.kept and r.view_parents == [] for r in squashed)
    some = {r.commit_id: r.view_parents for r in views.apply(":squash(a:/,m:/)", commits, files).collect()}
    assert some == {"a": [], "m": ["a"]}
    said = views.apply(':"[{n}] {@}";"add (?P<n>.)"', commits, files).select("commit_id", "message").collect()
    assert {r.commit_id: r.message for r in said}["b"] == "[b] b\n"
    with pytest.raises(FilterError):
        views.apply(":FOLD", commits, files)


def test_revisions_notes_and_back(repo, spark):
    commits, files = repo
    got = views.by_revision([("<=", "b", ":prefix=p"), ("==", "m", ":/d")], commits, files).collect()
    seen = {k: {r.path for r in got if r.commit_id == k} for k in "abcm"}
    assert seen == {"a": {"p/f1", "p/d/x"}, "b": {"p/f1", "p/d/x"}, "c": {"f1", "d/x", "d/e/z"}, "m": {"x", "e/z"}}
    notes = spark.createDataFrame([(k, ":/d" if k in "ab" else ":/") for k, _, _ in COMMITS], "commit_id string, spec string")
    noted = views.by_note(commits, notes, files).collect()
    assert {r.path for r in noted if r.commit_id == "a"} == {"x"} and {r.path for r in noted if r.commit_id == "c"} == {"f1", "d/x", "d/e/z"}
    with pytest.raises(FilterError):
        views.by_note(commits, notes.where("commit_id = 'a'"), files)
    view = trees.apply(":/d", files.where("tree_id = 'ta'")).withColumn("content", F.lit("new")).withColumn("oid", hashes.blob_id(F.lit("new"))).withColumn("tree_id", F.lit("p1"))
    pushed = spark.createDataFrame([("p1", "ta")], "commit_id string, base_tree string")
    back = {r.path: r.content for r in views.push_back(":/d", pushed, view, files).collect()}
    assert back == {"f1": "1\n", "d/x": "new"}
    base = files.where("tree_id = 'ta'").withColumn("tree_id", F.lit("p1"))
    assert views.round_trip_differences(":/d", base, view).count() == 0


def test_index_as_a_tree(repo):
    _, files = repo
    paths = {r.path for r in trees.apply(":INDEX", files.where("tree_id = 'ta'").withColumn("content", F.lit("abcd"))).collect()}
    assert paths == {f"{t}/{p}" for t in ("61/62/63", "62/63/64") for p in ("f1", "d/x")}
