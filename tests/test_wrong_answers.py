"""Answers that were once wrong: replacements, doubled filters, messages of views, pins, differences and merges of files with directories."""

import pytest
from pyspark.sql import functions as F

from grovekit.functions import hashes, regexes
from grovekit.operators import history, setops, trees, views
from grovekit.plans.nodes import FilterError
from grovekit.plans.parser import parse
from grovekit.plans.rewrite import optimize


@pytest.fixture(scope="module")
def tree(spark):
    def make(files: dict, tree_id: str = "t"):
        rows = [(tree_id, p, hashes.BLOB, c) for p, c in files.items()]
        return spark.createDataFrame(rows, "tree_id string, path string, mode int, content string").withColumn("oid", hashes.blob_id(F.col("content"))).select(*trees.COLUMNS)

    return make


def shown(df) -> dict:
    return {r.path: r.content for r in df.collect()}


@pytest.mark.parametrize(
    ("pattern", "to", "want"),
    [
        ("(h)(i)", "${1}i", "hi"), ("h", "$$5", "$5i"), ("h", "[$nope]", "[]i"), ("(h)", "$1x", "i"), ("(h)", "${1}x", "hxi"), ("(?P<a_b>h)", "<$a_b>", "<h>i"),
        ("(h)", "${1}0", "h0i"), ("h", "a\\b", "a\\bi"), ("[(]|(h)", "$1$1", "hhi"), ("(?:x|h)(i)", "$1$0", "ihi"), ("i", "$", "h$"),
    ],
)
def test_replacements(tree, pattern, to, want):
    def string(s):
        return '"' + s.replace("\\", "\\\\") + '"'

    assert shown(trees.apply(f":replace({string(pattern)}:{string(to)})", tree({"f": "hi"}))) == {"f": want}


def test_group_numbers():
    assert regexes.unnamed(r"\((a)[(](?P<n>b)(?:c)(?<m>d)") == (r"\((a)[(](b)(?:c)(d)", {"0": 0, "1": 1, "2": 2, "n": 2, "3": 3, "m": 3})


def test_a_doubled_select_is_not_one(tree):
    f = parse(":select[:/a]:select[:/a]")
    x = tree({"f": "1", "a/f": "2"})
    assert shown(trees.apply(f, x)) == shown(trees._lower(f, x, trees.Env())) == {}
    assert optimize(parse(":select[::a/]:select[::a/]")).kind == "select"


def test_differences_of_files_and_directories(tree):
    a, b = tree({"x": "1", "d/e": "2", "d/g/h": "2", "k": "3", "same": "4"}), tree({"x/a": "1", "x/b/c": "2", "d": "9", "n/m": "5", "same": "4"})
    assert {(r.path, r.change) for r in setops.diff(a, b).collect()} == {("x", -1), ("d", 1), ("k", -1), ("n/m", 1)}
    assert {(r.path, r.change) for r in setops.diff(b, a).collect()} == {("x", 1), ("d", -1), ("k", 1), ("n/m", -1)}


def test_merges(tree):
    base, ours, theirs = tree({"f": "0", "g": "0"}), tree({"f": "1", "g": "0", "x": "1"}), tree({"f": "2", "g": "2", "x/y": "1"})
    got = {r.path: (r.oid, r.conflict) for r in setops.merge(base, ours, theirs).collect()}
    ids = {c: oid for c, oid in tree({"a": "0", "b": "1", "c": "2"}).select("content", "oid").collect()}
    assert got == {"f": (ids["1"], True), "g": (ids["2"], False), "x": (ids["1"], True), "x/y": (ids["1"], True)}
    assert {r.path: r.oid for r in setops.merge(base, ours, theirs, "theirs").collect()}["f"] == ids["2"]
    assert not any(r.conflict for r in setops.merge(base, ours, theirs.where("path <> 'x/y'"), "ours").collect())


def test_unknown_objects_fail(tree):
    with pytest.raises(Exception, match="no object"):
        trees.apply(":#f", tree({"f": "a" * 40})).collect()
    assert shown(trees.apply(":#f", tree({"f": "text"}))) == {"f": ""}


def test_original_paths_and_repopulation(tree):
    x = tree({"a/f": "1", "b/g": "2"})
    assert {r.path: r.original for r in trees.original_paths(":[p=:/a,:/b]", x).collect()} == {"p/f": "a/f", "g": "b/g"}
    assert shown(trees.repopulated(":[p=:/a,:/b]", x, tree({"p/f": "new"}))) == {"a/f": "new"}


@pytest.fixture(scope="module")
def line(spark, tree):
    commits = spark.createDataFrame([("r", k, f"t{k}", ps, f"say {k}1") for k, ps in (("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["b"]), ("m", ["c", "d"]))], "repo string, commit_id string, tree string, parents array<string>, message string")
    at = {"a": {"f": "1", "d/g": "x"}, "b": {"f": "2", "d/g": "x"}, "c": {"f": "3", "h": "new", "d/g": "x"}, "d": {"f": "4"}, "m": {"f": "5", "h": "newer"}}
    files = None
    for k, fs in at.items():
        files = tree(fs, f"t{k}") if files is None else files.unionByName(tree(fs, f"t{k}"))
    return commits, files


def test_messages_show_the_filtered_tree(line):
    commits, files = line
    view = {r.commit_id: r.view for r in views.apply(":/d", commits, files).collect()}
    got = {r.commit_id: r.message for r in views.apply(':/d:"t {#} {@} {/g} {#g} {no}"', commits, files).collect()}
    blob = {r.oid for r in files.where("path = 'd/g'").collect()}.pop()
    assert got["a"] == f"t {view['a']} a x {blob} {{no}}" and got["m"] == f"t {views.EMPTY_TREE_ID} m  {'0' * 40} {{no}}"
    said = {r.commit_id: r.message for r in views.apply(':"{w_d}{/f}";"(?P<w_d>say .)1"', commits, files).collect()}
    assert said["b"] == "say b2"


def test_pins_follow_the_first_parent(line, spark):
    commits, files = line
    seen = lambda rows: {k: {r.path: r.content for r in rows if r.commit_id == k} for k in "abcdm"}
    specs = {"a": ":/", "b": ":/:pin[::f]", "c": ":/:pin[::f,::h]", "d": ":exclude[::d/]", "m": ":pin[::f]"}
    notes = spark.createDataFrame(list(specs.items()), "commit_id string, spec string")
    got = seen(views.by_note(commits, notes, files).collect())
    assert got == {"a": {"f": "1", "d/g": "x"}, "b": {"f": "1", "d/g": "x"}, "c": {"f": "1", "d/g": "x"}, "d": {"f": "4"}, "m": {"f": "1", "h": "newer"}}
    ruled = seen(views.by_revision([("==", "a", ":pin[::f]"), ("_", "", ":pin[::f]")], commits, files).collect())
    assert {k: v["f"] for k, v in ruled.items()} == dict.fromkeys("abcdm", "1")
    kept = {r.commit_id: r.kept for r in views.history_of(views.by_note(commits, notes, files), commits).collect()}
    assert kept == {"a": True, "b": False, "c": False, "d": True, "m": True}
    with pytest.raises(FilterError):
        views.apply(":pin[::f]", commits, files)


def test_pins_against_a_plain_model(spark):
    import random

    rnd = random.Random(5)
    parents = {i: sorted(rnd.sample(range(i), min(i, rnd.choice([1, 1, 2]))), reverse=rnd.random() < 0.5) for i in range(40)}
    raw = {i: {p: f"{i}{p}" for p in "xyz" if rnd.random() < 0.8} for i in parents}
    held = {i: {p for p in raw[i] if rnd.random() < 0.7} for i in parents}
    want: dict = {}
    for i, ps in parents.items():
        want[i] = raw[i] if not ps else {p: v for p, v in ({**raw[i]} | {p: want[ps[0]].get(p) for p in held[i]}).items() if v is not None}
    commits = spark.createDataFrame([("r", str(i), [str(p) for p in ps]) for i, ps in parents.items()], "repo string, commit_id string, parents array<string>")
    entries = spark.createDataFrame([("r", str(i), p, v) for i, t in raw.items() for p, v in t.items()], "repo string, commit_id string, path string, oid string")
    pinned = spark.createDataFrame([("r", str(i), p) for i, t in held.items() for p in t], "repo string, commit_id string, path string")
    got = {(r.commit_id, r.path): r.oid for r in history.pin(entries, pinned, commits).collect()}
    assert got == {(str(i), p): v for i, t in want.items() for p, v in t.items()}


def test_merged_commits(line):
    commits, files = line
    got = {r.path: r.conflict for r in views.merge_commits(commits, files, "c", "d").collect()}
    assert got == {"f": True, "h": False}
    assert not any(r.conflict for r in views.merge_commits(commits, files, "c", "d", "ours").collect())


def test_the_entry_survives_a_broken_corpus_package(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and "subdir" in entry.queries() and entry.oracle_sql()

