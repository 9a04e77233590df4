"""Revisions through filters: parents, history, originals and the filtered commit's own message."""

import pytest
from pyspark.sql import functions as F

from grovekit.functions import documents, hashes, text
from grovekit.operators import query, trees


@pytest.fixture(scope="module")
def repository(spark):
    """c1 and c3 and c4 touch a/, c2 only b/."""
    shown = {"c1": {"a/f": "1"}, "c2": {"a/f": "1", "b/g": "1"}, "c3": {"a/f": "2", "b/g": "1"}, "c4": {"a/f": "3", "b/g": "1"}}
    rows = [(f"t{c}", p, hashes.BLOB, x) for c, files in shown.items() for p, x in files.items()]
    files = spark.createDataFrame(rows, "tree_id string, path string, mode int, content string").withColumn("oid", hashes.blob_id(F.col("content"))).select(*trees.COLUMNS)
    names = list(shown)
    line = [("r", c, f"t{c}", names[i - 1 : i] if i else [], ("N", "n@example.com", 86400 * i), f"{c} says\nmore") for i, c in enumerate(names)]
    commits = spark.createDataFrame(line, "repo string, commit_id string, tree string, parents array<string>, author struct<name:string,email:string,ts:long>, message string")
    return query.Repository(commits, files, spark.createDataFrame([("refs/heads/main", "c4")], "name string, oid string"))


def test_parents_and_history_are_those_of_the_view(repository):
    main = repository.rev("main", ":/a")
    assert [r.commit_id for r in main.parents().collect()] == ["c3"]
    assert [r.commit_id for r in repository.rev("c3", ":/a").parents().collect()] == ["c1"]
    assert [r.commit_id for r in main.history(10).orderBy("place").collect()] == ["c4", "c3", "c1"]
    assert [(r.place, r.commit_id) for r in main.history(1, 1).collect()] == [(1, "c3")]
    assert [r.commit_id for r in repository.rev("main").history(10).orderBy("place").collect()] == ["c4", "c3", "c2", "c1"]
    assert repository.rev("c1", ":/a").parents().isEmpty() and main.history(5, 7).isEmpty()


def test_original_and_description_of_what_is_shown(repository):
    same = repository.rev("c2", ":/a")
    assert same.rev(original=True).commit == "c1" and same.rev(":/b").commit == "c2"
    assert same.described().first().summary == "c1 says" and repository.rev("c2").described().first().summary == "c2 says"
    with pytest.raises(ValueError):
        repository.rev("c1", ":/none").rev(original=True)


def test_directories_and_changes_of_a_first_commit(repository):
    assert [r.path for r in repository.rev("main").dir("b").collect()] == ["b/g"] and repository.rev("main").dir("a/f").isEmpty()
    assert [(r.path, r.change) for r in repository.rev("c1").changed_files().collect()] == [("a/f", 1)]


def test_toml_percent_forms_and_times(spark):
    x = spark.createDataFrame([("a = [1, 2]\nt = 2024-01-01", "a b~*/é", "1970-01-01T01:00:00+01:00"), ("= no", None, "1970-01-01 00:00"), (None, "", None)], "t string, p string, s string")
    got = x.select(documents.json_of_toml(F.col("t")), text.percent_encoded(F.col("p")), text.rfc3339_seconds(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [('{"a": [1, 2], "t": "2024-01-01"}', "a%20b~%2A%2F%C3%A9", 0), ("{}", None, None), ("{}", "", None)]
