"""What views.apply once passed over: filters of squashed commits, pins, and no-splice."""

import pytest
from pyspark.sql import functions as F

from grovekit.functions import hashes
from grovekit.operators import trees, views
from grovekit.plans.nodes import FilterError


def test_own_filters_of_a_squash_and_errors(spark):
    commits = spark.createDataFrame([("r", "a", "ta", [], "a"), ("r", "b", "tb", ["a"], "b")], "repo string, commit_id string, tree string, parents array<string>, message string")
    rows = [("ta", "d/x", hashes.BLOB, "x\n"), ("tb", "d/x", hashes.BLOB, "x\n"), ("tb", "f", hashes.BLOB, "f\n")]
    files = spark.createDataFrame(rows, "tree_id string, path string, mode int, content string").withColumn("oid", hashes.blob_id(F.col("content"))).select(*trees.COLUMNS)
    view = lambda spec: {r.commit_id: r.view for r in views.apply(spec, commits, files).collect()}
    got = view(":squash(a:/,b:/d)")
    assert got == {"a": view(":/")["a"], "b": view(":/d")["b"]} and got["b"] != view(":/")["b"]
    for spec in (":pin[::d/]", ':~(history="no-splice")[:/]'):
        with pytest.raises(FilterError):
            views.apply(spec, commits, files)
