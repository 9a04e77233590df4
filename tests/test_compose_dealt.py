"""compositions deal contents by path, never by directory."""

from grovekit.functions import hashes
from grovekit.operators import trees


def _files(spark, paths: dict) -> object:
    return spark.createDataFrame([("t", p, hashes.BLOB, f"o{p}", c) for p, c in paths.items()], trees.SCHEMA)


def test_no_row_goes_to_a_directory(spark):
    files = _files(spark, {f"de/src/{i}.txt": "x" for i in range(50)} | {"en/a.txt": "y"})
    view = trees.apply(":[::en/,a=:/de]:[b=:/a,:/]", files)
    assert view.count() == 51
    assert "Generate" not in view._jdf.queryExecution().optimizedPlan().toString()  # rows were multiplied by their directories, contents included


def test_files_and_directories_that_meet(spark):
    files = _files(spark, {"a/x": "file", "b/x/y/z": "below", "b/x/w": "below", "a/k/l": "below", "b/k": "file"})
    shown = lambda spec: {r.path: r.oid for r in trees.apply(spec, files).collect()}
    assert shown(":[:/a,:/b]") == {"x/y/z": "ob/x/y/z", "x/w": "ob/x/w", "k": "ob/k"}
    assert shown(":[:/b,:/a]") == {"x": "oa/x", "k/l": "oa/k/l"}
