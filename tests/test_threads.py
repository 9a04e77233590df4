"""Replies of any depth stay."""

from grovekit.operators import changes


def test_deep_replies_stay(spark):
    rows = [(1, i, i - 1 if i else None, i) for i in range(53)]
    got = changes.threads(spark.createDataFrame(rows, "scope int, id int, reply_to int, ts int").coalesce(1)).collect()
    assert sorted((r.id, r.root, r.depth) for r in got) == [(i, 0, i) for i in range(53)]
