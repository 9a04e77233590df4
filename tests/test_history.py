"""Commit graphs against plain recursive models; change metadata; streaming against its batch twin."""

import random

import pytest
from pyspark.sql import functions as F

from grovekit.functions import text
from grovekit.operators import changes, history
from grovekit.streaming import admission


def _graph(seed: int, n: int = 30) -> dict:
    rnd = random.Random(seed)
    return {f"{i:03d}": sorted(rnd.sample([f"{j:03d}" for j in range(i)], min(i, rnd.choice([0, 1, 1, 2, 3])))) for i in range(n)}


@pytest.fixture(scope="module")
def graphs(spark):
    made = {f"r{s}": _graph(s) for s in range(6)}
    rnd = random.Random(9)
    rows = [(r, c, ps, rnd.choice("xyz"), rnd.choice(["", "p", "q"])) for r, g in made.items() for c, ps in g.items()]
    return made, spark.createDataFrame(rows, "repo string, commit_id string, parents array<string>, tree string, view string").cache()


def _up(g: dict, c: str) -> set:
    return {c}.union(*(_up(g, p) for p in g[c])) if g[c] else {c}


def test_numbers_roots_and_reach(graphs):
    made, df = graphs
    for r in history.sequence_numbers(df).collect():
        g = made[r.repo]

        def seq(c, g=g):
            return max((seq(p) + 1 for p in g[c]), default=0)

        assert r.seq == seq(r.commit_id) and set(r.roots) == {c for c in _up(g, r.commit_id) if not g[c]}
    got = {(r.repo, r.commit_id) for r in history.ancestors(df, F.col("commit_id") == "029").collect()}
    assert got == {(k, c) for k, g in made.items() for c in _up(g, "029")}
    rng = {(r.repo, r.commit_id) for r in history.commit_range(df, F.col("commit_id") == "020", F.col("commit_id") == "029").collect()}
    assert rng == {(k, c) for k, g in made.items() for c in _up(g, "029") - _up(g, "020")}
    for r in history.merge_bases(df, F.col("commit_id") == "028", F.col("commit_id") == "029").collect():
        g = made[r.repo]
        common = _up(g, "028") & _up(g, "029")
        assert r.commit_id in common and not any(r.commit_id in _up(g, c) for c in common - {r.commit_id})


def test_simplified_views(graphs):
    made, df = graphs
    rows = {(r.repo, r.commit_id): r for r in df.collect()}
    got = {(r.repo, r.commit_id): r for r in history.simplify(df).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        if r.kept:
            assert r.mapped == k[1] and all(got[k[0], p].kept for p in r.view_parents)
        elif r.mapped is None:
            assert rows[k].view == ""
        else:
            assert rows[k[0], r.mapped].view == rows[k].view or not rows[k].parents
    assert all(len(r.view_parents) <= 1 for r in history.simplify(df, linear=True).collect())


def test_linear_window_equals_the_fold(spark):
    rnd = random.Random(4)
    rows = [(f"r{s}", f"{i:03d}", [f"{i - 1:03d}"] if i else [], rnd.choice("ab"), rnd.choice(["", "p", "q"])) for s in range(5) for i in range(25)]
    df = spark.createDataFrame(rows, "repo string, commit_id string, parents array<string>, tree string, view string")
    a = {(r.repo, r.commit_id): (r.kept, r.mapped) for r in history.simplify(df).collect()}
    b = {(r.repo, r.commit_id): (r.kept, r.mapped) for r in history.simplify_linear(df, ["commit_id"]).collect()}
    assert a == b


def test_squash_rev_prune_downstack(graphs, spark):
    made, df = graphs
    kept = {(r.repo, r.commit_id): r.view_parents for r in history.squash(df, F.col("tree") == "x").collect()}
    names = {(r.repo, r.commit_id) for r in df.where("tree = 'x'").collect()}
    assert set(kept) == names and all((k[0], p) in names for k, ps in kept.items() for p in ps)
    chosen = {(r.repo, r.commit_id): r.chosen for r in history.first_match(df, [("<=", "010", "old"), ("_", "", "new")]).collect()}
    assert all((v == "old") == (c in _up(made[r], "010")) for (r, c), v in chosen.items())
    with pytest.raises(ValueError):
        history.first_match(df, [("==", "nope", "x")])
    stack = spark.createDataFrame([("r", "a", 0, ["1"]), ("r", "b", 1, ["2"]), ("r", "c", 2, ["1", "3"]), ("r", "d", 3, ["3"])], "repo string, commit_id string, place long, keys array<string>")
    assert {r.commit_id for r in history.downstack(stack).collect()} == {"a", "c", "d"}
    merges = history.prune_trivial_merges(df).collect()
    assert all(len(made[r.repo][r.commit_id]) > 1 and r.mapped == made[r.repo][r.commit_id][0] for r in merges)


def test_trailers(spark):
    cases = {"a\n\nChange: x\n": "x", "a\n\nChange: x\nChange-Id: y": "y", "a\n\nChange: x\n\nbody": None, "Change: x": None, "": None, "t\n\nKey: v\nno trailer": None}
    df = spark.createDataFrame([(k,) for k in cases], "m string").select("m", text.change_id(F.col("m")).alias("id"))
    assert {r.m: r.id for r in df.collect()} == cases
    paths = spark.createDataFrame([("a/./b//c",), ("a/../b",), ("..",)], "p string").select("p", text.normal_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in paths.collect()} == {"a/./b//c": "a/b/c", "a/../b": "b", "..": None}


def test_jobs_threads_and_refs(spark):
    jobs = spark.createDataFrame([("c", "a"), ("c", "b"), ("b", "a")], "job string, needs string")
    assert {r.job: r.level for r in changes.job_levels(jobs).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        changes.job_levels(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("a", "z")], "job string, needs string"), 5)
    ref = spark.createDataFrame([("refs/heads/@changes/main/ann/x1",), ("refs/heads/main",)], "n string").select(changes.parsed_ref(F.col("n")).alias("p"))
    assert [r.p and r.p.id for r in ref.collect()] == ["x1", None]


def test_streaming_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"c{rnd.randint(0, 4)}", k := rnd.choice(["check", "review"]), rnd.choice(["ci", "lint"]) if k == "check" else rnd.choice(["ann", "bob"]), rnd.choice(["success", "failure"]) if k == "check" else rnd.choice(["approved", "changes_requested", "dismissed"]), i) for i in range(120)]
    schema = "change string, kind string, name string, state string, n long"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{part}"))
    want = {r.change: (r.admissible, r.approvals, r.failing) for r in admission.batch(spark.createDataFrame(rows, schema), ["ci", "lint"], ["n"]).collect()}
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen: dict = {}

    def keep(df, _):
        seen.update({r.change: (r.admissible, r.approvals, r.failing) for r in df.collect()})

    q = admission.stream(source, ["ci", "lint"]).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination(120)
    assert set(seen) == set(want) and seen == want
    raw = spark.createDataFrame([('{"action":"completed","number":7,"check_run":{"name":"ci","conclusion":"success"}}',), ('{"action":"dismissed","number":7,"review":{"state":"APPROVED","user":{"login":"ann"}}}',), ("nonsense",)], "value string")
    assert {tuple(r) for r in admission.typed(raw).collect()} == {("7", "check", "ci", "success"), ("7", "review", "ann", "dismissed")}
