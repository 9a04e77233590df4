"""Large repositories: what a task holds of them, and results against plain models."""

import random
import tracemalloc
from collections.abc import Iterator

import pyarrow as pa
import pytest

from grovekit.operators import graphs, history


def _comb(n: int) -> list[tuple]:
    """A trunk that takes in a root of its own with each commit: the sets of roots grow with every commit."""
    return [("r", f"t{i:06d}", ([f"t{i - 1:06d}"] if i else []) + [f"root{i:06d}"]) for i in range(n)] + [("r", f"root{i:06d}", []) for i in range(n)]


def _table(rows: list[tuple], **more: list) -> pa.Table:
    repo, ids, parents = zip(*rows, strict=True)
    return pa.table({"repo": repo, "commit_id": ids, "parents": pa.array(parents, pa.list_(pa.string())), **more})


def _peak(work) -> tuple:
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_roots_are_counted_without_sets_of_all(monkeypatch):
    monkeypatch.setattr(graphs, "SET_BYTES", 1 << 16)  # many passes
    n = 5000
    g = graphs.Graph(_table(_comb(n)))
    (count, lowest), mb = _peak(g.root_counts)
    names = g.ids.to_pylist()
    assert all((count[c], names[lowest[c]]) == ((int(x[1:]) + 1, "root000000") if x[0] == "t" else (1, x)) for c, x in enumerate(names))
    assert mb < 20  # sets of names came to more than 400 MB


def test_root_counts_of_mixed_repositories(spark):
    rnd = random.Random(5)
    rows = [(f"r{s}", str(i), [str(p) for p in rnd.sample(range(i), min(i, rnd.choice([0, 1, 1, 2])))] + ["gone"] * (i % 5 == 0) if i % 7 else None) for s in range(40) for i in range(s + 1)]
    rows += rows[:20]  # repeated commits count once
    got = {(r.repo, r.commit_id): (r.n_roots, r.root) for r in history.root_counts(spark.createDataFrame(rows, "repo string, commit_id string, parents array<string>").repartition(3)).collect()}
    own = {(r, c): [p for p in ps or [] if p != "gone"] for r, c, ps in rows}

    def roots(r: str, c: str) -> set:
        return set().union(*(roots(r, p) for p in own[r, c])) if own[r, c] else {c}

    assert got == {k: (len(x := roots(*k)), min(x)) for k in own}


def test_numbers_need_no_roots():
    """numbering a large comb holds numbers alone."""
    g = graphs.Graph(_table(_comb(20_000)))
    seq, mb = _peak(lambda: g.seq)
    assert {x: seq[c] for c, x in enumerate(g.ids.to_pylist())} == {f"t{i:06d}": i + 1 for i in range(20_000)} | {f"root{i:06d}": 0 for i in range(20_000)}
    assert mb < 5


def test_simplifying_holds_few_sets_of_roots():
    """where empty views make roots matter, only those of commits still to be used are held, as bits."""
    n = 5000
    rows = _comb(n)
    views = ["" if i % 2 and c[0] == "t" else "v" for i, (_, c, _) in enumerate(rows)]
    g = graphs.Graph(_table(rows, tree=[c for _, c, _ in rows], view=views))
    out, mb = _peak(lambda: sum(kept for _, _, kept, _ in history._simplified(g, False, False)))
    assert out and mb < 20  # sets of names came to more than 400 MB


def test_reach_holds_a_byte_a_commit():
    """F8."""
    g = graphs.Graph(_table(_comb(50_000)))
    top = g.ids.to_pylist().index("t049999")
    seen, mb = _peak(lambda: g.reached([top]))
    assert sum(seen) == g.n and mb < 10


def test_graphs_of_many_rows_are_narrow():
    """a graph costs its ids and a few numbers, not a dict for each commit."""
    rows = [("r", f"{i:07d}", [f"{i - 1:07d}"] if i else []) for i in range(100_000)]
    table = _table(rows)
    before = pa.total_allocated_bytes()
    g, mb = _peak(lambda: graphs.Graph(table))
    assert g.n == len(g.order) == 100_000 and mb + (pa.total_allocated_bytes() - before) / 1e6 < 12


_POOLS = []  # what is allocated in them outlives a test


def _arrow_peak(work) -> tuple:
    """Also what Arrow allocates, hash tables included."""
    before = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(before)
    _POOLS.append(pool)
    pa.set_memory_pool(pool)
    try:
        out, mb = _peak(work)
        return out, mb + pool.max_memory() / 1e6
    finally:
        pa.set_memory_pool(before)


def test_making_a_graph_of_sorted_rows_takes_little_beside_them():
    """ids are neither sorted again nor put in a table of strings; a commit costs less than a hundred bytes at the peak (150 before)."""
    n = 200_000
    table = _table([("r", f"{i:07d}", [f"{i - 1:07d}"] if i else []) for i in range(n)])
    g, mb = _arrow_peak(lambda: graphs.Graph(table))
    assert list(g.parents) == list(range(n - 1)) and mb * 1e6 / n < 100


def test_ids_whose_hashes_meet_are_told_apart(monkeypatch):
    """hashes only find candidates."""
    rnd = random.Random(3)
    rows = [(f"r{i % 3}", f"c{i}", [f"c{rnd.randrange(400)}" for _ in range(3)] + [None]) for i in range(300)]
    monkeypatch.setattr(graphs.Graph, "_hashes", lambda self, ids, codes: (pa.compute.binary_length(ids).fill_null(0).to_numpy(zero_copy_only=False) % 2).astype("uint64"))
    rows.sort()
    g, there = graphs.Graph(_table(rows)), {(r, c): i for i, (r, c, _) in enumerate(rows)}
    assert [list(g.parents[g.starts[i] : g.starts[i + 1]]) for i in range(g.n)] == [[there[r, p] for p in ps if (r, p) in there] for r, _, ps in rows]


def test_repeated_and_unsorted_commits():
    """F2."""
    g = graphs.Graph(_table([("b", "2", ["1", "0"]), ("b", "1", None), ("a", "1", ["2"]), ("b", "2", ["1", "0"]), ("a", "2", [])]))
    assert (g.repos(range(g.n)).to_pylist(), g.ids.to_pylist(), list(g.parents)) == (["b", "b", "a", "a"], ["1", "2", "1", "2"], [0, 3])


def test_equal_and_single_sets_of_roots_are_held_once():
    """lines that have taken in all roots hold one set, and a root's own set is its number."""
    n = 6000
    rows = [("r", f"a{i:05d}", []) for i in range(n)] + [("r", "all", [f"a{i:05d}" for i in range(n)])]
    rows += [("r", f"l{i:05d}", [f"a{i:05d}", "all"]) for i in range(n)] + [("r", "top", [f"l{i:05d}" for i in range(n)])]
    g = graphs.Graph(_table(rows, tree=[c for _, c, _ in rows], view=["" if c[0] == "l" else "v" for _, c, _ in rows]))
    out, mb = _peak(lambda: {c: (kept, len(chosen)) for c, _, kept, chosen in history._simplified(g, False, False)})
    assert len(out) == g.n and mb < 6  # 8.2 before
    assert all(b.bit_count() == (1 if g.ids[c].as_py()[0] == "a" and g.ids[c].as_py() != "all" else n) for c, b in g.root_sets())


def test_what_is_still_to_be_reached_is_narrow():
    """F8: numbers in an array, not objects."""
    n = 100_000
    g = graphs.Graph(_table([("r", f"p{i:06d}", []) for i in range(n)] + [("r", "tip", [f"p{i:06d}" for i in range(n)])]))
    seen, mb = _peak(lambda: g.reached([g.n - 1]))
    assert sum(seen) == g.n and mb < 2


def test_a_graph_with_its_order_is_narrow_at_the_peak():
    """a hundred bytes a commit at most, from rows with a flag to parents-first order (150 before)."""
    n = 200_000
    table = _table([("r", f"{i:07d}", [f"{i - 1:07d}"] if i else []) for i in range(n)], keep=[i % 3 == 0 for i in range(n)])
    g, mb = _arrow_peak(lambda: [g := graphs.Graph(table), g.order, g.flags("keep")][0])
    assert list(g.order) == list(range(n)) and mb * 1e6 / n < 110


def _batches(n: int, **more) -> Iterator[pa.RecordBatch]:
    """Batches of a line of commits, made as they are asked for."""
    for i in range(0, n, 10_000):
        ids = [f"{k:07d}" for k in range(i - 1, i + 10_000)]
        yield pa.RecordBatch.from_pydict({"repo": ["r"] * 10_000, "commit_id": ids[1:], "parents": pa.array([[p] for p in ids[:-1]], pa.list_(pa.string())), **{k: [f(x) for x in range(i, i + 10_000)] for k, f in more.items()}})


def test_batches_are_let_go_as_they_come(monkeypatch):
    """F8: what a graph is made of and the graph take 60 bytes a commit at most, batches included (87 before)."""
    monkeypatch.setattr(graphs, "STEP", 1 << 11)
    list(map(graphs.Graph, graphs.whole(_batches(10_000))))  # what is imported then is not counted
    n = 400_000

    def work() -> graphs.Graph:
        (g,) = map(graphs.Graph, graphs.whole(_batches(n, tip=lambda x: x == n - 1)))
        assert sum(g.reached([g.flags("tip").index(1)])) == n
        return g

    g, mb = _arrow_peak(work)
    assert list(g.parents) == list(range(n - 1)) and mb * 1e6 / n < 60, mb * 1e6 / n


def test_odd_ids_and_batches():
    """F8: null, empty, long, other alphabets' and repeated ids; slices; repositories over several batches."""
    ids = ["", "a", "ä", "a" * 300, "日本", None, "b"]
    rows = [(r, c, ps) for r in ("x", None, "y") for c in ids for ps in [[p for p in ids if p != c and str(p) > str(c)]]] + [("y", "b", ["a"]), ("z", "1", None), ("z", "2", ["1", "gone", None])]
    want = {(r, c): [p for p in ps or [] if p is not None and p != "gone"] for r, c, ps in rows if c is not None}
    for size in (1, 4, 100):
        table = _table([("w", "0", []), *rows]).slice(1)
        got = {}
        for g in map(graphs.Graph, graphs.whole(table.to_batches(size))):
            repos, names = g.repos(range(g.n)).to_pylist(), g.ids.to_pylist()
            got |= {(repos[i], names[i]): [names[p] for p in g.parents[g.starts[i] : g.starts[i + 1]]] for i in range(g.n) if names[i] is not None}
            assert len(names) == g.n and all(repos[p] == repos[i] for i in range(g.n) for p in g.parents[g.starts[i] : g.starts[i + 1]])
        assert got.keys() == want.keys() and all(sorted(got[k]) == sorted(want[k]) for k in want)


def test_an_order_against_that_of_ids_is_narrow():
    """the way down a long line is numbers in an array: 25 bytes a commit at most beside the graph (41 before)."""
    n = 200_000
    g = graphs.Graph(_table([("r", f"{i:07d}", [f"{i + 1:07d}"] if i + 1 < n else []) for i in range(n)]))
    order, mb = _arrow_peak(lambda: g.order)
    assert list(order) == list(range(n - 1, -1, -1)) and mb * 1e6 / n < 25, mb * 1e6 / n


def test_a_loop_of_commits_is_an_error():
    """also where it is far from the first commits."""
    n = 3 * graphs.STEP
    rows = [("r", f"{i:07d}", [f"{i - 1:07d}"] if i else []) for i in range(n)]
    assert len(graphs.Graph(_table(rows)).order) == n
    rows[n - 9] = ("r", f"{n - 9:07d}", [f"{n - 2:07d}"])
    with pytest.raises(ValueError, match="its own ancestor"):
        graphs.Graph(_table(rows)).order  # noqa: B018
