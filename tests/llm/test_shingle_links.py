"""Near copies by five-word shingles against all pairs, and the pipeline's stage on planted ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from grovekit.llm import shingle_links, simhash_ring


def _plain(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(rows):
    """The smallest id of each id's component, over all pairs."""
    sets = [(i, _plain(t)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = root(i), root(j)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def _texts():
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = [None, "", "one two", "One  two", "a b c d e", "a b c d e f"]
    for n in (12, 40, 150, 400):
        for _ in range(12):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 2, n // 60, n // 45, n // 30):
                copy = list(base)
                for _ in range(edits):
                    copy[rnd.randrange(n)] = word()
                texts.append(" ".join(copy))
    line = " ".join(word() for _ in range(30))  # a passage that many different texts have
    texts += [f"{line} {' '.join(word() for _ in range(60))}" for _ in range(30)]
    base = [word() for _ in range(120)]  # a large group of near copies
    for _ in range(60):
        copy = list(base)
        copy[rnd.randrange(120)] = word()
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("bands", [True, False])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, bands):
    rows = _texts()
    if not bands:  # the prefix filter alone finds every pair as well
        monkeypatch.setattr(shingle_links, "_checked", lambda d, m, c, p, f=shingle_links._checked, first=[True]: f(d, m, c, p.limit(0) if first and first.pop() else p))
    got = {r.doc_id: r.component_id for r in shingle_links.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _groups(rows) and len(set(got.values())) < len(got) - 100


def test_threshold_is_exact():
    a = np.arange(90, dtype=np.uint64)
    assert shingle_links.similar(a, a[:72]) and not shingle_links.similar(a, a[:71])
    assert all(shingle_links.prefix_length(n) == n - min(k for k in range(n + 1) if 5 * k >= 4 * n) + 1 for n in range(1, 200))


def test_stage_drops_edited_copies(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(20):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        copy = list(base)
        for at in (20, 100, 180):
            copy[at] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    far = sum((simhash_ring.fingerprint(rows[i][1]) ^ simhash_ring.fingerprint(rows[i + 1][1])).bit_count() > 2 for i in range(0, 40, 2))
    assert far > 10  # copies that two bits of a fingerprint of 3-word shingles don't reach
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect())
    assert kept == list(range(0, 40, 2))
    assert pipeline.near_dedup(spark, docs.where(F.lit(False)), "").count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    one, two = "a text about one thing and no other", "quite another text on some other matter"
    rows = [(1, one, "z"), (1, two, "s"), (2, two, "s"), (1, one, "s"), (3, "the third text of this small table", "s")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in order], "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted((r.doc_id, r.text, r.source) for r in pipeline.near_dedup(spark, docs, "").collect()) == sorted([(1, one, "s"), (1, two, "s"), rows[4]])
