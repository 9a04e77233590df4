"""The pipeline's stages, one after the other, against what each of them must do to its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from grovekit.llm import mixing_tree, secret_battery, sentencepiece_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(str(folder / str(i)))
        out.append(spark.read.parquet(str(folder / str(i))))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "encoding"]
    assert all(x.columns == stages[0].columns for x in stages[1:-1])


def test_quality_drops_junk_and_keeps_the_rest(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    rows = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).collect()
    assert sum((r.doc_id in kept) == (r.q == 1) for r in rows) >= 0.97 * len(rows)


def test_one_of_each_group_stays(stages):
    """The stage's groups are those of five-word shingles at a similarity of 0.8 or more, over all pairs."""
    rows = stages[1].select("doc_id", "text").collect()
    words = {r.doc_id: (r.text or "").encode("utf-8", "surrogatepass").lower().split() for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    kept = {r.doc_id for r in stages[2].select("doc_id").collect()}
    near = lambda a, b: a == b or (bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b))
    left = set(sets)
    assert kept <= left
    while left:
        group, stack = set(), [left.pop()]
        while stack:
            x = stack.pop()
            group.add(x)
            found = {j for j in left if near(sets[x], sets[j])}
            left -= found
            stack += found
        assert group & kept == {min(group)}


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = stages[3].collect()
    assert len(after) == len(before)
    assert all(r.text == secret_battery.masked(before[r.doc_id].text) and r.n_chars == len(r.text) for r in after)


def test_a_secret_is_masked_and_counted_out(spark):
    rows = [(1, "my token = abcdef0123456789 here", "en", "s", 32), (2, "nothing", "en", "s", 7)]
    got = pipeline.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in sorted(got)] == [(1, "my [secret] here", 16), (2, "nothing", 7)]


def test_mix_and_ids(stages):
    want = {r.doc_id: len(r.shards) for r in mixing_tree.decisions(stages[3]).collect()}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert {k: v for k, v in want.items() if v} == got
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.default_model())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.ids == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_odd_rows(spark):
    names = ["score", "ids", "n_tokens", "row_key", "stage_row_key", "stage_text_key", "stage_place", "stage_score", "mix_h", "mix_row", "mix_copy", "encode_row", "kept", "row", "giant", "label", "packed"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (None, "", "en", "s", 0), (2, "a b c", None, "s", 5), (2, "a b c", None, "s", 5), (3, "long text " * 9000, "en", "t", 90000)]
    odd = spark.createDataFrame([(*r, *(f"{n} of {i}" for n in names)) for i, r in enumerate(rows)], schema)
    for x in (odd, odd.limit(0)):
        for i, (_, f) in enumerate(pipeline.STAGES):
            out = f(spark, x, SF)
            got = out.collect()
            if i < 4:
                assert out.columns == x.columns
            for r in got:  # no column of the user's is lost or changed
                assert len({r[n].split(" of ")[1] for n in names}) == 1 and all(r[n].startswith(n) for n in names)
