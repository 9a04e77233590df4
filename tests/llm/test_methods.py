"""The operators' methods against brute force, and what SQL can say of their results against DuckDB."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.llm import exact_digest, gif_media, langid, mil_quality, mixing_tree, queries, secret_battery, token_transducer, url_filter
from grovekit.llm.common import components, fresh

SF = "/root/testdata/sf0.001"


def test_viterbi_against_all_labelings():
    rng = np.random.default_rng(8)
    lab = langid.Labeller(langid.Model(["a", "b", "c"], np.zeros((langid.BUCKETS, 3), np.float32), np.ones((langid.N_SCRIPTS, 3), bool)), 2.0)
    for _ in range(60):
        lab.rows = rng.normal(0, 2, (rng.integers(1, 7), 3)).astype(np.float32)
        n = len(lab.rows)
        cost = lambda p, s=lab.rows, n=n: sum(s[i, p[i]] for i in range(n)) - 2.0 * sum(p[i] != p[i - 1] for i in range(1, n))
        best = max(map(cost, itertools.product(range(3), repeat=n)))
        assert abs(cost(lab.labels(np.arange(n))) - best) < 1e-4 and abs(cost(lab._viterbi(lab.rows)) - best) < 1e-4


def test_segmentation_against_all_cuts_and_bayes_against_a_plain_sum():
    rnd = random.Random(4)
    unigrams = Counter({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): rnd.randint(1, 90) for _ in range(25)})
    blocked, allowed = Counter({"aa": 5, "b": 2}), Counter({"b": 3, "c": 9})
    model = url_filter.Model(unigrams, blocked, allowed, 0.25)
    total = sum(unigrams.values())

    def worth(parts):
        return sum(math.log(unigrams[w] / total) if w in unigrams else math.log(0.1 / total) - len(w) * math.log(10) for w in parts)

    for _ in range(40):
        name = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        cuts = ([name[a:b] for a, b in zip((0, *c), (*c, len(name)), strict=True)] for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k))
        assert abs(worth(model.segment(name)) - max(map(worth, cuts))) < 1e-9
    words = model.words("aab.c.net", "/b/c")
    seen = {"aa", "b", "c"}
    plain = math.log(0.25 / 0.75)
    for w in words:
        if w in seen:
            plain += math.log((blocked[w] + 1) / (7 + 4)) - math.log((allowed[w] + 1) / (12 + 4))
    assert abs(model.score("aab.c.net", "/b/c") - plain) < 1e-9
    assert url_filter.Model(unigrams, blocked, allowed).score("aa.net", "/") == -math.inf


def test_gradient_is_the_numeric_one():
    rng = np.random.default_rng(2)
    sizes, hidden, k = np.array([3, 1, 4]), 3, 5
    at, x, labels = np.array([0, 3, 4]), rng.normal(size=(8, k)), np.array([1.0, 0.0, 1.0])
    w = {n: rng.normal(0, 0.5, s) for n, s in {"W": (k, hidden), "b": (hidden,), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,), "d": ()}.items()}

    def loss(w):
        p = mil_quality._forward(x, at, sizes, w)["p"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grad = mil_quality.gradient(x, at, sizes, labels, w)
    for name, v in w.items():
        for i in np.ndindex(v.shape):
            up, down = ({**w, name: v + e * (np.arange(v.size).reshape(v.shape) == np.ravel_multi_index(i, v.shape) if v.shape else 1)} for e in (1e-6, -1e-6))
            assert abs((loss(up) - loss(down)) / 2e-6 - grad[name][i]) < 1e-6, name
    f = mil_quality._forward(x, at, sizes, w)  # attention of a bag by hand
    h = np.tanh(x[:3] @ w["W"] + w["b"])
    s = (np.tanh(h @ w["V"]) / (1 + np.exp(-h @ w["U"]))) @ w["w"]
    a = np.exp(s) / np.exp(s).sum()
    assert abs(f["p"][0] - 1 / (1 + math.exp(-(a @ h) @ w["c"] - w["d"]))) < 1e-9


def test_long_texts_are_encoded_in_pieces():
    rnd = random.Random(6)
    text = " ".join(rnd.choice(["Alpha", "beta,", "g9", "delta."]) for _ in range(4 * mil_quality.PASSAGE * 40 + 7))
    whole = mil_quality.encode([text])[0]
    assert len(whole) == -(-len(text.split()) // mil_quality.PASSAGE)
    import re

    piece, some = mil_quality._PIECE, mil_quality._SOME
    try:
        mil_quality._PIECE, mil_quality._SOME = 1000, re.compile(rb"[\x09-\x0d ]*(?:[^\x09-\x0d ]+[\x09-\x0d ]+){%d}" % (2 * mil_quality.PASSAGE))
        parts = mil_quality.encode([text, "short one", None])
    finally:
        mil_quality._PIECE, mil_quality._SOME = piece, some
    assert len(parts[0]) == len(whole) and len(parts[1]) == len(parts[2]) == 1
    assert np.allclose(parts[0], whole, atol=0.05)  # only a passage's first word's likeness to the word before may differ


def test_equal_hashes_of_different_bytes_part(spark):
    texts = ["aa", "AA ", "bb", "aa", "ccc", "bb", "dddd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def by_length(raw):
        return f"{len(raw):032x}"

    got = {r.doc_id: (r.first_doc_id, r.copies) for r in exact_digest.with_classes(docs, by_length).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 3: (0, 3), 2: (2, 2), 5: (2, 2), 4: (4, 1), 6: (6, 1)}
    groups = exact_digest.exact_groups(docs, digest=by_length).collect()
    assert sorted((int(g.fingerprint, 16), g.member, g.copies) for g in groups) == [(2, 0, 3), (2, 1, 2), (3, 0, 1), (4, 0, 1)]
    nulls = spark.createDataFrame([(None, "x"), (None, None), (None, "x")], "doc_id long, text string")
    assert [(r.first_doc_id, r.copies) for r in exact_digest.with_classes(nulls).orderBy("copies").collect()] == [(None, 1), (None, 2), (None, 2)]


def test_counts_of_long_texts_as_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_transducer.default_path())
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "'s", "'re", "'l", "'ll", "'", "a", "ing", "1", "!", " '", " ", "é", "日", "<|endoftext|>", "=" * 9, " word"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 120))) for _ in range(150)] + ["x" * 400, "<|endoftext|>" * 9, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("user's"))
    got = {r.doc_id: r.n_tokens for r in token_transducer.token_counts(docs, long=37).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_counts_on_transitions_sum_to_the_tokens():
    counter = token_transducer.Counter(token_transducer.default_path())
    words = counter.byte_pairs
    for word in ("international", "xqzzy", " the", "日本語", "=" * 40):
        state, total = 0, 0
        for i, byte in enumerate(word.encode()):
            state, added = words.move(state, byte)
            total += added
            assert total == len(words.automaton.path(word.encode()[: i + 1]))
        assert words.move(state, 0) == words.move(state, 0)


def test_state_maps_compose():
    counter, rnd = token_transducer.Counter(token_transducer.default_path()), random.Random(1)
    text = "".join(rnd.choice(" a1'slr\n!é") for _ in range(3000))
    tape = counter._tape(text)
    whole = counter.maps(tape)
    for at in (1, 255, 256, 700, 2999):
        a, b = counter.maps(tape[:at]), counter.maps(tape[at:])
        assert np.array_equal(b[a], whole)


def test_shares_of_words_are_calibrated():
    rng = np.random.default_rng(77)
    for symbols, n in ((secret_battery._ALPHABETS[5][1], 24), (secret_battery._ALPHABETS[7][1], 32)):
        words = secret_battery.Words(symbols)
        drawn = words.draw(40_000, n, rng)
        drawn = drawn[words.narrowest(drawn, secret_battery._NEEDS[symbols])][:3000]
        shares = np.array([secret_battery.word_share("".join(symbols[i] for i in row)) for row in drawn])
        assert all(abs((shares <= p).mean() - p) < 4 * math.sqrt(p / len(shares)) + 0.2 * p for p in (0.01, 0.05, 0.2, 0.5))


def test_step_up_is_that_of_the_weighted_shares(monkeypatch):
    shares = {"a" * 20: 0.004, "b" * 20: 0.0001, "c" * 60: 0.02, "d" * 20: 0.5}
    monkeypatch.setattr(secret_battery, "word_share", shares.get)
    tokens = list(shares)
    mean = sum(map(len, tokens)) / 4
    q = [shares[t] * mean / len(t) for t in tokens]
    keep = max((k for k in range(1, 5) if sorted(q)[k - 1] <= 0.01 * k / 4), default=0)
    assert secret_battery.accepted(tokens) == [x in sorted(q)[:keep] for x in q] and secret_battery.accepted([]) == []


def test_gif_frames_are_shown_by_their_rules():
    payload = bytes(random.Random(1).randbytes(gif_media.WIDTH * (2 * gif_media.ROWS + 3)))
    media = gif_media.store(payload)
    back, frames = gif_media.read_back(media)
    assert back == payload and [(f["index"], f["disposal"]) for f in frames] == [(0, 1), (1, 2), (2, 3)]
    canvas = np.zeros((gif_media.ROWS * gif_media.WIDTH, 3), np.uint8)
    for k, f in enumerate(frames):  # a plain composition
        part = np.frombuffer(payload[k * len(canvas) : (k + 1) * len(canvas)], np.uint8)
        palette = [gif_media._COLOURS, gif_media._REVERSED][k % 2]
        shown = canvas.copy()
        for i, v in enumerate(part.tolist()):
            if v or not k:
                shown[i] = list(palette[3 * v : 3 * v + 3])
        bins = Counter((r >> 6) << 4 | (g >> 6) << 2 | b >> 6 for r, g, b in shown.tolist())
        assert dict(zip(f["bins"], f["pixels"], strict=True)) == dict(bins)
        canvas = canvas if k == 2 else shown if k == 0 else np.where(np.arange(len(canvas))[:, None] < len(part), 0, shown).astype(np.uint8)


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long").repartition(7)
    assert {r.component for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, 0)
    assert fresh("a", ["A", "a_"]) == "a__"


def test_shards_are_shuffled_and_whole(spark):
    rnd = random.Random(5)
    made = [(i, "w " * rnd.randint(1, 9), rnd.choice("aab"), "x") for i in range(800)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string, mix_h string")
    want = mixing_tree.decisions(table, blocks=64, shards=4).collect()
    got = mixing_tree.shuffled(table, blocks=64, shards=4)
    assert got.columns == table.columns and {r.mix_h for r in got.collect()} == {"x"}
    places = sorted((s, o, r.doc_id) for r in want for s, o in zip(r.shards, r.orders, strict=True))
    assert len(set((s, o) for s, o, _ in places)) == len(places)
    order: dict = {}
    for s, _, i in places:
        order.setdefault(s, []).append(i)
    assert [r.doc_id for r in got.coalesce(1).collect()] and sorted(r.doc_id for r in got.collect()) == sorted(i for x in order.values() for i in x)
    seen = [r.doc_id for r in mixing_tree.shuffled(table, blocks=64, shards=1 << 2).collect()]
    at = 0
    runs = []
    while at < len(seen):  # each shard is one run, in its own order
        s = next(s for s, x in order.items() if seen[at : at + len(x)] == x and s not in runs)
        runs.append(s)
        at += len(order[s])
    assert sorted(runs) == sorted(order) and any(x != sorted(x) for x in order.values())


_WORD = r"[^\x20\x09-\x0D]+"
SQL = {
    "op2_gif_media": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, greatest(64, (strlen(coalesce(text, '')) + 63) // 64 * 64) AS payload_bytes, sha256(coalesce(text, '') || repeat(chr(0), CAST(greatest(64, (strlen(coalesce(text, '')) + 63) // 64 * 64) - strlen(coalesce(text, '')) AS BIGINT))) AS payload_sha256 FROM documents",
    "op4_token_counts": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "op5_secret_scan": r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
    "op6_url_filter": r"""WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
          WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM s""",
    "op7_exact_digest": "WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents) SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2)) AS edited_sha256 FROM n",
    "op10_mixing": f"WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents) SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM s",
}


@pytest.mark.parametrize("name", list(SQL))
def test_what_sql_can_say(spark, name):
    import duckdb

    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = con.execute(SQL[name])
        columns = [d[0] for d in want.description]
        rows = want.fetchall()
    got = getattr(queries, name)(spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


def test_pairs_are_judged_as_plain_merging_judges_them():
    """Merging both sides in step and looking at the border, against merging the whole, for tied and for rising ranks."""
    from grovekit.llm.bpe_automaton import Automaton

    rnd = random.Random(11)
    for _ in range(60):
        tokens = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) for _ in range(12)}
        rank = {t: rnd.randint(0, 6) for t in tokens}
        automaton = Automaton(tokens, lambda joined, _, rank=rank: rank.get(joined))
        for left in [*tokens, "a"]:
            for right in [*tokens, "b"]:
                assert automaton._apart(left, right) == (automaton.merged(left + right) == [left, right])
