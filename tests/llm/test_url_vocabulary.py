"""Words of every page count for the segmentation of hosts."""

from grovekit.llm import url_filter


def test_a_word_of_late_pages_is_known(spark):
    rows = [(i, f"https://site{i}.example.org/en/{i}", "<p>common words of most pages</p>") for i in range(2600)]
    rows += [(3000 + i, f"https://zymurgyquokka.example.org/x/{i}", f"<p>{'zymurgy quokka' if i < 4 else ''}</p>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (url_filter.TRAIN_URLS, 3):  # also where no host of the fitted sample has these words
        got = {r.page_id: r.words for r in url_filter.judged(pages, url_filter.fit(pages, most=most)).collect()}
        assert len(got) == len(rows) and all(got[3000 + i].startswith("zymurgy quokka example x") for i in range(5))


def test_every_url_is_learned_from(spark):
    """words that one URL each has count alike, however many URLs there are."""
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(21_000)]
    rows = [(i, f"https://a.net/{w}") for i, w in enumerate(names)] + [(-1, "https://b.org/fr/zzzzz")] + [(50_000 + i, f"https://c.museum/{w}") for i, w in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    got = url_filter.judged(pages, url_filter.fit(pages)).where("page_id >= 50000")
    assert [(r.log_odds, r.n) for r in got.groupBy("log_odds").agg({"*": "count"}).toDF("log_odds", "n").collect()] == [(got.first().log_odds, len(names))]
