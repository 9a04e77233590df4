"""URL filters: rules first, then host word segmentation and naive Bayes.

A URL's host and path are cut out by SQL functions. Rules name a host, which stands for its subdomains
too, and a path prefix; of those that fit the longest decides. Where none fits, the labels of the host are
segmented into words by unigram Viterbi, so that names run together come apart, and multinomial naive
Bayes scores the words of host and path.

The classifier learns from the rules: the URLs that one of them decides are its examples, and what their other
words say holds for URLs that no rule fits. What the rules look at (their own labels and path parts) is
no evidence, or it would only learn the rules again. It is fitted to all different URLs. Without an example of both
classes every other URL is allowed. Unigrams are the words of all pages without their mark-up, where words stand
apart, and the path words of all URLs. They and the scores of words stay tables, whatever their size: each host is
handed the unigrams that occur in it, and scores are joined and summed as whole multiples of 2^-32, in any order alike.

Cases: a null URL or one without ``://`` has empty host and path, no rule, and verdict ``allow``. Equal
URLs get equal verdicts. Ties between rules go to ``block``; ties of scores to ``allow``. Long URLs are
read whole. Null ids and repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import CACHE_SIZE
from .common import checkpointed, map_columns

#: The most URLs that ``fit`` learns from, unless it is told another number: all.
TRAIN_URLS = None
#: Times a word must be seen to be taken as one.
OFTEN = 3
#: What scores are whole multiples of, inverted.
UNIT = 1 << 32
#: Added to each word's count in each class.
SMOOTH = 1
#: The longest word, which is also the longest label that a host may have.
LONGEST = 63

# The rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_SPLIT = re.compile(r"[a-z]+").findall


def host_and_path(url: str) -> tuple[Column, Column]:
    """A URL column's host, with A-Z lower-cased, and its path; both empty without ``://``."""
    c = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", c)
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), locate('://', coalesce(`{url}`, '')) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Iterable = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls."""
    found = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(verdict).alias("verdict"), F.lit(h + p).alias("name"))) for verdict, h, p in rules]
    best = F.array_max(F.array(*found))
    return best["name"], best["verdict"]


class Model:
    """Unigrams for segmentation, and the class scores of words."""

    def __init__(self, unigrams: Counter, blocked: Counter, allowed: Counter, prior: float | None = None, total: int = 0) -> None:
        total = self.total = total or sum(unigrams.values()) or 1
        #: (w, n) and (w, odds), the score in ``UNIT``: what ``fit`` learned, in place of ``log_word`` and ``log_odds``.
        self.vocabulary: DataFrame | None = None
        self.odds: DataFrame | None = None
        self.log_word = {w: math.log(n / total) for w, n in unigrams.items()}
        #: An unknown word is rarer by a factor of ten for each letter.
        self.log_new = [math.log(0.1 / total) - n * math.log(10) for n in range(LONGEST + 1)]
        words = set(blocked) | set(allowed)
        b, a = sum(blocked.values()) + SMOOTH * (len(words) + 1), sum(allowed.values()) + SMOOTH * (len(words) + 1)
        self.log_odds = {w: math.log((blocked[w] + SMOOTH) / b) - math.log((allowed[w] + SMOOTH) / a) for w in words}
        #: Without examples of both classes nothing is blocked.
        self.bias = math.log(prior / (1 - prior)) if prior and prior < 1 else -math.inf
        self.held: dict[str, list[str]] = {}
        self.size = 0

    def segment(self, name: str, known: dict[str, float] | None = None) -> list[str]:
        """The words of a run of letters, by the best product of their unigram probabilities; ``known`` has more words' logarithms."""
        got = self.held.get(name)
        if got is not None:
            return got
        best, back = [0.0], [0]
        for i in range(1, len(name) + 1):
            top, at = -math.inf, i - 1
            for j in range(max(0, i - LONGEST), i):
                w = name[j:i]
                s = best[j] + (self.log_word[w] if w in self.log_word else (known or {}).get(w, self.log_new[i - j]))
                if s > top:
                    top, at = s, j
            best.append(top)
            back.append(at)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        if self.size > CACHE_SIZE:
            self.held.clear()
            self.size = 0
        self.size += len(name) + 256
        got = self.held[name] = out[::-1]
        return got

    def words(self, host: str, path: str, known: dict[str, float] | None = None) -> list[str]:
        """Segmented words of the host's labels but the last, and the path's words."""
        return [w for p in _SPLIT(host.rpartition(".")[0]) for w in self.segment(p, known)] + _SPLIT(path.lower())

    def score(self, host: str, path: str, known: dict[str, float] | None = None) -> float:
        """The log odds of ``block``."""
        return self.bias + sum(self.log_odds.get(w, 0.0) for w in self.words(host, path, known))


def _parts(hosts: DataFrame) -> DataFrame:
    """(host, w): what may be a word in the labels of each host but the last."""
    runs = hosts.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("host", r"(?s)^(.*)\.[^.]*$", 1), F.lit("[a-z]+"), F.lit(0)))).alias("run"))
    starts = runs.select("host", "run", F.explode(F.expr("sequence(1, length(run))")).alias("i"))
    return starts.select("host", F.explode(F.expr(f"transform(sequence(1, least({LONGEST}, length(run) - i + 1)), k -> substring(run, i, k))")).alias("w")).distinct()


def _parsed(pages: DataFrame, rules: Iterable) -> DataFrame:
    host, path = host_and_path("url")
    at = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return at.withColumns({"rule": name, "ruled": verdict})


def _path_words(path: str = "path") -> Column:
    return F.regexp_extract_all(F.lower(path), F.lit("[a-z]+"), F.lit(0))


def _segmented(hosts: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """(host, host_words): the segmented words of each of the different ``hosts``, joined by spaces."""
    known = _parts(hosts).join(vocabulary, "w").groupBy("host").agg(F.concat_ws(" ", F.collect_list(F.concat("w", F.lit(":"), "n"))).alias("known"))
    at = hosts.join(known, "host", "left").select("host", F.concat(F.coalesce("known", F.lit("")), F.lit("\n"), "host").alias("both"))

    def make() -> Callable:
        model = Model(Counter(), Counter(), Counter(), total=total)

        def work(rows: list) -> dict:
            out = []
            for r in rows:
                listed, _, host = r.partition("\n")
                out.append(" ".join(model.words(host, "", {w: math.log(int(n) / total) for w, _, n in (x.partition(":") for x in listed.split())})))
            return {"host_words": out}

        return work

    return map_columns(at, ["host", "both"], "host_words string", make)


def fit(pages: DataFrame, rules: Iterable = RULES, most: int | None = TRAIN_URLS) -> Model:
    """Learn from ``url`` and, where that column is there, ``html``; with ``most`` from that many URLs, the first by a hash."""
    urls = pages.select(F.lit(None).alias("page_id"), "url").where(F.col("url").isNotNull()).distinct()
    if most is not None:
        urls = urls.orderBy(F.xxhash64("url"), "url").limit(most)
    urls = checkpointed(_parsed(urls, rules).select("host", "path", "ruled"))
    counted = urls.select(F.explode(F.array_distinct(_path_words())).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    if "html" in pages.columns:
        text = F.lower(F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</[^>]*>", " "), "<[^>]*>", " "))
        words = pages.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("w"))
        counted = counted.unionByName(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)).groupBy("w").agg(F.sum("n").alias("n"))
    vocabulary = checkpointed(counted.where(F.length("w") <= LONGEST))
    total = vocabulary.agg(F.sum("n")).first()[0] or 1

    ruled = urls.where(F.col("ruled").isNotNull())
    seen = ruled.join(_segmented(ruled.select("host").distinct(), vocabulary, total), "host")
    words = seen.select("ruled", F.explode(F.concat(F.split("host_words", " "), _path_words())).alias("w"))
    looked_at = sorted({p for _, h, q in rules for p in _SPLIT(h + q)})
    blocked, allowed = (F.count(F.when(F.col("ruled") == v, 1)) for v in ("block", "allow"))
    counts = checkpointed(words.where((F.col("w") != "") & ~F.col("w").isin(looked_at)).groupBy("w").agg(blocked.alias("blocked"), allowed.alias("allowed")))
    n, b, a = counts.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
    share = lambda c, sum_: F.log((F.col(c) + SMOOTH) / F.lit(float(sum_ + SMOOTH * (n + 1))))
    examples = {r.ruled: r["count"] for r in ruled.groupBy("ruled").count().collect()}
    model = Model(Counter(), Counter(), Counter(), examples.get("block", 0) / max(1, sum(examples.values())), total)
    model.vocabulary = vocabulary
    model.odds = counts.select("w", F.round((share("blocked", b) - share("allowed", a)) * UNIT).cast("long").alias("odds"))
    return model


def judged(pages: DataFrame, model: Model, rules: Iterable = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, log_odds) for each row; ``model`` is one of ``fit``."""
    at = _parsed(pages, rules)

    def scored(words: DataFrame, key: str) -> DataFrame:
        return words.join(model.odds, "w").groupBy(key).agg(F.sum("odds").alias(f"{key}_odds"))

    hosts = checkpointed(_segmented(at.select("host").distinct(), model.vocabulary, model.total))
    hosts = hosts.join(scored(hosts.select("host", F.explode(F.split("host_words", " ")).alias("w")), "host"), "host", "left")
    paths = scored(at.select("path").distinct().select("path", F.explode(_path_words()).alias("w")), "path")
    at = at.join(hosts, "host", "left").join(paths, "path", "left")
    words = F.concat_ws(" ", F.when(F.col("host_words") != "", F.col("host_words")), _path_words())
    odds = F.lit(model.bias) + (F.coalesce("host_odds", F.lit(0)) + F.coalesce("path_odds", F.lit(0))) / F.lit(float(UNIT))
    learned = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return at.withColumns({"words": words, "log_odds": odds}).select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "words", "log_odds")
