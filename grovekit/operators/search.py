"""Text search: folded trigram postings, candidate paths and exact line matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a query's trigrams, how many of the rarest are looked up; fewer only let more candidates through.
MOST = 16


def fold_text(text: Column) -> Column:
    """A-Z to lower case; other ASCII characters but letters, digits and the underscore to blanks."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]", " ")


def trigrams(text: Column) -> Column:
    """The distinct three-character windows of the folded text."""
    def windows(t: Column) -> Column:
        c = F.split(t, "", -1)
        return F.transform(F.array(c), lambda x: F.transform(F.sequence(F.lit(0), F.length(t) - 3), lambda i: F.concat(x[i], x[i + 1], x[i + 2])))[0]

    # Bound once by a lambda: folding is not done again for each window, nor characters counted from the start.
    return F.transform(F.array(fold_text(text)), lambda t: F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(windows(t))))[0]


def postings(files: DataFrame) -> DataFrame:
    """(tree_id, trigram, path), each once: the inverted index in long form, so a common trigram is no long array."""
    return files.select("tree_id", "path", F.explode(trigrams(F.coalesce("content", F.lit("")))).alias("trigram")).select("tree_id", "trigram", "path")


def new_postings(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Postings of the blobs whose ``oid`` is not in ``indexed`` yet."""
    return postings(files.join(indexed.select("oid").distinct(), "oid", "left_anti"))


def query_trigrams(query: str) -> list[str]:
    folded = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or c == "_" or ord(c) > 127 else " " for c in query)
    return list(dict.fromkeys(folded[i : i + 3] for i in range(len(folded) - 2)))


def candidates(index: DataFrame, files: DataFrame, query: str, most: int = MOST) -> DataFrame:
    """(tree_id, path) that hold all of the query's rarest trigrams: a superset of the matches.

    A query under three characters leaves every file.
    """
    wanted = query_trigrams(query)
    if not wanted:
        return files.select("tree_id", "path")
    hits = index.where(F.col("trigram").isin(wanted))
    if len(wanted) > most:
        rare = hits.groupBy("trigram").count().orderBy("count", "trigram").limit(most)
        wanted = [r.trigram for r in rare.collect()]
        hits = index.where(F.col("trigram").isin(wanted))
    return hits.groupBy("tree_id", "path").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("tree_id", "path")


def lines(files: DataFrame) -> DataFrame:
    """(tree_id, path, line, text), lines numbered from 1; a line feed at the end opens no line, a carriage return before it goes."""
    text = F.coalesce("content", F.lit(""))
    parts = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    split = files.where(text != "").select("tree_id", "path", F.posexplode(parts).alias("at", "text"))
    return split.select("tree_id", "path", (F.col("at") + 1).alias("line"), F.regexp_replace("text", r"\r\z", "").alias("text"))


def matches(files: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """Lines that contain the query, case and all; through the index if there is one, with equal results."""
    kept = files.where(F.contains(F.coalesce("content", F.lit("")), F.lit(query)))
    if index is not None:
        kept = kept.join(candidates(index, files, query), ["tree_id", "path"], "left_semi")
    return lines(kept).where(F.contains("text", F.lit(query)))
