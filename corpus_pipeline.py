"""The corpus pipeline: filter by quality, drop near copies, mask secrets, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets what was written and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovekit.llm import mil_quality, mixing_tree, secret_battery, sentencepiece_scan, shingle_links
from grovekit.llm.common import checkpointed, fresh, read_table, shared_folder, short_batches

# SQL can express neither the learned filter nor the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted to the labels of the training fold."""
    short_batches(spark)
    score = fresh("stage_score", docs.columns)
    model = mil_quality.fit(docs, read_table(spark, sf_dir, "labels"))
    kept = mil_quality.scored(docs, model, docs.columns, score).where(F.col(score) >= mil_quality.THRESHOLD)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Keys of dropped rows up to which they are broadcast (two longs each, so about 20 MB); beyond it rows are joined by a shuffle.
BROADCAST_ROWS = 200_000


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id: five-word shingles, similarity 0.8 or more.

    A row without an id is known by its text's hash, made negative. Rows that share an id but not a group stand apart:
    of each group the row of the smallest id, then text hash, then other columns stays.
    """
    short_batches(spark)
    row_key, text_key, place = (fresh(x, docs.columns) for x in ("stage_row_key", "stage_text_key", "stage_place"))
    key, names = [row_key, text_key], [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({row_key: F.coalesce("doc_id", -F.abs(F.xxhash64("text") % (1 << 62)) - (1 << 61)), text_key: shingle_links.text_key()})
    found = shingle_links.near_copies(keyed.select(F.col(row_key).alias("doc_id"), "text"))
    low = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("low"))
    gone = found.join(low, "component").where(F.struct("doc_id", "text_key") != F.col("low")).select(F.col("doc_id").alias(row_key), F.col("text_key").alias(text_key)).distinct()
    again = keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)

    def held(rows: DataFrame) -> DataFrame:
        rows = checkpointed(rows)
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    gone, again = held(gone), held(again)
    rows = keyed.join(gone, key, "left_anti")
    alike = Window.partitionBy(*key).orderBy(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    one = rows.join(again, key, "left_semi").withColumn(place, F.row_number().over(alike)).where(F.col(place) == 1)
    return rows.join(again, key, "left_anti").select(*names).unionByName(one.select(*names))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    short_batches(spark)
    return secret_battery.mask(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: documents left out, kept, or repeated up to three times; each shard is shuffled."""
    return mixing_tree.shuffled(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids and their number, without its text; where a column has such a name already, the new one gets an underscore."""
    short_batches(spark)
    rest = [c for c in docs.columns if c != "text"]
    ids, n = fresh("ids", rest), fresh("n_tokens", rest)
    found = sentencepiece_scan.encode(docs, columns=rest, name=ids)
    return found.withColumn(n, F.coalesce(F.expr(f"array_size(`{ids}`)"), F.lit(0)).cast("bigint"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{at}_{name}")
            docs = spark.read.parquet(path)
    return docs
