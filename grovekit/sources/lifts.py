"""The driver's tables seen as trees, histories and event streams; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovekit.functions.hashes import BLOB, blob_id

from .tables import read_table


def _files(df: DataFrame, tree, path, content) -> DataFrame:
    return df.select(tree.alias("tree_id"), path.alias("path"), F.lit(BLOB).alias("mode"), blob_id(content).alias("oid"), content.alias("content"))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree: lang/source/doc_<id>.txt."""
    path = F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    return _files(read_table(spark, sf_dir, "documents"), F.lit("docs"), path, F.col("text"))


#: Shared pieces of SQL: the same lifts as common table expressions.
SQL_DOCS = "d AS (SELECT doc_id, text AS content, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM documents)"


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of parts: type/brand/name/key; the content is the part's size."""
    path = F.concat_ws("/", "p_type", F.replace("p_brand", F.lit("#"), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey")
    return _files(read_table(spark, sf_dir, "part"), F.lit("parts"), path, F.col("p_size").cast("string"))


SQL_PARTS = "p AS (SELECT p_type || '/' || replace(p_brand, '#', '_') || '/' || replace(p_name, ' ', '_') || '/' || p_partkey AS path, p_size, p_partkey FROM part)"


def conv_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as histories of one line: a commit a turn."""
    t = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    cid = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    return t.select(
        F.col("conv_id").cast("string").alias("repo"), cid.alias("commit_id"), "turn", F.sha1(F.encode("text", "UTF-8")).alias("tree"),
        F.array_compact(F.array(F.when(F.lag("turn").over(w).isNotNull(), F.concat_ws("-", F.col("conv_id"), F.lag("turn").over(w))))).alias("parents"),
        F.struct(F.col("role").alias("name"), F.concat("role", F.lit("@example.com")).alias("email"), F.col("turn").alias("ts")).alias("author"), F.col("text").alias("message"),
    )


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a history of one line; a commit's view is the supplier month it shows."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("commit_id"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("n"), F.col("o_orderpriority").alias("tree"), F.substring("o_orderpriority", 1, 1).alias("view"))


SQL_ORDERS = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS repo, CAST(o_orderkey AS VARCHAR) AS commit_id, o_orderdate AS day, o_orderkey AS n, o_orderpriority AS tree, substr(o_orderpriority, 1, 1) AS \"view\" FROM orders)"

BUCKETS = 16


def event_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commit graphs, one for each of a few groups of users.

    The first parent is the user's event before; a purchase also has the group's event before it, if that
    is another one, which makes merges.
    """
    e = read_table(spark, sf_dir, "events").withColumn("repo", (F.col("user_id") % BUCKETS).cast("string"))
    mine = F.lag("event_id").over(Window.partitionBy("repo", "user_id").orderBy("ts", "event_id"))
    group = F.lag("event_id").over(Window.partitionBy("repo").orderBy("ts", "event_id"))
    x = e.select("repo", F.col("event_id").alias("id"), "event_type", "user_id", mine.alias("a"), F.when(F.col("event_type") == "purchase", group).alias("b"))
    parents = F.array_distinct(F.array_compact(F.array(F.col("a").cast("string"), F.col("b").cast("string"))))
    return x.select("repo", F.col("id").cast("string").alias("commit_id"), "event_type", "user_id", parents.alias("parents"))


SQL_DAG = """e0 AS (SELECT CAST(user_id % 16 AS VARCHAR) AS repo, event_id AS id, event_type, user_id,
 lag(event_id) OVER (PARTITION BY user_id % 16, user_id ORDER BY ts, event_id) AS a,
 CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) END AS b FROM events),
 dag AS (SELECT repo, CAST(id AS VARCHAR) AS commit_id, event_type, user_id, id, a, b FROM e0),
 edge AS (SELECT repo, commit_id, 0 AS ix, CAST(coalesce(a, b) AS VARCHAR) AS parent FROM dag WHERE coalesce(a, b) IS NOT NULL
 UNION ALL SELECT repo, commit_id, 1, CAST(b AS VARCHAR) FROM dag WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"""
