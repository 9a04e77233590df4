"""Mix sources to target weights: exact block quotas, a hypergeometric splitting tree, disjoint blocks.

DataFrame and SQL functions only. A source's documents fall into ``blocks`` blocks by a hash. Targets
come from the weights, with a ceiling at ``cap`` times a source's own size; the excess is shared again
by weight. A source then gives whole passes over all its blocks, and a last pass that takes blocks in a
permuted order until the target is met; the block in which it is met is split by hash value, first by
sub-block, then by document, so the words taken miss the target by half a document at most.

The blocks drawn (one for each pass and block) are dealt to the output shards by a binary tree: at each
node the quotas of all sources are split by a multivariate hypergeometric draw, exactly, by inverting
the distribution at a hashed uniform number. Leaves then own consecutive ranges of a source's permuted
draws, so their draws are disjoint. What a document gives is read off the leaves' draws of its block, and
nothing else: a draw is of the whole block, or, the last of a source, of the hashes up to ``cut``. Each
shard is ordered by a hash ("shuffled locally").

What is planned on is a table of sources times blocks. Blocks and shards grow with the words of the table,
by powers of two, from ``BLOCKS`` and ``SHARDS`` on: a block has about ``BLOCK_WORDS`` words, a shard ``SHARD_WORDS``.
Everything depends on ``seed`` and the rows only; reruns agree.

Cases: a null or empty text has size 0 and is kept with taken 0. Null sources form one source, the last.
Null doc_ids are placed by their text. Repeated rows are equal in everything, so they share a decision.
An empty table gives an empty result. Only ``doc_id``, ``text`` and ``source`` are looked at; other
columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 512
SHARDS = 16
BLOCK_WORDS = 1 << 20
SHARD_WORDS = 1 << 24
SEED = 20240917
#: Rows of the plan up to which it is broadcast; a row is under 200 bytes, so this is at most 20 MB.
BROADCAST_ROWS = 100_000

_SPACE = r"\\x20\\x09-\\x0D"


def word_count(text: str) -> Column:
    """Number of runs of characters that are not ASCII white space; null: 0.

    Each run becomes one letter in a single pass, so no array of words is built.
    """
    marks = f"regexp_replace({text}, '[{_SPACE}]*+[^{_SPACE}]++', 'x')"
    return F.expr(f"cast(coalesce(length(rtrim(' \\t\\n\\u000B\\f\\r', {marks})), 0) as bigint)")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``mix_h`` and ``mix_key`` beside a struct of all columns (``mix_row``), so that no column meets a name used here."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), h.alias("mix_h"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("mix_key"))


def _block(blocks: int) -> Column:
    return F.pmod("mix_h", F.lit(blocks)).cast("int").alias("mix_block")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, mix_key, mix_h), one narrow row for each document."""
    keyed = _keyed(docs.select("doc_id", "source", "text"), seed)
    return keyed.select("mix_row.doc_id", "mix_row.source", word_count("mix_row.text").alias("size"), "mix_key", "mix_h")


def _power(n: float, least: int) -> int:
    """The power of two that is ``n`` or more, and ``least`` at least."""
    return max(least, 1 << max(0, int(n - 1)).bit_length())


def targets(block_words: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(mix_key, source_size, target) from words by block. The sources are sorted and levelled as one small table."""
    per = block_words.groupBy("mix_key").agg(F.sum("words").alias("source_size"), F.sum("n_blocks").alias("n_blocks"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_key").eqNullSafe("n"), "mix_key")) - 1
    weighed = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("limit_") / F.col("weight"), "rank")
    before, everyone = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit_").over(before), F.lit(0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("limit_", F.col("source_size") * cap).withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit_"), F.struct(F.col("limit_") / F.col("weight"), "rank", "level"))).over(everyone)
    shared = levelled.withColumn("share", free["level"] * F.col("weight"))
    return shared.select("mix_key", "rank", "n_blocks", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("share", F.col("limit_").cast("double"))).alias("target"))


#: Draws k of a hypergeometric variable: n taken of N units, K of which belong to the source; u is uniform.
#: The values are visited from the mode upwards and then downwards, by the ratio of neighbouring terms.
_DRAW = """
transform(array(named_struct('lo', greatest(0L, {n} - ({N} - {K})), 'hi', least({n}, {K}), 'mode', cast(floor(({n} + 1D) * ({K} + 1D) / ({N} + 2D)) as bigint))), r ->
transform(array(named_struct('lo', r.lo, 'hi', r.hi, 'mode', greatest(r.lo, least(r.hi, r.mode)))), q ->
transform(array(named_struct('lo', q.lo, 'hi', q.hi, 'mode', q.mode,
  'up', aggregate(sequence(q.mode, q.hi), named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * {up}, 's', a.s + a.w)).s,
  'down', aggregate(sequence(q.mode, q.lo), named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * {down}, 's', a.s + a.w)).s)), z ->
  aggregate(sequence(z.mode, z.lo),
    aggregate(sequence(z.mode, z.hi), named_struct('w', 1D, 's', 0D, 'x', {u} * (z.up + z.down - 1D), 'k', -1L),
      (a, k) -> named_struct('w', a.w * {up}, 's', a.s + a.w, 'x', a.x, 'k', if(a.k < 0 and a.s + a.w > a.x, k, a.k)),
      a -> named_struct('w', 1D, 's', a.s - 1D, 'x', a.x, 'k', a.k)),
    (a, k) -> named_struct('w', a.w * {down}, 's', a.s + a.w, 'x', a.x, 'k', if(a.k < 0 and a.s + a.w > a.x, k, a.k)),
    a -> if(a.k < 0, z.mode, a.k)))[0])[0])[0]
"""


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(mix_key, quota) to (mix_key, shard, quota): exact quotas of each shard, whose sizes differ by one at most."""
    levels = (shards - 1).bit_length()
    assert shards == 1 << levels, "shards must be a power of two"
    names = {"n": "acc.take", "N": "acc.pop", "K": "s.quota", "u": "s.u"}
    up = "((s.quota - k) * cast(acc.take - k as double)) / ((k + 1D) * (acc.pop - s.quota - acc.take + k + 1D))"
    down = "(k * cast(acc.pop - s.quota - acc.take + k as double)) / ((s.quota - k + 1D) * (acc.take - k + 1D))"
    draw = _DRAW.format(**names, up=up, down=down)
    fold = f"""aggregate(sources,
        named_struct('pop', total, 'take', left_n, 'out', cast(array() as array<struct<mix_key:string,quota:bigint,left:bigint>>)),
        (acc, s) -> transform(array({draw}), k1 -> named_struct('pop', acc.pop - s.quota, 'take', acc.take - k1,
            'out', concat(acc.out, array(named_struct('mix_key', s.mix_key, 'quota', s.quota, 'left', k1)))))[0]).out"""
    nodes = quotas.select(F.lit(0).alias("node"), "mix_key", "quota")
    for level in range(levels):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node", "mix_key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
        grouped = nodes.withColumn("u", u).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("mix_key", "quota", "u"))).alias("sources"), F.sum("quota").alias("total"))
        grouped = grouped.withColumn("left_n", F.expr("total div 2"))
        split = grouped.select("node", F.explode(F.expr(fold)).alias("d"))
        nodes = split.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), "d.mix_key", F.col("d.left").alias("quota")), F.struct((F.col("node") * 2 + 1).alias("node"), "d.mix_key", (F.col("d.quota") - F.col("d.left")).alias("quota")))).alias("c")).select("c.*")
    return nodes.withColumnRenamed("node", "shard")


def plan(narrow: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, blocks: int | None = None, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """What each (mix_key, mix_block) gives: source_size, target and its draws, an array of (pass, shard, cut).

    A draw is of all documents of the block whose hash is ``cut`` or less.
    """
    total = narrow.agg(F.sum("size")).first()[0] or 0
    blocks, shards = blocks or _power(total / BLOCK_WORDS, BLOCKS), shards or _power(total / SHARD_WORDS, SHARDS)
    narrow = narrow.withColumn("mix_block", _block(blocks))
    per_block = narrow.groupBy("mix_key", "mix_block").agg(F.sum("size").alias("words"))
    source = targets(per_block.withColumn("n_blocks", F.lit(1)), weights, cap)
    source = source.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    source = source.withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("bigint") - F.col("passes") * F.col("source_size")))
    permuted = Window.partitionBy("mix_key").orderBy(F.xxhash64(F.lit(seed), F.lit("rest"), "mix_key", "mix_block"), "mix_block")
    laid = per_block.join(source, "mix_key").withColumn("upto", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("left_over", F.col("rest") - (F.col("upto") - F.col("words")))
    whole = (F.col("left_over") >= F.col("words")) & (F.col("rest") > 0)
    edge = (F.col("left_over") > 0) & (F.col("left_over") < F.col("words"))
    laid = laid.withColumn("fill", F.when(whole, 2).when(edge, 1).otherwise(0)).select("mix_key", "mix_block", "source_size", "target", "passes", "left_over", "fill")
    # The block in which a source's last pass ends: hash ranges of it first, then the documents of one range.
    within = narrow.join(laid.where("fill = 1").select("mix_key", "mix_block", "left_over"), ["mix_key", "mix_block"])
    within = within.withColumn("part", F.shiftright("mix_h", 52).cast("int"))
    ranges = within.groupBy("mix_key", "mix_block", "part").agg(F.sum("size").alias("words"), F.first("left_over").alias("left_over"), F.max("mix_h").alias("top"))
    by_part = Window.partitionBy("mix_key", "mix_block").orderBy("part")
    ranges = ranges.withColumn("upto", F.sum("words").over(by_part.rowsBetween(Window.unboundedPreceding, 0)))
    full = ranges.where("upto <= left_over").groupBy("mix_key", "mix_block").agg(F.max("top").alias("cut"))
    last = ranges.where("upto > left_over and upto - words < left_over").select("mix_key", "mix_block", "part", (F.col("left_over") - (F.col("upto") - F.col("words"))).alias("need"))
    fine = within.join(last, ["mix_key", "mix_block", "part"]).groupBy("mix_key", "mix_block", "mix_h", "need").agg(F.sum("size").alias("words"))
    fine = fine.withColumn("upto", F.sum("words").over(Window.partitionBy("mix_key", "mix_block").orderBy("mix_h").rowsBetween(Window.unboundedPreceding, 0)))
    fine = fine.where("2 * upto - words <= 2 * need").groupBy("mix_key", "mix_block").agg(F.max("mix_h").alias("cut"))
    cuts = full.unionByName(fine).groupBy("mix_key", "mix_block").agg(F.max("cut").alias("cut"))
    top = F.lit((1 << 63) - 1)
    laid = checkpointed(laid.join(cuts, ["mix_key", "mix_block"], "left").select("mix_key", "mix_block", "source_size", "target", "passes", F.when(F.col("fill") == 2, top).when(F.col("fill") == 1, F.col("cut")).alias("cut")))
    # Draws: a row for each pass over a block; the tree says how many of a source's draws each shard owns.
    draws = laid.select("mix_key", "mix_block", "passes", "cut", F.explode(F.expr("filter(sequence(0, passes), p -> p < passes or cut is not null)")).alias("pass"))
    draws = draws.withColumn("cut", F.when(F.col("pass") < F.col("passes"), top).otherwise(F.col("cut"))).drop("passes")
    at = F.row_number().over(Window.partitionBy("mix_key").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "mix_key", "mix_block"), "mix_block")) - 1
    leaf = split_tree(draws.groupBy("mix_key").agg(F.count("*").alias("quota")), shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("mix_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    owned = leaf.withColumn("upto", upto).where("quota > 0").select("mix_key", "shard", F.explode(F.expr("sequence(upto - quota, upto - 1)")).alias("at"))
    placed = draws.withColumn("at", at.cast("bigint")).join(owned, ["mix_key", "at"])
    drawn = placed.groupBy("mix_key", "mix_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "cut"))).alias("draws"))
    return laid.join(drawn, ["mix_key", "mix_block"], "left").select("mix_key", "mix_block", "source_size", "target", "draws", F.lit(blocks).alias("blocks"), F.lit(shards).alias("shards"))


def _with_plan(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """``docs`` (mix_key, mix_h, ...) with mix_source_size, mix_target, mix_shards and ``mix_copies``: (shard, order) of each copy the leaves' draws take."""
    named = checkpointed(planned.select("mix_key", "mix_block", *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "draws", "blocks", "shards")]))
    n, blocks = named.agg(F.count("*"), F.coalesce(F.max("mix_blocks"), F.lit(BLOCKS))).first()
    joined = docs.withColumn("mix_block", _block(blocks)).join(F.broadcast(named) if n <= BROADCAST_ROWS else named, ["mix_key", "mix_block"])
    mine = F.filter(F.coalesce("mix_draws", F.array().cast("array<struct<pass:int,shard:int,cut:bigint>>")), lambda d: F.col("mix_h") <= d["cut"])
    return joined.withColumn("mix_copies", F.transform(mine, lambda d: F.struct(d["shard"].alias("shard"), F.xxhash64(d["shard"], d["pass"], F.col("mix_h")).alias("order"))))


def decisions(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, and of each copy its shard (``shards``) and its place there (``orders``)."""
    narrow = checkpointed(sizes(docs, seed))
    joined = _with_plan(narrow, plan(narrow, seed=seed, **options))
    return joined.select(
        "doc_id", "source", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.size("mix_copies")).alias("taken"),
        F.col("mix_copies.shard").alias("shards"), F.col("mix_copies.order").alias("orders"),
    )


def mixed(docs: DataFrame, placed: bool = False, seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, with all their columns.

    ``placed`` gives (mix_row, mix_shard, mix_order, mix_n) instead: the columns as a struct, the place, and the number of shards.
    """
    narrow = checkpointed(sizes(docs, seed))
    drawn = _with_plan(_keyed(docs, seed), plan(narrow, seed=seed, **options))
    copies = drawn.select("mix_row", F.col("mix_shards").alias("mix_n"), F.explode("mix_copies").alias("mix_copy"))
    if placed:
        return copies.select("mix_row", F.col("mix_copy.shard").alias("mix_shard"), F.col("mix_copy.order").alias("mix_order"), "mix_n")
    return copies.select("mix_row.*")


def shuffled(docs: DataFrame, **options) -> DataFrame:
    """The mix in its shards: rows of a shard are together, in the order of its local shuffle."""
    placed = mixed(docs, placed=True, **options)
    return placed.repartition(F.col("mix_shard")).sortWithinPartitions("mix_shard", "mix_order").select("mix_row.*")
