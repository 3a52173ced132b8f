"""Mixing sources to target weights, on DataFrame functions only.

1. Pack: a source's documents, in order of doc_id, are one stream of words cut
   into blocks of ``block`` words.  Positions come from two-level running sums
   (hash buckets of about sqrt(rows) documents, then the buckets), so a source
   that holds most rows is spread over many tasks.
2. Draw: each slot of the output draws a source with the target weights; the
   counts per shard and source are multinomial.  Running sums of the counts are
   scaled to the source's number of slots, so the totals meet the targets and
   no source is passed through more often than its cap allows.
3. Map: a source's slots are numbered over the shards; slot k reads block
   permutation(k mod blocks) of pass k div blocks.  The permutation is a
   swap-or-not shuffle, an exact bijection of any number of blocks.
4. Join blocks by (source, block).

Sources are ordered by code point, null last, and weigh ``weights``, repeating.
The target of a source is its share of ``share`` x all words, at most ``cap`` x
its own; the excess is shared among the others by weight until none is above.

Defined cases: null and empty texts have size 0 and are never taken; null
sources are one source; null doc_ids sort last; rows are told apart by their
own number, so repeated rows count as often as they stand; an empty table
gives an empty mix.  Reruns on the same rows agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import WORD, staged, with_row_id

BLOCK = 128
SHARD = 4096
CELL = 64
ROUNDS = 24
SEED = 17
SOURCES_BROADCAST = 10_000
SLOTS_PER_TASK = 100_000


def size_of(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: sid, source_size, target.  Windows run over the sources only."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    sources = (
        sources.withColumn("sid", (F.row_number().over(ordered) - 1).cast("long"))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("all_words", F.sum("source_size").over(everything) * share)
    )
    # filled in order of most / weight, a source is full if its share of what is left exceeds its most
    filled = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    level = (F.col("all_words") - before) / left
    sources = sources.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level"))).over(everything)
    )
    target = F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return sources.select("source", "sid", "source_size", target.alias("target"))


def with_source(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Rows with their source's columns; broadcast only a source table of checked size."""
    named = sources.withColumnRenamed("source", "source_name")
    if count <= SOURCES_BROADCAST:
        named = F.broadcast(named)
    return rows.join(named, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")


def positions(rows: DataFrame, buckets: int) -> DataFrame:
    """(row_id, sid, size, start): where each document starts in its source's stream of words."""
    placed = rows.select("row_id", "doc_id", "sid", "size").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets))
    )
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "size", "row_id")
    inside = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        placed.withColumn("inside", inside)
        .join(sums, ["sid", "bucket"])
        .select("row_id", "sid", "size", (F.col("bucket_start") + F.col("inside")).alias("start"))
    )


def slots(sources: DataFrame, total: int, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(sid, shard, slot, pass, block): what each slot of the output reads.

    ``sources`` has sid, blocks, quota (its slots) and first (slots of the
    sources before it).
    """
    spark = sources.sparkSession
    shards = -(-total // shard)
    cells = sources.where("quota > 0").select(
        "sid", "first", "quota", F.explode(F.expr(f"sequence(first div {CELL}, (first + quota - 1) div {CELL})")).alias("cell")
    )
    draws = spark.range(total).select(
        F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("u")
    )
    # both sides grow with the mix: they are merged, never broadcast (their sizes before the explode mislead)
    drawn = (
        draws.withColumn("cell", F.expr(f"u div {CELL}"))
        .join(cells.hint("merge"), "cell")
        .where("u >= first AND u < first + quota")
        .select("shard", "sid")
    )
    # one draw more per source, in a shard of its own choice: even the smallest source is drawn
    sure = sources.where("quota > 0").select(F.pmod(F.xxhash64(F.lit(seed), "sid"), F.lit(shards)).alias("shard"), "sid")
    counts = drawn.unionByName(sure).groupBy("sid", "shard").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("sid").orderBy("shard")
    share = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy("sid"))
    quotas = sources.select("sid", "blocks", "quota")
    scaled = counts.withColumn("share", share).join(quotas, "sid")
    scaled = scaled.withColumn("end", F.floor(F.col("share") * F.col("quota")))
    scaled = scaled.withColumn("begin", F.coalesce(F.lag("end").over(upto), F.lit(0)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLOTS_PER_TASK))
    spread = scaled.where("end > begin").repartition(parts, "sid", "shard")
    numbered = spread.select(
        "sid", "shard", "blocks", F.explode(F.expr("sequence(begin, end - 1)")).alias("k")
    ).selectExpr("sid", "shard", "blocks", "k AS slot", "k div blocks AS pass", "k % blocks AS x")
    key = f"pmod(xxhash64({seed}, sid, pass, -r), blocks)"
    partner = f"pmod({key} - x, blocks)"
    coin = f"(xxhash64({seed}, sid, pass, r, greatest(x, {partner})) & 1) = 1"
    shuffled = f"aggregate(sequence(1, {ROUNDS}), x, (x, r) -> IF({coin}, {partner}, x))"
    return numbered.selectExpr("sid", "shard", "slot", "pass", f"{shuffled} AS block")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row_id, sid, block, begin, words): the part of each document in each block."""
    spans = placed.where("size > 0").select(
        "*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")
    )
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    return spans.select("row_id", "sid", "block", begin.alias("begin"), (end - begin).alias("words"))


def mixed(rows: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **shares) -> tuple[DataFrame, DataFrame]:
    """(sources, taken pieces) of written rows with row_id, doc_id, source and size.

    The pieces have row_id, shard, slot, pass, begin and words; the sources
    sid, source_size and target.
    """
    sources = staged(targets(rows, **shares), "mix-sources")
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.when(
        F.col("source_size") > 0, F.least(blocks * 2, F.round(F.col("target") * blocks / F.col("source_size")))
    ).otherwise(0)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    drawable = sources.select("sid", blocks.alias("blocks"), quota.cast("long").alias("quota"))
    drawable = staged(
        drawable.withColumn("first", F.coalesce(F.sum("quota").over(before), F.lit(0))), "mix-quotas"
    )
    count, total = drawable.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    buckets = max(1, round(rows.count() ** 0.5))
    placed = positions(with_source(rows, sources, count), buckets)
    taken = pieces(placed, block).join(slots(drawable, total, shard, seed).hint("merge"), ["sid", "block"])
    return sources, taken.select("row_id", "shard", "slot", "pass", "begin", "words")


def words_taken(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of().alias("size"))
    rows = staged(with_row_id(rows, "row_id"), "mix-sizes")
    sources, taken = mixed(rows, block, **options)
    sums = taken.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return (
        with_source(rows, sources, sources.count())
        .join(sums, "row_id", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``.

    A document gives one row per pass of its source that takes words of it; the
    text of the row is what the pass takes: the whole text as it is, or the
    words of the taken blocks joined by spaces (n_chars follows).
    """
    columns = docs.columns
    prefix = "mix_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    held = staged(with_row_id(docs.withColumn(f"{prefix}size", size_of()), f"{prefix}row_id"), "mix-documents")
    rows = held.select(
        F.col(f"{prefix}row_id").alias("row_id"), F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.col(f"{prefix}size").alias("size"),
    )
    _, taken = mixed(rows, block, **options)
    parts = taken.groupBy(F.col("row_id").alias(f"{prefix}row_id"), F.col("pass").alias(f"{prefix}pass")).agg(
        F.sum("words").alias(f"{prefix}taken"),
        F.array_sort(F.collect_list(F.struct("begin", "words"))).alias(f"{prefix}parts"),
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = F.expr(
        f"flatten(transform({prefix}parts, p -> slice({prefix}words, int(p.begin) + 1, int(p.words))))"
    )
    whole = F.col(f"{prefix}taken") == F.col(f"{prefix}size")
    joined = held.join(parts, f"{prefix}row_id").withColumn(f"{prefix}words", F.when(~whole, words))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(chosen, " "))
    joined = joined.withColumn(f"{prefix}count", F.size(f"{prefix}words")).withColumn("text", text)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return joined.select(*columns)
