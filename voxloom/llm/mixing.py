"""Mixing sources to target weights.

Words of each source form one long stream in ``doc_id`` order, cut into blocks of fixed length. A
source gets its share of the slots of the whole mix, rounded to blocks, one at least. Given these
totals, the shards draw: all slots in source order are cut into as many equal strata as a shard has
slots, and a keyed permutation (swap-or-not rounds) deals each stratum to the shards, one slot each
(the last shard takes part in as many strata as it has slots). Another maps the slots of a source to
blocks, one pass over all blocks per epoch, and slots meet blocks by index.

Sources are ordered by code point, null last, and weigh 3, 1, 2, repeating. Together they get 150 %
of all words; a target stops at twice its source's size and the excess is shared again by weight.
Null text has no words; texts without words take nothing. A null ``doc_id`` comes first. Repeated
rows are separate documents. Everything is a hash of seed and place, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.llm.common import fresh, stored, words_of

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
#: Slots of one source that become rows at once.
PART_SLOTS = 1 << 14
#: Slots that one task fills.
TASK_SLOTS = 1 << 17
ROUNDS = 16
SHARE = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: size, weight, target.

    Sources fill up in the order of limit over weight, so the level of the last step is a running
    sum over this table of one row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    limits = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * MOST)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    stepped = limits.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    first = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(every)["level"]
    target = F.when(F.col("full") | last.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), first * F.col("weight")))
    return stepped.select("source", "rank", "source_size", "weight", target.alias("target"))


def streams(sized: DataFrame) -> DataFrame:
    """Rows (uid, doc_id, source, size) with ``start``, the words before them in their source.

    Range partitions cut a hot source; a running sum inside each is shifted by the sums before it.
    """
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("uid")]
    ranged = stored(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("shift"))
    local = Window.partitionBy("source", "part").orderBy(F.col("doc_id").asc_nulls_first(), "uid").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("end", F.sum("size").over(local))
    joined = inside.join(shifts, inside["source"].eqNullSafe(shifts["_source"]) & (inside["part"] == shifts["_part"]))
    return joined.select("uid", "doc_id", "source", "size", (F.col("end") - F.col("size") + F.col("shift")).alias("start"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not shuffle of 0..n-1 under a key: a permutation for every n."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r, F.lit(1)) - at, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, swap)


def block_uses(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """One row per filled slot: shard, slot, source rank, epoch and block.

    ``plan`` is the stored table of ``targets``; one number, the slots of the whole mix, comes to
    the driver. No block is used more than twice.
    """
    spark = plan.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    sources = plan.where("target > 0").withColumn("blocks", blocks)
    share = F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")
    wanted = F.least(F.col("blocks") * MOST, F.greatest(F.lit(1).cast("long"), share))
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sources = stored(sources.withColumn("wanted", wanted).withColumn("low", F.sum("wanted").over(order) - F.col("wanted")))
    slots = sources.agg(F.sum("wanted")).first()[0] or 0
    if slots == 0:
        return spark.range(0).select(F.col("id").alias("shard"), F.col("id").alias("slot"), F.lit(0).alias("rank"), F.col("id").alias("epoch"), F.col("id").alias("block"))
    shards = -(-slots // shard_slots)
    width = slots - (shards - 1) * shard_slots  # slots of the last shard
    parts = sources.select("rank", "blocks", "low", "wanted", F.expr(f"explode(sequence(0L, (wanted - 1) div {PART_SLOTS})) as part"))
    parts = parts.repartition(-(-slots // TASK_SLOTS))  # a part becomes many slots
    each = parts.selectExpr("rank", "blocks", "low", f"explode(sequence(part * {PART_SLOTS}, least(wanted, (part + 1) * {PART_SLOTS}) - 1)) as j")
    each = each.selectExpr("rank", "blocks", "j", "low + j as at", f"((low + j + 1) * {shard_slots} - 1) div {slots} as stratum")
    each = each.selectExpr("*", f"(stratum * {slots}) div {shard_slots} as begin", f"((stratum + 1) * {slots}) div {shard_slots} as end")
    each = each.selectExpr("rank", "blocks", "stratum", "at - begin as y", "end - begin as n", "j div blocks as epoch", "j % blocks as x")
    each = each.withColumn("shard", permuted(F.col("y"), F.col("n"), F.lit(seed), F.col("stratum")))
    return each.select(
        "shard", F.expr(f"if(shard = {shards - 1}, (stratum * {width}) div {shard_slots}, stratum) as slot"), "rank", "epoch",
        permuted(F.col("x"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch")).alias("block"),
    )


def pieces(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, doc_id, source, size, start) of all rows, the targets, and what each block use takes.

    The last table has uid, epoch, and the words [first, last) of the document.
    """
    placed = stored(streams(docs))
    plan = stored(targets(placed))
    uses = stored(block_uses(plan, block_words, seed=seed))
    ranks = plan.select(F.col("source").alias("_source"), "rank")
    ranked = placed.where("size > 0").join(ranks, placed["source"].eqNullSafe(ranks["_source"])).drop("_source")
    parts = ranked.select(
        "uid", "start", "size", "rank",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"),
    )
    taken = parts.join(uses.select("rank", "epoch", "block"), ["rank", "block"])
    first = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    return placed, plan, taken.select("uid", "epoch", first.alias("first"), last.alias("last"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"))


def report(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, and the words the mix takes of it."""
    placed, plan, parts = pieces(stored(sized(docs)), block_words, seed)
    sums = parts.groupBy("uid").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    by_source = plan.select(F.col("source").alias("_source"), "source_size", "target")
    rows = placed.join(sums, "uid", "left").join(by_source, placed["source"].eqNullSafe(by_source["_source"]))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row for each stretch of a document that
    consecutive blocks of one epoch take. A stretch of a whole document keeps its text unchanged;
    others are their words joined by one space. ``n_chars``, if there, is counted again.
    """
    uid, run = fresh(docs, "uid"), fresh(docs, "run")
    rows = stored(docs.select("*", F.monotonically_increasing_id().alias(uid)))
    table = stored(rows.select(F.col(uid).alias("uid"), "doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")))
    _, _, parts = pieces(table, block_words, seed)
    near = Window.partitionBy("uid", "epoch").orderBy("first")
    marked = parts.withColumn("new", F.coalesce((F.lag("last").over(near) != F.col("first")).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(near)).groupBy("uid", "epoch", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    lists = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("epoch", "first", "last"))).alias(run)).withColumnRenamed("uid", uid)
    out = rows.join(lists, uid).select(*docs.columns, F.explode(run).alias(run))
    words = words_of(out["text"])
    whole = (F.col(run)["first"] == 0) & (F.col(run)["last"] == F.size(words))
    cut = F.array_join(F.slice(words, (F.col(run)["first"] + 1).cast("int"), (F.col(run)["last"] - F.col(run)["first"]).cast("int")), " ")
    text = F.when(whole, out["text"]).otherwise(cut)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else out[c] for c in docs.columns])
