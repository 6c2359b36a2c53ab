"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. Documents travel as 64-bit key, SHA-256 and
``doc_id``, never as texts. Each task first folds its copies, so a text that fills a third of the table
is at most ``PARTS`` small rows when it leaves the tasks. A directory of key prefixes doubles until no
bucket is overfull. Entries go through the directory to the owner of their bucket, where the chain of
their key compares the bytes of the digests, places texts of equal key one after the other, and settles
``keep_id`` and ``group_size``. Documents find their place in the index the same way: prefix, bucket,
key, digest. Nothing but the chains of the buckets groups texts.

Null text counts as empty. A null ``doc_id`` sorts below all others. Rows equal in ``doc_id`` and
text cannot be told apart: one of them stays. Extra columns are left alone; an empty table gives an
empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.llm.common import ascii_lower, fresh, stored

#: Distinct keys in a bucket before it splits.
CAPACITY = 4096
_DEEPEST = 40
#: Rows of one text that may reach the owner of its bucket.
PARTS = 64


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, key_bits: int = 64, *more: Column) -> DataFrame:
    """doc_id, key and text_sha256 of each row, and ``more``; stored, so that texts are read and hashed once.

    ``key_bits`` below 64 makes keys collide (for tests).
    """
    body = normal(docs["text"])
    key = F.shiftrightunsigned(F.xxhash64(body), 64 - key_bits) if key_bits < 64 else F.xxhash64(body)
    return stored(docs.select(docs["doc_id"].alias("doc_id"), key.alias("key"), F.sha2(body.cast("binary"), 256).alias("text_sha256"), *more))


def folded(rows: DataFrame) -> DataFrame:
    """One row per text and part of the tasks: key, digest, largest doc_id, and how often the text occurs there."""
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    dealt = rows.select("doc_id", "key", "text_sha256", part)
    return dealt.groupBy("key", "text_sha256", "part").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).drop("part")


def _prefix(key: Column, depth: int, key_bits: int) -> Column:
    return F.shiftrightunsigned(key, key_bits - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, int]:
    """The directory and its depth: one row per prefix, pointing to a bucket.

    Starts at the depth that fits on average and doubles while a bucket is overfull. Only the
    buckets that split are counted again. A bucket shallower than the directory has several
    prefixes pointing at it. Keys that are all equal stop at the key's own length.
    """
    total = entries.count()
    depth = min(max(0, math.ceil(math.log2(max(total, 1) / capacity))), key_bits, _DEEPEST)
    level = stored(entries.groupBy(_prefix(F.col("key"), depth, key_bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))
    settled, full = [], level.where(F.col("n") > capacity)
    settled.append((depth, level.where(F.col("n") <= capacity)))
    while depth < min(key_bits, _DEEPEST) and not full.isEmpty():
        parents = full.select(F.col("prefix").alias("parent"))
        depth += 1
        child = _prefix(F.col("key"), depth, key_bits).alias("prefix")
        inside = entries.select("key").join(parents, _prefix(F.col("key"), depth - 1, key_bits) == F.col("parent"), "left_semi")
        level = stored(inside.groupBy(child).agg(F.count(F.lit(1)).alias("n")))
        settled.append((depth, level.where(F.col("n") <= capacity)))
        full = level.where(F.col("n") > capacity)
    settled.append((depth, full))
    tables = []
    for local, table in settled:
        width = 1 << (depth - local)
        slots = F.explode(F.sequence(F.col("prefix") * width, F.col("prefix") * width + (width - 1)))
        tables.append(table.select(F.lit(local).alias("local_depth"), F.col("prefix").alias("bucket"), slots.alias("slot")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, depth


def located(rows: DataFrame, slots: DataFrame, depth: int, key_bits: int) -> DataFrame:
    """``rows`` with the bucket (local_depth, bucket) that the directory names for their key."""
    return rows.withColumn("slot", _prefix(F.col("key"), depth, key_bits)).join(slots, "slot").drop("slot")


def index(rows: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """The stored index of ``digests``, its directory and the directory's depth.

    Index: bucket (local_depth, bucket), key, place in the chain of that key, digest, keep_id, group_size.
    The directory has a row for each few thousand texts; whether it is broadcast is left to Spark, which
    knows the size of the stored table.
    """
    entries = stored(folded(rows))
    slots, depth = directory(stored(entries.select("key").distinct()), capacity, key_bits)
    slots = stored(slots)
    owned = located(entries, slots, depth, key_bits).repartition("local_depth", "bucket")
    links = owned.groupBy("local_depth", "bucket", "key", "text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("local_depth", "bucket", "key").orderBy("text_sha256")
    return stored(links.withColumn("chain", F.row_number().over(chain))), slots, depth


_PLACE = ["local_depth", "bucket", "key", "text_sha256"]


def resolve(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, key_bits)
    table, slots, depth = index(rows, capacity, key_bits)
    same = rows.groupBy("doc_id", "key", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    found = located(same, slots, depth, key_bits).join(table, _PLACE)
    return found.select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "text_sha256"
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, one per distinct text, with the columns of ``docs``."""
    uid = fresh(docs, "uid")
    numbered = stored(docs.withColumn(uid, F.monotonically_increasing_id()))
    rows = digests(numbered, 64, F.col(uid).alias("uid"))
    table, slots, depth = index(rows, capacity)
    stay = located(rows, slots, depth, 64).join(table, _PLACE).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = stored(stay.groupBy(*_PLACE).agg(F.min("uid").alias(uid)).select(uid))
    # The list grows with the corpus: one plan at every size, a sort-merge join, never a broadcast.
    return numbered.join(stay.hint("merge"), uid, "left_semi").select(*docs.columns)
