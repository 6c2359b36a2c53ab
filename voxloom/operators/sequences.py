"""Windows over long sequences without one task per sequence.

A clip, a speaker or a user may own a third of all rows, so ``Window.partitionBy(clip)`` would put
that third into one task. Every helper here works in two levels: rows are split into *buckets* that
respect the order (``position div CHUNK``, an hour, a hash prefix, ...), the window runs inside
(key, bucket), and a small per-bucket summary carries state across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.session import durable

CHUNK = 4096
_UP = Window.unboundedPreceding
_DOWN = Window.unboundedFollowing


def chunk_of(position: str, size: int = CHUNK) -> Column:
    return F.floor(F.col(position) / F.lit(size)).cast("long")


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` over (bucket, order) inside each key."""
    valued = df.withColumn("_v", value)
    totals = valued.groupBy(*keys, bucket).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(_UP, -1) if keys else Window.orderBy(bucket).rowsBetween(_UP, -1)
    offsets = totals.select(*keys, bucket, F.sum("_t").over(before).alias("_before"))
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(_UP, 0)
    return (
        valued.withColumn(out, F.sum("_v").over(local))
        .join(offsets, [*keys, bucket])
        .withColumn(out, F.when(F.col("_before").isNull(), F.col(out)).otherwise(F.col(out) + F.col("_before")))
        .drop("_v", "_before")
    )


def position_in(df: DataFrame, keys: list[str], bucket: str, order: list, out: str = "pos") -> DataFrame:
    """0-based position of each row inside its key."""
    return running_sum(df, keys, bucket, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1)


def global_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """1-based rank by arbitrary sortable columns, however skewed the keys are.

    A range shuffle splits even one huge key over many partitions. Partition numbers come from
    sampling, so the shuffled table is materialised once before it is read twice.
    """
    staged = durable(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id())
    )
    return running_sum(staged, keys, "_range", order, F.lit(1).cast("long"), out).drop("_range")


def with_neighbours(
    df: DataFrame, keys: list[str], position: str, shifts: dict[str, tuple[Column, int]], size: int = CHUNK
) -> DataFrame:
    """lag (negative) and lead (positive) over a dense 0-based position.

    Rows next to a chunk border are copied to the neighbouring chunk, so each chunk can answer
    alone; copies are dropped afterwards.
    """
    reach = max(abs(n) for _, n in shifts.values())
    p, home = F.col(position), chunk_of(position, size)
    inside = p - home * F.lit(size)
    spread = F.array_compact(
        F.array(
            home,
            F.when((inside < reach) & (home > 0), home - 1),
            F.when(inside >= size - reach, home + 1),
        )
    )
    copied = df.withColumn("_home", home).withColumn("_chunk", F.explode(spread))
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    for name, (value, n) in shifts.items():
        copied = copied.withColumn(name, F.lag(value, -n).over(w) if n < 0 else F.lead(value, n).over(w))
    return copied.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def carry(
    df: DataFrame, keys: list[str], position: str, value: Column, out: str,
    forward: bool = True, inclusive: bool = False, size: int = CHUNK,
) -> DataFrame:
    """Nearest non-NULL ``value`` before (or after) each position, over any number of chunks."""
    tagged = df.withColumn("_v", value).withColumn("_chunk", chunk_of(position, size))
    edge = F.max_by if forward else F.min_by
    known_at = F.when(F.col("_v").isNotNull(), F.col(position))
    summary = tagged.groupBy(*keys, "_chunk").agg(edge(F.col("_v"), known_at).alias("_edge"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    by_row = Window.partitionBy(*keys, "_chunk").orderBy(position)
    if forward:
        far = F.last("_edge", ignorenulls=True).over(by_chunk.rowsBetween(_UP, -1))
        near = F.last("_v", ignorenulls=True).over(by_row.rowsBetween(_UP, 0 if inclusive else -1))
    else:
        far = F.first("_edge", ignorenulls=True).over(by_chunk.rowsBetween(1, _DOWN))
        near = F.first("_v", ignorenulls=True).over(by_row.rowsBetween(0 if inclusive else 1, _DOWN))
    borders = summary.select(*keys, "_chunk", far.alias("_far"))
    return (
        tagged.withColumn("_near", near)
        .join(borders, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_v", "_chunk", "_near", "_far")
    )


def order_picks(df: DataFrame, keys: list[str], value: str, picks: dict) -> DataFrame:
    """Exact order statistics of a non-negative column per key.

    ``picks`` maps an output name to a function of the count giving a 1-based rank. Equal values
    are counted before any shuffle; the running count then works bucket by bucket, where a bucket
    is 1/64 of an octave, so no key is sorted as a whole.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_octave", F.when(F.col("_value") > 0, F.floor(F.log2("_value") * 64)).otherwise(F.lit(-1_000_000)).cast("long"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_count"))
    ranked = running_sum(counts, keys, "_octave", ["_value"], F.col("_n"), "_hi").join(totals, keys)
    chosen = []
    for name, rank in picks.items():
        r = rank(F.col("_count"))
        chosen.append(F.max(F.when((r <= F.col("_hi")) & (r > F.col("_hi") - F.col("_n")), F.col("_value"))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_count").alias("pick_count"), *chosen)
