"""Weighted epoch sampling and hold-out choice, exact and repeatable at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.fingerprints import plain_columns, row_digest, set_fingerprint
from voxloom.functions.measure import finite, reasons
from voxloom.operators.sequences import global_rank, position_in, running_sum

SAMPLER_VERSION = "cell-draw-1"
MICRO = 1_000_000
CELL = 2 * MICRO  # the largest weight: an interval touches at most two cells
MAX_HELD, HELD_SHARE = 5, 0.1


def weight_problems(items: DataFrame) -> DataFrame:
    """The items whose weight is missing, not finite or negative; none of them gets an equal weight instead."""
    w = F.col("weight")
    return items.where(w.isNull() | ~finite(w) | (w < 0)).withColumn("problem", F.when(w.isNull(), "missing_weight").otherwise("bad_weight"))


def draw_epoch(items: DataFrame, keys: list[str], seed: int, epoch: int) -> DataFrame:
    """Draw, with replacement and p = weight / total, as many items as each key holds.

    ``items`` brings the keys, ``name`` and ``weight``. Weights are counted in millionths, so sums
    are exact whatever the partitioning. Items lie on a line in the order of md5(name); each is
    also the seat of one draw, whose point comes from md5(seed:epoch:key:draw). Points meet
    intervals through cells one maximum weight wide: with weights from 0.25 to 2, as the policy gives
    them, a cell holds at most nine intervals, so the join has no hot key even when one job owns most
    rows. Many weights near zero would share a cell. Keys with a bad weight draw nothing; their
    items are in ``weight_problems``.
    """
    bad = weight_problems(items).select(*keys).distinct()
    placed = items.join(bad, keys, "left_anti").withColumn("_w", F.round(F.col("weight") * MICRO).cast("long")).withColumn("_md5", F.md5("name")).withColumn(
        "_slot", F.substring("_md5", 1, 3)
    )
    lined = running_sum(placed, keys, "_slot", ["_md5", "name"], F.col("_w"), "_hi")
    seats = position_in(placed, keys, "_slot", ["_md5", "name"], "draw")
    totals = placed.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    key_text = F.concat_ws("/", *keys)
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), key_text, F.col("draw"))), 1, 15), 16, 10)
    points = (
        seats.select(*keys, "draw").join(totals, keys)
        .withColumn("_u", unit.cast("decimal(19,0)"))
        .withColumn("_point", F.expr("cast(_u * cast(_total as decimal(19,0)) as decimal(38,0)) div 1152921504606846976"))
        .select(*keys, "draw", "_point", F.expr(f"_point div {CELL}").alias("_cell"))
    )
    intervals = lined.select(
        *keys, "name", F.col("_hi"), (F.col("_hi") - F.col("_w")).alias("_lo"),
        F.explode(F.sequence(F.expr(f"(_hi - _w) div {CELL}"), F.expr(f"(_hi - 1) div {CELL}"))).alias("_cell"),
    )
    hit = (F.col("_lo") <= F.col("_point")) & (F.col("_point") < F.col("_hi"))
    return points.join(intervals, [*keys, "_cell"]).where(hit).select(*keys, "draw", "name")


def weight_prints(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item_count, manifest_hash): the names and weights of each key, whatever their order."""
    return set_fingerprint(items, keys, row_digest(*plain_columns(items, "name", "weight")), "manifest_hash").withColumnRenamed("row_count", "item_count")


def sampler_report(items: DataFrame, keys: list[str], seed: int, iterations: int, epoch: int | None) -> DataFrame:
    """What the sampler used per key: its version and seed, the weights by hash and range, how often it drew."""
    ranges = items.groupBy(*keys).agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))
    return weight_prints(items, keys).join(ranges, keys).select(
        *keys, F.lit(SAMPLER_VERSION).alias("sampler_version"), F.lit(True).alias("applied"), F.lit(seed).alias("seed"), "item_count", "min_weight", "max_weight",
        "manifest_hash", F.lit(iterations).alias("iterations"), F.lit(epoch).cast("int").alias("last_epoch"))


def report_problems(items: DataFrame, reports: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One row per key of the manifest or of the reports, with the codes of what does not hold.

    A training that left no report, or whose sampler never drew, is a problem and no success; so is a
    report of weights, seed or version other than the manifest's, or without a manifest.
    """
    now = weight_prints(items, keys).select(*keys, F.col("item_count").alias("_count"), F.col("manifest_hash").alias("_hash"))
    both = now.join(reports, keys, "full")
    there, told = F.col("_hash").isNotNull(), F.col("manifest_hash").isNotNull()
    held = there & told
    codes = reasons(
        (~told, "report_missing"), (~there, "manifest_missing"),
        (told & (~F.col("applied") | (F.col("iterations") < 1)), "sampler_never_used"), (told & (F.col("sampler_version") != SAMPLER_VERSION), "version_differs"),
        (told & (F.col("seed") != seed), "seed_differs"), (held & (F.col("_count") != F.col("item_count")), "item_count_differs"),
        (held & (F.col("_hash") != F.col("manifest_hash")), "weights_changed"),
    )
    return both.select(*keys, F.col("_count").alias("manifest_items"), "item_count", "min_weight", "max_weight", "seed", "iterations", "last_epoch", "manifest_hash", codes.alias("problems"))


def hold_out(items: DataFrame, keys: list[str], name: str, bucket: Column | None = None) -> DataFrame:
    """Evenly spaced hold-out names: min(5, max(1, floor(n/10)), n-1) of the sorted names per key.

    ``bucket`` is an order-preserving prefix of the name, if the names have an evenly spread one
    (hash names do); otherwise names are ranked through a range shuffle.
    """
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if bucket is None:
        ranked = global_rank(items, keys, [name], "_r").withColumn("_r", F.col("_r") - 1)
    else:
        ranked = position_in(items.withColumn("_b", bucket), keys, "_b", [name], "_r").drop("_b")
    held = F.least(F.lit(MAX_HELD), F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(HELD_SHARE))), F.col("_n") - 1)
    step = F.col("_n") / F.col("_held")
    return (
        ranked.join(counts, keys).where("_n >= 2").withColumn("_held", held)
        .where(F.exists(F.sequence(F.lit(0).cast("long"), F.col("_held") - 1), lambda i: F.floor(i * step) == F.col("_r")))
        .drop("_n", "_held", "_r")
    )
