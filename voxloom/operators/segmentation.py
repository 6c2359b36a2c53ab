"""Voice activity: threshold, merged ranges, emitted segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.functions.measure import low_rank
from voxloom.operators.sequences import carry, chunk_of, order_picks, position_in

WINDOW_SEC, MIN_RMS, FLOOR_FACTOR, MIN_VOICE_SEC, MAX_GAP_SEC = 0.03, 350.0, 3.0, 0.30, 0.25


def thresholds(windows: DataFrame) -> DataFrame:
    """Loudness above which a window counts as voice: max(350, 3 × the 20% level)."""
    picks = order_picks(windows, ["clip_id"], "rms", {"_floor": lambda n: low_rank(n, 0.20)})
    return picks.select("clip_id", F.greatest(F.lit(MIN_RMS), F.col("_floor") * FLOOR_FACTOR).alias("threshold"))


def voice_ranges(windows: DataFrame) -> DataFrame:
    """Voiced windows merged into ranges (clip_id, start_idx, end_idx exclusive).

    A range breaks where the distance to the previous voiced window exceeds the allowed gap by more
    than one window. Both look-backs cross chunk borders through small chunk summaries.
    """
    gap = max(1, round(MAX_GAP_SEC / WINDOW_SEC))
    voiced = windows.join(thresholds(windows), "clip_id").where(F.col("rms") >= F.col("threshold")).select("clip_id", "idx")
    seen = carry(voiced, ["clip_id"], "idx", F.col("idx"), "_previous")
    fresh = F.col("_previous").isNull() | (F.col("idx") - F.col("_previous") > gap + 1)
    started = carry(seen.withColumn("_start", F.when(fresh, F.col("idx"))).drop("_previous"), ["clip_id"], "idx", F.col("_start"), "start_idx", inclusive=True)
    return started.groupBy("clip_id", "start_idx").agg((F.max("idx") + 1).alias("end_idx"))


def emit_segments(ranges: DataFrame) -> DataFrame:
    """Ranges of at least 0.30 s, numbered densely per clip."""
    timed = ranges.withColumn("start_sec", F.col("start_idx") * F.lit(WINDOW_SEC)).withColumn("end_sec", F.col("end_idx") * F.lit(WINDOW_SEC))
    kept = timed.where(F.col("end_sec") - F.col("start_sec") >= MIN_VOICE_SEC).withColumn("_chunk", chunk_of("start_idx"))
    numbered = position_in(kept, ["clip_id"], "_chunk", ["start_idx"], "number")
    windows = F.greatest(F.lit(1), F.bround((F.col("end_sec") - F.col("start_sec")) / F.lit(WINDOW_SEC)).cast("long"))
    return numbered.select(
        F.concat(F.lit("seg_"), F.col("clip_id"), F.lit("_"), F.lpad(F.col("number").cast("string"), 5, "0")).alias("segment_id"),
        "clip_id", "start_sec", "end_sec", F.lit(1.0).alias("voiced_probability"), (F.lit(1.0) / windows).alias("silence_ratio"),
    )
