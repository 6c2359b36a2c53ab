"""Speech or singing: scores, overrides, and the override log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.functions.measure import clamp, high_rank, log_place, low_rank
from voxloom.operators.sequences import carry, order_picks, position_in, with_neighbours

VOICED_RMS = 300.0


def classify(frames: DataFrame) -> DataFrame:
    """Scores and class per clip from frames (clip_id, idx, rms, pitch_hz, zcr)."""
    voiced = F.col("rms") >= VOICED_RMS
    pitch = F.when(voiced & (F.col("pitch_hz") > 0), F.col("pitch_hz"))
    ready = frames.withColumn("_pitch", pitch)
    paired = carry(ready, ["clip_id"], "idx", F.col("_pitch"), "_before")
    cents = F.log2(F.col("_pitch") / 440.0) * 1200.0
    stable = F.abs(F.log2(F.col("_pitch") / F.col("_before")) * 1200.0) <= 80.0
    sums = paired.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("_frames"), F.count_if(voiced).alias("_voiced"), F.count("_pitch").alias("_pitched"),
        F.stddev_pop(cents).alias("_cents"), F.count_if(F.coalesce(stable, F.lit(False))).alias("_pairs"), F.avg(F.when(voiced, F.col("zcr"))).alias("_zcr"),
    )
    picks = order_picks(frames, ["clip_id"], "rms", {"_low": lambda n: low_rank(n, 0.20), "_high": lambda n: high_rank(n, 0.80)})
    one = F.lit(1)
    facts = (
        sums.join(picks, "clip_id")
        .withColumn("voiced_ratio", F.col("_voiced") / F.greatest(one, F.col("_frames")))
        .withColumn("pitch_ratio", F.col("_pitched") / F.greatest(one, F.col("_voiced")))
        .withColumn("stability", F.when(F.col("_pitched") < 3, 0.0).otherwise(clamp(F.lit(1.0) - F.col("_cents") / 220.0)))
        .withColumn("sustained", F.when(F.col("_pitched") < 2, 0.0).otherwise(F.col("_pairs") / F.greatest(one, F.col("_pitched") - 1)))
        .withColumn("zcr", F.coalesce("_zcr", F.lit(0.0)))
        .withColumn("dynamic", F.when((F.col("_frames") < 4) | (F.col("_high") <= 1e-9), 0.0).otherwise(clamp((F.col("_high") - F.col("_low")) / F.col("_high"))))
    )
    c = F.col
    singing = clamp(0.32 * c("pitch_ratio") + 0.30 * c("stability") + 0.22 * c("sustained") + 0.10 * c("voiced_ratio") + 0.06 * (1.0 - c("dynamic")))
    speech = clamp(0.28 * c("voiced_ratio") + 0.28 * (1.0 - c("stability")) + 0.20 * c("dynamic") + 0.14 * clamp(c("zcr") * 8.0) + 0.10 * (1.0 - c("sustained")))
    scored = facts.withColumn("singing_score", singing).withColumn("speech_score", speech).withColumn("_d", F.col("singing_score") - F.col("speech_score"))
    unclear = (F.greatest("singing_score", "speech_score") < 0.52) | (F.abs("_d") < 0.12)
    return scored.select(
        "clip_id", F.when(unclear, "ambiguous").when(F.col("_d") > 0, "singing").otherwise("speech").alias("content_type"),
        F.when(unclear, clamp(F.abs("_d") * 2.0)).otherwise(clamp(F.abs("_d") * 0.8 + 0.5)).alias("confidence"), "speech_score", "singing_score",
    )


def reapply_overrides(classes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Put each segment's latest override on top of new classes; overrides of vanished segments fall away.

    Of overrides with the same time the later in the log (``seq``) wins."""
    latest = overrides.groupBy("segment_id").agg(F.max_by("new_type", log_place(overrides)).alias("_new"))
    return classes.join(latest, "segment_id", "left").select(
        "segment_id", F.coalesce("_new", "content_type").alias("content_type"), "confidence",
        (F.coalesce("user_overridden", F.lit(False)) | F.col("_new").isNotNull()).alias("user_overridden"),
    )


def record_overrides(classes: DataFrame, requests: DataFrame) -> DataFrame:
    """Turn requests (segment_id, new_type, changed_at, and ``seq`` among equal times) into log rows and refusals.

    Each request sees the type left by the one before it. Asking again for a type that is already an
    override changes nothing and is not logged; an unknown segment is an error row.
    """
    order = [c for c in ("changed_at", "seq") if c in requests.columns]
    known = requests.join(classes.select("segment_id", F.col("content_type").alias("_type"), "user_overridden"), "segment_id", "left")
    placed = position_in(known.withColumn("_slot", F.floor(F.col("changed_at") / 1024)), ["segment_id"], "_slot", order, "_pos")
    seen = with_neighbours(placed, ["segment_id"], "_pos", {"_previous": (F.col("new_type"), -1)})
    before = F.coalesce("_previous", "_type")
    overridden = F.col("_previous").isNotNull() | F.coalesce("user_overridden", F.lit(False))
    return seen.select(
        "segment_id", "changed_at", before.alias("original_type"), "new_type",
        F.when(F.col("_type").isNull(), "unknown_segment").when(overridden & (before == F.col("new_type")), "unchanged").otherwise("logged").alias("result"),
    )
