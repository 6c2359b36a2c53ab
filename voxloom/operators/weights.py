"""Rarity utility, quality, training weights, manifests and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.measure import (
    alignment_measured, asr_measured, blank, clamp, exact_mean, finite, in_unit, measurement, placeholder_alignment, reasons, timed,
)
from voxloom.functions.vocabulary import ELIGIBILITIES, KNOWN_PHONES, REASON_CODES, ROLES, STATUSES, TARGETS
from voxloom.operators.sequences import with_neighbours

NEUTRAL, MIN_WEIGHT, MAX_WEIGHT, LOW_QUALITY = 0.5, 0.25, 2.0, 0.5
BASE_HZ, BIN_SEMITONES = 55.0, 6.0
GROUP = ["speaker_id", "target"]


def observed_phones(phones: str = "phonemes", known: Column | None = None) -> Column:
    """Distinct reliably timed known phones of a segment, for any target (no shuffle).

    ``known`` is what ``phone_arrays.known_phones`` found, where phones were looked at as arrays.
    """
    usable = (
        ~blank(F.col("alignment_method")) & ~placeholder_alignment()
        & ~F.coalesce(F.col("alignment_status").isin("unavailable", "invalid"), F.lit(False))
    )
    if known is None:
        sound = F.filter(phones, lambda x: timed(x["start_sec"], x["end_sec"]))
        known = F.filter(F.array_distinct(F.transform(sound, lambda x: x["phoneme"])), lambda x: x.isin(*KNOWN_PHONES))
    return F.when(usable, known).otherwise(F.array().cast("array<string>"))


def pitch_bin(f0: Column) -> Column:
    """Half-octave bin above 55 Hz."""
    return F.floor(F.log2(f0 / F.lit(BASE_HZ)) * 12.0 / F.lit(BIN_SEMITONES)).cast("int")


def observed_bins(f0: str = "f0_values") -> Column:
    """Distinct pitch bins of a segment's voiced frames, if its pitch is reliable at all."""
    r = F.col("pitch_reliability")
    voiced = F.filter(f0, lambda f: finite(f) & (f > 0))
    return F.when(finite(r) & (r > 0), F.array_distinct(F.transform(voiced, pitch_bin))).otherwise(F.array().cast("array<int>"))


def frame_bins(frames: DataFrame) -> DataFrame:
    """Distinct pitch bins per segment from long-form frames (map-side distinct first)."""
    f = F.col("f0")
    return frames.where(finite(f) & (f > 0)).select("segment_id", pitch_bin(f).alias("pitch_bin")).distinct()


def _group_counts(df: DataFrame, item: str, out: str) -> DataFrame:
    """MAP item -> number of segments per group; the map has one entry per catalog item or bin."""
    counts = df.select(*GROUP, F.explode(item).alias("_item")).groupBy(*GROUP, "_item").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*GROUP).agg(F.map_from_entries(F.collect_list(F.struct("_item", "_n"))).alias(out))


def _best_rarity(items: str, counts: str) -> Column:
    """1/sqrt(n) of the rarest item; the fewest segments win."""
    least = F.array_min(F.transform(items, lambda x: F.element_at(F.col(counts), x)))
    return F.when(F.size(items) > 0, F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), least)))


def with_utility(decisions: DataFrame) -> DataFrame:
    """Rarity utility inside each (speaker, target), added in place; only eligible segments have one.

    ``decisions`` brings ``phones`` and ``bins`` arrays. Document frequencies are two small maps
    per group (at most one entry per catalog phone or pitch bin), joined back on the group.
    """
    singing, eligible = F.col("target") == "singing", F.col("eligibility") == "eligible"
    rows = decisions.withColumn(
        "_phones", F.when(eligible & (~singing | F.col("valid_alignment")), F.col("phones")).otherwise(F.array().cast("array<string>"))
    ).withColumn("_bins", F.when(eligible & singing, F.col("bins")).otherwise(F.array().cast("array<int>")))
    scored = (
        rows.join(_group_counts(rows.where(eligible), "_phones", "_phone_counts"), GROUP, "left")
        .join(_group_counts(rows.where(eligible), "_bins", "_bin_counts"), GROUP, "left")
        .withColumn("_p", _best_rarity("_phones", "_phone_counts"))
        .withColumn("_b", _best_rarity("_bins", "_bin_counts"))
        .withColumn("_rare", F.coalesce(F.exists("_phones", lambda x: F.element_at(F.col("_phone_counts"), x) == 1), F.lit(False)))
    )
    value = F.when(F.col("_p").isNotNull() & F.col("_b").isNotNull(), (F.col("_p") + F.col("_b")) / 2).otherwise(F.coalesce("_p", "_b"))
    known = F.col("utility_value").isNotNull()
    return (
        scored.withColumn("utility_value", value)
        .withColumn("utility_status", F.when(known, "measured").otherwise("unavailable"))
        .withColumn("utility_reasons", F.when(known & F.col("_rare"), F.array(F.lit("rare_phoneme"))).otherwise(F.array().cast("array<string>")))
        .drop("_phones", "_bins", "_phone_counts", "_bin_counts", "_p", "_b", "_rare")
    )


def utility(decisions: DataFrame) -> DataFrame:
    """The utility of the eligible segments alone."""
    return with_utility(decisions.where("eligibility = 'eligible'")).select("segment_id", "target", "utility_value", "utility_status", "utility_reasons")


def quality_components() -> Column:
    """MAP name -> (value, status). Singing pitch reliability is never a measurement."""
    unavailable = F.struct(F.lit(None).cast("double").alias("value"), F.lit("unavailable").alias("status"))
    legacy = F.struct(F.lit(None).cast("double").alias("value"), F.lit("legacy_unknown").alias("status"))
    asr = measurement(asr_measured(), F.col("asr_confidence"), F.col("asr_status"))
    alignment = F.when(placeholder_alignment(), unavailable).otherwise(
        measurement(alignment_measured(), F.col("alignment_confidence"), F.col("alignment_status"))
    )
    both = F.create_map(F.lit("alignment_confidence"), alignment, F.lit("asr_confidence"), asr)
    return F.when(F.col("target") == "singing", F.map_concat(both, F.create_map(F.lit("f0_reliability"), legacy))).otherwise(both)


def quality_value(components: str = "components") -> Column:
    """Mean of the measured components, NULL when none is measured."""
    measured = F.filter(F.map_values(components), lambda m: m["status"] == "measured")
    total = F.aggregate(measured, F.lit(0.0), lambda acc, m: acc + m["value"])
    return F.when(F.size(measured) > 0, total / F.size(measured))


def raw_weight(quality: Column, util: Column) -> Column:
    q, u = F.coalesce(quality, F.lit(NEUTRAL)), F.coalesce(util, F.lit(NEUTRAL))
    return (F.lit(0.35) + F.lit(0.65) * q) * (F.lit(1.0) + F.lit(0.75) * u)


def weigh(rows: DataFrame) -> DataFrame:
    """Raw and final weight per row; ``quality_value`` and ``utility_value`` may be NULL.

    The group mean is a partial aggregate joined back (one row per group), never a window over a
    whole speaker, and exact, so that weights do not depend on the order of rows.
    """
    eligible = F.col("eligibility") == "eligible"
    raw = rows.withColumn("_raw", raw_weight(F.col("quality_value"), F.col("utility_value")))
    means = raw.where(eligible).groupBy(*GROUP).agg(exact_mean(F.col("_raw")).alias("_mean"))
    return (
        raw.join(means, GROUP, "left")
        .withColumn("raw_weight", F.when(eligible, F.col("_raw")).otherwise(0.0))
        .withColumn("training_weight", F.when(eligible, clamp(F.col("_raw") / F.col("_mean"), MIN_WEIGHT, MAX_WEIGHT)).otherwise(0.0))
        .drop("_raw", "_mean")
    )


def weight_input_problems(rows: DataFrame) -> DataFrame:
    """Rows the weight policy must refuse: empty or repeated ids, bad vocabulary, bad ranges."""
    repeated = rows.groupBy(*GROUP, "segment_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*GROUP, "segment_id", F.lit(True).alias("_twice"))
    checked = rows.join(repeated, [*GROUP, "segment_id"], "left").withColumn(
        "problem",
        F.explode(reasons(
            (blank(F.col("segment_id")), "empty_id"), (F.col("_twice").isNotNull(), "duplicate_id"),
            (~F.col("eligibility").isin(*ELIGIBILITIES), "unknown_eligibility"),
            (F.col("quality_value").isNotNull() & ~in_unit(F.col("quality_value")), "quality_out_of_range"),
            (F.col("utility_value").isNotNull() & ~in_unit(F.col("utility_value")), "utility_out_of_range"),
        )),
    )
    return checked.select(*GROUP, "segment_id", "problem")


def group_status(assessed: DataFrame) -> DataFrame:
    """A group without an eligible row is reported here; other groups go on."""
    own = assessed.where(~F.col("shared"))
    return own.groupBy(*GROUP).agg(F.count_if(F.col("eligibility") == "eligible").alias("eligible_count")).withColumn(
        "status", F.when(F.col("eligible_count") > 0, "ok").otherwise("no_eligible_segments")
    )


def assess(decisions: DataFrame) -> DataFrame:
    """Assessment of every segment × target of every speaker in one plan."""
    rows = (
        with_utility(decisions)
        .withColumn("components", quality_components())
        .withColumn("quality_value", quality_value())
        .withColumn("quality_status", F.when(F.col("quality_value").isNotNull(), "measured").otherwise("unavailable"))
    )
    return weigh(rows)


def assessment_problems(items: DataFrame) -> DataFrame:
    """One row per broken rule of a stored assessment (job_id, position, item fields)."""
    repeated = items.groupBy("job_id", "segment_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("job_id", "segment_id", F.lit(True).alias("_twice"))
    ordered = with_neighbours(items, ["job_id"], "position", {"_previous": (F.col("segment_id"), -1)})
    q, u, w, raw = (F.col(c) for c in ("quality_value", "utility_value", "training_weight", "raw_weight"))
    allowed = F.array(*[F.lit(c) for c in REASON_CODES])
    eligible = F.col("eligibility") == "eligible"

    def bad_measure(value: Column, status: str) -> list:
        s = F.col(status)
        return [
            (~F.coalesce(s.isin(*STATUSES), F.lit(False)), f"{status}_vocabulary"),
            (value.isNotNull() & ~in_unit(value), f"{status}_range"),
            ((s == "measured") & value.isNull(), f"{status}_measured_without_value"),
            ((s == "unavailable") & value.isNotNull(), f"{status}_unavailable_with_value"),
        ]

    rules = [
        (blank(F.col("segment_id")), "empty_id"),
        (F.col("_twice").isNotNull(), "duplicate_id"),
        (F.coalesce(F.col("_previous") > F.col("segment_id"), F.lit(False)), "not_ascending"),
        (~F.coalesce(F.col("eligibility").isin(*ELIGIBILITIES), F.lit(False)), "eligibility_vocabulary"),
        (F.col("role").isNotNull() & ~F.col("role").isin(*ROLES), "role_vocabulary"),
        (~F.coalesce(F.col("target").isin(*TARGETS), F.lit(False)), "target_vocabulary"),
        (F.size(F.array_except("reason_codes", allowed)) > 0, "reason_vocabulary"),
        (F.size(F.array_distinct("reason_codes")) != F.size("reason_codes"), "reason_repeated"),
        *bad_measure(q, "quality_status"), *bad_measure(u, "utility_status"),
        (~finite(raw) | (raw < 0), "raw_weight_range"), (~finite(w) | (w < 0), "weight_range"),
        (eligible & ~(w > 0), "eligible_without_weight"), (~eligible & (w != 0), "weight_without_eligibility"),
    ]
    checked = ordered.join(repeated, ["job_id", "segment_id"], "left")
    return checked.select("job_id", "segment_id", F.explode(reasons(*rules)).alias("problem"))


def assessment_label() -> Column:
    low = (F.col("quality_status") == "measured") & (F.col("quality_value") < LOW_QUALITY) & (F.col("training_weight") > 0)
    return (
        F.when(F.col("eligibility") == "excluded", "excluded").when(F.col("eligibility") == "needs_review", "review")
        .when(low, "adopted_low_quality").otherwise("adopted")
    )


def weight_manifest(candidates: DataFrame, assessed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, skipped, problems) for job candidates ⟕ assessment; a missing assessment is a problem."""
    joined = candidates.join(
        assessed.select("job_id", "segment_id", "eligibility", "reason_codes", "training_weight"), ["job_id", "segment_id"], "left"
    )
    items = joined.where("eligibility = 'eligible'").select(
        "job_id", "segment_id", F.concat("segment_id", F.lit(".wav")).alias("audio_filename"), "training_weight"
    )
    skipped = joined.where("eligibility <> 'eligible'").select("job_id", "segment_id", "eligibility", "reason_codes")
    problems = joined.where("eligibility IS NULL").select("job_id", "segment_id", F.lit("assessment_missing").alias("problem"))
    return items, skipped, problems


def safe_component(name: Column) -> Column:
    """May this text be a file name on any platform?"""
    return ~blank(name) & ~name.isin(".", "..") & ~name.rlike(r'[\x00-\x1f\x7f<>:"/\\|?*]') & ~name.rlike(r"[. ]$")


def manifest_problems(items: DataFrame, training_files: DataFrame) -> DataFrame:
    """Audit a stored manifest (job_id, position, segment_id, audio_filename, training_weight)
    against the files the training set really holds (job_id, audio_filename)."""
    w, name = F.col("training_weight"), F.col("audio_filename")
    ordered = with_neighbours(items, ["job_id"], "position", {"_previous": (F.col("segment_id"), -1)})
    per_row = ordered.select(
        "job_id", F.col("segment_id").alias("subject"),
        F.explode(reasons(
            (F.coalesce(F.col("_previous") >= F.col("segment_id"), F.lit(False)), "not_ascending"),
            (~finite(w) | (w < MIN_WEIGHT) | (w > MAX_WEIGHT), "weight_range"),
            (~safe_component(name), "unsafe_file_name"),
        )).alias("problem"),
    )
    names = items.groupBy("job_id", "audio_filename").agg(F.count(F.lit(1)).alias("_items"))
    repeated = names.where("_items > 1").select("job_id", name.alias("subject"), F.lit("file_name_repeated").alias("problem"))
    files = training_files.select("job_id", "audio_filename").distinct().withColumn("_file", F.lit(True))
    sets = names.join(files, ["job_id", "audio_filename"], "full_outer").select(
        "job_id", name.alias("subject"),
        F.when(F.col("_items").isNull(), "file_without_item").when(F.col("_file").isNull(), "item_without_file").alias("problem"),
    ).where("problem IS NOT NULL")
    return per_row.unionByName(repeated).unionByName(sets)
