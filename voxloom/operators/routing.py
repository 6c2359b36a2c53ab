"""Usage routing and eligibility: which segment may serve which target, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.measure import blank, finite, in_unit, log_place, reasons
from voxloom.functions.vocabulary import ROLES, TARGETS


def last_classes(classes: DataFrame) -> DataFrame:
    """One class per segment: the last row by position."""
    chosen = F.max_by(F.struct("content_type", "confidence", "user_overridden"), "position")
    return classes.groupBy("segment_id").agg(chosen.alias("class"))


def _role(own: str, other: str) -> tuple[Column, Column]:
    known = ~blank(F.col("speaker_id"))
    content = F.col("class.content_type")
    role = (
        F.when(F.col("user_excluded"), "excluded")
        .when(F.col("class").isNull(), "review")
        .when(content == own, "primary")
        .when((content == other) & known, "feature_only")
        .when(content == other, "excluded")
        .otherwise("review")
    )
    why = (
        F.when(F.col("user_excluded"), "user_excluded")
        .when(F.col("class").isNull(), "classification_missing")
        .when(content == own, F.lit(None).cast("string"))
        .when((content == other) & known, "speaker_reference")
        .when(content == other, "speaker_unconfirmed")
        .otherwise("ambiguous_content")
    )
    return role, why


def _status(role: str) -> Column:
    r = F.col(role)
    return F.when(r.isin("primary", "feature_only"), "eligible").when(r == "review", "needs_review").otherwise("excluded")


def route(segments: DataFrame, classes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Role, reason and status per target, with the origin and confidence of the class.

    ``segments`` brings segment_id, speaker_id and user_excluded. The last class and the first
    override per segment count. All joins share the segment key, so each side shuffles once.
    """
    first_override = overrides.groupBy("segment_id").agg(F.min_by("original_type", log_place(overrides)).alias("_original"), F.lit(True).alias("_changed"))
    joined = (
        segments.withColumn("user_excluded", F.coalesce("user_excluded", F.lit(False)))
        .join(last_classes(classes), "segment_id", "left")
        .join(first_override, "segment_id", "left")
        .withColumn("_manual", F.coalesce(F.col("class.user_overridden"), F.lit(False)) | F.col("_changed").isNotNull())
    )
    talk, talk_why = _role("speech", "singing")
    singing, singing_why = _role("singing", "speech")
    confidence = F.col("class.confidence")
    automatic = ~F.col("_manual") & F.col("class").isNotNull()
    routed = (
        joined.withColumn("talk_role", talk).withColumn("talk_reason", talk_why)
        .withColumn("singing_role", singing).withColumn("singing_reason", singing_why)
        .withColumn("talk_status", _status("talk_role")).withColumn("singing_status", _status("singing_role"))
        .withColumn("classification_origin", F.when(F.col("_manual"), "manual").otherwise("automatic"))
        .withColumn("original_content_type", F.when(F.col("_manual"), F.col("_original")))
        .withColumn("classification_confidence", F.when(automatic & in_unit(confidence) & (confidence > 0), confidence))
        .withColumn(
            "classification_confidence_status",
            F.when(~automatic, "unavailable").when(~in_unit(confidence), "invalid").when(confidence > 0, "measured").otherwise("legacy_unknown"),
        )
    )
    return routed.drop("class", "_original", "_changed", "_manual")


def role_counts(routed: DataFrame) -> DataFrame:
    """Segments per speaker, target and role."""
    long = routed.select("speaker_id", F.expr("stack(2, 'talk', talk_role, 'singing', singing_role) AS (target, role)"))
    return long.groupBy("speaker_id", "target").pivot("role", list(ROLES)).count().na.fill(0, list(ROLES))


def decision_reasons(target: Column) -> tuple[Column, Column]:
    """(exclusion codes, review codes) of a segment for one target, in reporting order."""
    excluded = F.coalesce("user_excluded", F.lit(False))
    wrong = F.coalesce("wrong_speaker", F.lit(False))
    unreadable = ~F.coalesce("audio_readable", F.lit(True))
    ratio = F.col("voiced_ratio")
    usable = finite(ratio) & (ratio >= 0) & ((ratio > 0) | blank(F.col("voicing_path")))
    content = F.col("content_type")
    matches = ((target == "talk") & (content == "speech")) | ((target == "singing") & (content == "singing"))
    removed = reasons(
        (excluded, "user_excluded"), (wrong, "wrong_speaker"),
        (unreadable, "unreadable_audio"), (~unreadable & ~usable, "no_usable_voice"),
    )
    open_points = reasons(
        (blank(F.col("speaker_id")) & ~wrong, "speaker_unconfirmed"), (~matches, "wrong_content_type"),
        ((target == "singing") & ~F.col("valid_alignment"), "alignment_required"),
    )
    return removed, open_points


def eligibility(segments: DataFrame) -> DataFrame:
    """Every segment × target with its decision and ordered reasons (exclusions first).

    A segment is a candidate for its own speaker's job; segments without a speaker, of a confirmed
    wrong speaker or excluded by the user are candidates of *every* job. Their decision does not
    depend on the job, so it is emitted once and marked ``shared`` instead of once per speaker.
    """
    unknown = blank(F.col("speaker_id"))
    shared = unknown | F.coalesce("wrong_speaker", F.lit(False)) | F.coalesce("user_excluded", F.lit(False))
    removed, open_points = decision_reasons(F.col("target"))
    return (
        segments.withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))
        .withColumn("shared", shared)
        .withColumn("_removed", removed)
        .withColumn("_open", open_points)
        .withColumn("reason_codes", F.concat("_removed", "_open"))
        .withColumn(
            "eligibility",
            F.when(F.size("_removed") > 0, "excluded").when(F.size("_open") > 0, "needs_review").otherwise("eligible"),
        )
        .drop("_removed", "_open")
    )


def _per_job(decisions: DataFrame, label: Column, jobs: DataFrame) -> DataFrame:
    """Counts of a label per (speaker, target) job: own rows plus the rows every job shares.

    Only counts are joined: the shared side has a handful of labels per target.
    """
    labelled = decisions.withColumn("label", label).where(F.col("label").isNotNull())
    counts = labelled.groupBy(
        F.when(~F.col("shared"), F.col("speaker_id")).alias("speaker_id"), "target", "shared", "label"
    ).agg(F.count(F.lit(1)).alias("n"))
    own = counts.where(~F.col("shared")).select("speaker_id", "target", "label", "n")
    everyone = jobs.join(counts.where(F.col("shared")).select("target", "label", "n"), "target").select("speaker_id", "target", "label", "n")
    return own.unionByName(everyone).groupBy("speaker_id", "target", "label").agg(F.sum("n").alias("n"))


def jobs_of(segments: DataFrame) -> DataFrame:
    """Every known speaker × target."""
    return (
        segments.where(~blank(F.col("speaker_id"))).select("speaker_id").distinct()
        .withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))
    )


def primary_reason_counts(decisions: DataFrame) -> DataFrame:
    """First reasons counted per job."""
    counted = _per_job(decisions, F.get("reason_codes", F.lit(0)), jobs_of(decisions))
    return counted.withColumnRenamed("label", "primary_reason")


def eligible_summary(decisions: DataFrame) -> DataFrame:
    """Candidates and eligible segments per job, and whether nothing is usable."""
    counted = _per_job(decisions, F.col("eligibility"), jobs_of(decisions))
    return counted.groupBy("speaker_id", "target").agg(
        F.sum("n").alias("candidates"), F.sum(F.when(F.col("label") == "eligible", F.col("n")).otherwise(0)).alias("eligible_count")
    ).withColumn("no_usable_segments", F.col("eligible_count") == 0)
