"""The common dataset: build, provenance, edits, views, snapshot and its fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.fingerprints import plain_columns, row_digest, set_fingerprint
from voxloom.functions.measure import blank, finite, legacy_measurement, log_place
from voxloom.functions.vocabulary import INVALIDATED_ALIGNMENT, PHONEME_METHOD_PREFIX, PROVENANCE_METHODS

Phones = Callable[[DataFrame], DataFrame]


def build(segments: DataFrame, stage: DataFrame, classes: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Segments of successfully processed sources with class, speaker and centroid attached."""
    done = stage.where(F.col("error").isNull()).select("source_id").distinct()
    return (
        segments.join(done, "source_id", "left_semi")
        .join(classes.select("segment_id", "content_type"), "segment_id", "left")
        .join(assigned.select("segment_id", "speaker_id"), "segment_id", "left")
        .join(centroids, "speaker_id", "left")
        .withColumn("content_type", F.coalesce("content_type", F.lit("ambiguous")))
        .withColumn("speaker_embedding", F.coalesce("centroid", F.array().cast("array<double>"))).drop("centroid")
    )


def new_provenance(segments: DataFrame, version: str) -> DataFrame:
    """Seven feature rows per extracted segment."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(m) if m else F.concat(F.lit(PHONEME_METHOD_PREFIX), F.coalesce("alignment_method", F.lit("")))).alias("method"))
                     for f, m in PROVENANCE_METHODS])
    return segments.select("segment_id", "cache_key", F.lit(version).alias("stage_version"), F.explode(rows).alias("p")).select("segment_id", "p.feature", "stage_version", "p.method", "cache_key")


def carried_provenance(reused: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows of reused segments whose key still matches."""
    return existing.join(reused.select("segment_id", "cache_key"), ["segment_id", "cache_key"], "left_semi")


def refresh_phoneme_methods(provenance: DataFrame, segments: DataFrame) -> DataFrame:
    """The last phoneme row of each segment follows the segment's current alignment method."""
    last = provenance.where("feature = 'phonemes'").groupBy("segment_id").agg(F.max("seq").alias("_last"))
    joined = provenance.join(last, "segment_id", "left").join(segments.select("segment_id", F.col("alignment_method").alias("_m")), "segment_id", "left")
    current = (F.col("feature") == "phonemes") & (F.col("seq") == F.col("_last")) & F.col("_m").isNotNull()
    return joined.withColumn("method", F.when(current, F.concat(F.lit(PHONEME_METHOD_PREFIX), "_m")).otherwise(F.col("method"))).drop("_last", "_m")


def latest_transcripts(edits: DataFrame) -> DataFrame:
    """The last transcript edit of each segment by time; of equal times the later in the log (``seq``)."""
    return edits.where("field = 'transcript'").groupBy("segment_id").agg(F.max_by("value", log_place(edits)).alias("new_transcript"))


def _invalidate(rows: DataFrame, when: Column) -> DataFrame:
    empty = F.filter("phonemes", lambda x: F.lit(False))
    return (
        rows.withColumn("phonemes", F.when(when, empty).otherwise(F.col("phonemes"))).withColumn("has_measurement", F.col("has_measurement") & ~when)
        .withColumn("alignment_confidence", F.when(when, 0.0).otherwise(F.col("alignment_confidence")))
        .withColumn("alignment_status", F.when(when, "unavailable").otherwise(F.col("alignment_status")))
        .withColumn("alignment_method", F.when(when, INVALIDATED_ALIGNMENT).otherwise(F.col("alignment_method")))
    )


def apply_transcript_edits(segments: DataFrame, edits: DataFrame, phones: Phones | None = None) -> DataFrame:
    """The latest transcript edit wins; only a really changed text gives up its phones and alignment.

    ``phones`` adds ``phonemes`` from the columns of ``segments``, which then come without: only after the
    join, so that no phones travel to meet an edit.
    """
    joined = segments.join(latest_transcripts(edits), "segment_id", "left")
    changed = F.coalesce(F.col("new_transcript") != F.col("transcript"), F.lit(False))
    marked = joined.withColumn("_changed", changed)
    marked = marked if phones is None else phones(marked)
    return _invalidate(marked, F.col("_changed")).withColumn("transcript", F.coalesce("new_transcript", "transcript")).drop("_changed", "new_transcript")


def set_transcripts(segments: DataFrame, provenance: DataFrame, edits: DataFrame, phones: Phones | None = None) -> dict[str, DataFrame]:
    """Interactive edit: always invalidates the alignment, marks the provenance, and appends to the log.

    ``phones``: see ``apply_transcript_edits``.
    """
    latest = edits.groupBy("segment_id").agg(F.max_by("value", log_place(edits)).alias("_new"))
    marked = segments.join(latest, "segment_id", "left").withColumn("_hit", F.col("_new").isNotNull())
    marked = marked if phones is None else phones(marked)
    changed = _invalidate(marked, F.col("_hit")).withColumn("transcript", F.coalesce("_new", "transcript")).drop("_new", "_hit")
    hit = edits.join(segments.select("segment_id"), "segment_id", "left_semi")
    last = provenance.where("feature = 'phonemes'").groupBy("segment_id").agg(F.max("seq").alias("_last")).join(hit.select("segment_id").distinct(), "segment_id", "left_semi")
    methods = provenance.join(last, "segment_id", "left").withColumn(
        "method", F.when((F.col("feature") == "phonemes") & (F.col("seq") == F.col("_last")), INVALIDATED_ALIGNMENT).otherwise(F.col("method"))).drop("_last")
    log = hit.select("segment_id", F.lit("transcript").alias("field"), "value", "changed_at")
    unknown = edits.join(segments.select("segment_id"), "segment_id", "left_anti").select("segment_id", F.lit("unknown_segment").alias("problem"))
    return {"segments": changed, "provenance": methods, "log": log, "problems": unknown}


def coverage_counts(segments: DataFrame) -> DataFrame:
    """Phone counts and content-type counts of the whole dataset, as (kind, name, n)."""
    phones = segments.select(F.explode(F.transform("phonemes", lambda p: p["phoneme"])).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    types = segments.groupBy(F.col("content_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return phones.select(F.lit("phoneme").alias("kind"), "name", "n").unionByName(types.select(F.lit("content_type").alias("kind"), "name", "n"))


def talk_view(segments: DataFrame) -> DataFrame:
    return segments.where("content_type = 'speech'")


def singing_view(segments: DataFrame) -> DataFrame:
    return segments.where("content_type = 'singing'")


def target_lists(classes: DataFrame) -> DataFrame:
    """Which list each classified segment belongs to."""
    return classes.select("segment_id", F.when(F.col("content_type") == "speech", "talk").when(F.col("content_type") == "singing", "singing").otherwise("ambiguous").alias("list"))


def snapshot(
    segments: DataFrame, excluded: DataFrame | None, assigned: DataFrame | None, centroids: DataFrame | None, classes: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """(training snapshot, problems). Without an analysis table the stored values stay; with one,
    a segment it does not mention loses its speaker or becomes ambiguous."""
    problems = segments.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("segment_id", F.lit("duplicate_id").alias("problem"))
    out = segments if excluded is None else segments.join(excluded.select("segment_id"), "segment_id", "left_anti")
    if assigned is not None and centroids is not None:
        named = assigned.join(centroids, "speaker_id").select("segment_id", F.col("speaker_id").alias("_speaker"), F.col("centroid").alias("_centroid"))
        out = out.join(named, "segment_id", "left").withColumn("speaker_id", F.col("_speaker")).withColumn(
            "speaker_embedding", F.coalesce("_centroid", F.array().cast("array<double>"))).drop("_speaker", "_centroid")
    if classes is not None:
        out = out.join(classes.select("segment_id", F.col("content_type").alias("_type")), "segment_id", "left").withColumn(
            "content_type", F.coalesce("_type", F.lit("ambiguous"))).drop("_type")
    return out, problems


def snapshot_fingerprint(segments: DataFrame, corrections: DataFrame, settings: dict[str, str | None]) -> DataFrame:
    """One fingerprint over every column of all segments and all corrections, and the named settings:
    versions of schema, stage and correction, whether correction is on, and how pitch is filled."""
    a = set_fingerprint(segments, [], row_digest(*plain_columns(segments)), "segment_print")
    b = set_fingerprint(corrections, [], row_digest(*plain_columns(corrections)), "correction_print")
    named = [F.lit(x) for pair in sorted(settings.items()) for x in pair]
    return a.select("segment_print").join(b.select("correction_print"), F.lit(True)).select(
        row_digest(F.lit("training-snapshot"), *named, F.col("segment_print"), F.col("correction_print")).alias("fingerprint"))


def job_fingerprints(members: DataFrame, snapshot_print: DataFrame) -> DataFrame:
    """Fingerprint of each job: the snapshot it was planned on plus speaker, target and members."""
    sets = set_fingerprint(members, ["job_id", "speaker_id", "target"], row_digest(F.col("segment_id")), "_set")
    return sets.join(F.broadcast(snapshot_print.limit(1)), F.lit(True)).select(
        "job_id", "speaker_id", "target", F.col("row_count").alias("members"),
        row_digest(F.lit("training-job"), *map(F.col, ("fingerprint", "speaker_id", "target", "_set"))).alias("job_fingerprint"))


def resolve_jobs(jobs: DataFrame, members: DataFrame, view: DataFrame, snapshot_print: DataFrame) -> DataFrame:
    """Does every stored job still select the same segments of the same snapshot?

    ``jobs``: job_id, speaker_id, target, job_fingerprint. ``members``: job_id, segment_id.
    """
    stored = members.groupBy("job_id").agg(F.count(F.lit(1)).alias("stored_members"), F.count_distinct("segment_id").alias("_d"))
    tagged = members.distinct().join(jobs.select("job_id", "speaker_id", "target"), "job_id").withColumn("content_type", F.when(F.col("target") == "talk", "speech").otherwise("singing"))
    found = tagged.join(view.select("segment_id", "speaker_id", "content_type"), ["segment_id", "speaker_id", "content_type"], "left_semi")
    counts = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("found_members"))
    now = job_fingerprints(found.select("job_id", "speaker_id", "target", "segment_id"), snapshot_print).select("job_id", F.col("job_fingerprint").alias("_now"))
    joined = jobs.join(stored, "job_id", "left").join(counts, "job_id", "left").join(now, "job_id", "left").na.fill(0, ["stored_members", "found_members"])
    status = (
        F.when(F.col("stored_members") == 0, "empty").when(F.col("_d") != F.col("stored_members"), "repeated_members")
        .when(F.col("found_members") != F.col("stored_members"), "members_changed").when(F.coalesce(F.col("_now") != F.col("job_fingerprint"), F.lit(True)), "input_changed").otherwise("ok")
    )
    return joined.select("job_id", "stored_members", "found_members", status.alias("status"))


def emotion_problem(name: str = "name", source: str = "source", confidence: str = "confidence") -> Column:
    n, s, c = F.col(name), F.col(source), F.col(confidence)
    return (
        F.when(blank(n) | n.rlike(r"(?U)^\s|\s\z"), "blank_or_padded").when(F.length(n) > 32, "too_long").when(n.rlike(r"\p{Cc}"), "control_character")
        .when(~F.coalesce(s.isin("user", "inferred"), F.lit(False)), "unknown_source").when(c.isNotNull() & (~finite(c) | (c < 0) | (c > 1)), "confidence_range")
        .when((s == "user") & c.isNotNull(), "user_label_with_confidence")
    )


def import_components(segments: DataFrame) -> DataFrame:
    """Stored confidences as (value, status) components, by recorded status only."""
    return segments.select(
        "segment_id", legacy_measurement(F.col("asr_confidence"), F.col("asr_status")).alias("asr_confidence"),
        legacy_measurement(F.col("alignment_confidence"), F.col("alignment_status")).alias("alignment_confidence"))
