"""Media folders, content fingerprints, and the incremental manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions.measure import blank
from voxloom.functions.vocabulary import AUDIO_EXTENSIONS, INVALIDATED_ALIGNMENT, VIDEO_EXTENSIONS


def read_folder(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Files under a folder, recursively; contents are only read when asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(path)
    meta = [F.col("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms")]
    return raw.select(*meta, "content") if with_content else raw.select(*meta)


def media_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin(*AUDIO_EXTENSIONS), "audio").when(extension.isin(*VIDEO_EXTENSIONS), "video")


def supported(files: DataFrame) -> DataFrame:
    """Keep audio and video files, tagged with their type."""
    return files.withColumn("media_type", media_type(F.col("path"))).where("media_type IS NOT NULL")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(content: Column, version: Column, transcript: Column | None = None) -> Column:
    """Hash of bytes and processing version; an overriding transcript is part of the version."""
    full = version if transcript is None else F.when(transcript.isNull(), version).otherwise(F.concat(version, F.lit("/transcript/"), F.sha2(transcript, 256)))
    return F.sha2(F.concat(content, F.encode(F.concat(F.lit("|"), full), "utf-8")), 256)


def manifest_diff(current: DataFrame, previous: DataFrame, version: str) -> DataFrame:
    """New manifest: unchanged sources keep their row, changed ones keep their id, new ones get one.

    ``current``: path, media_type, size, modified_ms, content_hash. ``previous`` also: source_id,
    analysis_version, state, extracted_path, error. Vanished files drop out. New ids hash the path,
    so that a recomputed task names a source the same way.
    """
    old = previous.select(F.lower("path").alias("_key"), *[F.col(c).alias(f"_{c}") for c in (
        "source_id", "size", "modified_ms", "content_hash", "analysis_version", "state", "extracted_path", "error")])
    joined = current.withColumn("_key", F.lower("path")).join(old, "_key", "left")
    same = F.coalesce(
        (F.col("_size") == F.col("size")) & (F.col("_modified_ms") == F.col("modified_ms"))
        & (F.lower("_content_hash") == F.lower("content_hash")) & (F.col("_analysis_version") == version), F.lit(False))
    return joined.select(
        F.coalesce("_source_id", F.concat(F.lit("src_"), F.md5("_key"))).alias("source_id"), "path", "media_type", "size", "modified_ms", "content_hash",
        F.lit(version).alias("analysis_version"), F.when(same, F.col("_state")).otherwise("pending").alias("state"),
        F.when(same, F.col("_extracted_path")).alias("extracted_path"), F.when(same, F.col("_error")).alias("error"),
        F.when(same, "unchanged").when(F.col("_source_id").isNotNull(), "changed").otherwise("added").alias("change"),
    )


def carry_extraction(scanned: DataFrame, previous: DataFrame, outputs: DataFrame) -> DataFrame:
    """Reuse extracted audio where hash and version still hold and the output exists; the rest is to do."""
    old = previous.select("source_id", F.col("content_hash").alias("_h"), F.col("analysis_version").alias("_v"), F.col("state").alias("_s"), F.col("extracted_path").alias("_p"))
    there = outputs.select(F.col("path").alias("_p"), F.lit(True).alias("_there")).distinct()
    joined = scanned.join(old, "source_id", "left").join(there, "_p", "left")
    reuse = F.coalesce((F.col("_h") == F.col("content_hash")) & (F.col("_v") == F.col("analysis_version")) & (F.col("_s") == "ready") & F.col("_there"), F.lit(False))
    return joined.select(
        "source_id", "path", "content_hash", "analysis_version", F.when(reuse, "ready").otherwise("pending").alias("state"), F.when(reuse, F.col("_p")).alias("extracted_path"), reuse.alias("reused"),
    )


def finish_extraction(todo: DataFrame, results: DataFrame) -> DataFrame:
    """Join extraction results (source_id, error); a failed source is a row, not a failed run."""
    done = todo.join(results, "source_id", "left")
    ok = F.col("error").isNull()
    return done.select(
        "source_id", "path", "content_hash", "analysis_version", F.when(ok, "ready").otherwise("failed").alias("state"),
        F.when(ok, F.concat(F.lit("extracted/"), "source_id", F.lit(".wav"))).alias("extracted_path"), "error",
    )


def stage_todo(sources: DataFrame, stage: DataFrame, outputs: DataFrame, version: str) -> DataFrame:
    """Sources whose stage result is missing, failed, of another version, or lost its output."""
    done = stage.where((F.col("stage_version") == version) & F.col("error").isNull()).join(outputs.select(F.col("path").alias("output_path")), "output_path", "left_semi")
    return sources.join(done.select("source_id"), "source_id", "left_anti")


def feature_reuse(segments: DataFrame, cached: DataFrame) -> DataFrame:
    """reuse or extract per segment: same key, not invalidated, all series there, measurement valid."""
    old = cached.select("segment_id", F.col("cache_key").alias("_key"), F.col("alignment_method").alias("_method"), "has_series", "measurement_valid")
    joined = segments.join(old, "segment_id", "left")
    reuse = F.coalesce(
        (F.col("_key") == F.col("cache_key")) & (F.coalesce("_method", F.lit("")) != INVALIDATED_ALIGNMENT) & F.col("has_series") & F.col("measurement_valid"), F.lit(False))
    why = F.when(F.col("_key").isNull(), "new").when(F.col("_key") != F.col("cache_key"), "key_changed").when(F.coalesce("_method", F.lit("")) == INVALIDATED_ALIGNMENT, "invalidated").when(
        ~F.col("has_series"), "series_missing").when(~F.col("measurement_valid"), "measurement_invalid")
    return joined.select("segment_id", "cache_key", F.when(reuse, "reuse").otherwise("extract").alias("decision"), F.when(~reuse, why).alias("reason"))


def clip_duration(bytes_count: Column, byte_rate: Column) -> Column:
    """Seconds of audio data; NULL, never zero, when they cannot be known."""
    return F.when((byte_rate > 0) & bytes_count.isNotNull() & ~blank(byte_rate.cast("string")), bytes_count / byte_rate)
