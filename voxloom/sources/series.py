"""Stored frame series and stored job files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.functions.measure import finite

FRAME_SCHEMA = "array<struct<time_sec:double,value:double,confidence:double>>"


def read_series(documents: DataFrame) -> DataFrame:
    """Frames (segment_id, idx, time_sec, value, confidence) from JSON text; unreadable text gives none."""
    parsed = documents.withColumn("_frames", F.from_json("json", FRAME_SCHEMA, {"mode": "PERMISSIVE"}))
    return parsed.select("segment_id", F.posexplode("_frames").alias("idx", "_f")).select("segment_id", "idx", "_f.*")


def voiced_f0(documents: DataFrame) -> DataFrame:
    """Usable pitch values only: finite and above zero."""
    return read_series(documents).where(finite(F.col("value")) & (F.col("value") > 0)).select("segment_id", "idx", F.col("value").alias("f0"))


def unreadable_series(documents: DataFrame) -> DataFrame:
    return documents.where(F.from_json("json", FRAME_SCHEMA, {"mode": "PERMISSIVE"}).isNull()).select("segment_id", F.lit("unreadable_series").alias("problem"))


BATCH_SCHEMA = "batch_id string, created_at string, jobs array<struct<job_id:string,speaker_id:string,target:string>>"


def parse_job_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches newest first, error rows) from file_name and json text."""
    parsed = files.withColumn("b", F.from_json("json", BATCH_SCHEMA, {"mode": "PERMISSIVE"})).withColumn("_created", F.try_to_timestamp(F.col("b.created_at")))
    stem = F.regexp_replace("file_name", r"\.json$", "")
    good = F.coalesce((F.col("b.batch_id") == stem) & F.col("_created").isNotNull() & (F.size("b.jobs") > 0), F.lit(False))
    batches = parsed.where(good).select("b.batch_id", F.col("_created").alias("created_at"), F.size("b.jobs").alias("jobs")).orderBy(F.desc("created_at"), "batch_id")
    return batches, parsed.where(~good).select("file_name", F.lit("unreadable_batch").alias("problem"))


def job_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read every stored batch of a folder; one bad file does not stop the scan."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    named = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("json"))
    return parse_job_files(named)
