"""Training-set sinks and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType

from voxloom.functions import phone_arrays
from voxloom.functions.measure import blank, let, reasons
from voxloom.functions.phone_arrays import ITEM_LISTS
from voxloom.operators.sequences import with_neighbours
from voxloom.session import ship_package


def bad_field(text: Column) -> Column:
    """Empty text or a delimiter character."""
    return blank(text) | text.rlike(r"[|\r\n]")


def talk_lines(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segment_id, line ``file|speaker|JP|text``) and refused rows."""
    refused = reasons((bad_field(F.col("speaker_name")), "speaker_name"), (bad_field(F.col("transcript")), "transcript"))
    judged = items.withColumn("_r", refused)
    line = F.concat_ws("|", F.concat("segment_id", F.lit(".wav")), "speaker_name", F.lit("JP"), "transcript")
    good = judged.where(F.size("_r") == 0).select("segment_id", line.alias("line"))
    return good, judged.where(F.size("_r") > 0).select("segment_id", F.explode("_r").alias("problem"))


def write_talk_list(lines: DataFrame, path: str) -> None:
    """Lines in id order; the range sort is distributed and each part file is a contiguous run."""
    lines.orderBy("segment_id").select("line").write.mode("errorifexists").text(path)


def singing_items(segments: DataFrame, *more: str) -> DataFrame:
    """Parallel phone, duration, start and end arrays per segment; ``more`` columns are kept.

    Where ``phone_arrays.ITEM_LISTS`` made the lists already, they are taken as they are.
    """
    if set(ITEM_LISTS) <= set(segments.columns):
        return segments.select(*more, "segment_id", "transcript", *ITEM_LISTS)
    p = F.col("phonemes")
    return segments.select(
        *more, "segment_id", "transcript", F.transform(p, lambda x: x["phoneme"]).alias("phones"),
        F.transform(p, lambda x: F.greatest(F.lit(0.0), x["end_sec"] - x["start_sec"])).alias("durations"),
        F.transform(p, lambda x: x["start_sec"]).alias("starts"), F.transform(p, lambda x: x["end_sec"]).alias("ends"),
    )


def _whole(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit(".0")), F.substring_index(text, ".", 1)).otherwise(text)


def significant(value: Column) -> Column:
    """Text of a positive number with up to twelve significant digits, without trailing zeros; below
    a ten-thousandth with an exponent.

    Numbers from a thousandth to a thousand, which phone lengths are, are rounded at the place of their
    twelfth digit and printed as they are; formatting and trimming the others is five times slower.
    """
    usual = F
    for place, top in ((14, 1e-2), (13, 1e-1), (12, 1.0), (11, 1e1), (10, 1e2), (9, 1e3)):
        usual = usual.when(value < top, F.round(value, place))
    short = usual.cast("string")
    plain = F.regexp_replace(F.format_string("%.12g", value), r"\.0*$|(?<=\.[0-9]{1,15})0+$", "")
    tiny = F.regexp_replace(F.format_string("%.11e", value), r"\.?0+e", "e")
    return F.when((value >= 1e-3) & (value < 1e3), let(short, _whole)).when(value >= 1e-4, plain).when(value > 0, tiny).otherwise("0")


def clip_name(segment_id: Column) -> Column:
    return F.concat(F.lit("segment_"), F.sha2(segment_id, 256))


def transcription_rows(items: DataFrame, *more: str) -> DataFrame:
    """name, ph_seq, ph_dur of every clip; ``more`` columns are kept."""
    lengths = F.transform(F.arrays_zip("starts", "ends"), lambda x: significant(x["ends"] - x["starts"]))
    return items.select(*more, clip_name(F.col("segment_id")).alias("name"), F.array_join("phones", " ").alias("ph_seq"), F.array_join(lengths, " ").alias("ph_dur"))


def phone_dictionary(items: DataFrame) -> DataFrame:
    """Sorted distinct phones of the set, each spelled as itself."""
    return items.select(F.explode(F.array_distinct("phones")).alias("phone")).distinct().select("phone", F.concat_ws("\t", "phone", "phone").alias("entry")).orderBy("phone")


def artifact_problems(manifest: DataFrame, actual: DataFrame, jobs: DataFrame) -> DataFrame:
    """Recorded artifacts (job_id, path, sha256) against files (job_id, path, size, sha256)."""
    escapes = F.col("path").rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")
    found = actual.select("job_id", "path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    joined = manifest.join(found, ["job_id", "path"], "left").select("job_id", "path", F.when(escapes, "path_escapes").when(
        F.col("_size").isNull() | (F.col("_size") == 0), "missing_or_empty").when(~F.lower("sha256").eqNullSafe(F.lower("_sha")), "hash_mismatch").alias("problem"))
    empty = jobs.join(manifest.select("job_id"), "job_id", "left_anti").select("job_id", F.lit(None).cast("string").alias("path"), F.lit("no_artifacts").alias("problem"))
    return joined.where("problem IS NOT NULL").unionByName(empty)


def sample_status(samples: DataFrame, actual: DataFrame) -> DataFrame:
    """State of each listening sample: outside, missing, hash not recorded, ok or mismatch."""
    found = actual.select("job_id", "path", F.col("sha256").alias("_sha"))
    outside = F.col("path").rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")
    return samples.join(found, ["job_id", "path"], "left").select("job_id", "path", F.when(outside, "outside_folder").when(F.col("_sha").isNull(), "missing").when(
        blank(F.col("sha256")), "hash_not_recorded").when(F.lower("sha256") == F.lower("_sha"), "ok").otherwise("mismatch").alias("status"))


def _field_prints(items: DataFrame, fields: list[str]) -> list[Column]:
    """SHA-256 of the texts and lists among the fields, other values as they are."""
    ship_package(items.sparkSession)
    listed = F.arrow_udf(phone_arrays.list_print, "binary", F.ArrowUDFType.SCALAR)
    flat = (StringType, DoubleType, LongType, IntegerType)

    def one(name: str) -> Column:
        kind = items.schema[name].dataType
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, flat):
            return listed(F.col(name)).alias(name)
        return (F.unhex(F.sha2(name, 256)) if isinstance(kind, StringType) else F.col(name)).alias(name)

    return [one(f) for f in fields]


def training_set_problems(stored: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Stored items against the current snapshot, column by column, with NULL equal to NULL.

    Texts and lists meet by their SHA-256, made in their own row, so the join carries some 32 bytes a column.
    Sides that made the digests already (binary, both in the same way) bring them instead.
    """
    fields = [c for c in snapshot.columns if c not in keys]
    left = stored.select(*keys, *_field_prints(stored, fields)).select(*keys, F.struct(*fields).alias("_a"))
    right = snapshot.select(*keys, *_field_prints(snapshot, fields)).select(*keys, F.struct(*fields).alias("_b"))
    joined = left.join(right, keys, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    codes = reasons(
        (F.col("_a").isNull(), "item_missing"), (F.col("_b").isNull(), "item_unexpected"),
        *[(both & ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), f"differs:{f}") for f in fields],
    )
    return joined.select(*keys, F.explode(codes).alias("problem"))


def list_problems(items: DataFrame, lines: DataFrame) -> DataFrame:
    """A written list (job_id, line_no, line) against its items (job_id, line_no, audio_name, speaker_name, transcript)."""
    fields = F.array("audio_name", "speaker_name", "transcript")
    expected = F.concat_ws("|", "audio_name", "speaker_name", F.lit("JP"), "transcript")
    bad = items.where(F.exists(fields, bad_field)).select("job_id", "line_no", F.lit("bad_column").alias("problem"))
    joined = items.select("job_id", "line_no", expected.alias("_want")).join(lines, ["job_id", "line_no"], "full_outer")
    differ = joined.where(~F.col("_want").eqNullSafe(F.col("line"))).select("job_id", "line_no", F.when(F.col("line").isNull(), "line_missing").when(
        F.col("_want").isNull(), "line_unexpected").otherwise("line_differs").alias("problem"))
    repeated = items.groupBy("job_id", "audio_name").agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("line_no")).where("_n > 1").select("job_id", "line_no", F.lit("name_repeated").alias("problem"))
    return bad.unionByName(differ).unionByName(repeated)
