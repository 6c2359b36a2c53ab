"""Training jobs: fan-out, regrouping, contract audit and input fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.functions.fingerprints import plain_columns, row_digest, set_fingerprint
from voxloom.functions.measure import blank, reasons

TALK_BIT, SINGING_BIT = 1, 2


def job_members(selections: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per (job, member): selections × targets joined to the matching segments.

    Members stay rows: a job of a prolific speaker may hold a third of the corpus.
    """
    targets = selections.withColumn("target", F.explode(F.filter(F.array(
        F.when(F.col("target_bits").bitwiseAND(TALK_BIT) > 0, F.lit("talk")), F.when(F.col("target_bits").bitwiseAND(SINGING_BIT) > 0, F.lit("singing")),
    ), lambda t: t.isNotNull()))).withColumn("content_type", F.when(F.col("target") == "talk", "speech").otherwise("singing"))
    joined = segments.select("segment_id", "speaker_id", "content_type", "valid_alignment").join(targets, ["speaker_id", "content_type"])
    return joined.select(
        F.concat_ws("/", "speaker_id", "target").alias("job_id"), "speaker_id", "target", "auto_correction", "segment_id", "valid_alignment"
    )


def fan_out(selections: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with size and member fingerprint, problems): empty selections and unaligned singing members."""
    prints = set_fingerprint(members, ["job_id", "speaker_id", "target", "auto_correction"], row_digest(F.col("segment_id")), "member_fingerprint")
    jobs = prints.withColumnRenamed("row_count", "members")
    unaligned = members.where((F.col("target") == "singing") & ~F.col("valid_alignment")).select(
        "job_id", "segment_id", F.lit("alignment_required").alias("problem")
    )
    wanted = selections.select("speaker_id", F.explode(F.array_compact(F.array(
        F.when(F.col("target_bits").bitwiseAND(TALK_BIT) > 0, F.lit("talk")), F.when(F.col("target_bits").bitwiseAND(SINGING_BIT) > 0, F.lit("singing")),
    ))).alias("target"))
    empty = wanted.join(jobs.select("speaker_id", "target"), ["speaker_id", "target"], "left_anti").select(
        F.concat_ws("/", "speaker_id", "target").alias("job_id"), F.lit(None).cast("string").alias("segment_id"), F.lit("empty_selection").alias("problem")
    )
    return jobs, unaligned.unionByName(empty)


def regroup(jobs: DataFrame) -> DataFrame:
    """Jobs back to selections; a speaker with two correction settings is marked."""
    bits = F.when(F.col("target") == "talk", TALK_BIT).otherwise(SINGING_BIT)
    grouped = jobs.groupBy("speaker_id", "auto_correction").agg(F.bit_or(bits).alias("target_bits"))
    mixed = grouped.groupBy("speaker_id").agg((F.count(F.lit(1)) > 1).alias("mixed_settings"))
    return grouped.join(mixed, "speaker_id")


def contract_problems(jobs: DataFrame) -> DataFrame:
    """One row per broken rule of a stored job."""
    repeated = jobs.groupBy("batch_id", "job_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("batch_id", "job_id", F.lit(True).alias("_twice"))
    requested, resolved = F.col("requested_mode"), F.col("resolved_mode")
    init, components = F.col("initialization"), F.coalesce(F.col("components"), F.array().cast("array<struct<name:string,sha256:string,path:string>>"))
    modes = ("auto", "fine_tune", "from_scratch")
    legacy = requested.isNull()
    checked = ~legacy & resolved.isNotNull() & (resolved != "auto")
    bad_component = F.exists(
        components,
        lambda c: blank(c["name"]) | ~F.coalesce(c["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False)) | blank(c["path"])
        | F.coalesce(c["path"].rlike(r"^[/\\]|:|(^|[/\\])\.\.([/\\]|$)"), F.lit(False)),
    )
    rules = [
        (blank(F.col("job_id")), "job_id_empty"), (F.col("_twice").isNotNull(), "job_id_repeated"),
        (blank(F.col("speaker_id")), "speaker_empty"), (blank(F.col("dataset_fingerprint")), "fingerprint_empty"),
        (~F.coalesce(F.col("target").isin("talk", "singing", "both"), F.lit(False)), "target_vocabulary"),
        (legacy & (resolved.isNotNull() | init.isNotNull() | F.col("texture").isNotNull()), "legacy_job_with_contract"),
        (~legacy & ~requested.isin(*modes), "requested_mode_vocabulary"),
        (~legacy & blank(F.col("texture")), "texture_missing"),
        (~legacy & resolved.isNull() & (requested != "auto"), "explicit_mode_unresolved"),
        (~legacy & resolved.isNull() & init.isNotNull(), "unresolved_with_initialization"),
        (~legacy & F.coalesce(resolved == "auto", F.lit(False)), "resolved_to_auto"),
        (checked & (requested != "auto") & (requested != resolved), "mode_mismatch"),
        (checked & init.isNull(), "initialization_missing"),
        (checked & (resolved == "from_scratch") & init.isNotNull() & ((init != "random_initialization") | (F.size(components) > 0)), "scratch_initialization"),
        (checked & (resolved == "fine_tune") & init.isNotNull() & ((init != "pretrained_checkpoint") | (F.size(components) == 0)), "fine_tune_initialization"),
        (checked & (resolved == "fine_tune") & bad_component, "component_invalid"),
    ]
    return jobs.join(repeated, ["batch_id", "job_id"], "left").select("batch_id", "job_id", F.explode(reasons(*rules)).alias("problem"))


def contract_fingerprint(jobs: DataFrame) -> DataFrame:
    """Fingerprint of what was asked for, per job that has a contract: target, texture with its version,
    description and reference ids, both modes, seed, and initialization with its components.

    The order of references and components, and the case of their hashes, do not count.
    """
    components = F.transform("components", lambda c: F.array(c["name"], F.lower(c["sha256"]), c["path"]))
    digest = row_digest(
        F.lit("training-job-contract"), *map(F.col, ("target", "texture", "preset_version", "description")), F.to_json(F.array_sort("reference_ids")),
        *map(F.col, ("requested_mode", "resolved_mode", "seed", "initialization")), F.to_json(F.array_sort(components)),
    )
    return jobs.where("requested_mode IS NOT NULL AND texture IS NOT NULL").select("job_id", digest.alias("contract_fingerprint"))


#: What a group's fingerprint takes from its job, and which of these may not be blank.
REQUIRED_CONTEXT = ("dataset_fingerprint", "contract_fingerprint", "backend", "backend_revision")
CONTEXT = (*REQUIRED_CONTEXT, "trainer_config_sha256", "policy_version", "speaker_id", "target", "source_fingerprint", "override_revision")


def input_fingerprint(assessed: DataFrame, keys: list[str], contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, problems) of the assessments that groups train on, with the job around them.

    ``contexts`` has one row per group: the keys and ``CONTEXT``. Role, eligibility, reasons, every
    quality component, statuses and numbers of each segment count. A group with a blank required field,
    without a context, or with a segment twice gets a problem row and no fingerprint.
    """
    role = F.col("role") if "role" in assessed.columns else F.lit(None).cast("string")
    digest = row_digest(
        F.col("segment_id"), role, F.col("eligibility"), F.to_json(F.array_sort("reason_codes")), F.col("quality_status"),
        *plain_columns(assessed, "quality_value", "components"), F.col("utility_status"), *plain_columns(assessed, "utility_value", "raw_weight", "training_weight"),
    )
    sets = set_fingerprint(assessed, keys, digest, "_set")
    repeated = assessed.groupBy(*keys, "segment_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).distinct().withColumn("_twice", F.lit(True))
    joined = sets.join(contexts.select(*keys, F.struct(*CONTEXT).alias("_context")), keys, "left").join(repeated, keys, "left")
    found = reasons(
        (F.col("_context").isNull(), "context_missing"),
        *[(F.col("_context").isNotNull() & blank(F.col("_context")[c]), f"{c}_blank") for c in REQUIRED_CONTEXT],
        (F.col("_twice").isNotNull(), "segment_repeated"),
    )
    judged = joined.withColumn("_problems", found)
    whole = row_digest(F.lit("training-input"), *[F.col("_context")[c] for c in CONTEXT], F.col("_set"))
    prints = judged.where(F.size("_problems") == 0).select(*keys, "row_count", whole.alias("input_fingerprint"))
    return prints, judged.select(*keys, F.explode("_problems").alias("problem"))
