"""Strategy rules against inventories, ranking, planning, and budgeted reference intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.measure import reasons
from voxloom.session import durable

MAX_ITEMS, MAX_ITEM_SEC, MAX_TOTAL_SEC = 8, 30.0, 120.0


def measures(inventory: DataFrame) -> DataFrame:
    """Inventory in long form: one row per (speaker, role, metric); seconds know how well they were measured."""
    rows = [
        ("speech_teacher", "eligible_seconds", "speech_eligible_seconds"), ("speech_teacher", "independent_utterances", "speech_utterances"),
        ("speech_teacher", "distinct_sources", "speech_recordings"), ("speech_teacher", "phoneme_coverage_count", "phoneme_coverage"),
        ("singing_teacher", "eligible_seconds", "singing_eligible_seconds"), ("singing_teacher", "independent_phrases", "singing_phrases"),
        ("singing_teacher", "distinct_sources", "singing_recordings"), ("singing_teacher", "pitch_bins_observed", "pitch_bins"),
        ("identity_reference", "eligible_seconds", "identity_seconds"), ("identity_reference", "distinct_sources", "identity_sources"),
    ]
    entries = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("actual")) for r, m, c in rows])
    long = inventory.select("speaker_id", "status_duration", F.explode(entries).alias("e")).select("speaker_id", "status_duration", "e.*")
    seconds = F.col("metric") == "eligible_seconds"
    return long.select(
        "speaker_id", "role", "metric",
        F.when(~(seconds & (F.col("status_duration") == "unavailable")), F.col("actual")).alias("actual"),
        (~seconds | (F.col("status_duration") == "measured")).alias("complete"),
    )


def requirement_results(requests: DataFrame, inventory: DataFrame, strategies: DataFrame, requirements: DataFrame) -> DataFrame:
    """met / unmet / unknown for every request × strategy × requirement. Strategies and rules are small catalogs."""
    rules = strategies.select("strategy_id", "version").join(requirements, "strategy_id")
    long = measures(inventory)
    roles = F.array(*[F.lit(r) for r in ("speech_teacher", "singing_teacher", "identity_reference", "texture_reference", "feature_only")])
    every = requests.select("speaker_id", "target", F.explode(roles).alias("role")).join(rules, "role")
    joined = every.join(long, ["speaker_id", "role", "metric"], "left")
    actual, required = F.col("actual"), F.col("required")
    holds = (
        F.when(F.col("op") == "gte", actual >= required).when(F.col("op") == "gt", actual > required)
        .when(F.col("op") == "lte", actual <= required).when(F.col("op") == "lt", actual < required).otherwise(actual == required)
    )
    outcome = (
        F.when(actual.isNull(), "unknown").when(~F.col("complete") & ~(holds & F.col("op").isin("gte", "gt")), "unknown")
        .when(holds, "met").otherwise("unmet")
    )
    return joined.select("speaker_id", "target", "strategy_id", "version", "role", "metric", "op", "required", "actual", outcome.alias("outcome"))


def strategy_fits(requests: DataFrame, results: DataFrame, strategies: DataFrame) -> DataFrame:
    """Outcome and refusal codes per request × strategy."""
    worst = results.groupBy("speaker_id", "target", "strategy_id", "version").agg(
        F.count_if(F.col("outcome") == "unmet").alias("_unmet"), F.count_if(F.col("outcome") == "unknown").alias("_unknown"),
        F.array_sort(F.collect_set(F.when(F.col("outcome") == "unmet", F.concat_ws(":", F.lit("requirement"), "role", "metric")))).alias("_failed"),
    )
    s = strategies.withColumnRenamed("target", "supported_target")
    every = worst.join(s, ["strategy_id", "version"]).join(requests, ["speaker_id", "target"])
    preset_ok = (F.size("preset_ids") == 0) | F.array_contains("preset_ids", F.col("preset_id"))
    codes = F.concat(
        reasons((F.col("supported_target") != F.col("target"), "target_unsupported"), (~preset_ok, "preset_unsupported"), (~F.col("available"), "capability_missing")),
        "_failed",
    )
    return every.withColumn("refusals", codes).withColumn(
        "outcome", F.when(F.size("refusals") > 0, "unmet").when(F.col("_unknown") > 0, "unknown").otherwise("met")
    ).select("speaker_id", "target", "preset_id", "strategy_id", "version", "outcome", "refusals", F.array_contains("preset_ids", F.col("preset_id")).alias("preset_specific"))


def version_order(version: str) -> list[Column]:
    """Sort columns, newest first: numeric parts, then releases before pre-releases."""
    core, pre = F.substring_index(version, "-", 1), F.when(F.instr(version, "-") > 0, F.expr(f"substring({version}, instr({version}, '-') + 1)"))
    parts = [F.split_part(core, F.lit("."), F.lit(i)).cast("long").desc() for i in (1, 2, 3)]
    return [*parts, pre.isNull().desc(), pre.desc()]


def ranked_candidates(fits: DataFrame) -> DataFrame:
    """Strategies that are not refused, best first. Groups hold one row per registered strategy."""
    order = [(F.col("outcome") == "met").desc(), F.col("preset_specific").desc(), F.col("strategy_id"), *version_order("version")]
    w = Window.partitionBy("speaker_id", "target").orderBy(*order)
    return fits.where("outcome <> 'unmet'").withColumn("rank", F.row_number().over(w))


def plan(fits: DataFrame, stages: DataFrame) -> DataFrame:
    """Candidates in planning order and rejections with codes, for both targets.

    A talk plan must not train speech on singing alone; a singing plan must not make a singing base
    without a singing teacher.
    """
    speech_in, singing_in = F.array_contains("input_roles", "speech_teacher"), F.array_contains("input_roles", "singing_teacher")
    speech_out = F.arrays_overlap("output_types", F.array(F.lit("tts_base"), F.lit("talk_model")))
    facts = stages.groupBy("strategy_id").agg(
        F.bool_or(singing_in & ~speech_in & F.col("trains") & speech_out).alias("_talk_guard"),
        F.bool_or(F.array_contains("output_types", "singing_base") & ~singing_in).alias("_singing_guard"),
        F.bool_or(speech_in).alias("_speech"), F.bool_or(singing_in).alias("_singing"),
    )
    talk = F.col("target") == "talk"
    joined = fits.join(facts, "strategy_id", "left")
    guard = F.when(talk & F.col("_talk_guard"), "singing_as_speech_teacher").when(~talk & F.col("_singing_guard"), "speech_as_singing_teacher")
    direct = F.when(talk, F.coalesce("_speech", F.lit(False))).otherwise(F.coalesce("_singing", F.lit(False)))
    variant = F.when(talk & direct, "speech_teacher_based").when(talk, "singing_timbre_reference").when(direct, "singing_teacher_based").otherwise("speech_timbre_reference")
    judged = joined.withColumn("reasons", F.concat("refusals", F.array_compact(F.array(guard)))).withColumn("variant", variant).withColumn("_direct", direct)
    order = [(F.col("outcome") == "met").desc(), F.col("_direct").desc(), F.col("preset_specific").desc(), F.col("strategy_id"), *version_order("version")]
    w = Window.partitionBy("speaker_id", "target", F.size("reasons") == 0).orderBy(*order)
    ok = F.size("reasons") == 0
    return judged.select(
        "speaker_id", "target", "strategy_id", "version", F.when(ok, "candidate").otherwise("rejected").alias("kind"),
        F.when(ok, F.row_number().over(w)).alias("rank"), F.when(ok, F.col("variant")).alias("variant"), F.when(ok, F.col("outcome")).alias("outcome"), "reasons",
    )


def reference_intake(items: DataFrame) -> DataFrame:
    """Accept reference clips in order under a budget: 8 items, 30 s each, 120 s in all, no repeats.

    ``items``: job_id, position, extension, exists, seconds, sha256. Whether a clip fits depends on
    what was accepted before it, but at most eight are. Each round finds every job's next
    acceptable clip with one partial aggregate over all items; after eight rounds the accepted
    lists (eight rows per job) decide the reason of every other clip. No job is read in one task.
    """
    readable = items.withColumn("_own", F.when(F.lower("extension") != "wav", "not_wav").when(~F.col("exists"), "missing").when(
        F.col("seconds").isNull() | (F.col("seconds") <= 0), "unreadable").when(F.col("seconds") > MAX_ITEM_SEC, "too_long"))
    fit = readable.where("_own IS NULL").select("job_id", "position", "seconds", "sha256")
    state = None
    for _ in range(MAX_ITEMS):
        if state is None:
            open_items = fit.withColumn("_got", F.array().cast("array<struct<position:bigint,seconds:double,sha256:string>>"))
        else:
            open_items = fit.join(state, "job_id", "left").withColumn(
                "_got", F.coalesce("_got", F.array().cast("array<struct<position:bigint,seconds:double,sha256:string>>")))
        used = F.aggregate("_got", F.lit(0.0), lambda a, x: a + x["seconds"])
        last = F.coalesce(F.array_max(F.transform("_got", lambda x: x["position"])), F.lit(-1))
        possible = open_items.where(
            (F.col("position") > last) & (used + F.col("seconds") <= MAX_TOTAL_SEC)
            & ~F.exists("_got", lambda x: x["sha256"] == F.col("sha256"))
        )
        entry = F.struct(F.col("position").cast("bigint").alias("position"), F.col("seconds").cast("double").alias("seconds"), "sha256")
        nxt = possible.groupBy("job_id").agg(F.min_by(entry, "position").alias("_next"))
        if state is None:
            state = durable(nxt.select("job_id", F.array("_next").alias("_got")))
        else:
            state = durable(state.join(nxt, "job_id", "left").select(
                "job_id", F.when(F.col("_next").isNull(), F.col("_got")).otherwise(F.array_append("_got", F.col("_next"))).alias("_got")))
    judged = readable.join(state, "job_id", "left").withColumn("_got", F.coalesce("_got", F.array().cast("array<struct<position:bigint,seconds:double,sha256:string>>")))
    before = F.filter("_got", lambda x: x["position"] < F.col("position"))
    accepted = F.exists("_got", lambda x: x["position"] == F.col("position"))
    spent = F.aggregate(before, F.lit(0.0), lambda a, x: a + x["seconds"])
    reason = (
        F.when(accepted, F.lit(None).cast("string")).when(F.size(before) >= MAX_ITEMS, "too_many").when(F.col("_own").isNotNull(), F.col("_own"))
        .when(spent + F.col("seconds") > MAX_TOTAL_SEC, "over_budget").otherwise("repeated_content")
    )
    return judged.select("job_id", "position", "sha256", "seconds", accepted.alias("accepted"), reason.alias("reason"))
