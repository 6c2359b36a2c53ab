"""Per-speaker inventories, shared features, timbre references and reference styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.fingerprints import row_digest, set_fingerprint
from voxloom.functions.measure import asr_measured, blank, finite, reasons
from voxloom.functions.vectors import all_finite, group_vector_sum
from voxloom.operators.routing import decision_reasons

FEATURES = ("speaker_embedding", "f0_distribution", "style_prosody")
STYLE = ("speaking_rate", "pitch_range_semitones", "energy_variation", "pause_ratio")


def with_eligibility_columns(segments: DataFrame) -> DataFrame:
    """Talk and singing eligibility (and first reason) as columns of the segment row."""
    out = segments
    for t in ("talk", "singing"):
        removed, open_points = decision_reasons(F.lit(t))
        out = out.withColumn(f"{t}_codes", F.concat(removed, open_points)).withColumn(
            f"{t}_eligibility", F.when(F.size(removed) > 0, "excluded").when(F.size(open_points) > 0, "needs_review").otherwise("eligible")
        )
    return out


def _domain_rows(segments: DataFrame) -> DataFrame:
    return segments.where(~blank(F.col("speaker_id"))).withColumn(
        "d", F.explode(F.array(
            F.struct(F.lit("speech").alias("domain"), F.col("talk_role").alias("role"), F.col("talk_reason").alias("reason")),
            F.struct(F.lit("singing").alias("domain"), F.col("singing_role").alias("role"), F.col("singing_reason").alias("reason")),
        ))
    ).select("*", "d.domain", "d.role", "d.reason").drop("d")


def shared_features(segments: DataFrame) -> dict[str, DataFrame]:
    """Embedding mean, pooled pitch and mean prosody per speaker × domain, plus the skipped rows.

    Returns ``embedding`` (speaker_id, domain, status, count, vector), ``pitch``, ``style`` and
    ``skipped`` (segment_id, feature, domain, reason). The first usable member by id fixes the
    embedding dimension.
    """
    rows = _domain_rows(segments)
    key = ["speaker_id", "domain"]
    groups = rows.select(*key).distinct()
    members = rows.where("role = 'primary'")
    v = F.col("speaker_embedding")
    has_vector = all_finite(v)
    dims = members.where(has_vector).groupBy(*key).agg(F.min_by(F.size(v), F.col("segment_id")).alias("_dim"))
    sized = members.join(dims, key, "left")
    vector_reason = F.when(~has_vector, "embedding_unavailable").when(F.size(v) != F.col("_dim"), "embedding_dimension_mismatch")
    f0, sd, rel = F.col("mean_f0_hz"), F.col("f0_std_dev_hz"), F.col("pitch_reliability")
    pitch_ok = finite(f0) & (f0 > 0) & finite(sd) & (sd >= 0) & finite(rel) & (rel > 0)
    style = [F.col(c) for c in STYLE]
    style_ok = finite(style[0]) & finite(style[1]) & finite(style[2]) & finite(style[3]) & ~(
        (style[0] == 0) & (style[1] == 0) & (style[2] == 0) & (style[3] == 0)
    )
    usable = sized.where(vector_reason.isNull())
    counts = usable.groupBy(*key).agg(F.count(F.lit(1)).alias("count"))
    sums = group_vector_sum(usable, key, "speaker_embedding")
    embedding = groups.join(counts, key, "left").join(sums, key, "left").select(
        *key, F.when(F.col("count") > 0, "measured").otherwise("unavailable").alias("status"), F.coalesce("count", F.lit(0)).alias("count"),
        F.transform("vector_sum", lambda x: x / F.col("count")).alias("vector"),
    )
    scalars = members.groupBy(*key).agg(
        F.count_if(pitch_ok).alias("pitch_count"), F.avg(F.when(pitch_ok, f0)).alias("mean_f0_hz"),
        F.sqrt(F.avg(F.when(pitch_ok, sd * sd)) + F.var_pop(F.when(pitch_ok, f0))).alias("f0_std_dev_hz"),
        F.count_if(style_ok).alias("style_count"), *[F.avg(F.when(style_ok, F.col(c))).alias(c) for c in STYLE],
    )
    scalars = groups.join(scalars, key, "left").na.fill(0, ["pitch_count", "style_count"])

    def why(feature: str, reason: Column) -> Column:
        return F.when(reason.isNotNull(), F.struct(F.lit(feature).alias("feature"), reason.alias("reason")))

    outside = rows.where("role <> 'primary'").select(
        "segment_id", "domain", F.explode(F.array(*[F.lit(f) for f in FEATURES])).alias("feature"), F.coalesce("reason", "role").alias("reason")
    )
    inside = sized.select("segment_id", "domain", F.explode(F.array_compact(F.array(
        why("speaker_embedding", vector_reason), why("f0_distribution", F.when(~pitch_ok, "f0_unavailable")), why("style_prosody", F.when(~style_ok, "style_unavailable")),
    ))).alias("w")).select("segment_id", "domain", "w.feature", "w.reason")
    return {"embedding": embedding, "scalars": scalars, "skipped": outside.unionByName(inside)}


def _status(total: Column, good: Column) -> Column:
    return F.when((total == 0) | (good == 0), "unavailable").when(total == good, "measured").otherwise("partially_measured")


#: Counts up whenever the same material would give other figures.
CALCULATION_VERSION = "1"


def speaker_inventory(segments: DataFrame, dataset_fingerprint: str, override_revision: str | None = None) -> DataFrame:
    """Material of every speaker in one aggregate.

    ``segments`` brings routing roles, eligibility columns and the ``phones`` and ``bins`` arrays.
    The revision also covers the version of this calculation, the fingerprint of the dataset and the
    revision of manual overrides. Distinct counts are exact without copying rows for each of them: one
    aggregate by (speaker, source) carries the sums and marks which sources count for what, one by
    (speaker, phone, bin or recording) does the same for the other items. Both combine before their
    shuffle and leave a row for each different item, so a large speaker is not one task.
    """
    own = segments.where(~blank(F.col("speaker_id")))
    speech, singing = F.col("talk_role") == "primary", F.col("singing_role") == "primary"
    speech_ok = speech & (F.col("talk_eligibility") == "eligible")
    singing_ok = singing & (F.col("singing_eligibility") == "eligible")
    roles = ("primary", "feature_only")
    identity = (F.col("talk_role").isin(*roles) | F.col("singing_role").isin(*roles)) & (F.col("talk_eligibility") != "excluded")
    d = F.col("duration_sec")
    seconds = F.when(finite(d) & (d > 0), d).otherwise(0.0)
    uses = {"speech": speech_ok, "singing": singing_ok, "identity": identity}
    lengths = {"speech_raw_seconds": speech, "speech_eligible_seconds": speech_ok, "singing_raw_seconds": singing, "singing_eligible_seconds": singing_ok, "identity_seconds": identity}
    measured = {
        "status_duration": (F.lit(True), d.isNotNull()), "status_transcription": (speech_ok, asr_measured()),
        "status_singing_f0": (singing_ok, F.col("has_f0")), "status_speaker_identity": (identity, F.col("has_embedding")),
    }
    counts = {f"_of_{n}": c for n, (c, _) in measured.items()} | {f"_good_{n}": c & m for n, (c, m) in measured.items()} | {f"_{n}": c for n, c in uses.items()}
    counts["transcript_usable"] = speech_ok & ~F.col("transcript_blank")

    by_source = own.groupBy("speaker_id", "source_id").agg(
        *[F.sum(F.when(c, seconds).otherwise(0.0)).alias(n) for n, c in lengths.items()], *[F.count_if(c).alias(n) for n, c in counts.items()])

    def sources(use: str) -> Column:
        return F.count_if((F.col(f"_{use}") > 0) & F.col("source_id").isNotNull())

    base = by_source.groupBy("speaker_id").agg(
        sources("speech").alias("speech_recordings"), sources("singing").alias("singing_recordings"), sources("identity").alias("identity_sources"),
        *[F.sum(n).alias(n) for n in (*lengths, *counts)])

    def listed(kind: str, values: Column) -> Column:
        made = F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("value")))
        return F.coalesce(made, F.array().cast("array<struct<kind:string,value:string>>"))

    items = F.concat(
        listed("phone", F.when(speech_ok, F.array_distinct("phones"))), listed("bin", F.when(singing_ok, F.array_distinct("bins"))),
        listed("cache", F.when(speech_ok | singing_ok, F.array("cache_key"))),
    )
    marked = own.select("speaker_id", F.coalesce(speech_ok, F.lit(False)).alias("_sp"), F.coalesce(singing_ok, F.lit(False)).alias("_si"), F.explode(items).alias("i"))
    once = marked.groupBy("speaker_id", "i.kind", "i.value").agg(F.bool_or("_sp").alias("_sp"), F.bool_or("_si").alias("_si"))
    kind, real = F.col("kind"), F.col("value").isNotNull()
    found = once.groupBy("speaker_id").agg(
        F.count_if((kind == "cache") & real & F.col("_sp")).alias("speech_utterances"), F.count_if((kind == "cache") & real & F.col("_si")).alias("singing_phrases"),
        F.count_if(kind == "phone").alias("phoneme_coverage"), F.count_if(kind == "bin").alias("pitch_bins"))
    tags = F.array_compact(F.array(
        F.when(F.col("_speech") > 0, F.lit("has_speech_teacher")).otherwise("speech_teacher_absent"),
        F.when(F.col("_singing") > 0, F.lit("has_singing_teacher")).otherwise("singing_teacher_absent"),
        F.when(F.col("_identity") > 0, F.lit("has_identity_reference")),
    ))
    joined = base.join(found, "speaker_id", "left").na.fill(0, ["speech_utterances", "singing_phrases", "phoneme_coverage", "pitch_bins"]).withColumns(
        {n: _status(F.col(f"_of_{n}"), F.col(f"_good_{n}")) for n in measured})

    def ms(name: str) -> Column:
        return F.round(F.col(name) * 1000).cast("long")

    columns = (
        "speaker_id", ms("speech_raw_seconds"), ms("speech_eligible_seconds"), "speech_recordings", "speech_utterances", "transcript_usable", "phoneme_coverage",
        ms("singing_raw_seconds"), ms("singing_eligible_seconds"), "singing_recordings", "singing_phrases", "pitch_bins", ms("identity_seconds"), "identity_sources",
        "status_duration", "status_transcription", "status_singing_f0", "status_speaker_identity",
    )
    context = (F.lit(CALCULATION_VERSION), F.lit(dataset_fingerprint), F.lit(override_revision))
    revision = row_digest(*context, *[F.col(c) if isinstance(c, str) else c for c in columns])
    return joined.withColumn("derived_tags", tags).withColumn("inventory_revision", revision).drop(*[n for n in counts if n.startswith("_")])


def timbre_references(segments: DataFrame) -> DataFrame:
    """Cross-domain voice references: singing for a talk model, speech for a singing model.

    One row per (target, segment): ``kind`` is reference or skipped with a reason.
    """
    own = segments.where(~blank(F.col("speaker_id")))

    def side(target: str, source_role: str, teacher_role: str) -> DataFrame:
        reference = F.col(source_role) == "primary"
        out = F.col(f"{target}_eligibility") == "excluded"
        return own.where(reference | (F.col(teacher_role) != "primary")).select(
            "speaker_id", F.lit(target).alias("target"), "segment_id", "source_id", "cache_key",
            F.when(reference & ~out, "reference").otherwise("skipped").alias("kind"),
            F.when(reference & out, F.get(f"{target}_codes", F.lit(0))).when(~reference, F.coalesce("talk_reason", "talk_role")).alias("reason"),
        )

    return side("talk", "singing_role", "talk_role").unionByName(side("singing", "talk_role", "singing_role"))


def reference_fingerprint(references: DataFrame) -> DataFrame:
    """Input hash of the chosen references per (speaker, target)."""
    return set_fingerprint(
        references.where("kind = 'reference'"), ["speaker_id", "target"], row_digest(F.col("segment_id"), F.col("source_id"), F.col("cache_key")), "input_hash"
    )


def consumption_problems(chosen: DataFrame, consumed: DataFrame, keys: list[str]) -> DataFrame:
    """Segments chosen but not consumed, or consumed without being chosen."""
    both = chosen.select(*keys, "segment_id").distinct().withColumn("_c", F.lit(1)).join(
        consumed.select(*keys, "segment_id").distinct().withColumn("_u", F.lit(1)), [*keys, "segment_id"], "full_outer"
    )
    return both.where("_c IS NULL OR _u IS NULL").select(*keys, "segment_id", F.when(F.col("_u").isNull(), "not_consumed").otherwise("not_chosen").alias("problem"))


def reference_style(vectors: DataFrame, styles: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(new style rows, skipped vectors): mean of the valid vectors as the next style of each model.

    ``vectors``: model_id, vector_id, style_name, embedding. ``styles``: model_id, style_name,
    style_index. A name the model already has is refused; so is an index list with holes.
    """
    e = F.col("embedding")
    problem = F.when(F.size(e) != dimension, "wrong_dimension").when(~all_finite(e), "not_finite")
    judged = vectors.withColumn("problem", problem)
    valid = judged.where("problem IS NULL")
    key = ["model_id", "style_name"]
    existing = styles.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("style_index").alias("_max"), F.count_distinct("style_index").alias("_d")
    )
    taken = styles.select("model_id", "style_name").withColumn("_taken", F.lit(True))
    counts = valid.groupBy(*key).agg(F.count(F.lit(1)).alias("reference_count"))
    made = (
        counts.join(group_vector_sum(valid, key, "embedding"), key).join(existing, "model_id", "left").join(taken, key, "left")
        .withColumn("problem", F.when(F.col("_taken"), "name_taken").when(
            F.col("_n").isNotNull() & ((F.col("_max") + 1 != F.col("_n")) | (F.col("_d") != F.col("_n"))), "index_list_broken"))
        .select(*key, "reference_count", F.when(F.col("problem").isNull(), F.coalesce(F.col("_n"), F.lit(0))).alias("style_index"),
                F.transform("vector_sum", lambda x: x / F.col("reference_count")).alias("vector"), "problem")
    )
    return made, judged.where("problem IS NOT NULL").select(*key, "vector_id", "problem")


def material_lines(inventory: DataFrame) -> DataFrame:
    """A readable line per kind of material; unmeasured parts are named, never shown as zero."""
    def clock(c: str) -> Column:
        whole = F.bround(F.col(c)).cast("long")
        short = F.concat(whole.cast("string"), F.lit("s"))
        long = F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s"))
        return F.when(whole < 60, short).otherwise(long)

    def amount(eligible: str, raw: str | None) -> Column:
        main = F.when(F.col(eligible) <= 0, F.lit("none")).otherwise(clock(eligible))
        return main if raw is None else F.when(F.col(raw) > 0, F.concat(main, F.lit(" (assigned "), clock(raw), F.lit(")"))).otherwise(main)

    def note(status: str, label: str) -> Column:
        s = F.col(status)
        return F.when(s == "measured", "").when(s == "partially_measured", f" / {label} partly unmeasured").otherwise(f" / {label} unmeasured")

    lines = F.array_compact(F.array(
        F.concat(F.lit("speech: "), amount("speech_eligible_seconds", "speech_raw_seconds"), F.lit(" / utterances "), F.col("speech_utterances").cast("string"),
                 F.lit(" / transcripts "), F.col("transcript_usable").cast("string"), note("status_transcription", "transcription")),
        F.concat(F.lit("singing: "), amount("singing_eligible_seconds", "singing_raw_seconds"), F.lit(" / phrases "), F.col("singing_phrases").cast("string"),
                 F.lit(" / pitch bins "), F.col("pitch_bins").cast("string"), note("status_singing_f0", "pitch")),
        F.concat(F.lit("identity: "), amount("identity_seconds", None), F.lit(" / recordings "), F.col("identity_sources").cast("string"), note("status_speaker_identity", "speaker feature")),
        F.when(F.col("status_duration") != "measured", F.concat(F.lit("note:"), note("status_duration", "duration"))),
    ))
    return inventory.select("speaker_id", F.posexplode(lines).alias("line_no", "line"))
