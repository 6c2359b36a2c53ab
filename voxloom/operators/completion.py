"""Corrections, pitch gap filling, phone supplements and speaker feature estimates."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions.fingerprints import plain_columns, row_digest, set_fingerprint
from voxloom.functions.measure import alignment_measured, asr_measured, blank, finite, in_unit, reasons
from voxloom.functions.vectors import all_finite, group_vector_sum, norm
from voxloom.functions.vocabulary import CORE_PHONES, FOREIGN_PHONES, PALATALIZED_PHONES, VOWELS
from voxloom.operators.sequences import carry, with_neighbours
from voxloom.operators.signal import summarize
from voxloom.session import durable

REJECT, WEAK, RELIABLE, LOW_COUNT, MAX_FRAMES = 0.35, 0.65, 0.65, 3, 200_000
PITCH_METHOD = "short-vowel-gap-1"


@dataclass(frozen=True)
class GapSettings:
    """Limits of pitch gap filling; each must lie in its allowed range."""

    max_gap_sec: float = 0.06
    min_anchor_confidence: float = 0.80
    max_boundary_semitones: float = 2.0
    min_periodicity: float = 0.90
    min_rms: float = 0.008
    min_phoneme_confidence: float = 0.65

    def __post_init__(self) -> None:
        allowed = {
            "max_gap_sec": (0.005, 0.12), "min_anchor_confidence": (0.60, 1.0), "max_boundary_semitones": (0.0, 4.0),
            "min_periodicity": (0.80, 1.0), "min_rms": (0.001, 0.10), "min_phoneme_confidence": (0.50, 1.0),
        }
        for name, (low, high) in allowed.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in [{low}, {high}]")


def _measured() -> Column:
    return F.array_compact(F.array(F.when(asr_measured(), F.col("asr_confidence")), F.when(alignment_measured(), F.col("alignment_confidence"))))


def _lowest() -> Column:
    return F.coalesce(F.array_min(_measured()), F.lit(1.0))


def triage(segments: DataFrame) -> DataFrame:
    """Observed, weak or rejected by measured confidences only; unmeasured segments are kept."""
    measured, low = _measured(), _lowest()
    rejected = low < REJECT
    return segments.select(
        "segment_id", "speaker_id", F.when(rejected, "rejected").when(low < WEAK, "weak_observed").otherwise("observed").alias("state"),
        F.when(rejected, "confidence-outlier-rejection").otherwise("observed").alias("method"),
        F.when(rejected, "applied").otherwise("not_required").alias("application_status"),
        F.when(F.size(measured) > 0, low).otherwise(0.0).alias("confidence"), (F.size(measured) == 0).alias("unmeasured"),
    )


def _not_rejected(segments: DataFrame) -> DataFrame:
    return segments.where(~(_lowest() < REJECT))


def missing_core_phones(segments: DataFrame) -> DataFrame:
    """Core phones a speaker never produced, as deferred corrections."""
    kept = _not_rejected(segments).where("speaker_id IS NOT NULL")
    seen = kept.select("speaker_id", F.explode(F.array_distinct(F.transform("phonemes", lambda p: p["phoneme"]))).alias("phoneme")).distinct()
    wanted = kept.select("speaker_id").distinct().withColumn("phoneme", F.explode(F.array(*[F.lit(p) for p in CORE_PHONES])))
    return wanted.join(seen, ["speaker_id", "phoneme"], "left_anti").select(
        "speaker_id", "phoneme", F.lit("estimated").alias("state"), F.lit("missing-phoneme-generation").alias("method"), F.lit("deferred").alias("application_status"))


def label_reviews(segments: DataFrame) -> DataFrame:
    """Phones of low confidence, once per segment; their labels stay as observed."""
    weak = F.array_distinct(F.transform(F.filter("phonemes", lambda p: p["confidence"] < REJECT), lambda p: p["phoneme"]))
    return _not_rejected(segments).select("segment_id", "speaker_id", F.explode(weak).alias("phoneme"))


def corrected_view(segments: DataFrame, corrected: DataFrame, filled: DataFrame, generated: DataFrame, enabled: bool = True) -> DataFrame:
    """The view training uses: rejected segments gone, reviewed transcripts and refilled pitch applied,
    accepted supplements appended. Switched off, it is the observed data alone.

    ``corrected``: segment_id, transcript, asr_confidence, alignment_confidence, alignment_method.
    ``filled``: segment_id, mean_f0_hz, f0_std_dev_hz, voiced_ratio (:func:`resummarize`). ``generated``: rows
    of the view (:func:`generated_segments`); measurements that generated speech does not have stay NULL.
    """
    columns = ["segment_id", "source_id", "speaker_id", "content_type", "transcript", "asr_confidence", "alignment_confidence", "alignment_method", "mean_f0_hz", "f0_std_dev_hz", "voiced_ratio"]
    if not enabled:
        return segments.select(*columns)
    for c in columns:
        if c not in generated.columns:
            generated = generated.withColumn(c, F.lit(None).cast(segments.schema[c].dataType))
    new_text = corrected.select("segment_id", F.struct("transcript", "asr_confidence", "alignment_confidence", "alignment_method").alias("_t"))
    new_pitch = filled.select("segment_id", F.struct("mean_f0_hz", "f0_std_dev_hz", "voiced_ratio").alias("_p"))
    kept = _not_rejected(segments).join(new_text, "segment_id", "left").join(new_pitch, "segment_id", "left")
    for c in ("transcript", "asr_confidence", "alignment_confidence", "alignment_method"):
        kept = kept.withColumn(c, F.coalesce(F.col(f"_t.{c}"), F.col(c)))
    for c in ("mean_f0_hz", "f0_std_dev_hz", "voiced_ratio"):
        kept = kept.withColumn(c, F.coalesce(F.col(f"_p.{c}"), F.col(c)))
    return kept.select(*columns).unionByName(generated.join(segments.select("segment_id"), "segment_id", "left_anti").select(*columns))


def observed_records(segments: DataFrame) -> DataFrame:
    """One record for each segment when correction is switched off: what was observed is used as it is.

    Manual edits and exclusions hold all the same; no segment is judged, so none is left out.
    """
    return segments.select(
        "segment_id", "speaker_id", F.lit("observed").alias("state"), F.lit("observed-only").alias("method"), F.lit("not_required").alias("application_status"),
        F.lit(1.0).alias("confidence"), F.lit("correction_off").alias("reason"))


def frame_problems(series: DataFrame) -> DataFrame:
    """One row per broken rule of stored frame series.

    ``series``: segment_id, idx, f0_time, f0, f0_conf, energy_time, energy, voicing_time, voicing;
    a missing frame of one series is NULL.
    """
    counts = series.groupBy("segment_id").agg(
        F.count("f0").alias("_f"), F.count("energy").alias("_e"), F.count("voicing").alias("_v"),
        (F.max(F.when(F.col("idx") == 1, F.col("f0_time"))) - F.max(F.when(F.col("idx") == 0, F.col("f0_time")))).alias("_step"))
    step = F.coalesce("_step", F.lit(0.01))
    whole = counts.select("segment_id", F.lit(None).cast("bigint").alias("idx"), F.explode(reasons(
        ((F.col("_f") != F.col("_e")) | (F.col("_f") != F.col("_v")), "lengths_differ"), (F.col("_f") > MAX_FRAMES, "too_many_frames"), (~finite(step) | (step <= 0) | (step > 0.02), "bad_step"))).alias("problem"))
    ordered = with_neighbours(series, ["segment_id"], "idx", {"_before": (F.col("f0_time"), -1)}).join(counts.select("segment_id", step.alias("_s")), "segment_id")
    values = [F.col(c) for c in ("f0_time", "f0", "energy_time", "energy", "voicing_time", "voicing")]
    bad_value = F.lit(False)
    for x in values:
        bad_value = bad_value | (x.isNotNull() & (~finite(x) | (x < 0)))
    conf = F.col("f0_conf")
    rows = ordered.select("segment_id", "idx", F.explode(reasons(
        (bad_value | (conf.isNotNull() & ~in_unit(conf)), "bad_value"), ((F.col("energy") > 1) | (F.col("voicing") > 1), "above_one"),
        ((F.abs(F.col("f0_time") - F.col("energy_time")) > 1e-8) | (F.abs(F.col("f0_time") - F.col("voicing_time")) > 1e-8), "times_disagree"),
        (F.abs(F.col("f0_time") - F.col("_before") - F.col("_s")) > 1e-8, "uneven_step"))).alias("problem"))
    return whole.unionByName(rows)


def _gaps(frames: DataFrame) -> DataFrame:
    """Missing or unsure pitch runs with the two frames on each side and the quietest frame inside."""
    needs = (F.col("f0") == 0) | F.coalesce(F.col("f0_conf") < 0.45, F.lit(False))
    side = F.struct("time_sec", "f0", "f0_conf", "energy", "voicing")
    seen = with_neighbours(
        frames.withColumn("_need", needs), ["segment_id"], "idx",
        {"_l1": (side, -1), "_l2": (side, -2), "_r1": (side, 1), "_r2": (side, 2), "_before": (F.col("_need"), -1)},
    )
    opened = F.col("_need") & ~F.coalesce("_before", F.lit(False))
    return carry(seen.withColumn("_open", F.when(opened, F.col("idx"))), ["segment_id"], "idx", F.col("_open"), "start_frame", inclusive=True).where("_need").drop("_open", "_before", "_need")


def _semitones(a: Column, b: Column) -> Column:
    return F.abs(F.log2(a / b) * 12.0)


def gap_decisions(frames: DataFrame, phones: DataFrame, settings: GapSettings = GapSettings()) -> tuple[DataFrame, DataFrame]:
    """(one decision per gap, the frames inside gaps with their estimate).

    ``frames`` brings the evidence columns periodicity and rms of each frame. A gap is filled only
    if every condition holds for all of its frames; every other gap keeps a reason. Gap frames and
    judged gaps are a small part of all frames and are read several times, so each is written once.
    """
    inside = durable(_gaps(frames))
    steps = frames.groupBy("segment_id").agg((F.max(F.when(F.col("idx") == 1, F.col("time_sec"))) - F.max(F.when(F.col("idx") == 0, F.col("time_sec")))).alias("_step"))
    gaps = inside.groupBy("segment_id", "start_frame").agg(
        (F.max("idx") + 1).alias("end_frame"), F.min_by("_l1", "idx").alias("l1"), F.min_by("_l2", "idx").alias("l2"), F.max_by("_r1", "idx").alias("r1"), F.max_by("_r2", "idx").alias("r2"),
        F.min("energy").alias("_quiet"), F.bool_and(F.col("f0") == 0).alias("all_zero"),
    ).join(steps, "segment_id").withColumn("_step", F.coalesce("_step", F.lit(0.01)))

    def anchor(n: str) -> Column:
        a = F.col(n)
        return a["f0"].between(60, 1200) & (a["f0_conf"] >= settings.min_anchor_confidence) & (a["voicing"] >= 0.5) & (a["energy"] >= settings.min_rms)

    l1, l2, r1, r2 = (F.col(n) for n in ("l1", "l2", "r1", "r2"))
    quiet_limit = F.greatest(F.lit(settings.min_rms), F.least(l1["energy"], r1["energy"]) * 0.25)
    early = (
        F.when(l2.isNull() | r2.isNull(), "not_enough_anchors").when((F.col("end_frame") - F.col("start_frame")) * F.col("_step") > settings.max_gap_sec + 1e-9, "gap_too_long")
        .when(~(anchor("l1") & anchor("l2") & anchor("r1") & anchor("r2")), "weak_anchor")
        .when((_semitones(l1["f0"], r1["f0"]) > settings.max_boundary_semitones) | (_semitones(l2["f0"], l1["f0"]) > 1.0) | (_semitones(r1["f0"], r2["f0"]) > 1.0), "pitch_jump")
        .when(F.col("_quiet") < quiet_limit, "energy_drop")
    )
    right = r2["time_sec"] + F.greatest(F.lit(0.04), F.lit(3.0) / F.least(l1["f0"], r1["f0"]))
    judged = durable(gaps.withColumn("_early", early).withColumn("_left", l2["time_sec"]).withColumn("_right", right))
    # Interval join by whole seconds: a pair is counted only in the first second both touch.
    spans = judged.where("_early IS NULL").select("segment_id", "start_frame", "_left", "_right", F.floor("_left").alias("_g0"), F.explode(F.sequence(F.floor("_left"), F.floor("_right"))).alias("_sec"))
    timed = phones.where(finite(F.col("start_sec")) & finite(F.col("end_sec")) & (F.col("end_sec") >= F.col("start_sec"))).withColumn("_p0", F.floor("start_sec")).withColumn(
        "_sec", F.explode(F.sequence(F.floor("start_sec"), F.floor("end_sec"))))
    met = spans.join(timed, ["segment_id", "_sec"]).where((F.col("_sec") == F.greatest("_g0", "_p0")) & (F.col("start_sec") < F.col("_right")) & (F.col("end_sec") > F.col("_left")))
    covers = F.col("phoneme").isin(*VOWELS) & finite(F.col("confidence")) & F.col("confidence").between(settings.min_phoneme_confidence, 1) & (F.col("start_sec") >= 0) & (
        F.col("start_sec") <= F.col("_left")) & (F.col("end_sec") >= F.col("_right"))
    vowels = met.groupBy("segment_id", "start_frame").agg(F.count(F.lit(1)).alias("_overlaps"), F.count_if(covers).alias("_covers"), F.max(F.when(covers, F.col("phoneme"))).alias("_vowel"))
    placed = judged.join(vowels, ["segment_id", "start_frame"], "left").withColumn("_one", F.coalesce((F.col("_covers") == 1) & (F.col("_overlaps") == 1), F.lit(False)))
    # Estimates of the frames inside the gaps that got this far.
    open_gaps = placed.where("_early IS NULL AND _one").select("segment_id", "start_frame", F.col("l1.time_sec").alias("_t0"), F.col("r1.time_sec").alias("_t1"), F.col("l1.f0").alias("_f0"), F.col("r1.f0").alias("_f1"), F.least("l1.f0_conf", "r1.f0_conf").alias("_c"))
    fraction = (F.col("time_sec") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    estimates = inside.select("segment_id", "start_frame", "idx", "time_sec", "f0", "periodicity", "rms").join(open_gaps, ["segment_id", "start_frame"]).withColumn(
        "estimate", F.exp(F.log("_f0") * (F.lit(1.0) - fraction) + F.log("_f1") * fraction)).withColumn(
        "_sound", finite(F.col("periodicity")) & finite(F.col("rms")) & (F.col("periodicity") >= settings.min_periodicity) & (F.col("rms") >= settings.min_rms))
    proven = estimates.groupBy("segment_id", "start_frame").agg(F.bool_and("_sound").alias("_sound"), F.least(F.lit(0.65), F.min(F.col("_c") * F.col("periodicity") * 0.75)).alias("_confidence"))
    reason = F.coalesce(F.col("_early"), F.when(~F.col("_one"), "not_one_vowel"), F.when(~F.coalesce("_sound", F.lit(False)), "no_periodicity"))
    decisions = placed.join(proven, ["segment_id", "start_frame"], "left").withColumn("reason", reason).select(
        "segment_id", "start_frame", "end_frame", F.col("reason").isNull().alias("applied"), "reason", F.when(F.col("_early").isNull() & F.col("_one"), F.col("_vowel")).alias("phoneme"),
        F.when(F.col("reason").isNull(), F.col("_confidence")).otherwise(0.0).alias("confidence"),
        F.when(F.col("reason").isNotNull(), "weak_observed").when(F.col("all_zero"), "estimated").otherwise("corrected").alias("state"),
        F.when(F.col("reason").isNull(), "applied").otherwise("deferred").alias("application_status"), F.lit(PITCH_METHOD).alias("method"),
    )
    return decisions, estimates.select("segment_id", "start_frame", "idx", F.col("f0").alias("original_f0"), "estimate")


def input_fingerprints(frames: DataFrame, phones: DataFrame, settings: GapSettings = GapSettings()) -> DataFrame:
    """(segment_id, input_fingerprint): all that gap filling reads of a segment, and the settings it used.

    Sums of row digests, so a long clip is neither sorted nor collected; any frame or phone that changes,
    comes or goes changes it.
    """
    seen = ("idx", "time_sec", "f0", "f0_conf", "energy", "voicing", "periodicity", "rms")
    heard = ("phoneme", "start_sec", "end_sec", "confidence")
    of_frames = set_fingerprint(frames, ["segment_id"], row_digest(*plain_columns(frames, *seen)), "_frames")
    of_phones = set_fingerprint(phones, ["segment_id"], row_digest(*plain_columns(phones, *heard)), "_phones")
    values = [F.rint(F.lit(float(x)) * 1e9).cast("long") for _, x in sorted(asdict(settings).items())]
    both = of_frames.select("segment_id", "_frames").join(of_phones.select("segment_id", "_phones"), "segment_id", "left")
    return both.select("segment_id", row_digest(F.lit(PITCH_METHOD), *values, F.col("segment_id"), F.col("_frames"), F.col("_phones")).alias("input_fingerprint"))


def correction_records(frames: DataFrame, phones: DataFrame, decisions: DataFrame, estimates: DataFrame, settings: GapSettings = GapSettings()) -> DataFrame:
    """One record for each segment's input and one for each gap, with the values before and after.

    A record of a gap holds its original pitches in order, and the new ones if it was filled (else none).
    A gap lies in one segment, and a series longer than ``MAX_FRAMES`` is refused by ``frame_problems``, so a
    record is bounded. Results of a filled gap are found under its segment's input fingerprint.
    """
    prints = durable(input_fingerprints(frames, phones, settings))
    inside = _gaps(frames).select("segment_id", "start_frame", "idx", "f0")
    guessed = inside.join(estimates.select("segment_id", "idx", "estimate"), ["segment_id", "idx"], "left")
    held = guessed.groupBy("segment_id", "start_frame").agg(F.sort_array(F.collect_list(F.struct("idx", "f0", "estimate"))).alias("_v"))
    place = F.concat(F.lit(f"features/completion/{PITCH_METHOD}/"), F.col("input_fingerprint"), F.lit("/f0.json"))
    gaps = decisions.join(held, ["segment_id", "start_frame"]).join(prints, "segment_id").select(
        "segment_id", "state", "method", "application_status", "confidence", "reason", "phoneme", "start_frame", "end_frame",
        F.transform("_v", lambda x: x["f0"]).alias("original_values"),
        F.when(F.col("applied"), F.transform("_v", lambda x: x["estimate"])).otherwise(F.array().cast("array<double>")).alias("result_values"),
        F.when(F.col("applied"), place).alias("result_path"), "input_fingerprint",
    )
    none = {f.name: F.lit(None).cast(f.dataType) for f in gaps.schema}
    fixed = {"state": F.lit("observed"), "method": F.lit("pitch-input-snapshot"), "application_status": F.lit("not_required")}
    inputs = prints.select(*[F.col(c) if c in prints.columns else fixed.get(c, none[c]).alias(c) for c in gaps.columns])
    return inputs.unionByName(gaps)


def filled_frames(frames: DataFrame, decisions: DataFrame, estimates: DataFrame) -> DataFrame:
    """Frames with accepted estimates in place; all others untouched."""
    new = estimates.join(decisions.where("applied").select("segment_id", "start_frame", F.col("confidence").alias("_c")), ["segment_id", "start_frame"]).select("segment_id", "idx", "estimate", "_c")
    joined = frames.join(new, ["segment_id", "idx"], "left")
    hit = F.col("estimate").isNotNull()
    return joined.withColumn("f0", F.coalesce("estimate", "f0")).withColumn("f0_conf", F.coalesce("_c", "f0_conf")).withColumn("voicing", F.when(hit, 1.0).otherwise(F.col("voicing"))).withColumn("filled", hit).drop("estimate", "_c")


def resummarize(filled: DataFrame) -> DataFrame:
    """New pitch summaries of the segments in which a gap was filled; all others keep theirs.

    Reliability stays the original estimator's and is not part of it. A filled gap has four voiced
    frames around it, so there always is a range.
    """
    touched = filled.where("filled").select("segment_id").distinct()
    return summarize(filled.join(touched, "segment_id", "left_semi")).select("segment_id", "mean_f0_hz", "f0_std_dev_hz", "voiced_ratio", "pitch_range_semitones")


def _reference_segments(segments: DataFrame, with_phones=None) -> DataFrame:
    """Reliable speech of known speakers; ``with_phones`` adds its phones where ``segments`` has none yet."""
    kept = segments.where((F.col("content_type") == "speech") & (F.col("asr_confidence") >= RELIABLE) & (F.col("alignment_confidence") >= RELIABLE) & F.col("speaker_id").isNotNull())
    return kept if with_phones is None else with_phones(kept)


def reliable_counts(segments: DataFrame, with_phones=None) -> DataFrame:
    """Occurrences per speaker and phone in reliable recorded speech; generated speech never counts."""
    real = _reference_segments(segments.where(~F.col("source_id").startswith("generated:")), with_phones)
    good = F.filter("phonemes", lambda p: (p["confidence"] >= RELIABLE) & ~blank(p["phoneme"]))
    return real.select("speaker_id", F.explode(F.transform(good, lambda p: p["phoneme"])).alias("phoneme")).groupBy("speaker_id", "phoneme").agg(F.count(F.lit(1)).alias("n"))


def observation_prints(segments: DataFrame, with_phones=None) -> DataFrame:
    """(speaker_id, observation_fingerprint): the reliable recorded phones that the counts rest on.

    A sum of row digests over exploded phones, so no speaker is collected; a phone that moves, changes its
    confidence, comes or goes changes it.
    """
    real = _reference_segments(segments.where(~F.col("source_id").startswith("generated:")), with_phones)
    good = F.filter("phonemes", lambda p: (p["confidence"] >= RELIABLE) & ~blank(p["phoneme"]))
    rows = real.select("speaker_id", "segment_id", F.posexplode(good).alias("pos", "p")).select("speaker_id", "segment_id", "pos", "p.phoneme", "p.start_sec", "p.end_sec", "p.confidence")
    digest = row_digest(*plain_columns(rows, "segment_id", "pos", "phoneme", "start_sec", "end_sec", "confidence"))
    return set_fingerprint(rows, ["speaker_id"], digest, "observation_fingerprint").select("speaker_id", "observation_fingerprint")


def candidate_problems(candidates: DataFrame, counts: DataFrame, prints: DataFrame) -> DataFrame:
    """Broken rules per generated candidate, with its phone lists and its observation recomputed from real
    recordings.

    ``candidates``: candidate_id, speaker_id, metrics, expected, recognized, missing, weak,
    observation_fingerprint (as it was when the candidate was made), audio_sha256. ``counts`` from
    :func:`reliable_counts`, ``prints`` from :func:`observation_prints`. Only the phones a candidate asks for
    are looked up, by speaker and phone; speakers without reliable speech have no print on either side.
    """
    asked = candidates.select("candidate_id", "speaker_id", F.explode(F.array_distinct("expected")).alias("phoneme")).join(counts, ["speaker_id", "phoneme"], "left")
    lists = asked.groupBy("candidate_id", "speaker_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("phoneme")))).alias("_missing"), F.array_sort(F.collect_list(F.when(F.col("n") < LOW_COUNT, F.col("phoneme")))).alias("_weak"))
    now = prints.select("speaker_id", F.col("observation_fingerprint").alias("_now"))
    joined = candidates.join(lists, ["candidate_id", "speaker_id"], "left").join(now, "speaker_id", "left")
    none = F.array().cast("array<string>")
    real_missing, real_weak = F.coalesce("_missing", none), F.coalesce("_weak", none)

    def outside(name: str, low: float, high: float) -> Column:
        return ~(finite(F.col(name)) & F.col(name).between(low, high))

    codes = reasons(
        ((F.size("expected") == 0) | (F.col("expected") != F.col("recognized")), "phones_disagree"), ((F.size("missing") == 0) & (F.size("weak") == 0), "nothing_to_add"),
        (outside("asr_avg_logprob", -0.50, 0.0), "logprob"), (outside("speaker_similarity", 0.80, 1.0), "similarity"), (outside("no_speech_probability", 0.0, 0.20), "no_speech"),
        (outside("duration_sec", 2, 14), "duration"), (outside("rms", 0.008, 1), "loudness"), (outside("clipping_ratio", 0, 0.001), "clipping"), (outside("silence_ratio", 0, 0.60), "silence"),
        (~F.coalesce(F.col("audio_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash"),
        (F.array_sort("missing") != real_missing, "missing_list_differs"), (F.array_sort("weak") != real_weak, "weak_list_differs"), (~F.col("observation_fingerprint").eqNullSafe(F.col("_now")), "observation_changed"),
    )
    return joined.select("candidate_id", "speaker_id", codes.alias("problems"))


def accepted_candidates(log: DataFrame) -> DataFrame:
    """Current choice per speaker from the selection log (speaker_id, candidate_id, accepted, seq).

    A later acceptance replaces an earlier one; withdrawing only counts for the current choice.
    """
    chosen = log.where("accepted").groupBy("speaker_id").agg(F.max_by("candidate_id", "seq").alias("candidate_id"), F.max("seq").alias("_at"))
    withdrawn = log.where("NOT accepted").groupBy("speaker_id", "candidate_id").agg(F.max("seq").alias("_out"))
    return chosen.join(withdrawn, ["speaker_id", "candidate_id"], "left").where(F.coalesce(F.col("_out") < F.col("_at"), F.lit(True))).select("speaker_id", "candidate_id")


def generated_segments(candidates: DataFrame, accepted: DataFrame, problems: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments to append, problems). Times, confidences and pitch of generated speech are not invented."""
    good = problems.where(F.size("problems") == 0).select("candidate_id")
    picked = candidates.join(accepted, ["speaker_id", "candidate_id"], "left_semi")
    made = picked.join(good, "candidate_id", "left_semi").select(
        F.concat(F.lit("generated_"), "candidate_id").alias("segment_id"), F.concat(F.lit("generated:"), "candidate_id").alias("source_id"), "speaker_id", F.lit("speech").alias("content_type"),
        F.col("audio_sha256").alias("cache_key"), F.col("text").alias("transcript"), "candidate_id", "speaker_similarity", F.array_union("missing", "weak").alias("assisted"))
    clash = made.join(segments.select("segment_id"), "segment_id", "left_semi").select("candidate_id", F.lit("segment_id_taken").alias("problem"))
    refused = picked.join(good, "candidate_id", "left_anti").select("candidate_id", F.lit("not_verified").alias("problem"))
    return made.join(segments.select("segment_id"), "segment_id", "left_anti"), clash.unionByName(refused)


def _fold_vowel(p: Column) -> Column:
    return F.when(p.isin("I", "U"), F.lower(p)).otherwise(p)


def estimate_speaker_features(generated: DataFrame, segments: DataFrame) -> DataFrame:
    """Speaker vector of each generated segment from recordings that hold another reliable phone.

    ``generated``: segment_id, source_id, content_type, speaker_id, speaker_embedding,
    speaker_similarity, assisted (phones). There is at most one accepted candidate per speaker, so the join multiplies nothing. Refusals are deferred rows.
    """
    targets = F.array_distinct(F.transform(F.filter("assisted", lambda p: ~blank(p)), _fold_vowel))
    asked = generated.select("segment_id", "speaker_id", "speaker_similarity", "source_id", "content_type", "speaker_embedding", targets.alias("_targets"))
    sim = F.col("speaker_similarity")
    made = F.coalesce(F.col("source_id").startswith("generated:") & (F.col("content_type") == "speech"), F.lit(False))
    early = (
        F.when(~made, "not_generated_speech").when(blank(F.col("speaker_id")), "speaker_unknown").when(F.size("speaker_embedding") > 0, "vector_present").when(~finite(sim) | (sim < 0.80) | (sim > 1), "similarity").when(F.size("_targets") == 0, "no_target_phones"))
    asked = asked.withColumn("_early", early)
    reliable = F.array_distinct(F.transform(F.filter("phonemes", lambda p: (p["confidence"] >= RELIABLE) & ~blank(p["phoneme"])), lambda p: _fold_vowel(p["phoneme"])))
    real = _reference_segments(segments).where(~F.col("source_id").startswith("generated:") & (F.size("speaker_embedding") > 0)).select("speaker_id", "speaker_embedding", reliable.alias("_phones"))
    usable = asked.where("_early IS NULL").select("segment_id", "speaker_id", "_targets").join(real, "speaker_id").where(F.size(F.array_except("_phones", "_targets")) > 0)
    facts = usable.groupBy("segment_id").agg(F.count(F.lit(1)).alias("references"), F.count_distinct(F.size("speaker_embedding")).alias("_dims"), F.bool_and(all_finite(F.col("speaker_embedding"))).alias("_finite"))
    sums = group_vector_sum(usable, ["segment_id"], "speaker_embedding")
    joined = asked.join(facts, "segment_id", "left").join(sums, "segment_id", "left").withColumn("_norm", norm(F.col("vector_sum")))
    reason = F.coalesce(F.col("_early"), F.when(F.col("references").isNull(), "no_reference"), F.when((F.col("_dims") != 1) | ~F.col("_finite"), "bad_reference_vectors"),
                        F.when(~finite(F.col("_norm")) | (F.col("_norm") <= 1e-12), "zero_mean"))
    return joined.withColumn("reason", reason).select(
        "segment_id", "speaker_id", F.when(F.col("reason").isNull(), "applied").otherwise("deferred").alias("application_status"), "reason",
        F.when(F.col("reason").isNull(), sim).alias("confidence"), F.coalesce("references", F.lit(0).cast("long")).alias("references"),
        F.when(F.col("reason").isNull(), F.transform("vector_sum", lambda x: x / F.col("_norm"))).alias("vector"))


def supplement_needs(segments: DataFrame) -> DataFrame:
    """Per speaker: the phones of the catalog not yet heard reliably, the best reference clip with its
    hash (``cache_key``), and why there is no plan, if so."""
    good = segments.where((F.col("content_type") == "speech") & finite(F.col("asr_confidence")) & finite(F.col("alignment_confidence")) & (F.col("asr_confidence") >= 0.75) & (F.col("alignment_confidence") >= RELIABLE) & F.col("speaker_id").isNotNull())
    wanted = F.array(*[F.lit(p) for p in dict.fromkeys(CORE_PHONES + PALATALIZED_PHONES + FOREIGN_PHONES)])
    heard = F.array_distinct(F.transform(F.filter("phonemes", lambda p: finite(p["confidence"]) & (p["confidence"] >= RELIABLE)), lambda p: _fold_vowel(p["phoneme"])))
    observed = good.select("speaker_id", F.explode_outer(F.array_intersect(heard, wanted)).alias("p")).groupBy("speaker_id").agg(F.collect_set("p").alias("_seen"))
    length = F.array_max(F.transform("phonemes", lambda p: p["end_sec"]))
    fit = good.where(~blank(F.col("transcript")) & (F.length("transcript") <= 500) & (F.size("phonemes") > 0) & length.between(3, 15))
    best = fit.groupBy("speaker_id").agg(F.min(F.struct(-F.col("asr_confidence"), F.col("segment_id"), F.col("cache_key"))).alias("_best")).select(
        "speaker_id", F.col("_best.segment_id").alias("reference_segment_id"), F.col("_best.cache_key").alias("reference_sha256"))
    every = segments.where("speaker_id IS NOT NULL").select("speaker_id").distinct().join(observed, "speaker_id", "left").join(best, "speaker_id", "left").withColumn(
        "missing", F.array_sort(F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>")))))
    problem = F.when(F.col("_seen").isNull(), "no_usable_speech").when(F.size("missing") == 0, "nothing_missing").when(F.col("reference_segment_id").isNull(), "no_reference_clip")
    return every.withColumn("problem", problem)


def supplement_plans(segments: DataFrame, snapshot_print: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan per speaker: best reference clip with its hash, missing phones and the fingerprint of the
    snapshot planned on; speakers without a plan). A plan whose hash or fingerprint no longer holds is
    to be made again. ``snapshot_print`` has one row."""
    judged = supplement_needs(segments)
    plans = judged.where("problem IS NULL").join(F.broadcast(snapshot_print.limit(1).select(F.col("fingerprint").alias("snapshot_fingerprint"))), F.lit(True))
    return plans.select("speaker_id", "reference_segment_id", "reference_sha256", "missing", "snapshot_fingerprint"), judged.where("problem IS NOT NULL").select("speaker_id", "problem")


def choose_prompts(needs: DataFrame, prompts: list[tuple[str, list[str]]], maximum: int) -> DataFrame:
    """Greedy prompt choice per speaker (speaker_id, missing): most uncovered phones first, then prompt order.

    Prompts are a fixed list of sentences, so each speaker's choice is a fold inside its own row.
    """
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(p) for p in dict.fromkeys(q.lower() if q in ("I", "U") else q for q in phones)]).alias("phones")) for i, (_, phones) in enumerate(prompts)])
    start = F.struct(F.col("missing").alias("left"), F.array().cast("array<struct<prompt:int,targets:array<string>>>").alias("picks"))

    def pick(state: Column, _round: Column) -> Column:
        scored = F.transform("_prompts", lambda p: F.struct(F.size(F.array_intersect(p["phones"], state["left"])).alias("n"), (-p["i"]).alias("back"), F.array_sort(F.array_intersect(p["phones"], state["left"])).alias("targets")))
        best = F.array_max(scored)
        return F.when(F.coalesce(best["n"], F.lit(0)) == 0, state).otherwise(F.struct(
            F.array_except(state["left"], best["targets"]).alias("left"), F.concat(state["picks"], F.array(F.struct((-best["back"]).alias("prompt"), best["targets"].alias("targets")))).alias("picks")))

    done = needs.withColumn("_prompts", table).withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(maximum)), start, pick))
    return done.select("speaker_id", F.col("_s.picks").alias("picks"), F.array_sort("_s.left").alias("uncovered"))
