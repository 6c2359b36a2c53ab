"""Transcripts, phone timing, alignment checks and duration inputs. All work is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions import phone_arrays as arrays
from voxloom.functions.fingerprints import plain_columns, row_digest
from voxloom.functions.measure import alignment_measured, asr_measured, blank, clamp, finite, in_unit, let, reasons
from voxloom.functions.vocabulary import (
    ALIGNER_ALPHABET, CONSONANTS, FORCED_ALIGNMENT, PHONE_ALIASES, REVIEWED_ALIGNMENT, STANDALONE_PHONES, VOWELS, WORD_BOUNDARY_ALIGNMENT,
)
from voxloom.session import ship_package

MIN_REVIEW, MIN_GAIN, MAX_REVIEW_PHONES, EPS = 0.72, 0.12, 512, 1e-6


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _earlier(array: Column, first: Column) -> Column:
    """The array shifted by one, so that zip_with sees each element's predecessor."""
    return F.concat(F.array(first), F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0))))


def word_timing(rows: DataFrame) -> DataFrame:
    """Spread each recognised word's span evenly over its phones.

    ``rows``: phones, duration_sec, asr_confidence, words (start_sec, end_sec, confidence, phones).
    The words' phones must be exactly the segment's phones; otherwise no time is invented.
    """
    valid = F.filter("words", lambda w: (w["end_sec"] > w["start_sec"]) & (F.size(w["phones"]) > 0))
    agrees = F.flatten(F.transform("_valid", lambda w: w["phones"])) == F.col("phones")
    clipped = F.filter(
        F.transform("_valid", lambda w: F.struct(
            F.greatest(F.lit(0.0), w["start_sec"]).alias("s"), F.least(F.col("duration_sec"), w["end_sec"]).alias("e"),
            clamp(F.col("asr_confidence") * w["confidence"]).alias("c"), w["phones"].alias("phones"))),
        lambda w: w["e"] > w["s"],
    )

    def spread(w: Column) -> Column:
        n = F.size(w["phones"])
        step = (w["e"] - w["s"]) / n
        return F.transform(w["phones"], lambda p, i: F.struct(
            p.alias("phoneme"), (w["s"] + i * step).alias("start_sec"), F.when(i == n - 1, w["e"]).otherwise(w["s"] + (i + 1) * step).alias("end_sec"), w["c"].alias("confidence")))

    usable = (F.size("phones") > 0) & (F.col("duration_sec") > 0) & (F.size("_valid") > 0) & agrees
    timed = F.when(usable, F.flatten(F.transform(clipped, spread)))
    out = rows.withColumn("_valid", valid).withColumn("_t", timed).withColumn("_ok", F.coalesce(F.size("_t") > 0, F.lit(False)))
    mean = F.aggregate("_t", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("_t")
    return out.withColumn("timed", F.when(F.col("_ok"), F.col("_t"))).withColumn("alignment_confidence", F.when(F.col("_ok"), mean).otherwise(0.0)).withColumn(
        "alignment_method", F.when(F.col("_ok"), WORD_BOUNDARY_ALIGNMENT).otherwise("unavailable")).drop("_valid", "_t", "_ok")


def decode_confidence(mean_logprob: Column, has_text: Column) -> Column:
    """Sigmoid of the mean log-probability; without one, a neutral value for any text."""
    return F.when(mean_logprob.isNull(), F.when(has_text, 0.5).otherwise(0.0)).otherwise(clamp(F.lit(1.0) / (F.exp((mean_logprob + 1.0) * -2.0) + 1.0)))


def normalize_text(text: Column) -> Column:
    """Text without white space and sentence punctuation."""
    return F.regexp_replace(text, r"(?U)[\s、。,.!?！？「」『』（）()［］\[\]]+", "")


def review_transcripts(rows: DataFrame) -> DataFrame:
    """Consensus of two decodes.

    ``rows``: observed, observed_confidence, text_a, text_b, phones_a, phones_b, confidence_a,
    confidence_b. Adds confidence, changed, reasons and machine_passed.
    """
    confidence = F.least("confidence_a", "confidence_b")
    changed = normalize_text(F.col("text_a")) != normalize_text(F.col("observed"))
    codes = reasons(
        (blank(F.col("text_a")) | blank(F.col("text_b")) | (F.size("phones_a") == 0), "no_transcript"),
        (F.col("phones_a") != F.col("phones_b"), "phones_disagree"), (F.col("confidence") < MIN_REVIEW, "low_confidence"),
        (F.col("confidence") - F.col("observed_confidence") < MIN_GAIN, "small_gain"), (~F.col("changed"), "unchanged"),
    )
    return rows.withColumn("confidence", confidence).withColumn("changed", changed).withColumn("reasons", codes).withColumn("machine_passed", F.size("reasons") == 0)


def correction_targets(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Doubtful but usable transcripts nobody edited by hand."""
    touched = edits.where(F.lower("field") == "transcript").select("segment_id").distinct()
    a, m = F.col("asr_confidence"), F.col("alignment_confidence")
    return segments.where((a >= 0.35) & (a < 0.65) & (m >= 0.35) & ~F.col("source_id").startswith("generated:")).join(touched, "segment_id", "left_anti")


def apply_reviews(targets: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrected segments, correction rows). A review that fails its own contract is refused as invalid; a
    target without a review is deferred with what was observed.

    ``reviews``: segment_id, candidate_transcript, candidate_phones, confidence, duration_sec,
    changed, machine_passed, reasons. Of phones that are too many, and so invalid, only their number travels.
    """
    n = F.size("candidate_phones")
    few = F.when(n <= MAX_REVIEW_PHONES, F.col("candidate_phones")).alias("candidate_phones")
    rest = [c for c in reviews.columns if c not in ("segment_id", "candidate_phones")]
    joined = targets.join(reviews.select("segment_id", F.struct(*rest, few, n.alias("n")).alias("r")), "segment_id", "left")
    n = F.col("r.n")
    invalid = ~in_unit(F.col("r.confidence")) | ~finite(F.col("r.duration_sec")) | (F.col("r.duration_sec") <= 0) | (n > MAX_REVIEW_PHONES) | (
        F.col("r.machine_passed") & (~F.col("r.changed") | blank(F.col("r.candidate_transcript")) | (n == 0) | (F.col("r.confidence") < MIN_REVIEW)))
    state = F.when(F.col("r").isNull(), "deferred").when(invalid, "invalid").when(F.col("r.machine_passed"), "applied").otherwise("deferred")
    judged = joined.withColumn("_state", state)
    step = F.col("r.duration_sec") / n
    aligned = clamp(F.col("r.confidence") * 0.8)
    timed = F.transform("r.candidate_phones", lambda p, i: F.struct(
        p.alias("phoneme"), (i * step).alias("start_sec"), F.when(i == n - 1, F.col("r.duration_sec")).otherwise((i + 1) * step).alias("end_sec"), aligned.alias("confidence")))
    corrected = judged.where("_state = 'applied'").select(
        "segment_id", F.col("r.candidate_transcript").alias("transcript"), F.col("r.confidence").alias("asr_confidence"), aligned.alias("alignment_confidence"),
        F.lit(REVIEWED_ALIGNMENT).alias("alignment_method"), F.lit(False).alias("has_measurement"), timed.alias("phonemes"))
    log = judged.select(
        "segment_id", "speaker_id", F.when(F.col("_state") == "applied", "corrected").otherwise("weak_observed").alias("state"), F.col("_state").alias("application_status"),
        F.col("r.confidence").alias("confidence"), F.col("transcript").alias("original_value"), F.when(F.col("_state") == "applied", F.col("r.candidate_transcript")).alias("corrected_value"),
        F.array_join("r.reasons", ",").alias("reason"))
    return corrected, log


def encode_phones(phones: Column) -> Column:
    """Aligner spelling of every phone, or NULL for the whole list if one has none."""
    coded = F.transform(phones, lambda p: F.try_element_at(_map(ALIGNER_ALPHABET), p))
    return let(coded, lambda c: F.when((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull()), c))


def read_intervals(rows: DataFrame) -> DataFrame:
    """Zip a forced aligner's intervals with the expected phones.

    ``rows``: phones, duration_sec, entries (start, end, label). Adds timed and problem.
    """
    e = F.col("entries")
    ordered = F.zip_with(e, _earlier(F.transform(e, lambda x: x["end"]), F.lit(0.0)), lambda x, before: F.coalesce(
        finite(x["start"]) & finite(x["end"]) & (x["start"] >= before - EPS) & (x["end"] > x["start"]) & (x["end"] <= F.col("duration_sec")) & x["label"].isNotNull(), F.lit(False)))
    voiced = F.filter(e, lambda x: ~x["label"].isin("", "sil"))
    out = rows.withColumn("_codes", encode_phones(F.col("phones"))).withColumn("_voiced", voiced)
    problem = (
        F.when(F.col("_codes").isNull(), "phone_without_code").when(~finite(F.col("duration_sec")) | (F.col("duration_sec") <= 0), "bad_duration")
        .when(F.coalesce(F.size(e), F.lit(0)) == 0, "no_intervals").when(~F.forall(ordered, lambda ok: ok), "bad_interval")
        .when(F.transform("_voiced", lambda x: x["label"]) != F.col("_codes"), "labels_disagree")
    )
    timed = F.zip_with("phones", "_voiced", lambda p, x: F.struct(p.alias("phoneme"), x["start"].alias("start_sec"), x["end"].alias("end_sec"), F.lit(0.0).alias("confidence")))
    return out.withColumn("problem", problem).withColumn("timed", F.when(F.col("problem").isNull(), timed)).drop("_codes", "_voiced")


def convert_aliases(found: Column, expected: Column) -> Column:
    """The found phones in expected spelling, or NULL when they are not the expected ones."""
    spelled = F.transform(found, lambda p: F.coalesce(F.try_element_at(_map(PHONE_ALIASES), p), p))
    odd = F.exists(F.concat(found, expected), lambda p: blank(p) | p.rlike(r"(?U)\s"))
    return let(spelled, lambda s: F.when((F.size(s) > 0) & ~odd & (s == expected), s))


def unobserved_intervals(entries: Column, duration: Column) -> Column:
    """Parts of [0, duration] no interval covers."""
    ends = _earlier(F.transform(entries, lambda x: x["end"]), F.lit(0.0))
    gaps = F.zip_with(entries, ends, lambda x, before: F.when(x["start"] > before + EPS, F.struct(before.alias("start_sec"), x["start"].alias("end_sec"))))
    last = F.coalesce(F.get(entries, F.size(entries) - 1)["end"], F.lit(0.0))
    tail = F.when(duration > last + EPS, F.struct(last.alias("start_sec"), duration.alias("end_sec")))
    return F.filter(F.concat(gaps, F.array(tail)), lambda g: g.isNotNull())


def labelled_intervals(entries: Column, duration: Column) -> Column:
    """Struct of what an aligner's intervals say besides phones: ``silence`` (label ``sil``), ``unlabelled``
    (empty label) and ``unobserved`` (no interval at all), each a list of (start_sec, end_sec) in order.

    Silence is the aligner's class only; it is never turned into pauses or breaths.
    """
    def spans(label: str) -> Column:
        return F.transform(F.filter(entries, lambda e: e["label"] == label), lambda e: F.struct(e["start"].alias("start_sec"), e["end"].alias("end_sec")))

    return F.struct(spans("sil").alias("silence"), spans("").alias("unlabelled"), unobserved_intervals(entries, duration).alias("unobserved"))


def measured_flags(segments: DataFrame) -> DataFrame:
    return segments.select("segment_id", asr_measured().alias("asr_measured"), alignment_measured().alias("alignment_measured"))


_NUMBERS = ("start_sec", "end_sec", "confidence")
_PHONES = "array<struct<phoneme:string," + ",".join(f"{n}:double" for n in _NUMBERS) + ">>"
_ENTRIES = "array<struct<label:string,start:double,end:double>>"
SEGMENT_PRINTS = "struct<n:int,phones:binary,phones_whole:boolean,labels:binary,labels_whole:boolean>"
KNOWN_BY = "struct<phones_print:binary,entries_print:binary>"
RECORD_PRINTS = "struct<n:int,inside:boolean,voiced:int,phones:binary,phones_whole:boolean,labels:binary,labels_whole:boolean,phones_print:binary,entries_print:binary>"


def _shaped(items: Column | str, kind: str, names: tuple[str, ...]) -> Column:
    """The list with the named fields alone, as the kernels read it."""
    return F.transform(items, lambda x: F.struct(*[x[n].alias(n) for n in names])).cast(kind)


def segment_prints(segments: DataFrame) -> Column:
    """What ``phone_arrays.segment_prints`` makes of the phones; a column ``phone_prints`` has it already."""
    if "phone_prints" in segments.columns:
        return F.col("phone_prints")
    ship_package(segments.sparkSession)
    made = F.arrow_udf(lambda p: arrays.segment_prints(p, ALIGNER_ALPHABET), SEGMENT_PRINTS, F.ArrowUDFType.SCALAR)
    return made(_shaped("phonemes", _PHONES, ("phoneme", *_NUMBERS)))


def record_prints(records: DataFrame) -> Column:
    """What ``phone_arrays.record_prints`` makes of phones and intervals; a column ``record_prints`` has it already
    (for ``record_print`` what ``phone_arrays.known_by`` makes is enough)."""
    if "record_prints" in records.columns:
        return F.col("record_prints")
    ship_package(records.sparkSession)
    made = F.arrow_udf(arrays.record_prints, RECORD_PRINTS, F.ArrowUDFType.SCALAR)
    return made(_shaped("phonemes", _PHONES, ("phoneme", *_NUMBERS)), _shaped("entries", _ENTRIES, ("label", "start", "end")), F.col("duration_sec").cast("double"))


def _known_by(records: DataFrame, prints: Column) -> Column:
    lists = [F.hex(prints[n]) for n in ("phones_print", "entries_print")]
    return row_digest(*plain_columns(records, "audio_sha256", "duration_sec", "conditions"), *lists)


def record_print(records: DataFrame) -> Column:
    """The digest of a measurement record: its audio, length and conditions as plain text, its phones and intervals
    by digests of their numbers in billionths."""
    return _known_by(records, record_prints(records))


def measurement_problems(segments: DataFrame, records: DataFrame) -> DataFrame:
    """Stored measurement records against their segments, phone by phone.

    Both sides bring segment_id, phonemes, audio_sha256 and conditions; records also duration_sec and
    entries, segments also reference_sha256 (the digest of the record they were aligned by), clip_sec and
    alignment_method. The digest of a record is computed here. Arrays are compared whole, by SHA-256 of
    their exact values made in their own row; only these meet, so a join carries some hundred bytes a segment.
    Sides whose prints were made with their phones bring them instead of the arrays (``segment_prints``,
    ``record_prints``).
    """
    left = segments.select(
        "segment_id", "alignment_method", "audio_sha256", "conditions", "reference_sha256", "clip_sec", segment_prints(segments).alias("_p"))
    right = records.withColumn("_q", record_prints(records))
    right = right.select("segment_id", F.struct("audio_sha256", "conditions", "duration_sec", _known_by(right, F.col("_q")).alias("record_sha256"), *[
        F.col(f"_q.{n}").alias(n) for n in ("n", "inside", "voiced", "phones", "labels")]).alias("r"))
    joined = left.join(right, "segment_id", "full_outer")
    forced = F.col("alignment_method") == FORCED_ALIGNMENT
    has, there = F.col("r").isNotNull(), F.col("_p.n").isNotNull()
    checked = forced & has
    same_length = F.col("_p.n") == F.col("r.n")
    phones = F.col("_p.phones_whole") & F.col("r.inside") & (F.col("_p.phones") == F.col("r.phones"))
    labels = F.when(F.col("r.labels").isNotNull(), F.col("_p.labels_whole") & (F.col("_p.labels") == F.col("r.labels")))
    codes = reasons(
        (~there & has, "segment_missing"), (~forced & has, "reference_on_estimate"), (forced & ~has, "record_missing"),
        (checked & ~F.col("r.record_sha256").eqNullSafe(F.col("reference_sha256")), "record_changed"), (checked & (F.col("r.audio_sha256") != F.col("audio_sha256")), "audio_changed"),
        (checked & (F.abs(F.col("clip_sec") - F.col("r.duration_sec")) > EPS), "length_changed"), (checked & ~F.col("r.conditions").eqNullSafe(F.col("conditions")), "conditions_differ"),
        (checked & ~same_length, "phone_count_differs"), (checked & same_length & ~phones, "phones_differ"),
        (checked & ((F.col("r.voiced") != F.col("_p.n")) | ~labels), "intervals_differ"),
    )
    return joined.select("segment_id", F.explode(codes).alias("problem"))


def mora_groups(phones: Column) -> tuple[Column, Column]:
    """(group sizes, problem): a consonant joins the next vowel, standalone phones stand alone."""
    kind = F.transform(phones, lambda p: F.when(p.isin(*CONSONANTS), "C").when(p.isin(*VOWELS), "V").when(p.isin(*STANDALONE_PHONES), "S").otherwise("U"))

    def sizes(k: Column) -> Column:
        each = F.zip_with(k, _earlier(k, F.lit("^")), lambda x, before: F.when(x == "V", F.when(before == "C", 2).otherwise(1)).when(x == "S", 1))
        return F.filter(each, lambda n: n.isNotNull())

    def first_problem(k: Column) -> Column:
        each = F.zip_with(k, _earlier(k, F.lit("^")), lambda x, before: F.when(x == "U", "unknown_phone").when((x == "C") & (before == "C"), "consonant_cluster").when(
            (x == "S") & (before == "C"), "consonant_without_vowel"))
        last = F.when(F.get(k, F.size(k) - 1) == "C", "trailing_consonant")
        return F.get(F.filter(F.concat(each, F.array(last)), lambda c: c.isNotNull()), F.lit(0))

    return let(kind, sizes), let(kind, first_problem)


def clip_problem(phones: Column, durations: Column, clip_sec: Column, sample_rate: Column) -> Column:
    """First broken rule of a clip: equal lists, positive finite lengths, a sum within two samples."""
    total = F.aggregate(durations, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when((F.size(phones) == 0) | (F.size(phones) != F.size(durations)), "length_mismatch")
        .when(F.exists(durations, lambda d: ~finite(d) | (d <= 0)), "bad_duration").when(F.abs(total - clip_sec) > F.lit(2.0) / sample_rate, "sum_mismatch")
    )


def duration_input(clips: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with mora counts, held clips with a reason): nothing is dropped silently. ``more`` columns are kept."""
    from voxloom.sinks.datasets import clip_name, significant

    groups, trouble = mora_groups(F.col("phones"))
    judged = clips.withColumn("reason", F.coalesce(clip_problem(F.col("phones"), F.col("durations"), F.col("clip_sec"), F.col("sample_rate")), trouble))
    accepted = judged.where("reason IS NULL").select(
        *more, "segment_id", clip_name(F.col("segment_id")).alias("name"), F.array_join("phones", " ").alias("ph_seq"),
        F.array_join(F.transform("durations", significant), " ").alias("ph_dur"), F.array_join(groups, " ").alias("ph_num"), "training_weight")
    return accepted, judged.where("reason IS NOT NULL").select(*more, "segment_id", "reason")


def crop_ranges(clips: DataFrame) -> DataFrame:
    """Sample range of each clip, or its first problem.

    ``clips``: phones, starts, ends, durations, sample_rate, frame_count.
    """
    rows = F.arrays_zip("phones", "starts", "ends", "durations")
    before = _earlier(F.col("ends"), F.lit(None).cast("double"))
    each = F.zip_with(rows, before, lambda x, e: F.when(~F.coalesce(x["phones"].rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.lit(False)), "phone_spelling").when(
        ~finite(x["starts"]) | ~finite(x["ends"]) | ~finite(x["durations"]), "not_finite").when(
        (x["starts"] < 0) | (x["ends"] <= x["starts"]) | (F.abs(x["ends"] - x["starts"] - x["durations"]) > 1e-9), "bounds_disagree").when(
        e.isNotNull() & (F.abs(x["starts"] - e) > EPS), "gap_between_phones"))
    first = F.get(F.filter(each, lambda c: c.isNotNull()), F.lit(0))
    start = F.bround(F.get("starts", F.lit(0)) * F.col("sample_rate")).cast("long")
    end = F.bround(F.get("ends", F.size("ends") - 1) * F.col("sample_rate")).cast("long")
    outside = (F.col("_e") > F.col("frame_count")) | (F.col("_s") < 0) | (F.col("_s") >= F.col("_e"))
    return clips.withColumn("_s", start).withColumn("_e", end).withColumn("problem", F.coalesce(first, F.when(outside, "outside_clip"))).select(
        "segment_id", F.when(F.col("problem").isNull(), F.col("_s")).alias("start_sample"), F.when(F.col("problem").isNull(), F.col("_e")).alias("end_sample"),
        F.when(F.col("problem").isNull(), (F.col("_e") - F.col("_s")) / F.col("sample_rate")).alias("duration_sec"), "problem")
