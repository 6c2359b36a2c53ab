"""Queries of corrections, pitch gaps, supplements and prompts."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from voxloom.operators import completion as c
from voxloom.plans import views as v
from voxloom.plans.queries_text import APPLIED, _applied
from voxloom.plans.queries_dataset import PRINT, snapshot_print
from voxloom.plans.queries_jobs import billionths, digest_sql, set_print_sql
from voxloom.plans.registry import query
from voxloom.session import durable

TRIAGE = """, tm AS (SELECT *, list_filter([CASE WHEN CASE asr_status WHEN 'measured' THEN true WHEN 'legacy_unknown' THEN asr_confidence > 0 ELSE false END THEN asr_confidence END, CASE WHEN alignment_status = 'measured' THEN alignment_confidence END], lambda x: x IS NOT NULL) AS m FROM segments),
 tri AS (SELECT *, coalesce(list_min(m), 1) < 35e-2 AS rej, coalesce(list_min(m), 1) < 65e-2 AS weak FROM tm), kept AS (SELECT * FROM tri WHERE NOT rej)
"""


@query("cmp_1_triage", "segments", TRIAGE + """SELECT segment_id, speaker_id, CASE WHEN rej THEN 'rejected' WHEN weak THEN 'weak_observed' ELSE 'observed' END AS state, CASE WHEN rej THEN 'confidence-outlier-rejection' ELSE 'observed' END AS method,
  CASE WHEN rej THEN 'applied' ELSE 'not_required' END AS application_status, coalesce(list_min(m), 0) AS confidence, len(m) = 0 AS unmeasured FROM tri""")
def triage(spark, sf_dir):
    return c.triage(v.segments(spark, sf_dir))


def _bare(spark, sf_dir):
    """Segments of small speakers, so that phones are really missing: only letters of short texts count."""
    return v.phoned_segments(spark, sf_dir).withColumn("speaker_id", F.expr("CASE WHEN speaker_id IS NULL THEN NULL ELSE concat('spk_', source_id, '_', cast(doc_id % 25 as varchar(20))) END"))


BARE = TRIAGE + """, bare AS (SELECT * REPLACE (CASE WHEN speaker_id IS NULL THEN NULL ELSE concat('spk_', source_id, '_', doc_id % 25) END AS speaker_id) FROM kept)
"""


@query("cmp_2_missing_core_phones", "segments phonemes", BARE + """, core AS (SELECT unnest(['a','i','u','e','o','k','s','t','n','h','m','y','r','w','g','z','d','b','p','N','cl']) AS phoneme),
 seen AS (SELECT DISTINCT speaker_id, phoneme FROM bare JOIN (SELECT DISTINCT segment_id, phoneme FROM phonemes) p USING (segment_id))
SELECT speaker_id, phoneme, 'estimated' AS state, 'missing-phoneme-generation' AS method, 'deferred' AS application_status FROM (SELECT DISTINCT speaker_id FROM bare WHERE speaker_id IS NOT NULL) CROSS JOIN core ANTI JOIN seen USING (speaker_id, phoneme)""")
def missing_core(spark, sf_dir):
    return c.missing_core_phones(_bare(spark, sf_dir))


@query("cmp_3_label_reviews", "segments phonemes", TRIAGE + "SELECT DISTINCT segment_id, speaker_id, phoneme FROM kept JOIN phonemes p USING (segment_id) WHERE p.confidence < 35e-2")
def label_reviews(spark, sf_dir):
    return c.label_reviews(v.phoned_segments(spark, sf_dir))


def _decided(spark, sf_dir):
    """Placed frames with the decisions and estimates made on them."""
    frames = durable(v.frames(spark, sf_dir))
    return frames, *c.gap_decisions(frames, v.clip_phones(spark, sf_dir, frames))


GAPS = """, fr AS (SELECT *, f0 = 0 OR f0_conf < 45e-2 AS need FROM frames),
 nb AS (SELECT *, lag(need) OVER w AS bn, lag(f0, 1) OVER w AS lf1, lag(f0, 2) OVER w AS lf2, lead(f0, 1) OVER w AS rf1, lead(f0, 2) OVER w AS rf2, lag(f0_conf, 1) OVER w AS lc1, lag(f0_conf, 2) OVER w AS lc2, lead(f0_conf, 1) OVER w AS rc1, lead(f0_conf, 2) OVER w AS rc2,
   lag(energy, 1) OVER w AS le1, lag(energy, 2) OVER w AS le2, lead(energy, 1) OVER w AS re1, lead(energy, 2) OVER w AS re2, lag(voicing, 1) OVER w AS lv1, lag(voicing, 2) OVER w AS lv2, lead(voicing, 1) OVER w AS rv1, lead(voicing, 2) OVER w AS rv2,
   lag(time_sec, 1) OVER w AS lt1, lag(time_sec, 2) OVER w AS lt2, lead(time_sec, 1) OVER w AS rt1, lead(time_sec, 2) OVER w AS rt2 FROM fr WINDOW w AS (PARTITION BY segment_id ORDER BY idx)),
 isl AS (SELECT *, max(CASE WHEN need AND NOT coalesce(bn, false) THEN idx END) OVER (PARTITION BY segment_id ORDER BY idx) AS start_frame FROM nb),
 gp AS (SELECT segment_id, start_frame, max(idx) + 1 AS end_frame, min(energy) AS quiet, """ + ", ".join(f"arg_min({x}, idx) FILTER ({x} IS NOT NULL AND idx = start_frame) AS {x}" for x in ("lf1", "lf2", "lc1", "lc2", "le1", "le2", "lv1", "lv2", "lt1", "lt2")) + ", " + ", ".join(
    f"max_by({x}, idx) FILTER (last) AS {x}" for x in ("rf1", "rf2", "rc1", "rc2", "re1", "re2", "rv1", "rv2", "rt1", "rt2")) + """
   FROM (SELECT *, idx = max(idx) OVER (PARTITION BY segment_id, start_frame) AS last FROM isl WHERE need) GROUP BY segment_id, start_frame),
 ea AS (SELECT *, CASE WHEN lf2 IS NULL OR rf2 IS NULL THEN 'not_enough_anchors' WHEN (end_frame - start_frame) * 1e-2 > 6e-2 + 1e-9 THEN 'gap_too_long'
   WHEN NOT (lf1 BETWEEN 60 AND 1200 AND lf2 BETWEEN 60 AND 1200 AND rf1 BETWEEN 60 AND 1200 AND rf2 BETWEEN 60 AND 1200 AND least(lc1, lc2, rc1, rc2) >= 8e-1 AND least(lv1, lv2, rv1, rv2) >= 5e-1 AND least(le1, le2, re1, re2) >= 8e-3) THEN 'weak_anchor'
   WHEN abs(12 * log2(lf1 / rf1)) > 2 OR abs(12 * log2(lf2 / lf1)) > 1 OR abs(12 * log2(rf1 / rf2)) > 1 THEN 'pitch_jump' WHEN quiet < greatest(8e-3, least(le1, re1) * 25e-2) THEN 'energy_drop' END AS early,
   lt2 AS lft, rt2 + greatest(4e-2, 3e0 / least(lf1, rf1)) AS rgt FROM gp),
 vw AS (SELECT e.segment_id, e.start_frame, count(*) AS n_over, count(*) FILTER (k) AS n_cover, max(phoneme) FILTER (k) AS vowel FROM (
   SELECT e.segment_id, e.start_frame, p.phoneme, p.phoneme IN ('a','i','u','e','o') AND p.confidence BETWEEN 65e-2 AND 1 AND p.start_sec >= 0 AND p.start_sec <= lft AND p.end_sec >= rgt AS k
   FROM ea e JOIN clip_phones p ON p.segment_id = e.segment_id AND p.start_sec < rgt AND p.end_sec > lft WHERE early IS NULL) e GROUP BY ALL),
 one AS (SELECT ea.*, coalesce(n_cover = 1 AND n_over = 1, false) AS one, vowel FROM ea LEFT JOIN vw USING (segment_id, start_frame)),
 es AS (SELECT i.segment_id, i.start_frame, i.idx, i.f0, i.periodicity, i.rms, least(o.lc1, o.rc1) AS cc, exp(ln(o.lf1) * (1 - (i.time_sec - o.lt1) / (o.rt1 - o.lt1)) + ln(o.rf1) * ((i.time_sec - o.lt1) / (o.rt1 - o.lt1))) AS estimate
   FROM isl i JOIN one o ON o.segment_id = i.segment_id AND o.start_frame = i.start_frame WHERE i.need AND early IS NULL AND one),
 pv AS (SELECT segment_id, start_frame, bool_and(periodicity >= 9e-1 AND rms >= 8e-3) AS sound, least(65e-2, min(cc * periodicity * 75e-2)) AS conf FROM es GROUP BY ALL),
 dec AS (SELECT o.segment_id, o.start_frame, end_frame, coalesce(early, CASE WHEN NOT one THEN 'not_one_vowel' WHEN NOT coalesce(sound, false) THEN 'no_periodicity' END) AS reason, CASE WHEN early IS NULL AND one THEN vowel END AS phoneme, conf FROM one o LEFT JOIN pv USING (segment_id, start_frame)),
 fil AS (SELECT f.segment_id, f.idx, coalesce(x.estimate, f.f0) AS f0, coalesce(x.conf, f.f0_conf) AS f0_conf, f.energy, CASE WHEN x.estimate IS NULL THEN f.voicing ELSE 1 END AS voicing, x.estimate IS NOT NULL AS filled
   FROM frames f LEFT JOIN (SELECT es.segment_id, es.idx, estimate, d.conf FROM es JOIN dec d USING (segment_id, start_frame) WHERE reason IS NULL) x USING (segment_id, idx))
"""


@query("cmp_5_gap_decisions", "frames clip_phones", GAPS + """SELECT segment_id, start_frame, end_frame, reason IS NULL AS applied, reason, phoneme, round(CASE WHEN reason IS NULL THEN conf ELSE 0 END, 9) AS confidence,
  CASE WHEN reason IS NULL THEN 'estimated' ELSE 'weak_observed' END AS state, CASE WHEN reason IS NULL THEN 'applied' ELSE 'deferred' END AS application_status, 'short-vowel-gap-1' AS method FROM dec""")
def gap_decisions(spark, sf_dir):
    return _decided(spark, sf_dir)[1].withColumn("confidence", F.round("confidence", 9))


@query("cmp_5_filled_frames", "frames clip_phones", GAPS + "SELECT segment_id, idx, round(f0, 6) AS f0, round(f0_conf, 9) AS f0_conf, voicing::DOUBLE AS voicing, filled FROM fil")
def filled_frames(spark, sf_dir):
    return c.filled_frames(*_decided(spark, sf_dir)).select("segment_id", "idx", F.round("f0", 6).alias("f0"), F.round("f0_conf", 9).alias("f0_conf"), "voicing", "filled")


def _stored_series(spark, sf_dir):
    i = F.col("event_id")
    return v.frames(spark, sf_dir).select(
        "segment_id", "idx", (F.col("time_sec") + F.when(i % 211 == 0, 0.003).otherwise(0.0)).alias("f0_time"), F.when(i % 97 == 0, -1.0).otherwise(F.col("f0")).alias("f0"), F.when(i % 89 == 0, 1.5).otherwise(F.col("f0_conf")).alias("f0_conf"),
        (F.col("time_sec") + F.when((i % 83 == 0) | (i % 211 == 0), 0.003).otherwise(0.0)).alias("energy_time"), F.when(i % 79 == 0, 1.25).otherwise(F.col("energy")).alias("energy"),
        (F.col("time_sec") + F.when(i % 211 == 0, 0.003).otherwise(0.0)).alias("voicing_time"), F.when((F.col("segment_id").endswith("7")) & (F.col("idx") == 5), F.lit(None)).otherwise(F.col("voicing")).alias("voicing"))


@query("cmp_6_frame_audit", "frames", """, s AS (SELECT segment_id, idx, time_sec + CASE WHEN event_id % 211 = 0 THEN 3e-3 ELSE 0 END AS t, CASE WHEN event_id % 97 = 0 THEN -1 ELSE f0 END AS f0, CASE WHEN event_id % 89 = 0 THEN 15e-1 ELSE f0_conf END AS fc,
   time_sec + CASE WHEN event_id % 83 = 0 OR event_id % 211 = 0 THEN 3e-3 ELSE 0 END AS et, CASE WHEN event_id % 79 = 0 THEN 125e-2 ELSE energy END AS e, CASE WHEN segment_id LIKE '%7' AND idx = 5 THEN NULL ELSE voicing END AS v FROM frames),
 st AS (SELECT segment_id, count(*) AS n, count(v) AS nv, coalesce(max(t) FILTER (idx = 1) - max(t) FILTER (idx = 0), 1e-2) AS step FROM s GROUP BY ALL),
 o AS (SELECT s.*, step, lag(t) OVER (PARTITION BY segment_id ORDER BY idx) AS b FROM s JOIN st USING (segment_id))
SELECT segment_id, NULL::BIGINT AS idx, 'lengths_differ' AS problem FROM st WHERE n <> nv UNION ALL SELECT segment_id, NULL, 'bad_step' FROM st WHERE step <= 0 OR step > 2e-2
UNION ALL SELECT segment_id, idx, unnest(list_filter([CASE WHEN f0 < 0 OR fc > 1 THEN 'bad_value' END, CASE WHEN e > 1 THEN 'above_one' END, CASE WHEN abs(t - et) > 1e-8 THEN 'times_disagree' END, CASE WHEN abs(t - b - step) > 1e-8 THEN 'uneven_step' END], lambda x: x IS NOT NULL)) FROM o""")
def frame_audit(spark, sf_dir):
    return c.frame_problems(_stored_series(spark, sf_dir))


_SETTINGS = [str(round(float(x) * 1e9)) for _, x in sorted(asdict(c.GapSettings()).items())]
_MILLIONTHS = "array_to_string(list_transform({0}, lambda x: CAST(CAST(x * 1e6 AS BIGINT) AS VARCHAR)), ',')"
RECORDS = GAPS + ", pf AS (" + set_print_sql("frames", "segment_id", digest_sql("idx", *map(billionths, ("time_sec", "f0", "f0_conf", "energy", "voicing", "periodicity", "rms"))), "f") + "), pp AS (" + set_print_sql(
    "clip_phones", "segment_id", digest_sql("phoneme", *map(billionths, ("start_sec", "end_sec", "confidence"))), "p") + """),
 pr AS (SELECT pf.segment_id, """ + digest_sql("'short-vowel-gap-1'", *[f"'{x}'" for x in _SETTINGS], "pf.segment_id", "f", "p") + """ AS input_fingerprint FROM pf LEFT JOIN pp USING (segment_id)),
 vals AS (SELECT i.segment_id, i.start_frame, list(i.f0 ORDER BY i.idx) AS was, list(es.estimate ORDER BY i.idx) AS new FROM isl i LEFT JOIN es USING (segment_id, idx) WHERE i.need GROUP BY ALL)
"""


@query("cmp_7_corrections", "frames clip_phones", RECORDS + f"""SELECT segment_id, 'observed' AS state, 'pitch-input-snapshot' AS method, 'not_required' AS application_status, NULL::DOUBLE AS confidence, NULL AS reason, NULL AS phoneme, NULL::BIGINT AS start_frame, NULL::BIGINT AS end_frame,
  NULL AS original_values, NULL AS result_values, NULL AS result_path, input_fingerprint FROM pr
UNION ALL SELECT d.segment_id, CASE WHEN reason IS NULL THEN 'estimated' ELSE 'weak_observed' END, 'short-vowel-gap-1', CASE WHEN reason IS NULL THEN 'applied' ELSE 'deferred' END, round(CASE WHEN reason IS NULL THEN conf ELSE 0 END, 9), reason, phoneme, d.start_frame, end_frame,
  {_MILLIONTHS.format("was")}, CASE WHEN reason IS NULL THEN {_MILLIONTHS.format("new")} ELSE '' END, CASE WHEN reason IS NULL THEN concat('features/completion/short-vowel-gap-1/', input_fingerprint, '/f0.json') END, input_fingerprint
FROM dec d JOIN vals USING (segment_id, start_frame) JOIN pr ON pr.segment_id = d.segment_id""")
def corrections(spark, sf_dir):
    frames = durable(v.frames(spark, sf_dir))
    phones = v.clip_phones(spark, sf_dir, frames)
    out = c.correction_records(frames, phones, *c.gap_decisions(frames, phones))
    text = lambda name: F.array_join(F.transform(name, lambda x: F.rint(x * 1e6).cast("long").cast("string")), ",").alias(name)
    return out.withColumn("confidence", F.round("confidence", 9)).select(*[text(n) if n.endswith("_values") else n for n in out.columns])


@query("cmp_7_resummarized", "frames clip_phones", GAPS + """, ranked AS (SELECT segment_id, f0, row_number() OVER (PARTITION BY segment_id ORDER BY f0) AS r, count(*) OVER (PARTITION BY segment_id) AS n FROM fil WHERE f0 > 0),
 ends AS (SELECT segment_id, max(n) AS n, max(f0) FILTER (r = greatest(1, CAST(floor(n * 1e-1) AS BIGINT))) AS lo, max(f0) FILTER (r = least(n, CAST(floor(n * 9e-1) AS BIGINT) + 1)) AS hi FROM ranked GROUP BY ALL)
SELECT f.segment_id, round(coalesce(avg(f0) FILTER (f0 > 0), 0), 6) AS mean_f0_hz, round(coalesce(stddev_pop(f0) FILTER (f0 > 0), 0), 6) AS f0_std_dev_hz, round(avg(CASE WHEN voicing >= 5e-1 THEN 1e0 ELSE 0e0 END), 9) AS voiced_ratio,
  round(CASE WHEN max(e.n) >= 2 AND max(hi) > max(lo) THEN 12 * log2(max(hi) / max(lo)) ELSE 0 END, 6) AS pitch_range_semitones FROM fil f LEFT JOIN ends e USING (segment_id) WHERE f.segment_id IN (SELECT segment_id FROM fil WHERE filled) GROUP BY ALL""")
def resummarized(spark, sf_dir):
    out = c.resummarize(c.filled_frames(*_decided(spark, sf_dir)))
    return out.select("segment_id", F.round("mean_f0_hz", 6).alias("mean_f0_hz"), F.round("f0_std_dev_hz", 6).alias("f0_std_dev_hz"), F.round("voiced_ratio", 9).alias("voiced_ratio"), F.round("pitch_range_semitones", 6).alias("pitch_range_semitones"))


def _moved(segments):
    """The same recordings with the end of each first reliable phone a millisecond later."""
    def one(p, i):
        return F.when(i == 0, p.withField("end_sec", p["end_sec"] + 1e-3)).otherwise(p)

    return segments.withColumn("phonemes", F.transform(F.filter("phonemes", lambda p: p["confidence"] >= c.RELIABLE), one))


def _observed(spark, sf_dir):
    """The print of each speaker's reliable phones, taken once; phones are made of reliable speech only."""
    return durable(c.observation_prints(v.segments(spark, sf_dir), v.with_phones))


def _candidates(spark, sf_dir, now):
    """Candidates with the fingerprint of what was observed; every ninth was made from moved phones."""
    then = c.observation_prints(v.segments(spark, sf_dir), lambda s: _moved(v.with_phones(s))).withColumnRenamed("observation_fingerprint", "_then")
    base = v.benchmark_candidates(spark, sf_dir).join(now, "speaker_id", "left").join(then, "speaker_id", "left").withColumn(
        "observation_fingerprint", F.when(F.col("fingerprint_current"), F.col("observation_fingerprint")).otherwise(F.col("_then"))).drop("fingerprint_current", "_then")
    i = F.col("doc_id")
    expected = F.array("common_phone", "rare_phone", "common_phone")
    return base.select(
        "*", expected.alias("expected"), F.when(F.col("misrecognized"), F.array("common_phone")).otherwise(expected).alias("recognized"),
        F.when(i % 12 == 0, F.array().cast("array<string>")).otherwise(F.array("rare_phone")).alias("missing"), F.array().cast("array<string>").alias("weak"), F.concat(F.lit("say "), "rare_phone").alias("text"))


def _judged(spark, sf_dir):
    segs, now = v.segments(spark, sf_dir), _observed(spark, sf_dir)
    cand = durable(_candidates(spark, sf_dir, now))
    return segs, cand, c.candidate_problems(cand, c.reliable_counts(segs, v.with_phones), now)


RELIABLE = """, rel AS (SELECT speaker_id, phoneme, count(*) AS n FROM segments s JOIN phonemes p USING (segment_id) WHERE content_type = 'speech' AND asr_confidence >= 65e-2 AND alignment_confidence >= 65e-2 AND speaker_id IS NOT NULL AND p.confidence >= 65e-2 GROUP BY ALL)
"""


@query("cmp_9_reliable_counts", "segments phonemes", RELIABLE + "SELECT * FROM rel")
def reliable_counts(spark, sf_dir):
    return c.reliable_counts(v.segments(spark, sf_dir), v.with_phones)


CAND = RELIABLE + """, cx AS (SELECT c.*, coalesce(r.n, 0) AS nr, coalesce(q.n, 0) AS nc FROM candidates c LEFT JOIN rel r ON r.speaker_id = c.speaker_id AND r.phoneme = c.rare_phone LEFT JOIN rel q ON q.speaker_id = c.speaker_id AND q.phoneme = c.common_phone),
 cp AS (SELECT *, list_filter([CASE WHEN misrecognized THEN 'phones_disagree' END, CASE WHEN doc_id % 12 = 0 THEN 'nothing_to_add' END, CASE WHEN asr_avg_logprob < -5e-1 THEN 'logprob' END, CASE WHEN speaker_similarity < 8e-1 THEN 'similarity' END,
   CASE WHEN no_speech_probability > 2e-1 THEN 'no_speech' END, CASE WHEN duration_sec NOT BETWEEN 2 AND 14 THEN 'duration' END, CASE WHEN rms < 8e-3 THEN 'loudness' END, CASE WHEN clipping_ratio > 1e-3 THEN 'clipping' END, CASE WHEN silence_ratio > 6e-1 THEN 'silence' END,
   CASE WHEN CASE WHEN doc_id % 12 = 0 THEN '' ELSE rare_phone END <> concat(CASE WHEN nc = 0 THEN concat(common_phone, CASE WHEN nr = 0 THEN ' ' ELSE '' END) ELSE '' END, CASE WHEN nr = 0 THEN rare_phone ELSE '' END) AND NOT (nc = 0 AND false) THEN 'missing_list_differs' END,
   CASE WHEN nr BETWEEN 1 AND 2 OR nc BETWEEN 1 AND 2 THEN 'weak_list_differs' END, CASE WHEN NOT fingerprint_current AND speaker_id IN (SELECT speaker_id FROM rel) THEN 'observation_changed' END], lambda x: x IS NOT NULL) AS problems FROM cx)
"""


@query("cmp_10_candidate_gate", "segments phonemes candidates", CAND + "SELECT candidate_id, speaker_id, array_to_string(problems, ',') AS problems FROM cp")
def candidate_gate(spark, sf_dir):
    return _judged(spark, sf_dir)[2].withColumn("problems", F.array_join("problems", ","))


def _log(spark, sf_dir):
    cand = v.benchmark_candidates(spark, sf_dir)
    took = cand.select("speaker_id", "candidate_id", F.lit(True).alias("accepted"), F.expr("doc_id * 10 % 997 * 10000000000 + doc_id * 10").alias("seq"))
    gave = cand.where("doc_id % 2 = 1").select("speaker_id", "candidate_id", F.lit(False).alias("accepted"), F.expr("doc_id * 10 % 997 * 10000000000 + doc_id * 10 + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE -1 END").alias("seq"))
    return took.unionByName(gave)


LOG = """, lg AS (SELECT speaker_id, candidate_id, true AS accepted, doc_id * 10 % 997 * 10000000000 + doc_id * 10 AS seq FROM candidates UNION ALL SELECT speaker_id, candidate_id, false, doc_id * 10 % 997 * 10000000000 + doc_id * 10 + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE -1 END FROM candidates WHERE doc_id % 2 = 1),
 ch AS (SELECT speaker_id, arg_max(candidate_id, seq) AS candidate_id, max(seq) AS taken FROM lg WHERE accepted GROUP BY ALL),
 acc AS (SELECT ch.speaker_id, ch.candidate_id FROM ch LEFT JOIN (SELECT speaker_id, candidate_id, max(seq) AS outs FROM lg WHERE NOT accepted GROUP BY ALL) w USING (speaker_id, candidate_id) WHERE coalesce(outs < taken, true))
"""


@query("cmp_11_accepted", "candidates", LOG + "SELECT * FROM acc")
def accepted(spark, sf_dir):
    return c.accepted_candidates(_log(spark, sf_dir))


def _generated(spark, sf_dir):
    segs, cand, problems = _judged(spark, sf_dir)
    return c.generated_segments(cand, c.accepted_candidates(_log(spark, sf_dir)), problems, segs)


@query("cmp_8_generated_segments", "segments phonemes candidates", CAND + LOG + """SELECT concat('generated_', candidate_id) AS segment_id, speaker_id, concat('generated:', candidate_id) AS source_id, NULL AS problem FROM acc JOIN cp USING (speaker_id, candidate_id) WHERE len(problems) = 0
UNION ALL SELECT candidate_id, NULL, NULL, 'not_verified' FROM acc JOIN cp USING (speaker_id, candidate_id) WHERE len(problems) > 0""")
def generated_segments(spark, sf_dir):
    made, problems = _generated(spark, sf_dir)
    return made.select("segment_id", "speaker_id", "source_id", F.lit(None).cast("string").alias("problem")).unionByName(problems.select(F.col("candidate_id").alias("segment_id"), "problem"), allowMissingColumns=True)


def _asked(spark, sf_dir):
    """Every generated candidate that names a rare phone, to exercise the estimate per speaker."""
    cand = _candidates(spark, sf_dir, _observed(spark, sf_dir)).groupBy("speaker_id").agg(F.min_by("candidate_id", "doc_id").alias("candidate_id"), F.max("speaker_similarity").alias("speaker_similarity"))
    return cand.select(F.concat(F.lit("generated_"), "candidate_id").alias("segment_id"), "speaker_id", F.lit("speech").alias("content_type"),
                       F.when(F.col("speaker_id") == "spk_4", "src_1").otherwise(F.concat(F.lit("generated:"), "candidate_id")).alias("source_id"),
                       F.when(F.col("speaker_id") == "spk_5", F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("speaker_embedding"),
                       F.when(F.col("speaker_id") == "spk_2", 0.5).otherwise(F.col("speaker_similarity")).alias("speaker_similarity"),
                       F.when(F.col("speaker_id") == "spk_3", F.array().cast("array<string>")).otherwise(F.array(F.lit("U"), F.lit("kw"))).alias("assisted"))


@query("cmp_12_feature_estimates", "segments phonemes candidates embedded", """, ask AS (SELECT speaker_id, concat('generated_', arg_min(candidate_id, doc_id)) AS segment_id, max(speaker_similarity) AS sim FROM candidates GROUP BY ALL),
 oth AS (SELECT DISTINCT segment_id FROM phonemes WHERE confidence >= 65e-2 AND phoneme NOT IN ('u', 'kw')),
 rf AS (SELECT e.* REPLACE (CASE WHEN speaker_id <> 'spk_6' AND (len(speaker_embedding) = 3 OR isnan(speaker_embedding[1])) THEN [1e0, 1e0, 1e0, 1e0] ELSE speaker_embedding END AS speaker_embedding)
   FROM embedded e JOIN oth USING (segment_id) WHERE content_type = 'speech' AND asr_confidence >= 65e-2 AND alignment_confidence >= 65e-2 AND len(speaker_embedding) > 0 AND speaker_id IS NOT NULL),
 sm AS (SELECT speaker_id, count(*) AS k, count(DISTINCT len(speaker_embedding)) > 1 OR bool_or(isnan(speaker_embedding[1])) AS bad, [sum(speaker_embedding[1]), sum(speaker_embedding[2]), sum(speaker_embedding[3]), sum(speaker_embedding[4])] AS s FROM rf GROUP BY ALL),
 j AS (SELECT a.*, k, s, bad, CASE speaker_id WHEN 'spk_4' THEN 'not_generated_speech' WHEN 'spk_5' THEN 'vector_present' WHEN 'spk_2' THEN 'similarity' WHEN 'spk_3' THEN 'no_target_phones' ELSE CASE WHEN k IS NULL THEN 'no_reference' WHEN bad THEN 'bad_reference_vectors' END END AS reason FROM ask a LEFT JOIN sm USING (speaker_id))
SELECT segment_id, speaker_id, reason, CASE WHEN reason IS NULL THEN 'applied' ELSE 'deferred' END AS application_status, CASE WHEN reason IS NULL THEN sim END AS confidence, CASE WHEN speaker_id IN ('spk_2', 'spk_3', 'spk_4', 'spk_5') THEN 0 ELSE coalesce(k, 0) END AS "references",
  round(CASE WHEN reason IS NULL THEN s[1] / sqrt(list_inner_product(s, s)) END, 7) AS first_value FROM j""")
def feature_estimates(spark, sf_dir):
    """One speaker keeps vectors of another dimension or without numbers; elsewhere they are replaced."""
    odd = "coalesce(speaker_id, '') <> 'spk_6' AND (size(speaker_embedding) = 3 OR coalesce(isnan(get(speaker_embedding, 0)), false))"
    segs = v.embeddings_of_segments(v.phoned_segments(spark, sf_dir))
    segs = segs.withColumn("speaker_embedding", F.when(F.expr(odd), F.array(*[F.lit(1.0)] * 4)).otherwise(F.col("speaker_embedding")))
    return c.estimate_speaker_features(_asked(spark, sf_dir), segs).select("segment_id", "speaker_id", "reason", "application_status", "confidence", "references", F.round(F.get("vector", F.lit(0)), 7).alias("first_value"))


PLAN = """, good AS (SELECT * FROM segments WHERE content_type = 'speech' AND asr_confidence >= 75e-2 AND alignment_confidence >= 65e-2 AND speaker_id IS NOT NULL),
 len_ AS (SELECT segment_id, max(end_sec / 20) AS l FROM phonemes GROUP BY ALL), seen AS (SELECT DISTINCT speaker_id, phoneme FROM good JOIN phonemes p USING (segment_id) WHERE p.confidence >= 65e-2),
 best AS (SELECT speaker_id, arg_min(segment_id, (-asr_confidence, segment_id)) AS reference_segment_id, arg_min(cache_key, (-asr_confidence, segment_id)) AS reference_sha256 FROM good JOIN len_ USING (segment_id) WHERE trim(transcript) <> '' AND length(transcript) <= 500 AND l BETWEEN 3 AND 15 GROUP BY ALL),
 want AS (SELECT unnest(['a','i','u','e','o','k','s','t','n','h','m','y','r','w','g','z','d','b','p','N','cl','ky','gy','sh','j','ch','ny','hy','by','py','my','ry','f','v','ts','ty','dy','kw','gw']) AS phoneme),
 miss AS (SELECT speaker_id, string_agg(phoneme, ',' ORDER BY phoneme) AS missing FROM (SELECT DISTINCT speaker_id FROM segments WHERE speaker_id IS NOT NULL) CROSS JOIN want ANTI JOIN seen USING (speaker_id, phoneme) GROUP BY ALL),
 pl AS (SELECT speaker_id, reference_segment_id, reference_sha256, missing, CASE WHEN speaker_id NOT IN (SELECT speaker_id FROM good) THEN 'no_usable_speech' WHEN missing IS NULL THEN 'nothing_missing' WHEN reference_segment_id IS NULL THEN 'no_reference_clip' END AS problem FROM miss LEFT JOIN best USING (speaker_id))
"""


def _quick(spark, sf_dir):
    """Segments whose phones come twenty times as fast, so that some clips have the length of a reference."""
    def faster(p):
        return p.withField("start_sec", p["start_sec"] / 20).withField("end_sec", p["end_sec"] / 20)

    return v.phoned_segments(spark, sf_dir).withColumn("phonemes", F.transform("phonemes", faster))


@query("cmp_13_supplement_plan", "segments phonemes edits", PRINT + PLAN + """SELECT speaker_id, CASE WHEN problem IS NULL THEN reference_segment_id END AS reference_segment_id, CASE WHEN problem IS NULL THEN missing END AS missing,
  CASE WHEN problem IS NULL THEN reference_sha256 END AS reference_sha256, CASE WHEN problem IS NULL THEN fingerprint END AS snapshot_fingerprint, problem FROM pl, fp""")
def supplement_plan(spark, sf_dir):
    plans, problems = c.supplement_plans(_quick(spark, sf_dir), snapshot_print(spark, sf_dir))
    return plans.withColumn("missing", F.array_join("missing", ",")).unionByName(problems, allowMissingColumns=True)


# A small fixed list of sentences with their phones, standing in for the phonemized prompt list.
PROMPTS = [
    ("pa pa ky a", ["p", "a", "p", "a", "ky", "a"]), ("gy u u ny u u", ["gy", "u", "u", "ny", "u", "u"]), ("sh a sh i N", ["sh", "a", "sh", "i", "N"]), ("ry o k o o ch a", ["ry", "o", "k", "o", "ch", "a"]),
    ("hy a k u py o N", ["hy", "a", "k", "U", "py", "o", "N"]), ("f a i r u v a", ["f", "a", "i", "r", "u", "v", "a"]), ("ty dy ts kw gw", ["ty", "i", "dy", "i", "ts", "u", "kw", "a", "gw", "a"]), ("my a by o j i", ["my", "a", "by", "o", "j", "i"]),
]


_LIST = "[" + ", ".join(f"{{'i': {i}, 'phones': {list(dict.fromkeys(p.lower() if p in ('I', 'U') else p for p in phones))}}}" for i, (_, phones) in enumerate(PROMPTS)) + "]"
#: Greedy choice as a recursion: in each round the sentence with the most uncovered phones, of equals the first.
CHOICE = """, picks(speaker_id, missing, chosen, round) AS (SELECT speaker_id, string_split(missing, ','), CAST([] AS VARCHAR[]), 0 FROM pl WHERE missing IS NOT NULL
  UNION ALL SELECT speaker_id, CASE WHEN best.n = 0 THEN missing ELSE list_filter(missing, lambda x: NOT list_contains(best.t, x)) END,
    CASE WHEN best.n = 0 THEN chosen ELSE list_append(chosen, concat(best.i, ':', array_to_string(best.t, '+'))) END, round + 1
  FROM (SELECT *, list_sort(list_transform(""" + _LIST + """, lambda p: {'n': -len(list_intersect(p.phones, missing)), 'i': p.i, 't': list_sort(list_intersect(p.phones, missing))}))[1] AS best FROM picks WHERE round < 4))
"""


@query("cmp_14_prompts", sql=v.with_views(
    "segments phonemes", PLAN + CHOICE + "SELECT speaker_id, array_to_string(chosen, ' ') AS picks, array_to_string(list_sort(missing), ',') AS uncovered FROM picks WHERE round = 4",
).replace("WITH", "WITH RECURSIVE", 1))
def prompts(spark, sf_dir):
    return c.choose_prompts(c.supplement_needs(_quick(spark, sf_dir)).where("size(missing) > 0").select("speaker_id", "missing"), PROMPTS, 4).select("speaker_id", F.array_join(F.transform("picks", lambda p: F.concat(p["prompt"].cast("string"), F.lit(":"), F.array_join(p["targets"], "+"))), " ").alias("picks"), F.array_join("uncovered", ",").alias("uncovered"))


#: The clips of the frames are those of the documents of the same number.
_CLIP = "concat('seg_', lpad(substr(segment_id, 6), 8, '0'))"


@query("cmp_4_corrected_view", "segments edits candidates phonemes frames clip_phones", APPLIED + TRIAGE.replace("kept AS", "kept4 AS") + GAPS + CAND + LOG + f""", pit AS (SELECT {_CLIP} AS segment_id, avg(f0) FILTER (f0 > 0) AS m FROM fil WHERE segment_id IN (SELECT segment_id FROM fil WHERE filled) GROUP BY ALL)
SELECT k.segment_id, k.speaker_id, k.content_type, sha256(CASE WHEN st = 'applied' THEN ta ELSE k.transcript END) AS transcript, round(CASE WHEN st = 'applied' THEN conf ELSE k.asr_confidence END, 9) AS asr_confidence,
  CASE WHEN st = 'applied' THEN 'transcript-review-estimated' ELSE k.alignment_method END AS alignment_method, round(coalesce(pit.m, k.mean_f0_hz), 6) AS mean_f0_hz FROM kept4 k LEFT JOIN ap USING (segment_id) LEFT JOIN pit ON pit.segment_id = k.segment_id
UNION ALL SELECT concat('generated_', candidate_id), speaker_id, 'speech', sha256(concat('say ', rare_phone)), NULL, NULL, NULL FROM acc JOIN cp USING (speaker_id, candidate_id) WHERE len(problems) = 0""")
def corrected_view(spark, sf_dir):
    """Reviews that passed, pitch of clips with filled gaps, and the accepted supplements, in one view."""
    filled = c.resummarize(c.filled_frames(*_decided(spark, sf_dir))).withColumn("segment_id", F.expr(_CLIP))
    out = c.corrected_view(v.segments(spark, sf_dir), _applied(spark, sf_dir)[0], filled, _generated(spark, sf_dir)[0])
    return out.select("segment_id", "speaker_id", "content_type", F.sha2("transcript", 256).alias("transcript"), F.round("asr_confidence", 9).alias("asr_confidence"), "alignment_method", F.round("mean_f0_hz", 6).alias("mean_f0_hz"))


@query("cmp_4_observed_only", "segments", "SELECT segment_id, speaker_id, 'observed' AS state, 'observed-only' AS method, 'not_required' AS application_status, 1e0 AS confidence, 'correction_off' AS reason FROM segments")
def observed_only(spark, sf_dir):
    return c.observed_records(v.segments(spark, sf_dir))
