"""Queries of routing, eligibility, rarity, quality and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.functions.measure import valid_singing_alignment
from voxloom.operators import routing, weights
from voxloom.plans import views as v
from voxloom.plans.registry import query
from voxloom.session import durable


def eligible_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with alignment validity, observed phones and pitch bins, phones already folded away.

    Rarity, means and weights read this table several times, and folding the phones is the costly
    part, so the narrow result is written once.
    """
    segs = v.with_phones(v.segments(spark, sf_dir), v.WELL_TIMED | v.KNOWN, ("phonemes", "transcript")).withColumn(
        "f0_values", F.array(F.col("mean_f0_hz"), F.col("mean_f0_hz") + F.col("f0_std_dev_hz"), F.lit(0.0))
    )
    return durable(
        segs.withColumn("valid_alignment", valid_singing_alignment(well_timed=F.col("_well_timed")))
        .withColumn("phones", weights.observed_phones(known=F.col("_known")))
        .withColumn("bins", weights.observed_bins())
        .drop("_well_timed", "_known", "f0_values")
    )


def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.assess(routing.eligibility(eligible_input(spark, sf_dir)))


def _routed(spark, sf_dir):
    return routing.route(
        v.segments(spark, sf_dir).select("segment_id", "speaker_id", "user_excluded"),
        v.content_classes(spark, sf_dir), v.content_overrides(spark, sf_dir),
    )


ROUTED = """, last_class AS (SELECT segment_id, arg_max(content_type, position) AS content_type, arg_max(confidence, position) AS confidence,
    arg_max(user_overridden, position) AS user_overridden FROM content_classes GROUP BY segment_id),
  first_override AS (SELECT segment_id, arg_min(original_type, seq) AS original_type FROM content_overrides GROUP BY segment_id),
  routed0 AS (SELECT s.segment_id, s.speaker_id, s.user_excluded, c.segment_id IS NOT NULL AS has_class, c.content_type, c.confidence,
    coalesce(c.user_overridden, false) OR o.segment_id IS NOT NULL AS manual, o.original_type
    FROM segments s LEFT JOIN last_class c ON s.segment_id = c.segment_id LEFT JOIN first_override o ON s.segment_id = o.segment_id),
  routed AS (SELECT segment_id, speaker_id,
    CASE WHEN user_excluded THEN 'excluded' WHEN NOT has_class THEN 'review' WHEN content_type = 'speech' THEN 'primary'
      WHEN content_type = 'singing' THEN CASE WHEN speaker_id IS NOT NULL THEN 'feature_only' ELSE 'excluded' END ELSE 'review' END AS talk_role,
    CASE WHEN user_excluded THEN 'excluded' WHEN NOT has_class THEN 'review' WHEN content_type = 'singing' THEN 'primary'
      WHEN content_type = 'speech' THEN CASE WHEN speaker_id IS NOT NULL THEN 'feature_only' ELSE 'excluded' END ELSE 'review' END AS singing_role,
    CASE WHEN user_excluded THEN 'user_excluded' WHEN NOT has_class THEN 'classification_missing' WHEN content_type = 'speech' THEN NULL
      WHEN content_type = 'singing' THEN CASE WHEN speaker_id IS NOT NULL THEN 'speaker_reference' ELSE 'speaker_unconfirmed' END ELSE 'ambiguous_content' END AS talk_reason,
    CASE WHEN user_excluded THEN 'user_excluded' WHEN NOT has_class THEN 'classification_missing' WHEN content_type = 'singing' THEN NULL
      WHEN content_type = 'speech' THEN CASE WHEN speaker_id IS NOT NULL THEN 'speaker_reference' ELSE 'speaker_unconfirmed' END ELSE 'ambiguous_content' END AS singing_reason,
    CASE WHEN manual THEN 'manual' ELSE 'automatic' END AS classification_origin,
    CASE WHEN manual THEN original_type END AS original_content_type,
    CASE WHEN has_class AND NOT manual AND confidence > 0 THEN confidence END AS classification_confidence,
    CASE WHEN manual OR NOT has_class THEN 'unavailable' WHEN confidence > 0 THEN 'measured' ELSE 'legacy_unknown' END AS classification_confidence_status
    FROM routed0)
"""


@query("rte_1_usage_routing", "segments content_classes content_overrides", ROUTED + """
SELECT *, CASE WHEN talk_role IN ('primary', 'feature_only') THEN 'eligible' WHEN talk_role = 'review' THEN 'needs_review' ELSE 'excluded' END AS talk_status,
  CASE WHEN singing_role IN ('primary', 'feature_only') THEN 'eligible' WHEN singing_role = 'review' THEN 'needs_review' ELSE 'excluded' END AS singing_status
FROM routed""")
def usage_routing(spark, sf_dir):
    return _routed(spark, sf_dir).drop("user_excluded")


@query("rte_2_role_counts", "segments content_classes content_overrides", ROUTED + """
, long AS (SELECT speaker_id, 'talk' AS target, talk_role AS role FROM routed UNION ALL SELECT speaker_id, 'singing', singing_role FROM routed)
SELECT speaker_id, target, count(*) FILTER (role = 'primary') AS "primary", count(*) FILTER (role = 'feature_only') AS feature_only,
  count(*) FILTER (role = 'review') AS review, count(*) FILTER (role = 'excluded') AS excluded FROM long GROUP BY ALL""")
def role_counts(spark, sf_dir):
    return routing.role_counts(_routed(spark, sf_dir))


DECIDED = """, decided0 AS (
  SELECT s.*, a.valid_alignment, t.target, speaker_id IS NULL OR wrong_speaker OR user_excluded AS shared,
    list_filter([CASE WHEN user_excluded THEN 'user_excluded' END, CASE WHEN wrong_speaker THEN 'wrong_speaker' END,
      CASE WHEN NOT audio_readable THEN 'unreadable_audio' END,
      CASE WHEN audio_readable AND voiced_ratio = 0 AND voicing_path <> '' THEN 'no_usable_voice' END], lambda x: x IS NOT NULL) AS removed,
    list_filter([CASE WHEN speaker_id IS NULL AND NOT wrong_speaker THEN 'speaker_unconfirmed' END,
      CASE WHEN NOT ((t.target = 'talk' AND content_type = 'speech') OR (t.target = 'singing' AND content_type = 'singing')) THEN 'wrong_content_type' END,
      CASE WHEN t.target = 'singing' AND NOT a.valid_alignment THEN 'alignment_required' END], lambda x: x IS NOT NULL) AS open_points
  FROM segments s JOIN aligned a ON s.segment_id = a.segment_id CROSS JOIN (VALUES ('talk'), ('singing')) t(target)),
 decided AS (SELECT *, list_concat(removed, open_points) AS reason_codes,
   CASE WHEN len(removed) > 0 THEN 'excluded' WHEN len(open_points) > 0 THEN 'needs_review' ELSE 'eligible' END AS eligibility FROM decided0)
"""


@query("rte_3_eligibility", "segments aligned", DECIDED + """
SELECT segment_id, speaker_id, target, shared, eligibility, array_to_string(reason_codes, ',') AS reason_codes FROM decided""")
def eligibility(spark, sf_dir):
    return routing.eligibility(eligible_input(spark, sf_dir)).select(
        "segment_id", "speaker_id", "target", "shared", "eligibility", F.array_join("reason_codes", ",").alias("reason_codes")
    )


@query("rte_4_primary_reasons", "segments aligned", DECIDED + """
, jobs AS (SELECT DISTINCT speaker_id, target FROM decided WHERE speaker_id IS NOT NULL)
SELECT j.speaker_id, j.target, d.reason_codes[1] AS primary_reason, count(*) AS n
FROM jobs j JOIN decided d ON d.target = j.target AND (d.shared OR d.speaker_id = j.speaker_id)
WHERE len(d.reason_codes) > 0 GROUP BY ALL""")
def primary_reasons(spark, sf_dir):
    return routing.primary_reason_counts(routing.eligibility(eligible_input(spark, sf_dir)))


@query("rte_4_eligible_counts", "segments aligned", DECIDED + """
, jobs AS (SELECT DISTINCT speaker_id, target FROM decided WHERE speaker_id IS NOT NULL)
SELECT j.speaker_id, j.target, count(*) AS candidates, count(*) FILTER (d.eligibility = 'eligible') AS eligible_count,
  count(*) FILTER (d.eligibility = 'eligible') = 0 AS no_usable_segments
FROM jobs j JOIN decided d ON d.target = j.target AND (d.shared OR d.speaker_id = j.speaker_id) GROUP BY ALL""")
def eligible_counts(spark, sf_dir):
    return routing.eligible_summary(routing.eligibility(eligible_input(spark, sf_dir)))


KNOWN = """, known_phones AS (SELECT unnest(['a','i','u','e','o','k','s','t','n','h','m','y','r','w','g','z','d','b','p','N','cl',
  'ky','gy','sh','j','ch','ny','hy','by','py','my','ry','f','v','ts','ty','dy','kw','gw']) AS phoneme),
 observed AS (SELECT DISTINCT p.segment_id, p.phoneme FROM phonemes p JOIN segments s ON s.segment_id = p.segment_id JOIN known_phones k ON k.phoneme = p.phoneme
  WHERE s.alignment_method <> 'legacy-uniform-placeholder' AND s.alignment_status NOT IN ('unavailable', 'invalid') AND p.start_sec >= 0 AND p.end_sec > p.start_sec),
 bins AS (SELECT DISTINCT segment_id, pitch_bin FROM (
   SELECT segment_id, CAST(floor(12 * log2(f / 55e0) / 6e0) AS INTEGER) AS pitch_bin FROM (
     SELECT segment_id, unnest([mean_f0_hz, mean_f0_hz + f0_std_dev_hz]) AS f FROM segments WHERE pitch_reliability > 0) WHERE f > 0))
"""
UTILITY = KNOWN + DECIDED + """
, elig AS (SELECT * FROM decided WHERE eligibility = 'eligible'),
 ph AS (SELECT e.speaker_id, e.target, e.segment_id, o.phoneme AS item FROM elig e JOIN observed o ON o.segment_id = e.segment_id),
 bn AS (SELECT e.speaker_id, e.target, e.segment_id, b.pitch_bin AS item FROM elig e JOIN bins b ON b.segment_id = e.segment_id WHERE e.target = 'singing'),
 phs AS (SELECT segment_id, target, max(1 / sqrt(n)) AS score, bool_or(n = 1) AS rare FROM (SELECT *, count(*) OVER (PARTITION BY speaker_id, target, item) AS n FROM ph) GROUP BY ALL),
 bns AS (SELECT segment_id, target, max(1 / sqrt(n)) AS score FROM (SELECT *, count(*) OVER (PARTITION BY speaker_id, target, item) AS n FROM bn) GROUP BY ALL),
 util AS (SELECT e.speaker_id, e.segment_id, e.target,
   CASE WHEN p.score IS NOT NULL AND b.score IS NOT NULL THEN (p.score + b.score) / 2 ELSE coalesce(p.score, b.score) END AS utility_value, coalesce(p.rare, false) AS rare
   FROM elig e LEFT JOIN phs p ON p.segment_id = e.segment_id AND p.target = e.target LEFT JOIN bns b ON b.segment_id = e.segment_id AND b.target = e.target)
"""


@query("wgt_1_observed_phones", "segments phonemes", KNOWN + "SELECT segment_id, phoneme FROM observed")
def observed_phones(spark, sf_dir):
    rows = v.with_phones(v.segments(spark, sf_dir), v.KNOWN, ("phonemes", "transcript"))
    return rows.select("segment_id", F.explode(weights.observed_phones(known=F.col("_known"))).alias("phoneme"))


@query("wgt_2_pitch_bins", "frames", """
SELECT DISTINCT segment_id, CAST(floor(12 * log2(f0 / 55e0) / 6e0) AS INTEGER) AS pitch_bin FROM frames WHERE f0 > 0""")
def pitch_bins(spark, sf_dir):
    return weights.frame_bins(v.frames(spark, sf_dir))


@query("wgt_3_rarity_utility", "segments aligned phonemes", UTILITY + """
SELECT segment_id, target, round(utility_value, 6) AS utility_value, CASE WHEN utility_value IS NULL THEN 'unavailable' ELSE 'measured' END AS utility_status,
  CASE WHEN rare THEN 'rare_phoneme' ELSE '' END AS utility_reasons FROM util""")
def rarity_utility(spark, sf_dir):
    return weights.utility(routing.eligibility(eligible_input(spark, sf_dir))).select(
        "segment_id", "target", F.round("utility_value", 6).alias("utility_value"), "utility_status",
        F.array_join("utility_reasons", ",").alias("utility_reasons"),
    )


QUALITY = """, components AS (
  SELECT segment_id, target, 'asr_confidence' AS name, CASE WHEN m THEN asr_confidence END AS value, CASE WHEN m THEN 'measured' ELSE asr_status END AS status FROM (
    SELECT *, CASE asr_status WHEN 'measured' THEN true WHEN 'legacy_unknown' THEN asr_confidence > 0 ELSE false END AS m FROM decided)
  UNION ALL
  SELECT segment_id, target, 'alignment_confidence', CASE WHEN m THEN alignment_confidence END, CASE WHEN placeholder THEN 'unavailable' WHEN m THEN 'measured' ELSE alignment_status END FROM (
    SELECT *, alignment_method = 'legacy-uniform-placeholder' AS placeholder,
      alignment_method <> 'legacy-uniform-placeholder' AND alignment_status = 'measured' AS m FROM decided)
  UNION ALL SELECT segment_id, target, 'f0_reliability', NULL, 'legacy_unknown' FROM decided WHERE target = 'singing'),
 quality AS (SELECT segment_id, target, avg(value) FILTER (status = 'measured') AS quality_value,
   string_agg(concat(name, ':', status), ',' ORDER BY name) AS components FROM components GROUP BY ALL)
"""


@query("wgt_4_quality", "segments aligned", DECIDED + QUALITY + """
SELECT segment_id, target, round(quality_value, 6) AS quality_value, CASE WHEN quality_value IS NULL THEN 'unavailable' ELSE 'measured' END AS quality_status, components FROM quality""")
def quality(spark, sf_dir):
    segs = v.segments(spark, sf_dir).withColumn("target", F.explode(F.array(F.lit("talk"), F.lit("singing"))))
    return segs.withColumn("components", weights.quality_components()).withColumn("q", weights.quality_value()).select(
        "segment_id", "target", F.round("q", 6).alias("quality_value"),
        F.when(F.col("q").isNotNull(), "measured").otherwise("unavailable").alias("quality_status"),
        F.array_join(F.array_sort(F.transform(F.map_entries("components"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["status"]))), ",").alias("components"),
    )


ASSESSED = UTILITY + QUALITY + """
, raws AS (SELECT d.segment_id, d.speaker_id, d.target, d.shared, d.eligibility, d.reason_codes, q.quality_value, u.utility_value, coalesce(u.rare, false) AS rare,
   (35e-2 + 65e-2 * coalesce(q.quality_value, 5e-1)) * (1 + 75e-2 * coalesce(u.utility_value, 5e-1)) AS raw
   FROM decided d JOIN quality q ON q.segment_id = d.segment_id AND q.target = d.target
   LEFT JOIN util u ON u.segment_id = d.segment_id AND u.target = d.target),
 assessed AS (SELECT *, CASE WHEN eligibility = 'eligible' THEN raw ELSE 0 END AS raw_weight,
   CASE WHEN eligibility = 'eligible' THEN least(greatest(raw / avg(raw) FILTER (eligibility = 'eligible') OVER (PARTITION BY speaker_id, target), 25e-2), 2e0) ELSE 0 END AS training_weight FROM raws)
"""


@query("wgt_5_weights", "segments aligned phonemes", ASSESSED + """
SELECT segment_id, target, round(raw_weight, 9) AS raw_weight, round(training_weight, 9) AS training_weight FROM assessed""")
def training_weights(spark, sf_dir):
    return assessment(spark, sf_dir).select(
        "segment_id", "target", F.round("raw_weight", 9).alias("raw_weight"), F.round("training_weight", 9).alias("training_weight")
    )


@query("wgt_6_assessment", "segments aligned phonemes", ASSESSED + """
SELECT speaker_id, target, segment_id, shared, eligibility, array_to_string(reason_codes, ',') AS reason_codes, round(quality_value, 6) AS quality_value,
  CASE WHEN quality_value IS NULL THEN 'unavailable' ELSE 'measured' END AS quality_status, round(utility_value, 6) AS utility_value,
  CASE WHEN utility_value IS NULL THEN 'unavailable' ELSE 'measured' END AS utility_status, CASE WHEN rare THEN 'rare_phoneme' ELSE '' END AS utility_reasons,
  round(training_weight, 9) AS training_weight FROM assessed""")
def assessment_items(spark, sf_dir):
    return assessment(spark, sf_dir).select(
        "speaker_id", "target", "segment_id", "shared", "eligibility", F.array_join("reason_codes", ",").alias("reason_codes"),
        F.round("quality_value", 6).alias("quality_value"), "quality_status", F.round("utility_value", 6).alias("utility_value"), "utility_status",
        F.array_join("utility_reasons", ",").alias("utility_reasons"), F.round("training_weight", 9).alias("training_weight"),
    )


def stored_items(spark, sf_dir):
    """A stored assessment with one broken rule here and there, positioned per job."""
    s = v.segments(spark, sf_dir)
    i = F.col("doc_id")
    return s.select(
        F.concat(F.lit("job_"), F.col("source_id")).alias("job_id"),
        F.expr("doc_id div 20").alias("position"),
        F.when(i % 61 == 0, F.lit("zz")).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(i % 53 == 0, "maybe").when(i % 2 == 0, "eligible").otherwise("excluded").alias("eligibility"),
        F.when(i % 47 == 0, "lead").when(i % 3 == 0, "primary").alias("role"), F.lit("talk").alias("target"),
        F.when(i % 43 == 0, F.array(F.lit("too_quiet"))).when(i % 41 == 0, F.array(F.lit("wrong_speaker"), F.lit("wrong_speaker")))
        .otherwise(F.array().cast("array<string>")).alias("reason_codes"),
        F.when(i % 37 == 0, 1.5).when(i % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("asr_confidence")).alias("quality_value"),
        F.when(i % 5 == 0, F.when(i % 10 == 0, "measured").otherwise("unavailable")).otherwise("measured").alias("quality_status"),
        F.when(i % 7 == 0, 0.5).alias("utility_value"), F.when(i % 14 == 0, "unavailable").when(i % 7 == 0, "measured").otherwise("unavailable").alias("utility_status"),
        F.when(i % 31 == 0, -1.0).otherwise(1.0).alias("raw_weight"),
        F.when(i % 2 == 0, F.when(i % 29 == 0, 0.0).otherwise(1.0)).otherwise(F.when(i % 23 == 0, 0.5).otherwise(0.0)).alias("training_weight"),
    )


@query("wgt_7_assessment_audit", "segments", """, stored AS (
  SELECT concat('job_', source_id) AS job_id, doc_id // 20 AS position, CASE WHEN doc_id % 61 = 0 THEN 'zz' ELSE segment_id END AS segment_id,
    CASE WHEN doc_id % 53 = 0 THEN 'maybe' WHEN doc_id % 2 = 0 THEN 'eligible' ELSE 'excluded' END AS eligibility,
    CASE WHEN doc_id % 47 = 0 THEN 'lead' WHEN doc_id % 3 = 0 THEN 'primary' END AS role, doc_id % 43 = 0 AS strange, doc_id % 43 <> 0 AND doc_id % 41 = 0 AS twice,
    CASE WHEN doc_id % 37 = 0 THEN 15e-1 WHEN doc_id % 5 = 0 THEN NULL ELSE asr_confidence END AS qv,
    CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 0 THEN 'unavailable' ELSE 'measured' END AS qs,
    CASE WHEN doc_id % 7 = 0 THEN 5e-1 END AS uv, CASE WHEN doc_id % 14 = 0 THEN 'unavailable' WHEN doc_id % 7 = 0 THEN 'measured' ELSE 'unavailable' END AS us,
    CASE WHEN doc_id % 31 = 0 THEN -1e0 ELSE 1e0 END AS rw,
    CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 29 = 0 THEN 0e0 ELSE 1e0 END ELSE CASE WHEN doc_id % 23 = 0 THEN 5e-1 ELSE 0e0 END END AS w FROM segments),
 ranked AS (SELECT *, lag(segment_id) OVER (PARTITION BY job_id ORDER BY position) AS prev, count(*) OVER (PARTITION BY job_id, segment_id) AS n FROM stored)
SELECT job_id, segment_id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN prev > segment_id THEN 'not_ascending' END,
  CASE WHEN eligibility = 'maybe' THEN 'eligibility_vocabulary' END, CASE WHEN role = 'lead' THEN 'role_vocabulary' END,
  CASE WHEN strange THEN 'reason_vocabulary' END, CASE WHEN twice THEN 'reason_repeated' END,
  CASE WHEN qv > 1 THEN 'quality_status_range' END, CASE WHEN qs = 'measured' AND qv IS NULL THEN 'quality_status_measured_without_value' END,
  CASE WHEN qs = 'unavailable' AND qv IS NOT NULL THEN 'quality_status_unavailable_with_value' END,
  CASE WHEN us = 'unavailable' AND uv IS NOT NULL THEN 'utility_status_unavailable_with_value' END,
  CASE WHEN rw < 0 THEN 'raw_weight_range' END, CASE WHEN eligibility = 'eligible' AND w = 0 THEN 'eligible_without_weight' END,
  CASE WHEN eligibility <> 'eligible' AND w <> 0 THEN 'weight_without_eligibility' END], lambda x: x IS NOT NULL)) AS problem FROM ranked""")
def assessment_audit(spark, sf_dir):
    return weights.assessment_problems(stored_items(spark, sf_dir))


@query("wgt_8_assessment_summary", "segments aligned phonemes", ASSESSED + """
, jobs AS (SELECT DISTINCT speaker_id, target FROM decided WHERE speaker_id IS NOT NULL)
SELECT j.speaker_id, j.target, CASE WHEN a.eligibility = 'excluded' THEN 'excluded' WHEN a.eligibility = 'needs_review' THEN 'review'
  WHEN a.quality_value < 5e-1 AND a.training_weight > 0 THEN 'adopted_low_quality' ELSE 'adopted' END AS label, count(*) AS n
FROM jobs j JOIN assessed a ON a.target = j.target AND (a.shared OR a.speaker_id = j.speaker_id) GROUP BY ALL""")
def assessment_summary(spark, sf_dir):
    items = assessment(spark, sf_dir)
    return routing._per_job(items, weights.assessment_label(), routing.jobs_of(v.segments(spark, sf_dir)))
