"""Queries of phone, kana and singing coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.vocabulary import KANA_PHONES
from voxloom.operators import coverage as c
from voxloom.plans import views as v
from voxloom.plans.registry import query
from voxloom.session import durable

SCOPED = """, scopes AS (SELECT 'all' AS scope, '' AS speaker_id, '' AS content_type
   UNION ALL SELECT DISTINCT 'speaker', speaker_id, '' FROM segments WHERE speaker_id IS NOT NULL
   UNION ALL SELECT DISTINCT 'speaker_type', speaker_id, t FROM segments CROSS JOIN (VALUES ('speech'), ('singing')) k(t) WHERE speaker_id IS NOT NULL),
 member AS (SELECT 'all' AS scope, '' AS speaker_id, '' AS content_type, segment_id FROM segments
   UNION ALL SELECT 'speaker', speaker_id, '', segment_id FROM segments WHERE speaker_id IS NOT NULL
   UNION ALL SELECT 'speaker_type', speaker_id, content_type, segment_id FROM segments WHERE speaker_id IS NOT NULL AND content_type <> 'ambiguous'),
 counts AS (SELECT scope, speaker_id, content_type, phoneme, CAST(sum(n) AS BIGINT) AS n FROM member JOIN
   (SELECT segment_id, phoneme, count(*) AS n FROM phonemes GROUP BY ALL) p USING (segment_id) GROUP BY ALL)
"""
CORE = "unnest(['a','i','u','e','o','k','s','t','n','h','m','y','r','w','g','z','d','b','p','N','cl'])"
GAPS = f""", core AS (SELECT {CORE} AS phoneme),
 gaps AS (SELECT s.*, core.phoneme, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' ELSE 'low' END AS level
   FROM scopes s CROSS JOIN core LEFT JOIN counts USING (scope, speaker_id, content_type, phoneme) WHERE coalesce(n, 0) < 3)
"""
CATEGORIES = """, expected AS (SELECT category, unnest(ps) AS phoneme, len(ps) AS expected FROM (VALUES
    ('palatalized', ['ky','gy','sh','j','ch','ny','hy','by','py','my','ry']), ('voiced', ['g','z','d','b']), ('semi_voiced', ['p']),
    ('special', ['cl','N',':']), ('foreign', ['f','v','ts','ty','dy','kw','gw'])) x(category, ps)),
 categories AS (SELECT scope, speaker_id, content_type, category, expected, count(n) AS observed, count(n) / expected AS ratio FROM scopes CROSS JOIN expected
   LEFT JOIN counts USING (scope, speaker_id, content_type, phoneme) GROUP BY scope, speaker_id, content_type, category, expected)
"""


def _segs(spark, sf_dir):
    return v.phoned_segments(spark, sf_dir).select("segment_id", "speaker_id", "content_type", "mean_f0_hz", "pitch_reliability", "phonemes")


def _texts(spark, sf_dir):
    return v.segments(spark, sf_dir).select("doc_id", "speaker_id", "content_type", F.lower("transcript").alias("_lower"))


def _both(spark, sf_dir):
    return v.segments(spark, sf_dir), durable(c.phone_counts(_texts(spark, sf_dir), v.folded_phones))


@query("cov_1_phone_coverage", "segments phonemes", SCOPED + """SELECT scope, speaker_id, content_type, coalesce(phoneme, '') AS phoneme, coalesce(n, 0) AS n
  FROM scopes LEFT JOIN counts USING (scope, speaker_id, content_type)""")
def phone_coverage(spark, sf_dir):
    segs, counts = _both(spark, sf_dir)
    return c.scopes_of(segs).join(counts, c.SCOPE, "left").na.fill({"phoneme": "", "n": 0})


@query("cov_1_scope_totals", "segments phonemes", SCOPED + """SELECT scope, speaker_id, content_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS phone_total, count(n) AS phone_kinds
  FROM scopes LEFT JOIN counts USING (scope, speaker_id, content_type) GROUP BY ALL""")
def scope_totals(spark, sf_dir):
    return c.scope_summary(*_both(spark, sf_dir))


@query("cov_2_phone_contexts", "segments phonemes", SCOPED + """, tri AS (SELECT segment_id, concat(coalesce(lag(phoneme) OVER w, '<BOS>'), '|', phoneme, '|', coalesce(lead(phoneme) OVER w, '<EOS>')) AS context
    FROM phonemes WINDOW w AS (PARTITION BY segment_id ORDER BY pos))
  SELECT scope, speaker_id, content_type, context, CAST(sum(n) AS BIGINT) AS n FROM member JOIN (SELECT segment_id, context, count(*) AS n FROM tri GROUP BY ALL) t USING (segment_id) GROUP BY ALL""")
def phone_contexts(spark, sf_dir):
    return c.context_counts(_texts(spark, sf_dir), v.folded_phones)


@query("cov_3_core_gaps", "segments phonemes", SCOPED + GAPS + "SELECT * FROM gaps")
def core_gaps(spark, sf_dir):
    return c.core_gaps(*_both(spark, sf_dir))


@query("cov_4_categories", "segments phonemes", SCOPED + CATEGORIES + """SELECT scope, speaker_id, content_type, category, expected, observed, round(ratio, 9) AS ratio,
  CASE WHEN ratio >= 8e-1 THEN 'good' WHEN ratio >= 5e-1 THEN 'warning' ELSE 'missing' END AS quality FROM categories""")
def category_ratios(spark, sf_dir):
    return c.categories(*_both(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query("cov_5_kana", "segments phonemes", SCOPED + ", kana AS (SELECT kana, phoneme_key, unnest(string_split(phoneme_key, ' ')) AS phoneme FROM (VALUES "
       + ", ".join(f"('{k}', '{p}')" for k, p in KANA_PHONES.items()) + """) x(kana, phoneme_key))
  SELECT scope, speaker_id, content_type, kana, phoneme_key, min(coalesce(n, 0)) AS n,
    CASE WHEN min(coalesce(n, 0)) = 0 THEN 'missing' WHEN min(coalesce(n, 0)) < 3 THEN 'warning' ELSE 'good' END AS quality
  FROM scopes CROSS JOIN kana LEFT JOIN counts USING (scope, speaker_id, content_type, phoneme) GROUP BY ALL""")
def kana(spark, sf_dir):
    return c.kana_counts(*_both(spark, sf_dir))


@query("cov_6_overall", "segments phonemes", SCOPED + GAPS + CATEGORIES + """
 , g AS (SELECT scope, speaker_id, content_type, count(*) FILTER (level = 'missing') AS missing, count(*) FILTER (level = 'low') AS low FROM gaps GROUP BY ALL),
 w AS (SELECT scope, speaker_id, content_type, count(*) FILTER (ratio < 8e-1) AS weak_categories FROM categories GROUP BY ALL)
 SELECT scope, speaker_id, content_type, coalesce(missing, 0) AS missing, coalesce(low, 0) AS low, weak_categories,
   CASE WHEN coalesce(missing, 0) >= 5 THEN 'missing' WHEN coalesce(missing, 0) + coalesce(low, 0) + weak_categories > 0 THEN 'warning' ELSE 'good' END AS quality
 FROM scopes LEFT JOIN g USING (scope, speaker_id, content_type) LEFT JOIN w USING (scope, speaker_id, content_type)""")
def overall(spark, sf_dir):
    return c.overall(*_both(spark, sf_dir))


SINGING = """, per AS (SELECT s.segment_id, s.speaker_id, mean_f0_hz, pitch_reliability,
    CASE WHEN mean_f0_hz <= 0 THEN 'mid' WHEN mean_f0_hz < 165 THEN 'low' WHEN mean_f0_hz >= 330 THEN 'high' ELSE 'mid' END AS range,
    coalesce(max(end_sec), 0) AS seconds, count(*) FILTER (phoneme IN ('a','i','u','e','o') AND end_sec - start_sec >= 3e-1) AS sustained,
    coalesce(sum(end_sec - start_sec) FILTER (phoneme IN ('a','i','u','e','o') AND end_sec - start_sec >= 3e-1), 0) AS sustained_sec,
    count(*) FILTER (phoneme = 'a') AS v_a, count(*) FILTER (phoneme = 'i') AS v_i, count(*) FILTER (phoneme = 'u') AS v_u,
    count(*) FILTER (phoneme = 'e') AS v_e, count(*) FILTER (phoneme = 'o') AS v_o
  FROM segments s LEFT JOIN phonemes p ON p.segment_id = s.segment_id WHERE content_type = 'singing' GROUP BY ALL),
 scoped AS (SELECT *, '' AS who FROM per UNION ALL SELECT *, speaker_id FROM per WHERE speaker_id IS NOT NULL),
 sums AS (SELECT who AS speaker_id, count(*) AS segment_count, sum(seconds) AS total_sec, min(CASE WHEN mean_f0_hz > 0 THEN mean_f0_hz END) AS lo,
   max(CASE WHEN mean_f0_hz > 0 THEN mean_f0_hz END) AS hi, avg(pitch_reliability) AS reliability,
   sum(CASE WHEN range = 'low' THEN seconds ELSE 0 END) AS low_sec, sum(CASE WHEN range = 'mid' THEN seconds ELSE 0 END) AS mid_sec,
   sum(CASE WHEN range = 'high' THEN seconds ELSE 0 END) AS high_sec, CAST(sum(sustained) AS BIGINT) AS sustained_count, sum(sustained_sec) AS sustained_sec,
   """ + ", ".join(f"CAST(sum(CASE WHEN range = '{r}' THEN v_{x} ELSE 0 END) AS BIGINT) AS vowel_{r}_{x}" for r in ("low", "mid", "high") for x in "aiueo") + """
   FROM scoped GROUP BY who),
 warned AS (SELECT *, list_filter([CASE WHEN lo IS NULL THEN 'no_f0' WHEN hi / greatest(lo, 1) < 15e-1 THEN 'narrow_range' END,
   CASE WHEN low_sec < 5 THEN 'little_low_range' END, CASE WHEN high_sec < 5 THEN 'little_high_range' END,
   CASE WHEN sustained_count < 5 THEN 'few_sustained_vowels' END, CASE WHEN reliability < 6e-1 THEN 'low_reliability' END,
   """ + ", ".join(f"CASE WHEN least({', '.join(f'vowel_{r}_{x}' for x in 'aiueo')}) = 0 THEN 'missing_vowels_{r}' END" for r in ("low", "mid", "high")) + """
   ], lambda x: x IS NOT NULL) AS warnings FROM sums),
 graded AS (SELECT *, CASE WHEN total_sec < 10 OR lo IS NULL THEN 'insufficient' WHEN len(warnings) > 0 THEN 'warning' ELSE 'good' END AS quality FROM warned)
"""


@query("cov_7_singing_scopes", "segments phonemes", SINGING + """SELECT speaker_id, segment_count, round(total_sec, 6) AS total_sec, coalesce(lo, 0) AS min_f0_hz, coalesce(hi, 0) AS max_f0_hz,
  round(reliability, 9) AS pitch_reliability, round(low_sec, 6) AS low_sec, round(mid_sec, 6) AS mid_sec, round(high_sec, 6) AS high_sec, sustained_count, round(sustained_sec, 6) AS sustained_sec,
  """ + ", ".join(f"vowel_{r}_{x}" for r in ("low", "mid", "high") for x in "aiueo") + """,
  round(CASE WHEN sustained_count = 0 THEN 0 ELSE least(greatest(reliability * least(1e0, sustained_sec / 8e0), 0e0), 1e0) END, 9) AS long_tone_quality,
  array_to_string(warnings, ',') AS warnings, quality FROM graded""")
def singing_scopes(spark, sf_dir):
    out = c.singing_scopes(_segs(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", ","))
    for name in ("total_sec", "low_sec", "mid_sec", "high_sec", "sustained_sec"):
        out = out.withColumn(name, F.round(name, 6))
    return out.withColumn("pitch_reliability", F.round("pitch_reliability", 9)).withColumn("long_tone_quality", F.round("long_tone_quality", 9))


@query("cov_7_transitions", "segments phonemes", """, pairs AS (SELECT segment_id, phoneme, lead(phoneme) OVER (PARTITION BY segment_id ORDER BY pos) AS nxt FROM phonemes),
  t AS (SELECT s.speaker_id, concat(p.phoneme, '->', p.nxt) AS transition FROM segments s JOIN pairs p ON p.segment_id = s.segment_id
    WHERE content_type = 'singing' AND p.phoneme NOT IN ('a','i','u','e','o') AND p.nxt IN ('a','i','u','e','o'))
  SELECT '' AS speaker_id, transition, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT speaker_id, transition, count(*) FROM t WHERE speaker_id IS NOT NULL GROUP BY ALL""")
def transitions(spark, sf_dir):
    return c.singing_transitions(_segs(spark, sf_dir))


@query("cov_8_project_grade", "segments phonemes", SINGING + """SELECT count(*) AS scope_count, CASE WHEN bool_or(quality = 'insufficient') THEN 'insufficient'
  WHEN bool_or(quality = 'warning') THEN 'warning' ELSE 'good' END AS overall_quality FROM graded""")
def project_grade(spark, sf_dir):
    return c.project_grade(c.singing_scopes(_segs(spark, sf_dir)))
