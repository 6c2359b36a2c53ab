"""Queries of signal measures, voice activity and content classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import classification as cls, segmentation as seg, signal as sig
from voxloom.operators.sequences import CHUNK, position_in
from voxloom.plans import views as v
from voxloom.plans.registry import query

RATE = 400


def _placed(spark, sf_dir):
    """Samples of one clip per supplier, in order, from whole lineitem."""
    rows = v.table(spark, sf_dir, "lineitem").select(
        F.expr("concat('clip_', cast(l_suppkey as varchar(20)))").alias("clip_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.expr("cast(floor(l_quantity * 65e1) as int) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CASE WHEN l_orderkey % 16 < 6 THEN 0 ELSE 1 END").alias("sample"),
        F.expr("cast(floor(l_discount * 32e4) as int)").alias("other"), F.expr("l_orderkey div 1024").alias("slot"),
    )
    return position_in(rows, ["clip_id"], "slot", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "idx")


def _chunks(spark, sf_dir, sample="sample"):
    rows = _placed(spark, sf_dir).select("clip_id", F.floor(F.col("idx") / CHUNK).alias("chunk"), "idx", F.expr(sample).cast("int").alias("s"))
    return rows.groupBy("clip_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "s"))).alias("x")).select(
        "clip_id", "chunk", F.transform("x", lambda e: e["s"]).alias("samples"), F.lit(RATE).alias("sample_rate")
    )


SAMPLES = """WITH smp AS (SELECT concat('clip_', l_suppkey) AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
   CAST(floor(l_quantity * 65e1) AS INTEGER) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CASE WHEN l_orderkey % 16 < 6 THEN 0 ELSE 1 END AS sample, CAST(floor(l_discount * 32e4) AS INTEGER) AS other FROM lineitem)
"""


@query("sig_1_down_mix", sql=SAMPLES + "SELECT clip_id, idx, CAST(trunc((sample + other) / 2) AS INTEGER) AS mono FROM smp")
def down_mix(spark, sf_dir):
    left = _chunks(spark, sf_dir).withColumnRenamed("samples", "l")
    both = left.join(_chunks(spark, sf_dir, "other").select("clip_id", "chunk", F.col("samples").alias("r")), ["clip_id", "chunk"])
    woven = both.withColumn("w", F.flatten(F.zip_with("l", "r", lambda a, b: F.array(a, b))))
    return woven.select("clip_id", "chunk", F.posexplode(sig.down_mix(F.col("w"), 2)).alias("p", "mono")).select("clip_id", (F.col("chunk") * CHUNK + F.col("p")).alias("idx"), "mono")


WINDOWS = ", win AS (SELECT clip_id, idx // 12 AS idx, sqrt(avg(sample::DOUBLE * sample)) AS rms FROM smp GROUP BY ALL)\n"


@query("sig_2_rms_windows", sql=SAMPLES + WINDOWS + "SELECT clip_id, idx, round(rms, 6) AS rms FROM win")
def rms_windows(spark, sf_dir):
    return sig.rms_windows(_chunks(spark, sf_dir)).withColumn("rms", F.round("rms", 6))


FRAMES = """, size AS (SELECT clip_id, count(*) AS n FROM smp GROUP BY ALL),
 starts AS (SELECT clip_id, unnest(range(0, greatest(0, n - 16 + 1), 4)) AS start FROM size),
 frm AS (SELECT f.clip_id, f.start // 4 AS frame, s.idx, s.sample, lag(s.sample) OVER (PARTITION BY f.clip_id, f.start ORDER BY s.idx) AS prev
   FROM starts f JOIN smp s ON s.clip_id = f.clip_id AND s.idx >= f.start AND s.idx < f.start + 16)
"""


@query("sig_3_frames", sql=SAMPLES + FRAMES + "SELECT clip_id, frame, count(*)::INTEGER AS samples, round(sqrt(avg(sample::DOUBLE * sample)) / 32768e0, 9) AS energy FROM frm GROUP BY ALL")
def frames(spark, sf_dir):
    return sig.frames(_chunks(spark, sf_dir)).select("clip_id", "frame", F.size("samples").alias("samples"), F.round(sig.rms_of(F.col("samples")) / 32768.0, 9).alias("energy"))


@query("sig_4_feature_pitch")
def feature_pitch(spark, sf_dir):
    return sig.with_pitch(sig.frames(_chunks(spark, sf_dir)), sig.feature_pitch)


@query("sig_5_classifier_pitch")
def classifier_pitch(spark, sf_dir):
    return sig.with_pitch(sig.frames(_chunks(spark, sf_dir), hop_sec=0.020), sig.classifier_pitch)


@query("sig_6_zero_crossings", sql=SAMPLES + FRAMES + "SELECT clip_id, frame, round(count(*) FILTER ((prev < 0 AND sample >= 0) OR (prev >= 0 AND sample < 0)) / 15e0, 9) AS zcr FROM frm GROUP BY ALL")
def zero_crossings(spark, sf_dir):
    return sig.frames(_chunks(spark, sf_dir)).select("clip_id", "frame", F.round(sig.zero_crossing_rate(F.col("samples")), 9).alias("zcr"))


@query("sig_7_voicing", "frames", "SELECT segment_id, idx, CASE WHEN f0 > 0 AND (event_id % 100) / 1e2 >= 55e-2 THEN 1e0 ELSE 0e0 END AS voicing FROM frames")
def voicing(spark, sf_dir):
    return v.frames(spark, sf_dir).select("segment_id", "idx", sig.voicing(F.col("f0"), (F.col("event_id") % 100) / 100.0).alias("voicing"))


SUMMARY = """, ranked AS (SELECT segment_id, f0, row_number() OVER (PARTITION BY segment_id ORDER BY f0) AS r, count(*) OVER (PARTITION BY segment_id) AS n FROM frames WHERE f0 > 0),
 ends AS (SELECT segment_id, max(n) AS n, max(f0) FILTER (r = greatest(1, CAST(floor(n * 1e-1) AS BIGINT))) AS lo, max(f0) FILTER (r = least(n, CAST(floor(n * 9e-1) AS BIGINT) + 1)) AS hi FROM ranked GROUP BY ALL),
 summary AS (SELECT f.segment_id, coalesce(avg(f0) FILTER (f0 > 0), 0) AS mean_f0_hz, coalesce(stddev_pop(f0) FILTER (f0 > 0), 0) AS f0_std_dev_hz,
   CASE WHEN max(e.n) >= 2 AND max(hi) > max(lo) THEN 12 * log2(max(hi) / max(lo)) ELSE 0 END AS pitch_range_semitones, coalesce(avg(f0_conf) FILTER (f0 > 0), 0) AS pitch_reliability,
   avg(energy) AS mean_energy, CASE WHEN avg(energy) > 1e-9 THEN stddev_pop(energy) / avg(energy) ELSE 0 END AS energy_variation, avg(CASE WHEN voicing >= 5e-1 THEN 1e0 ELSE 0e0 END) AS voiced_ratio
   FROM frames f LEFT JOIN ends e USING (segment_id) GROUP BY ALL)
"""
_SUM = ("mean_f0_hz", "f0_std_dev_hz", "pitch_range_semitones", "pitch_reliability", "mean_energy", "energy_variation", "voiced_ratio")


@query("sig_8_segment_summary", "frames", SUMMARY + "SELECT segment_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUM) + " FROM summary")
def summary(spark, sf_dir):
    return sig.summarize(v.frames(spark, sf_dir)).select("segment_id", *[F.round(c, 6).alias(c) for c in _SUM])


@query("sig_9_prosody", "frames clip_phones", SUMMARY + """, len AS (SELECT segment_id, count(*) AS phone_count, max(end_sec) AS duration_sec FROM clip_phones GROUP BY ALL)
SELECT segment_id, round(phone_count / greatest(duration_sec, 1e-3), 6) AS speaking_rate, round(pitch_range_semitones, 6) AS pitch_range_semitones, round(energy_variation, 6) AS energy_variation, round(1 - voiced_ratio, 6) AS pause_ratio FROM summary JOIN len USING (segment_id)""")
def prosody(spark, sf_dir):
    lengths = v.clip_phones(spark, sf_dir).groupBy("segment_id").agg(F.count(F.lit(1)).alias("phone_count"), F.max("end_sec").alias("duration_sec"))
    out = sig.prosody(sig.summarize(v.frames(spark, sf_dir)), lengths)
    return out.select("segment_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "segment_id"])


STATS = """, stats AS (SELECT clip_id, count(*) AS n, sqrt(avg(sample::DOUBLE * sample)) / 32768e0 AS rms, max(abs(sample)) / 32768e0 AS peak,
   avg(CASE WHEN abs(sample) >= 32700 THEN 1e0 ELSE 0e0 END) AS clipping_ratio, avg(CASE WHEN abs(sample) <= 180 THEN 1e0 ELSE 0e0 END) AS silence_ratio FROM smp GROUP BY ALL)
"""
NOISE = """, nb AS (SELECT clip_id, count(*) AS n FROM smp GROUP BY ALL),
 blk AS (SELECT clip_id, idx // greatest(1, n // 200) AS b, sqrt(avg(sample::DOUBLE * sample)) AS rms FROM smp JOIN nb USING (clip_id) GROUP BY ALL),
 br AS (SELECT clip_id, rms, row_number() OVER (PARTITION BY clip_id ORDER BY rms) AS r, count(*) OVER (PARTITION BY clip_id) AS k FROM blk),
 bp AS (SELECT clip_id, max(rms) FILTER (r = greatest(1, CAST(floor(k * 1e-1) AS BIGINT))) AS q, max(rms) FILTER (r = greatest(1, CAST(floor(k * 75e-2) AS BIGINT))) AS l FROM br GROUP BY ALL),
 noise AS (SELECT clip_id, CASE WHEN l <= 1 THEN 1e0 ELSE least(1e0, greatest(0e0, q / l * 3e0)) END AS noise_score FROM bp)
"""
REVERB = """, env AS (SELECT clip_id, idx // 2 AS step, abs(sample) AS level FROM smp WHERE idx % 2 = 0),
 pk AS (SELECT clip_id, max(level) AS peak, count(*) AS steps FROM env GROUP BY ALL),
 ld AS (SELECT clip_id, step, steps, peak, level >= peak * 35e-2 AS loud FROM env JOIN pk USING (clip_id)),
 tr AS (SELECT *, max(CASE WHEN loud THEN step END) OVER (PARTITION BY clip_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ld),
 reverb AS (SELECT clip_id, CASE WHEN max(n) >= 200 AND max(steps) >= 20 AND max(peak) > 0 THEN least(1e0, count(*) FILTER (NOT loud AND step - last BETWEEN 1 AND 21) / max(steps) * 2e0) ELSE 0e0 END AS reverb_score
   FROM tr JOIN (SELECT clip_id, count(*) AS n FROM smp GROUP BY ALL) c USING (clip_id) GROUP BY ALL)
"""


@query("sig_10_wave_stats", sql=SAMPLES + STATS + "SELECT clip_id, n AS sample_count, round(n / 4e2, 6) AS duration_sec, round(rms, 9) AS rms, peak, round(clipping_ratio, 9) AS clipping_ratio, round(silence_ratio, 9) AS silence_ratio FROM stats")
def wave_stats(spark, sf_dir):
    return sig.wave_stats(_chunks(spark, sf_dir)).drop("sample_rate").withColumns({c: F.round(c, 9) for c in ("rms", "clipping_ratio", "silence_ratio")}).withColumn("duration_sec", F.round("duration_sec", 6))


@query("sig_11_noise", sql=SAMPLES + NOISE + "SELECT clip_id, round(noise_score, 9) AS noise_score FROM noise")
def noise(spark, sf_dir):
    return sig.noise_scores(_chunks(spark, sf_dir)).withColumn("noise_score", F.round("noise_score", 9))


@query("sig_12_reverb", sql=SAMPLES + REVERB + "SELECT clip_id, round(reverb_score, 9) AS reverb_score FROM reverb")
def reverb(spark, sf_dir):
    return sig.reverb_scores(_chunks(spark, sf_dir)).withColumn("reverb_score", F.round("reverb_score", 9))


@query("sig_13_overall_quality", sql=SAMPLES + STATS + NOISE + REVERB + """, sep AS (SELECT clip_id, sqrt(avg(trunc(sample / 2)::DOUBLE * trunc(sample / 2))) / 32768e0 AS rms FROM smp GROUP BY ALL),
 j AS (SELECT s.clip_id, noise_score AS noise, least(1e0, sep.rms / greatest(s.rms, 1e-9)) AS music_leak, reverb_score AS reverb, clipping_ratio AS clipping, silence_ratio AS silence FROM stats s JOIN sep USING (clip_id) JOIN noise USING (clip_id) JOIN reverb USING (clip_id))
SELECT clip_id, round(greatest(0e0, least(1e0, 1e0 - (3e-1 * noise + 2e-1 * music_leak + 2e-1 * reverb + 2e-1 * least(1e0, clipping * 1e2) + 1e-1 * silence))), 9) AS overall, round(noise, 9) AS noise, round(music_leak, 9) AS music_leak,
  round(reverb, 9) AS reverb, round(clipping, 9) AS clipping, round(silence, 9) AS silence FROM j""")
def overall_quality(spark, sf_dir):
    raw = _chunks(spark, sf_dir)
    separated = raw.withColumn("samples", F.transform("samples", lambda s: (s / 2).cast("int")))
    cleaned = sig.wave_stats(raw).join(sig.noise_scores(raw), "clip_id").join(sig.reverb_scores(raw), "clip_id")
    out = sig.overall_quality(sig.wave_stats(raw), sig.wave_stats(separated), cleaned)
    return out.select("clip_id", *[F.round(c, 9).alias(c) for c in out.columns if c != "clip_id"])


@query("sig_14_reference_gate", sql=SAMPLES + """, b AS (SELECT clip_id, idx // 8 AS b, count(*) AS n, sum(sample::DOUBLE * sample) AS sq, count(*) FILTER (abs(sample) >= 32760) AS c1, count(*) FILTER (abs(sample) >= 32700) AS c2 FROM smp GROUP BY ALL),
 f AS (SELECT clip_id, sum(n) / 4e2 AS duration_sec, sqrt(sum(sq) / sum(n)) / 32768e0 AS rms, sum(c1) / sum(n) AS c1, sum(c2) / sum(n) AS c2, avg(CASE WHEN sqrt(sq / n) / 32768e0 < 8e-3 THEN 1e0 ELSE 0e0 END) AS silence FROM b GROUP BY ALL)
SELECT clip_id, round(duration_sec, 6) AS duration_sec, round(rms, 9) AS rms, round(silence, 9) AS silence_ratio,
  array_to_string(list_filter(['sample_rate', CASE WHEN duration_sec NOT BETWEEN 2 AND 14 THEN 'duration' END, CASE WHEN rms < 8e-3 THEN 'too_quiet' END, CASE WHEN c1 > 1e-3 THEN 'clipping' END, CASE WHEN silence > 6e-1 THEN 'silence' END], lambda x: x IS NOT NULL), ',') AS supplement_reasons,
  array_to_string(list_filter(['sample_rate', CASE WHEN duration_sec NOT BETWEEN 3 AND 15 THEN 'duration' END, CASE WHEN rms < 3e-3 THEN 'too_quiet' END, CASE WHEN c2 > 1e-2 THEN 'clipping' END], lambda x: x IS NOT NULL), ',') AS candidate_reasons FROM f""")
def reference_gate(spark, sf_dir):
    return sig.reference_facts(_chunks(spark, sf_dir)).select(
        "clip_id", F.round("duration_sec", 6).alias("duration_sec"), F.round("rms", 9).alias("rms"), F.round("silence_ratio", 9).alias("silence_ratio"),
        F.array_join("supplement_reasons", ",").alias("supplement_reasons"), F.array_join("candidate_reasons", ",").alias("candidate_reasons"),
    )


@query("sig_15_periodicity")
def periodicity(spark, sf_dir):
    wanted = _placed(spark, sf_dir).select(
        "clip_id", (F.col("idx") / float(RATE)).alias("time_sec"), F.expr("6e1 + idx % 300").alias("f0"), F.lit(0.01).alias("step_sec"))
    return sig.periodicity(wanted, _chunks(spark, sf_dir))


def _windows(spark, sf_dir):
    return v.frames(spark, sf_dir).select(F.col("segment_id").alias("clip_id"), "idx", "rms")


VAD = """, w AS (SELECT segment_id AS clip_id, idx, rms FROM frames),
 wr AS (SELECT clip_id, rms, row_number() OVER (PARTITION BY clip_id ORDER BY rms) AS r, count(*) OVER (PARTITION BY clip_id) AS n FROM w),
 th AS (SELECT clip_id, greatest(350e0, max(rms) FILTER (r = greatest(1, CAST(floor(n * 2e-1) AS BIGINT))) * 3e0) AS threshold FROM wr GROUP BY ALL),
 vo AS (SELECT clip_id, idx, idx - lag(idx) OVER (PARTITION BY clip_id ORDER BY idx) AS gap FROM w JOIN th USING (clip_id) WHERE rms >= threshold),
 il AS (SELECT clip_id, idx, sum(CASE WHEN gap IS NULL OR gap > 9 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY idx) AS island FROM vo),
 rg AS (SELECT clip_id, min(idx) AS start_idx, max(idx) + 1 AS end_idx FROM il GROUP BY clip_id, island)
"""


@query("vad_1_thresholds", "frames", VAD + "SELECT clip_id, round(threshold, 6) AS threshold FROM th")
def thresholds(spark, sf_dir):
    return seg.thresholds(_windows(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6))


@query("vad_2_voice_ranges", "frames", VAD + "SELECT * FROM rg")
def voice_ranges(spark, sf_dir):
    return seg.voice_ranges(_windows(spark, sf_dir))


@query("vad_3_segments", "frames", VAD + """, k AS (SELECT *, start_idx * 3e-2 AS start_sec, end_idx * 3e-2 AS end_sec FROM rg WHERE end_idx * 3e-2 - start_idx * 3e-2 >= 3e-1)
SELECT concat('seg_', clip_id, '_', lpad(CAST(row_number() OVER (PARTITION BY clip_id ORDER BY start_idx) - 1 AS VARCHAR), 5, '0')) AS segment_id, clip_id, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, 1e0 AS voiced_probability,
  round(1e0 / greatest(1, CAST(round_even((end_sec - start_sec) / 3e-2, 0) AS BIGINT)), 9) AS silence_ratio FROM k""")
def vad_segments(spark, sf_dir):
    return seg.emit_segments(seg.voice_ranges(_windows(spark, sf_dir))).withColumns({"start_sec": F.round("start_sec", 6), "end_sec": F.round("end_sec", 6), "silence_ratio": F.round("silence_ratio", 9)})


@query("cls_1_content_scores", "frames", """, f AS (SELECT segment_id AS clip_id, idx, rms, CASE WHEN rms >= 300 AND f0 > 0 THEN f0 + event_id % 40 END AS pitch, CASE WHEN rms >= 300 THEN (event_id % 20) / 1e2 END AS z FROM frames),
 p AS (SELECT clip_id, pitch, lag(pitch) OVER (PARTITION BY clip_id ORDER BY idx) AS prev FROM f WHERE pitch IS NOT NULL),
 ps AS (SELECT clip_id, count(*) AS np, stddev_pop(1200 * log2(pitch / 440e0)) AS sd, count(*) FILTER (abs(1200 * log2(pitch / prev)) <= 80) AS pairs FROM p GROUP BY ALL),
 r AS (SELECT clip_id, rms, row_number() OVER (PARTITION BY clip_id ORDER BY rms) AS r, count(*) OVER (PARTITION BY clip_id) AS n FROM f),
 d AS (SELECT clip_id, max(rms) FILTER (r = greatest(1, CAST(floor(n * 2e-1) AS BIGINT))) AS lo, max(rms) FILTER (r = least(n, CAST(floor(n * 8e-1) AS BIGINT) + 1)) AS hi FROM r GROUP BY ALL),
 s AS (SELECT clip_id, count(*) AS n, count(*) FILTER (rms >= 300) AS nv, avg(z) AS z FROM f GROUP BY ALL),
 x AS (SELECT s.clip_id, nv / n AS vr, coalesce(np, 0) / greatest(1, nv) AS pr, CASE WHEN coalesce(np, 0) < 3 THEN 0 ELSE greatest(0e0, least(1e0, 1 - sd / 220e0)) END AS st,
   CASE WHEN coalesce(np, 0) < 2 THEN 0 ELSE pairs / greatest(1, np - 1) END AS su, coalesce(z, 0) AS z, CASE WHEN n < 4 OR hi <= 1e-9 THEN 0 ELSE (hi - lo) / hi END AS dy FROM s JOIN d USING (clip_id) LEFT JOIN ps USING (clip_id)),
 y AS (SELECT clip_id, least(1e0, 32e-2 * pr + 3e-1 * st + 22e-2 * su + 1e-1 * vr + 6e-2 * (1 - dy)) AS si, least(1e0, 28e-2 * vr + 28e-2 * (1 - st) + 2e-1 * dy + 14e-2 * least(1e0, z * 8) + 1e-1 * (1 - su)) AS sp FROM x)
SELECT clip_id, CASE WHEN greatest(si, sp) < 52e-2 OR abs(si - sp) < 12e-2 THEN 'ambiguous' WHEN si > sp THEN 'singing' ELSE 'speech' END AS content_type,
  round(CASE WHEN greatest(si, sp) < 52e-2 OR abs(si - sp) < 12e-2 THEN least(1e0, abs(si - sp) * 2) ELSE least(1e0, 5e-1 + abs(si - sp) * 8e-1) END, 9) AS confidence, round(sp, 9) AS speech_score, round(si, 9) AS singing_score FROM y""")
def content_scores(spark, sf_dir):
    f = v.frames(spark, sf_dir).select(
        F.col("segment_id").alias("clip_id"), "idx", "rms", F.expr("CASE WHEN f0 > 0 THEN f0 + event_id % 40 END").alias("pitch_hz"), F.expr("(event_id % 20) / 1e2").alias("zcr"))
    return cls.classify(f).withColumns({c: F.round(c, 9) for c in ("confidence", "speech_score", "singing_score")})


def _classes(spark, sf_dir):
    return v.segments(spark, sf_dir).select("segment_id", "content_type", "asr_confidence", F.expr("doc_id % 29 = 0").alias("user_overridden")).withColumnRenamed("asr_confidence", "confidence")


@query("cls_2_reapply_overrides", "segments content_overrides", """, l AS (SELECT segment_id, arg_max(new_type, seq) AS nt FROM content_overrides GROUP BY ALL)
SELECT s.segment_id, coalesce(nt, content_type) AS content_type, asr_confidence AS confidence, doc_id % 29 = 0 OR nt IS NOT NULL AS user_overridden FROM segments s LEFT JOIN l USING (segment_id)""")
def reapply(spark, sf_dir):
    return cls.reapply_overrides(_classes(spark, sf_dir), v.content_overrides(spark, sf_dir))


@query("cls_3_record_overrides", "segments content_overrides", """, r AS (SELECT o.segment_id, changed_at, new_type, content_type, coalesce(doc_id % 29 = 0, false) AS ov, lag(new_type) OVER (PARTITION BY o.segment_id ORDER BY seq) AS prev FROM content_overrides o LEFT JOIN segments s USING (segment_id))
SELECT segment_id, changed_at, coalesce(prev, content_type) AS original_type, new_type, CASE WHEN content_type IS NULL THEN 'unknown_segment' WHEN (prev IS NOT NULL OR ov) AND coalesce(prev, content_type) = new_type THEN 'unchanged' ELSE 'logged' END AS result FROM r""")
def record_overrides(spark, sf_dir):
    return cls.record_overrides(_classes(spark, sf_dir), v.content_overrides(spark, sf_dir))
