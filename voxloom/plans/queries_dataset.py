"""Queries of the common dataset, its edits and its fingerprints; the versioned sink; worker stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from voxloom.functions import stages
from voxloom.functions.phone_arrays import plain_phones
from voxloom.operators import dataset as d, speakers
from voxloom.plans import views as v
from voxloom.plans.queries_jobs import billionths, digest_sql, json_sql, set_print_sql
from voxloom.plans.registry import query
from voxloom.session import shared_folder
from voxloom.sinks import versioned


def _assigned(spark, sf_dir):
    return v.segments(spark, sf_dir).where("speaker_id IS NOT NULL AND doc_id % 15 <> 2").select("segment_id", "speaker_id")


def _centroids(spark, sf_dir):
    """Two-dimensional centroids of the speakers below six."""
    n = F.substring("speaker_id", 5, 9).cast("int")
    return v.segments(spark, sf_dir).where("speaker_id IS NOT NULL").select("speaker_id").distinct().where(n < 6).select("speaker_id", F.array(n * F.lit(1.0), F.lit(1.0)).alias("centroid"))


@query("dat_1_build", "segments content_classes", """, c AS (SELECT segment_id, arg_max(content_type, position) AS ct FROM content_classes GROUP BY ALL)
SELECT s.segment_id, coalesce(c.ct, 'ambiguous') AS content_type, CASE WHEN doc_id % 15 <> 2 THEN speaker_id END AS speaker_id, CASE WHEN doc_id % 15 <> 2 AND CAST(substr(speaker_id, 5) AS INTEGER) < 6 THEN substr(speaker_id, 5) || '.0,1.0' ELSE '' END AS speaker_embedding
FROM segments s LEFT JOIN c USING (segment_id) WHERE CAST(substr(source_id, 4) AS INTEGER) % 4 <> 1 AND CAST(substr(source_id, 4) AS INTEGER) % 7 <> 5""")
def build(spark, sf_dir):
    n = F.substring("source_id", 4, 9).cast("int")
    stage = v.segments(spark, sf_dir).select("source_id").distinct().where(n % 4 != 1).withColumn("error", F.when(n % 7 == 5, F.lit("failed")))
    classes = v.content_classes(spark, sf_dir).groupBy("segment_id").agg(F.max_by("content_type", "position").alias("content_type"))
    base = v.segments(spark, sf_dir).select("segment_id", "source_id")
    out = d.build(base, stage, classes, _assigned(spark, sf_dir), _centroids(spark, sf_dir))
    return out.select("segment_id", "content_type", "speaker_id", F.array_join(F.col("speaker_embedding").cast("array<string>"), ",").alias("speaker_embedding"))


PROV = """SELECT segment_id, unnest(['transcript', 'phonemes', 'f0', 'energy', 'voicing', 'style_prosody', 'speaker_embedding']) AS feature,
    unnest(['faster-whisper', concat('pyopenjtalk+', alignment_method), 'autocorrelation', 'rms', 'pitch-confidence', 'summary-statistics', 'speaker-centroid']) AS method, cache_key, doc_id FROM segments"""


@query("dat_2_provenance", "segments", f"""SELECT segment_id, feature, 'v9' AS stage_version, method, cache_key FROM ({PROV}) WHERE doc_id % 3 = 0
UNION ALL SELECT segment_id, feature, 'v8', method, cache_key FROM ({PROV}) WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1""")
def provenance(spark, sf_dir):
    segs = v.segments(spark, sf_dir)
    existing = d.new_provenance(segs, "v8").withColumn("cache_key", F.when(F.substring("segment_id", 5, 20).cast("long") % 4 == 1, F.lit("old")).otherwise(F.col("cache_key")))
    return d.new_provenance(segs.where("doc_id % 3 = 0"), "v9").unionByName(d.carried_provenance(segs.where("doc_id % 3 <> 0"), existing).select("segment_id", "feature", "stage_version", "method", "cache_key"))


def _sequenced(spark, sf_dir):
    rows = d.new_provenance(v.segments(spark, sf_dir), "v8").withColumn("seq", F.lit(1))
    again = rows.where("feature = 'phonemes'").withColumn("seq", F.lit(2)).withColumn("method", F.lit("pyopenjtalk+older"))
    return rows.unionByName(again)


SEQ = f", pr AS (SELECT segment_id, feature, method, 1 AS seq, doc_id FROM ({PROV}) UNION ALL SELECT segment_id, feature, 'pyopenjtalk+older', 2, doc_id FROM ({PROV}) WHERE feature = 'phonemes')\n"


@query("dat_2_refreshed_methods", "segments", SEQ + "SELECT segment_id, feature, seq, CASE WHEN feature = 'phonemes' AND seq = 2 THEN concat('pyopenjtalk+', CASE WHEN doc_id % 2 = 0 THEN 'now' ELSE alignment_method END) ELSE method END AS method FROM pr JOIN segments USING (segment_id, doc_id)")
def refreshed(spark, sf_dir):
    now = v.segments(spark, sf_dir).withColumn("alignment_method", F.when(F.col("doc_id") % 2 == 0, "now").otherwise(F.col("alignment_method")))
    return d.refresh_phoneme_methods(_sequenced(spark, sf_dir), now).select("segment_id", "feature", "seq", "method")


EDITED = """, lt AS (SELECT segment_id, arg_max(value, seq) AS nt FROM edits WHERE field = 'transcript' GROUP BY ALL),
 np AS (SELECT segment_id, count(*) AS n FROM phonemes GROUP BY ALL), ed AS (SELECT s.*, nt, coalesce(nt <> transcript, false) AS ch, coalesce(n, 0) AS n FROM segments s LEFT JOIN lt USING (segment_id) LEFT JOIN np USING (segment_id))
"""


@query("dat_3_transcript_edits", "segments phonemes edits", EDITED + """SELECT segment_id, sha256(coalesce(nt, transcript)) AS transcript, CASE WHEN ch THEN 0 ELSE n END::INTEGER AS phones, has_measurement AND NOT ch AS has_measurement,
  CASE WHEN ch THEN 0 ELSE alignment_confidence END AS alignment_confidence, CASE WHEN ch THEN 'unavailable' ELSE alignment_status END AS alignment_status, CASE WHEN ch THEN 'invalidated-by-transcript-override' ELSE alignment_method END AS alignment_method FROM ed""")
def transcript_edits(spark, sf_dir):
    out = d.apply_transcript_edits(v.segments(spark, sf_dir), v.edits(spark, sf_dir), v.with_phones)
    return out.select("segment_id", F.sha2("transcript", 256).alias("transcript"), F.size("phonemes").alias("phones"), "has_measurement", "alignment_confidence", "alignment_status", "alignment_method")


def _set(spark, sf_dir):
    asked = v.edits(spark, sf_dir).where("field <> 'note'").select("segment_id", "value", "changed_at", "seq")
    return d.set_transcripts(v.segments(spark, sf_dir), _sequenced(spark, sf_dir), asked.unionByName(asked.where("changed_at = 0").withColumn("segment_id", F.concat("segment_id", F.lit("_x")))), v.with_phones)


SET = """, ask AS (SELECT segment_id, value, changed_at, seq FROM edits WHERE field <> 'note'), lt AS (SELECT segment_id, arg_max(value, seq) AS nt FROM ask GROUP BY ALL)
"""


@query("dat_4_set_transcript", "segments phonemes edits", SET + """, np AS (SELECT segment_id, count(*) AS n FROM phonemes GROUP BY ALL)
SELECT s.segment_id, sha256(coalesce(nt, transcript)) AS transcript, CASE WHEN nt IS NULL THEN coalesce(n, 0) ELSE 0 END::INTEGER AS phones, CASE WHEN nt IS NULL THEN alignment_method ELSE 'invalidated-by-transcript-override' END AS alignment_method
FROM segments s LEFT JOIN lt USING (segment_id) LEFT JOIN np USING (segment_id)""")
def set_transcript(spark, sf_dir):
    return _set(spark, sf_dir)["segments"].select("segment_id", F.sha2("transcript", 256).alias("transcript"), F.size("phonemes").alias("phones"), "alignment_method")


@query("dat_4_edit_log", "segments edits", SET + """SELECT segment_id, 'log' AS kind, sha256(value) AS value FROM ask JOIN segments USING (segment_id) UNION ALL SELECT concat(segment_id, '_x'), 'unknown_segment', NULL FROM ask WHERE changed_at = 0
  UNION ALL SELECT segment_id, 'unknown_segment', NULL FROM ask WHERE segment_id NOT IN (SELECT segment_id FROM segments)""")
def edit_log(spark, sf_dir):
    out = _set(spark, sf_dir)
    return out["log"].select("segment_id", F.lit("log").alias("kind"), F.sha2("value", 256).alias("value")).unionByName(out["problems"].select("segment_id", F.col("problem").alias("kind"), F.lit(None).cast("string").alias("value")))


@query("dat_4_marked_provenance", "segments edits", SET + SEQ.replace(", pr AS", ", pr AS") + "SELECT p.segment_id, feature, seq, CASE WHEN feature = 'phonemes' AND seq = 2 AND nt IS NOT NULL THEN 'invalidated-by-transcript-override' ELSE method END AS method FROM pr p LEFT JOIN lt USING (segment_id)")
def marked_provenance(spark, sf_dir):
    return _set(spark, sf_dir)["provenance"].select("segment_id", "feature", "seq", "method")


@query("dat_5_coverage", "segments phonemes", "SELECT 'phoneme' AS kind, phoneme AS name, count(*) AS n FROM phonemes GROUP BY ALL UNION ALL SELECT 'content_type', content_type, count(*) FROM segments GROUP BY ALL")
def coverage(spark, sf_dir):
    return d.coverage_counts(v.phoned_segments(spark, sf_dir))


@query("dat_6_views", "segments content_classes", """, c AS (SELECT segment_id, arg_max(content_type, position) AS ct FROM content_classes GROUP BY ALL)
SELECT segment_id, 'talk_view' AS list FROM segments WHERE content_type = 'speech' UNION ALL SELECT segment_id, 'singing_view' FROM segments WHERE content_type = 'singing'
UNION ALL SELECT segment_id, CASE ct WHEN 'speech' THEN 'talk' WHEN 'singing' THEN 'singing' ELSE 'ambiguous' END FROM c""")
def dataset_views(spark, sf_dir):
    segs = v.segments(spark, sf_dir)
    classes = v.content_classes(spark, sf_dir).groupBy("segment_id").agg(F.max_by("content_type", "position").alias("content_type"))
    return d.talk_view(segs).select("segment_id", F.lit("talk_view").alias("list")).unionByName(d.singing_view(segs).select("segment_id", F.lit("singing_view").alias("list"))).unionByName(d.target_lists(classes))


def _snapshot(spark, sf_dir):
    segs = v.segments(spark, sf_dir)
    twice = segs.where("doc_id % 101 = 7")
    base = segs.unionByName(twice).withColumn("speaker_embedding", F.array().cast("array<double>"))
    classes = v.content_classes(spark, sf_dir).groupBy("segment_id").agg(F.max_by("content_type", "position").alias("content_type"))
    return d.snapshot(base, segs.where("user_excluded").select("segment_id"), _assigned(spark, sf_dir), _centroids(spark, sf_dir), classes)


@query("dat_7_snapshot", "segments content_classes", """, c AS (SELECT segment_id, arg_max(content_type, position) AS ct FROM content_classes GROUP BY ALL), two AS (SELECT * FROM segments UNION ALL SELECT * FROM segments WHERE doc_id % 101 = 7)
SELECT two.segment_id, CASE WHEN doc_id % 15 <> 2 AND CAST(substr(speaker_id, 5) AS INTEGER) < 6 THEN speaker_id END AS speaker_id, coalesce(ct, 'ambiguous') AS content_type,
  CASE WHEN doc_id % 15 <> 2 AND CAST(substr(speaker_id, 5) AS INTEGER) < 6 THEN 2 ELSE 0 END AS dimensions FROM two LEFT JOIN c USING (segment_id) WHERE NOT user_excluded""")
def snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir)[0].select("segment_id", "speaker_id", "content_type", F.size("speaker_embedding").alias("dimensions"))


@query("dat_7_snapshot_problems", "segments", "SELECT segment_id, 'duplicate_id' AS problem FROM segments WHERE doc_id % 101 = 7")
def snapshot_problems(spark, sf_dir):
    return _snapshot(spark, sf_dir)[1]


SETTINGS = {"schema": "1", "stage": "v9", "correction": "v1", "enabled": "true", "pitch": None}


def snapshot_print(spark, sf_dir):
    """Every column of the segments, phones included, and every edit."""
    plain = {"phonemes": (plain_phones, T.StringType())}
    segs = v.with_phones(v.segments(spark, sf_dir), plain, ("phonemes", "doc_id"))
    return d.snapshot_fingerprint(segs, v.edits(spark, sf_dir), SETTINGS)


def _one(sql: str) -> str:
    """A set fingerprint over the whole table."""
    return sql.replace("SELECT 1, count", "SELECT count").replace(" GROUP BY 1", "")


_REAL = {
    "asr_confidence", "alignment_confidence", "voiced_ratio", "mean_f0_hz", "f0_std_dev_hz", "pitch_reliability", "duration_sec", "speaking_rate",
    "pitch_range_semitones", "energy_variation", "pause_ratio",
}
_FIELDS = sorted(["phonemes", *[n for n, _ in v.SEGMENT_COLUMNS if n != "doc_id"]])
_PHONE = json_sql("[phoneme, " + ", ".join(billionths(c) for c in ("start_sec", "end_sec", "confidence")) + "]")
_NAMED = [f"'{x}'" if x is not None else "CAST(NULL AS VARCHAR)" for pair in sorted(SETTINGS.items()) for x in pair]
PRINT = f", ph AS (SELECT segment_id, {json_sql(f"list({_PHONE} ORDER BY pos)")} AS phonemes FROM phonemes GROUP BY segment_id), sp AS (" + _one(set_print_sql(
    "(SELECT s.*, coalesce(ph.phonemes, '[]') AS phonemes FROM segments s LEFT JOIN ph USING (segment_id))", "1",
    digest_sql(*[billionths(c) if c in _REAL else c for c in _FIELDS]), "f")) + "), cp AS (" + _one(set_print_sql(
    "edits", "1", digest_sql("changed_at", "field", "segment_id", "seq", "value"), "f")) + "), fp AS (SELECT " + digest_sql("'training-snapshot'", *_NAMED, "sp.f", "cp.f") + " AS fingerprint FROM sp, cp)\n"


@query("dat_8_snapshot_fingerprint", "segments phonemes edits", PRINT + "SELECT fingerprint FROM fp")
def snapshot_fingerprint(spark, sf_dir):
    return snapshot_print(spark, sf_dir)


def _members(spark, sf_dir):
    return v.segments(spark, sf_dir).where("speaker_id IS NOT NULL AND content_type <> 'ambiguous'").select(
        "speaker_id", F.expr("CASE content_type WHEN 'speech' THEN 'talk' ELSE 'singing' END").alias("target"), "segment_id", "doc_id").withColumn("job_id", F.concat_ws("/", "speaker_id", "target"))


MEMBERS = """, mb AS (SELECT concat(speaker_id, '/', CASE content_type WHEN 'speech' THEN 'talk' ELSE 'singing' END) AS job_id, speaker_id, CASE content_type WHEN 'speech' THEN 'talk' ELSE 'singing' END AS target, segment_id, doc_id FROM segments WHERE speaker_id IS NOT NULL AND content_type <> 'ambiguous'),
 js AS (""" + set_print_sql("mb", "job_id, speaker_id, target", digest_sql("segment_id"), "s") + ")\n"


@query("dat_8_job_fingerprints", "segments phonemes edits", PRINT + MEMBERS + "SELECT job_id, speaker_id, target, row_count AS members, " + digest_sql("'training-job'", "fingerprint", "speaker_id", "target", "s") + " AS job_fingerprint FROM js, fp")
def job_fingerprints(spark, sf_dir):
    return d.job_fingerprints(_members(spark, sf_dir), snapshot_print(spark, sf_dir))


@query("dat_9_resolve_jobs", "segments", MEMBERS + """, n AS (SELECT job_id, any_value(speaker_id) AS sp, count(*) AS n, count(*) FILTER (doc_id % 50 = 9 AND speaker_id = 'spk_1') AS gone FROM mb GROUP BY ALL)
SELECT job_id, CASE WHEN sp = 'spk_3' THEN 0 WHEN sp = 'spk_4' THEN n * 2 ELSE n END AS stored_members, CASE WHEN sp = 'spk_3' THEN 0 ELSE n - gone END AS found_members,
  CASE WHEN sp = 'spk_3' THEN 'empty' WHEN sp = 'spk_4' THEN 'repeated_members' WHEN gone > 0 THEN 'members_changed' WHEN sp = 'spk_2' THEN 'input_changed' ELSE 'ok' END AS status FROM n""")
def resolve_jobs(spark, sf_dir):
    members = _members(spark, sf_dir)
    prints = d.job_fingerprints(members, snapshot_print(spark, sf_dir))
    jobs = prints.withColumn("job_fingerprint", F.when(F.col("speaker_id") == "spk_2", F.lit("old")).otherwise(F.col("job_fingerprint"))).drop("members")
    stored = members.where("speaker_id <> 'spk_3'").select("job_id", "segment_id")
    stored = stored.unionByName(stored.where("job_id LIKE 'spk_4/%'"))
    view = v.segments(spark, sf_dir).where("NOT (doc_id % 50 = 9 AND coalesce(speaker_id, '') = 'spk_1')")
    return d.resolve_jobs(jobs, stored, view, snapshot_print(spark, sf_dir))


_NAME = "CASE doc_id % 7 WHEN 0 THEN ' calm' WHEN 1 THEN '' WHEN 2 THEN repeat('x', 33) WHEN 3 THEN concat('a', chr(9), 'b') ELSE 'calm' END"
_SRC = "CASE doc_id % 5 WHEN 0 THEN 'model' WHEN 1 THEN 'user' ELSE 'inferred' END"
_CF = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 15e-1 ELSE 5e-1 END"


@query("dat_10_emotion_labels", "segments", f"""SELECT segment_id, CASE WHEN doc_id % 7 IN (0, 1) THEN 'blank_or_padded' WHEN doc_id % 7 = 2 THEN 'too_long' WHEN doc_id % 7 = 3 THEN 'control_character' WHEN doc_id % 5 = 0 THEN 'unknown_source'
  WHEN doc_id % 6 = 1 THEN 'confidence_range' WHEN doc_id % 5 = 1 AND doc_id % 6 <> 0 THEN 'user_label_with_confidence' END AS problem FROM segments""")
def emotion_labels(spark, sf_dir):
    rows = v.segments(spark, sf_dir).select("segment_id", F.expr(_NAME).alias("name"), F.expr(_SRC).alias("source"), F.expr(_CF).alias("confidence"))
    return rows.select("segment_id", d.emotion_problem().alias("problem"))


@query("dat_11_legacy_import", "segments", """SELECT segment_id, CASE WHEN asr_status IN ('unavailable', 'invalid') THEN NULL ELSE asr_confidence END AS asr_value, asr_status,
  CASE WHEN alignment_status IN ('unavailable', 'invalid') THEN NULL ELSE alignment_confidence END AS alignment_value, alignment_status FROM segments""")
def legacy_import(spark, sf_dir):
    out = d.import_components(v.segments(spark, sf_dir))
    return out.select("segment_id", F.col("asr_confidence.value").alias("asr_value"), F.col("asr_confidence.status").alias("asr_status"), F.col("alignment_confidence.value").alias("alignment_value"), F.col("alignment_confidence.status").alias("alignment_status"))


SAVES = """WITH cur AS (SELECT c_custkey AS dataset_id, c_custkey % 4 AS revision FROM customer WHERE c_custkey % 10 <> 0),
 s AS (SELECT o_orderkey AS place, o_custkey AS dataset_id, CASE WHEN o_custkey % 10 = 0 AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 4 END AS expected, o_totalprice AS price FROM orders),
 j AS (SELECT s.*, revision AS now, expected IS NOT DISTINCT FROM revision AS fits FROM s LEFT JOIN cur USING (dataset_id)),
 w AS (SELECT *, coalesce(fits AND place = min(place) FILTER (fits) OVER (PARTITION BY dataset_id), false) AS won FROM j)
"""


def _saves(spark, sf_dir):
    """Every order is a save of its customer's dataset; every tenth dataset is new."""
    key = F.col("o_custkey")
    expected = F.when((key % 10 == 0) & (F.col("o_orderkey") % 3 == 0), F.lit(None)).otherwise(F.col("o_orderkey") % 4)
    saves = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), key.alias("dataset_id"), expected.cast("long").alias("expected"), F.col("o_totalprice").alias("price"))
    current = v.table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("dataset_id"), (F.col("c_custkey") % 4).cast("long").alias("revision"))
    return saves, current


@query("snk_1_versioned_save", sql=SAVES + "SELECT place, dataset_id, CASE WHEN won THEN 'saved' ELSE 'stale' END AS outcome, CASE WHEN won THEN coalesce(now, 0) + 1 END AS revision, CASE WHEN won THEN price END AS price FROM w")
def versioned_save(spark, sf_dir):
    """Every save with its outcome; the accepted ones as they come back from their files."""
    judged = versioned.judge_saves(*_saves(spark, sf_dir))
    saved = versioned.save_all(judged, f"{shared_folder(spark)}/saves-{uuid.uuid4().hex}")
    accepted = saved.select("place", "dataset_id", F.lit("saved").alias("outcome"), "revision", "price")
    refused = judged.where("outcome = 'stale'").select("place", "dataset_id", "outcome", F.lit(None).cast("long").alias("revision"), F.lit(None).cast("double").alias("price"))
    return accepted.unionByName(refused)


@query("snk_1_revisions", sql=SAVES + "SELECT dataset_id, max(revision) AS revision FROM (SELECT dataset_id, revision FROM cur UNION ALL SELECT dataset_id, coalesce(now, 0) + 1 FROM w WHERE won) GROUP BY ALL")
def revisions(spark, sf_dir):
    """The revision of every dataset after the saves."""
    saves, current = _saves(spark, sf_dir)
    return versioned.advance(current, versioned.judge_saves(saves, current).where("outcome = 'saved'"))


NEEDS = {"extract_universal_features": ("text",)}


def _stage(spark, sf_dir):
    asked = v.table(spark, sf_dir, "conversations").select(
        F.expr("concat(cast(conv_id as varchar(20)), '/', cast(turn as varchar(20)))").alias("request_id"), F.expr("CASE turn % 5 WHEN 4 THEN 'fly' ELSE 'extract_universal_features' END").alias("command"),
        F.when(F.col("turn") % 5 == 3, F.lit("[1]")).when(F.col("turn") % 5 == 2, F.lit("{}")).otherwise(F.to_json(F.struct("text"))).alias("payload"))
    return stages.run_stage(asked, NEEDS, {})


def _answers(spark, sf_dir):
    """A well-formed request for every turn, and what comes back."""
    asked = v.table(spark, sf_dir, "conversations").select(
        F.expr("concat(cast(conv_id as varchar(20)), '/', cast(turn as varchar(20)))").alias("request_id"), F.lit("extract_universal_features").alias("command"), F.to_json(F.struct("text")).alias("payload"))
    return stages.run_stage(asked, NEEDS, {"letters": lambda f: F.regexp_count(F.lower(f["text"]), F.lit("[a-z]")).cast("long"), "n": lambda f: F.length(f["text"]).cast("long")})


@query("udf_1_stage_status", sql="SELECT concat(conv_id, '/', turn) AS request_id, CASE WHEN turn % 5 < 2 THEN 'ok' ELSE 'error' END AS status, CASE turn % 5 WHEN 2 THEN 'KeyError: ''text''' WHEN 3 THEN 'ValueError: payload is not an object' WHEN 4 THEN 'ValueError: unknown command' END AS error FROM conversations")
def stage_status(spark, sf_dir):
    return _stage(spark, sf_dir).select("request_id", "status", "error")


@query("udf_2_cached_resource", sql="SELECT concat(conv_id, '/', turn) AS request_id, len(regexp_extract_all(lower(text), '[a-z]')) AS letters FROM conversations")
def cached_resource(spark, sf_dir):
    return _answers(spark, sf_dir).select("request_id", "letters")


@query("udf_3_injected_values", sql="SELECT concat(conv_id, '/', turn) AS request_id, length(text) AS n FROM conversations")
def injected_values(spark, sf_dir):
    return _answers(spark, sf_dir).select("request_id", "n")
