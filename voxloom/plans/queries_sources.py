"""Queries of sources, incremental state and sinks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from voxloom.functions import phone_arrays
from voxloom.functions.measure import valid_singing_alignment
from voxloom.operators import text
from voxloom.plans import views as v
from voxloom.plans.queries_jobs import billionths, digest_sql, set_print_sql
from voxloom.plans.registry import query
from voxloom.session import durable, shared_folder
from voxloom.sinks import datasets as sink, files
from voxloom.sources import media, series

VERSION = "analysis-2"


def _current(spark, sf_dir):
    files = v.media_files(spark, sf_dir)
    return media.supported(files).select("path", "media_type", F.octet_length("content").alias("size"), "modified_ms", media.fingerprint(F.col("content")).alias("content_hash"), "page_id")


def _previous(spark, sf_dir):
    i = F.col("page_id")
    return _current(spark, sf_dir).where("page_id % 6 <> 0").select(
        F.concat(F.lit("src_"), i.cast("string")).alias("source_id"), F.upper("path").alias("path"), F.when(i % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(i % 13 == 0, F.lit(1)).otherwise(F.col("modified_ms")).alias("modified_ms"), F.when(i % 11 == 0, F.lit("00")).otherwise(F.upper("content_hash")).alias("content_hash"),
        F.when(i % 17 == 0, F.lit("analysis-1")).otherwise(F.lit(VERSION)).alias("analysis_version"), F.when(i % 5 == 1, F.lit("failed")).otherwise(F.lit("ready")).alias("state"),
        F.when(i % 5 != 1, F.concat(F.lit("extracted/src_"), i.cast("string"), F.lit(".wav"))).alias("extracted_path"), F.when(i % 5 == 1, F.lit("cannot decode")).alias("error"),
    )


CUR = """, cur AS (SELECT *, CASE WHEN lower(path) SIMILAR TO '.*\\.(wav|flac|mp3|m4a|ogg|opus)' THEN 'audio' WHEN lower(path) SIMILAR TO '.*\\.(mp4|mkv|webm|mov|avi|m4v)' THEN 'video' END AS media_type, sha256(html) AS content_hash FROM media_files),
 cu AS (SELECT * FROM cur WHERE media_type IS NOT NULL),
 prv AS (SELECT concat('src_', page_id) AS source_id, lower(path) AS k, CASE WHEN page_id % 7 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN page_id % 13 = 0 THEN 1 ELSE modified_ms END AS modified_ms,
   CASE WHEN page_id % 11 = 0 THEN '00' ELSE content_hash END AS content_hash, CASE WHEN page_id % 17 = 0 THEN 'analysis-1' ELSE 'analysis-2' END AS analysis_version, CASE WHEN page_id % 5 = 1 THEN 'failed' ELSE 'ready' END AS state,
   CASE WHEN page_id % 5 <> 1 THEN concat('extracted/src_', page_id, '.wav') END AS extracted_path, CASE WHEN page_id % 5 = 1 THEN 'cannot decode' END AS error FROM cu WHERE page_id % 6 <> 0),
 dif AS (SELECT coalesce(p.source_id, concat('src_', md5(lower(c.path)))) AS source_id, c.path, c.media_type, c.size, c.modified_ms, c.content_hash, 'analysis-2' AS analysis_version, p.source_id IS NOT NULL AS known,
   coalesce(p.size = c.size AND p.modified_ms = c.modified_ms AND p.content_hash = c.content_hash AND p.analysis_version = 'analysis-2', false) AS same, p.state, p.extracted_path, p.error FROM cu c LEFT JOIN prv p ON p.k = lower(c.path))
"""


@query("src_1_media_scan", "media_files", CUR + "SELECT path, media_type, size FROM cu")
def media_scan(spark, sf_dir):
    return _current(spark, sf_dir).select("path", "media_type", "size")


@query("src_2_fingerprint", "media_files", "SELECT path, sha256(html) AS content_hash FROM media_files")
def fingerprints(spark, sf_dir):
    return v.media_files(spark, sf_dir).select("path", media.fingerprint(F.col("content")).alias("content_hash"))


@query("src_3_manifest_diff", "media_files", CUR + """SELECT source_id, path, media_type, size, modified_ms, content_hash, analysis_version, CASE WHEN same THEN state ELSE 'pending' END AS state, CASE WHEN same THEN extracted_path END AS extracted_path,
  CASE WHEN same THEN error END AS error, CASE WHEN same THEN 'unchanged' WHEN known THEN 'changed' ELSE 'added' END AS change FROM dif""")
def manifest_diff(spark, sf_dir):
    return media.manifest_diff(_current(spark, sf_dir).drop("page_id"), _previous(spark, sf_dir), VERSION)


def _carried(spark, sf_dir):
    previous = _previous(spark, sf_dir).withColumn("content_hash", F.lower("content_hash"))
    outputs = previous.where("extracted_path IS NOT NULL AND substring(source_id, -1) <> '9'").select(F.col("extracted_path").alias("path"))
    return media.carry_extraction(media.manifest_diff(_current(spark, sf_dir).drop("page_id"), _previous(spark, sf_dir), VERSION), previous, outputs)


CARRIED = CUR + """, car AS (SELECT d.*, coalesce(p.content_hash = d.content_hash AND p.analysis_version = 'analysis-2' AND p.state = 'ready' AND substr(p.source_id, -1) <> '9', false) AS reused, p.extracted_path AS old FROM dif d LEFT JOIN prv p USING (source_id))
"""


@query("src_4_carry_extraction", "media_files", CARRIED + "SELECT source_id, path, content_hash, analysis_version, CASE WHEN reused THEN 'ready' ELSE 'pending' END AS state, CASE WHEN reused THEN old END AS extracted_path, reused FROM car")
def carry_extraction(spark, sf_dir):
    return _carried(spark, sf_dir)


@query("src_4_failed_rows", "media_files", CARRIED + """, t AS (SELECT *, CASE WHEN size % 4 = 0 THEN 'no audio stream' END AS err FROM car WHERE NOT reused)
SELECT source_id, path, content_hash, analysis_version, CASE WHEN err IS NULL THEN 'ready' ELSE 'failed' END AS state, CASE WHEN err IS NULL THEN concat('extracted/', source_id, '.wav') END AS extracted_path, err AS error FROM t""")
def failed_rows(spark, sf_dir):
    todo = _carried(spark, sf_dir).where("NOT reused").drop("state", "extracted_path", "reused")
    sizes = _current(spark, sf_dir).select("path", "size")
    results = todo.join(sizes, "path").select("source_id", F.when(F.col("size") % 4 == 0, F.lit("no audio stream")).alias("error"))
    return media.finish_extraction(todo, results)


@query("src_5_stage_todo", "media_files", "SELECT concat('src_', page_id) AS source_id FROM media_files WHERE NOT (page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0)")
def stage_todo(spark, sf_dir):
    src = v.media_files(spark, sf_dir).select(F.expr("concat('src_', cast(page_id as varchar(20)))").alias("source_id"), "page_id")
    stage = src.select("source_id", F.expr("CASE WHEN page_id % 3 = 0 THEN 'v1' ELSE 'v2' END").alias("stage_version"), F.expr("CASE WHEN page_id % 5 = 0 THEN 'broken' END").alias("error"), F.concat("source_id", F.lit(".wav")).alias("output_path"))
    outputs = src.where("page_id % 7 <> 0").select(F.concat("source_id", F.lit(".wav")).alias("path"))
    return media.stage_todo(src.select("source_id"), stage, outputs, "v2")


@query("src_6_cache_keys", "media_files", "SELECT path, sha256(concat(html, '|features-1', CASE WHEN page_id % 3 = 0 THEN concat('/transcript/', sha256(path)) ELSE '' END)) AS cache_key FROM media_files")
def cache_keys(spark, sf_dir):
    return v.media_files(spark, sf_dir).select("path", media.cache_key(F.col("content"), F.lit("features-1"), F.when(F.col("page_id") % 3 == 0, F.col("path"))).alias("cache_key"))


@query("src_7_feature_reuse", "segments", """, d AS (SELECT *, doc_id % 6 = 0 AS fresh, doc_id % 7 = 0 AS moved, doc_id % 11 = 0 AS inval, doc_id % 13 <> 0 AS has_series, doc_id % 5 <> 3 AS valid FROM segments)
SELECT segment_id, cache_key, CASE WHEN NOT fresh AND NOT moved AND NOT inval AND has_series AND valid THEN 'reuse' ELSE 'extract' END AS decision,
  CASE WHEN fresh THEN 'new' WHEN moved THEN 'key_changed' WHEN inval THEN 'invalidated' WHEN NOT has_series THEN 'series_missing' WHEN NOT valid THEN 'measurement_invalid' END AS reason FROM d""")
def feature_reuse(spark, sf_dir):
    segs, i = v.segments(spark, sf_dir), F.col("doc_id")
    cached = segs.where("doc_id % 6 <> 0").select(
        "segment_id", F.when(i % 7 == 0, F.lit("old")).otherwise(F.col("cache_key")).alias("cache_key"), F.when(i % 11 == 0, F.lit("invalidated-by-transcript-override")).otherwise(F.col("alignment_method")).alias("alignment_method"),
        (i % 13 != 0).alias("has_series"), (i % 5 != 3).alias("measurement_valid"))
    return media.feature_reuse(segs.select("segment_id", "cache_key"), cached)


def _series(spark, sf_dir):
    """One stored series per event batch, some with broken JSON."""
    return v.table(spark, sf_dir, "events").select(
        F.expr("concat('series_', cast(event_id as varchar(20)))").alias("segment_id"),
        F.expr("""CASE WHEN event_id % 10 = 3 THEN concat('{', props) ELSE concat('[{"time_sec":0.0,"value":', cast(cast(value * 100 as bigint) as varchar(20)), ',"confidence":0.9},{"time_sec":0.01,"value":',
            CASE WHEN event_type = 'error' THEN '0' ELSE cast(200 + event_id % 7 as varchar(20)) END, '}]') END""").alias("json"))


@query("src_8_f0_series", sql="""WITH e AS (SELECT concat('series_', event_id) AS segment_id, event_id, event_type, value FROM events WHERE event_id % 10 <> 3)
SELECT segment_id, 0 AS idx, CAST(trunc(value * 100) AS DOUBLE) AS f0 FROM e WHERE trunc(value * 100) > 0 UNION ALL SELECT segment_id, 1, 2e2 + event_id % 7 FROM e WHERE event_type <> 'error'""")
def f0_series(spark, sf_dir):
    return series.voiced_f0(_series(spark, sf_dir))


@query("src_8_unreadable_series", sql="SELECT concat('series_', event_id) AS segment_id, 'unreadable_series' AS problem FROM events WHERE event_id % 10 = 3")
def unreadable(spark, sf_dir):
    return series.unreadable_series(_series(spark, sf_dir))


@query("src_9_durations", "media_files", "SELECT path, round(CASE WHEN page_id % 6 = 0 THEN NULL ELSE size / (page_id % 6 * 1e2) END, 6) AS duration_sec FROM media_files")
def durations(spark, sf_dir):
    return v.media_files(spark, sf_dir).select("path", F.round(media.clip_duration(F.octet_length("content"), (F.col("page_id") % 6 * 100).cast("double")), 6).alias("duration_sec"))


def _job_files(spark, sf_dir):
    return v.table(spark, sf_dir, "customer").select(
        F.expr("concat('batch_', cast(c_custkey as varchar(20)), '.json')").alias("file_name"),
        F.expr("""CASE c_custkey % 9 WHEN 0 THEN '{broken' WHEN 1 THEN concat('{"batch_id":"other","created_at":"2024-01-01 00:00:00","jobs":[{"job_id":"j"}]}')
            WHEN 2 THEN concat('{"batch_id":"batch_', cast(c_custkey as varchar(20)), '","created_at":"2024-01-01 00:00:00","jobs":[]}')
            ELSE concat('{"batch_id":"batch_', cast(c_custkey as varchar(20)), '","created_at":"2024-01-0', cast(c_custkey % 7 + 1 as varchar(20)), ' 00:00:00","jobs":[{"job_id":"j"},{"job_id":"k"}]}') END""").alias("json"))


@query("src_10_job_history", sql="SELECT concat('batch_', c_custkey) AS batch_id, concat('2024-01-0', c_custkey % 7 + 1) AS created_on, 2 AS jobs FROM customer WHERE c_custkey % 9 > 2")
def job_history(spark, sf_dir):
    return series.parse_job_files(_job_files(spark, sf_dir))[0].select("batch_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"), "jobs")


@query("src_10_job_errors", sql="SELECT concat('batch_', c_custkey, '.json') AS file_name, 'unreadable_batch' AS problem FROM customer WHERE c_custkey % 9 <= 2")
def job_errors(spark, sf_dir):
    return series.parse_job_files(_job_files(spark, sf_dir))[1]


def _talk(spark, sf_dir):
    return v.segments(spark, sf_dir).where("content_type = 'speech'").select("segment_id", F.coalesce("speaker_id", F.lit(" ")).alias("speaker_name"), "transcript")


_BAD = "(trim({0}) = '' OR {0} LIKE '%|%' OR contains({0}, chr(10)) OR contains({0}, chr(13)))"


@query("snk_2_talk_lines", "segments", f"SELECT segment_id, concat(segment_id, '.wav|', speaker_id, '|JP|', transcript) AS line FROM segments WHERE content_type = 'speech' AND speaker_id IS NOT NULL AND NOT {_BAD.format('transcript')}")
def talk_lines(spark, sf_dir):
    return sink.talk_lines(_talk(spark, sf_dir))[0]


@query("snk_2_refused_lines", "segments", f"SELECT segment_id, 'speaker_name' AS problem FROM segments WHERE content_type = 'speech' AND speaker_id IS NULL UNION ALL SELECT segment_id, 'transcript' FROM segments WHERE content_type = 'speech' AND {_BAD.format('transcript')}")
def refused_lines(spark, sf_dir):
    return sink.talk_lines(_talk(spark, sf_dir))[1]


def _singing(spark, sf_dir, *more):
    """Items of the singing sets. Rows are dealt to their files as texts: phones are many times larger."""
    segs = v.segments(spark, sf_dir).where("content_type = 'singing' AND speaker_id IS NOT NULL").where(valid_singing_alignment(well_timed=F.lit(True)))
    made = v.with_phones(files.dealt(segs, "speaker_id", "segment_id"), v.WELL_TIMED | v.LISTS, ("phonemes",))
    return sink.singing_items(made.where("_well_timed"), *more)


def _published(spark, df, form):
    """One folder a speaker's job, written below the shared folder and read back; the rows are dealt already."""
    return files.publish(df, f"{shared_folder(spark)}/published-{uuid.uuid4().hex}", "speaker_id", form, deal=False)


SINGING = """, it AS (SELECT p.*, s.speaker_id FROM phonemes p JOIN segments s USING (segment_id) JOIN aligned a USING (segment_id) WHERE s.content_type = 'singing' AND s.speaker_id IS NOT NULL AND valid_alignment)
"""


@query("snk_3_singing_items", "segments phonemes aligned", SINGING + """SELECT segment_id, string_agg(phoneme, ' ' ORDER BY pos) AS phones, count(*)::INTEGER AS n, round(sum(greatest(0, end_sec - start_sec)), 6) AS seconds, max(start_sec) AS last_start, max(end_sec) AS last_end FROM it GROUP BY ALL""")
def singing_items(spark, sf_dir):
    """The singing sets as they come back from their JSON files."""
    items = _published(spark, _singing(spark, sf_dir, "speaker_id"), "json")
    return items.select("segment_id", F.array_join("phones", " ").alias("phones"), F.size("durations").alias("n"), F.round(F.aggregate("durations", F.lit(0.0), lambda a, x: a + x), 6).alias("seconds"),
                        F.array_max("starts").alias("last_start"), F.array_max("ends").alias("last_end"))


@query("snk_4_transcription_rows", "segments phonemes aligned", SINGING + "SELECT concat('segment_', sha256(segment_id)) AS name, string_agg(phoneme, ' ' ORDER BY pos) AS ph_seq, string_agg(format('{:.12g}', end_sec - start_sec), ' ' ORDER BY pos) AS ph_dur FROM it GROUP BY segment_id")
def transcription_rows(spark, sf_dir):
    """The transcription tables as they come back from their CSV files."""
    rows = sink.transcription_rows(_singing(spark, sf_dir, "speaker_id"), "speaker_id")
    return _published(spark, rows, "csv").drop("speaker_id")


@query("snk_5_phone_dictionary", "segments phonemes aligned", SINGING + "SELECT DISTINCT phoneme AS phone, concat(phoneme, chr(9), phoneme) AS entry FROM it")
def phone_dictionary(spark, sf_dir):
    return sink.phone_dictionary(_singing(spark, sf_dir))


def _artifacts(spark, sf_dir):
    o, i = v.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    job = F.expr("concat('job_', cast(o_custkey as varchar(20)))")
    path = F.expr("CASE WHEN o_orderkey % 23 = 0 THEN concat('../m', cast(o_orderkey as varchar(20))) WHEN o_orderkey % 29 = 0 THEN concat('/abs/m', cast(o_orderkey as varchar(20))) ELSE concat('out/m', cast(o_orderkey as varchar(20))) END")
    sha = F.sha2(i.cast("string"), 256)
    manifest = o.where("o_custkey % 31 <> 0").select(job.alias("job_id"), path.alias("path"), F.when(i % 19 == 0, F.lit("")).when(i % 17 == 0, F.lit("bad")).otherwise(F.upper(sha)).alias("sha256"))
    actual = o.where("o_orderkey % 13 <> 0").select(job.alias("job_id"), path.alias("path"), F.when(i % 11 == 0, 0).otherwise(10).alias("size"), sha.alias("sha256"))
    return manifest, actual, o.select(job.alias("job_id")).distinct()


ART = """WITH m AS (SELECT concat('job_', o_custkey) AS job_id, CASE WHEN o_orderkey % 23 = 0 THEN concat('../m', o_orderkey) WHEN o_orderkey % 29 = 0 THEN concat('/abs/m', o_orderkey) ELSE concat('out/m', o_orderkey) END AS path,
   o_orderkey % 23 = 0 OR o_orderkey % 29 = 0 AS esc, o_orderkey % 13 = 0 AS gone, o_orderkey % 11 = 0 AS empty, o_orderkey % 19 = 0 AS nohash, o_orderkey % 17 = 0 AS badhash, o_custkey % 31 <> 0 AS listed FROM orders)
"""


@query("snk_6_artifact_audit", sql=ART + """SELECT job_id, path, CASE WHEN esc THEN 'path_escapes' WHEN gone OR empty THEN 'missing_or_empty' ELSE 'hash_mismatch' END AS problem FROM m WHERE listed AND (esc OR gone OR empty OR nohash OR badhash)
UNION ALL SELECT DISTINCT job_id, NULL, 'no_artifacts' FROM m WHERE NOT listed""")
def artifact_audit(spark, sf_dir):
    return sink.artifact_problems(*_artifacts(spark, sf_dir))


@query("snk_6_sample_status", sql=ART + "SELECT job_id, path, CASE WHEN esc THEN 'outside_folder' WHEN gone THEN 'missing' WHEN nohash THEN 'hash_not_recorded' WHEN badhash THEN 'mismatch' ELSE 'ok' END AS status FROM m WHERE listed")
def sample_status(spark, sf_dir):
    manifest, actual, _ = _artifacts(spark, sf_dir)
    return sink.sample_status(manifest, actual)


@query("snk_7_training_set_audit", "segments phonemes aligned", SINGING + """, k AS (SELECT DISTINCT segment_id, doc_id, speaker_id FROM it)
SELECT segment_id, unnest(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'item_missing' END, CASE WHEN doc_id % 9 <> 0 AND doc_id % 7 = 0 THEN 'differs:transcript' END, CASE WHEN doc_id % 9 <> 0 AND doc_id % 11 = 0 THEN 'differs:phones' END,
  CASE WHEN doc_id % 9 <> 0 AND doc_id % 5 = 1 THEN 'differs:ends' END], lambda x: x IS NOT NULL)) AS problem FROM k UNION ALL SELECT concat(segment_id, '_x'), 'item_unexpected' FROM k WHERE doc_id % 17 = 1""")
def training_set_audit(spark, sf_dir):
    """Lists become digests in the tasks that make them: neither they nor the texts are dealt or joined."""
    segs = v.segments(spark, sf_dir).where("content_type = 'singing' AND speaker_id IS NOT NULL").where(valid_singing_alignment(well_timed=F.lit(True)))
    kernels = {n: (_printed(k), T.BinaryType()) for n, k in phone_arrays.ITEM_LISTS.items()}
    changed = {"_phones": (_printed(phone_arrays.ITEM_LISTS["phones"], _backwards), T.BinaryType()), "_ends": (_printed(phone_arrays.ITEM_LISTS["ends"], _later), T.BinaryType())}

    def made(more):
        lean = segs.select("doc_id", "segment_id", "transcript")
        rows = v.with_phones(lean.withColumn("text_print", F.unhex(F.sha2("transcript", 256))), v.WELL_TIMED | kernels | more, ("phonemes", "transcript"))
        return rows.where("_well_timed").withColumnRenamed("text_print", "transcript")

    i, now, old = F.col("doc_id"), made({}), made(changed)
    fields = ["segment_id", "transcript", *phone_arrays.ITEM_LISTS]
    stored = old.where(i % 9 != 0).withColumns({
        "transcript": F.when(i % 7 == 0, F.unhex(F.sha2(F.lit("changed"), 256))).otherwise(F.col("transcript")),
        "phones": F.when(i % 11 == 0, F.col("_phones")).otherwise(F.col("phones")), "ends": F.when(i % 5 == 1, F.col("_ends")).otherwise(F.col("ends"))})
    extra = now.where(i % 17 == 1).withColumn("segment_id", F.concat("segment_id", F.lit("_x")))
    return sink.training_set_problems(stored.select(fields).unionByName(extra.select(fields)), now.select(fields), ["segment_id"])


def _printed(kernel, change=None):
    """The digest of the list that a kernel makes, or of a changed one."""
    return lambda lists: phone_arrays.list_print(kernel(lists) if change is None else change(kernel(lists)))


def _backwards(lists):
    """Each list with an "a" more, backwards."""
    counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, ends = lists.flatten(), np.cumsum(counts + 1)
    at = np.full(int(ends[-1]) if len(ends) else 0, len(values), dtype=np.int64)  # the "a" comes first
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    at[np.repeat(ends, counts) - 1 - place] = np.arange(len(values))
    more = pa.concat_arrays([values.cast(pa.string()), pa.array(["a"])])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[lists.is_null().to_numpy(zero_copy_only=False), False]), more.take(pa.array(at)))


def _later(lists):
    offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[lists.is_null().to_numpy(zero_copy_only=False), False]), pc.add(lists.flatten(), 1.0))


@query("snk_8_list_audit", "segments", f""", it AS (SELECT source_id AS job_id, doc_id AS line_no, CASE WHEN doc_id % 37 = 0 THEN 'same.wav' ELSE concat(segment_id, '.wav') END AS audio_name, coalesce(speaker_id, ' ') AS speaker_name, transcript FROM segments)
SELECT job_id, line_no, 'bad_column' AS problem FROM it WHERE trim(speaker_name) = '' OR {_BAD.format('transcript')}
UNION ALL SELECT job_id, line_no, CASE WHEN line_no % 8 = 5 THEN 'line_missing' ELSE 'line_differs' END FROM it WHERE line_no % 8 = 5 OR line_no % 10 = 3
UNION ALL SELECT job_id, min(line_no), 'name_repeated' FROM it GROUP BY job_id, audio_name HAVING count(*) > 1""")
def list_audit(spark, sf_dir):
    items = v.segments(spark, sf_dir).select(F.col("source_id").alias("job_id"), F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 37 == 0, F.lit("same.wav")).otherwise(F.concat("segment_id", F.lit(".wav"))).alias("audio_name"),
                                            F.coalesce("speaker_id", F.lit(" ")).alias("speaker_name"), "transcript")
    lines = items.where("line_no % 8 <> 5").select("job_id", "line_no", F.concat_ws("|", "audio_name", "speaker_name", F.when(F.col("line_no") % 10 == 3, F.lit("EN")).otherwise(F.lit("JP")), "transcript").alias("line"))
    return sink.list_problems(items, lines)




def duration_clips(spark, sf_dir):
    """Clips with a phone list of one of five shapes and lengths that mostly add up."""
    s = v.segments(spark, sf_dir)
    phones = F.split(F.expr("CASE doc_id % 5 WHEN 0 THEN 'k a N s a' WHEN 1 THEN 'k s a' WHEN 2 THEN 'a k' WHEN 3 THEN 'sh i cl t e' ELSE 'a xx' END"), " ")
    return s.select(
        "segment_id", phones.alias("phones"), F.when(F.col("doc_id") % 7 == 0, F.transform(F.slice(phones, 2, 9), lambda p: F.lit(0.25))).when(F.col("doc_id") % 11 == 0, F.transform(phones, lambda p: F.lit(0.0)))
        .otherwise(F.transform(phones, lambda p: F.lit(0.25))).alias("durations"),
        (F.size(phones) * 0.25 + F.when(F.col("doc_id") % 13 == 0, 0.5).otherwise(0.0)).alias("clip_sec"), F.lit(44100).alias("sample_rate"), F.expr("25e-2 + (doc_id % 8) / 4e0").alias("training_weight"), "doc_id",
    )


@query("snk_9_duration_rows", "segments", """SELECT concat('segment_', sha256(segment_id)) AS name, CASE doc_id % 5 WHEN 0 THEN 'k a N s a' ELSE 'sh i cl t e' END AS ph_seq, '0.25 0.25 0.25 0.25 0.25' AS ph_dur,
  CASE doc_id % 5 WHEN 0 THEN '2 1 2' ELSE '2 1 2' END AS ph_num, 25e-2 + (doc_id % 8) / 4e0 AS training_weight FROM segments WHERE doc_id % 5 IN (0, 3) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def duration_rows(spark, sf_dir):
    return text.duration_input(duration_clips(spark, sf_dir))[0].drop("segment_id")


@query("snk_9_held_clips", "segments", """SELECT segment_id, CASE WHEN doc_id % 7 = 0 THEN 'length_mismatch' WHEN doc_id % 11 = 0 THEN 'bad_duration' WHEN doc_id % 13 = 0 THEN 'sum_mismatch'
  WHEN doc_id % 5 = 1 THEN 'consonant_cluster' WHEN doc_id % 5 = 2 THEN 'trailing_consonant' ELSE 'unknown_phone' END AS reason FROM segments WHERE NOT (doc_id % 5 IN (0, 3) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)""")
def held_clips(spark, sf_dir):
    return text.duration_input(duration_clips(spark, sf_dir))[1]


@query("snk_9_provenance", "segments", """, k AS (SELECT CASE WHEN doc_id % 5 IN (0, 3) THEN source_id ELSE concat(source_id, '/held only') END AS job_id, segment_id, doc_id % 5 IN (0, 3) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS ok,
   concat('segment_', sha256(segment_id)) AS name, 25e-2 + (doc_id % 8) / 4e0 AS w FROM segments),
 wp AS (""" + set_print_sql("(SELECT * FROM k WHERE ok)", "job_id", digest_sql("name", billionths("w")), "weights_hash") + """)
SELECT job_id, CASE WHEN count(*) FILTER (ok) > 0 THEN 'written' ELSE 'none_accepted' END AS status, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS held, any_value(weights_hash) AS weights_hash,
  'dataset-1' AS dataset_fingerprint, count(*) FILTER (ok) > 0 AS has_files, NULL AS problem FROM k LEFT JOIN wp USING (job_id) GROUP BY job_id""")
def provenance(spark, sf_dir):
    """Duration inputs of every source written as a job of its own, with their provenance read back and
    held against the files; clips of shapes that are always held form jobs without a file."""
    clips = duration_clips(spark, sf_dir).join(v.segments(spark, sf_dir).select("segment_id", "source_id"), "segment_id")
    job = F.when((F.col("doc_id") % 5).isin(0, 3), F.col("source_id")).otherwise(F.concat("source_id", F.lit("/held only")))
    accepted, held = text.duration_input(clips.withColumn("job_id", job), "job_id")
    accepted, folder = durable(accepted), f"{shared_folder(spark)}/durations-{uuid.uuid4().hex}"
    files.publish(accepted, folder, "job_id", "csv")
    told = files.record_provenance(accepted, held, folder, "job_id", "dataset-1")
    found = files.provenance_problems(spark, folder, "job_id")
    return told.join(found, "job_id", "left").select("job_id", "status", "accepted", "held", "weights_hash", "dataset_fingerprint", ((F.col("files") > 0) & (F.col("bytes") > 0) & F.col("files_hash").isNotNull()).alias("has_files"), "problem")
