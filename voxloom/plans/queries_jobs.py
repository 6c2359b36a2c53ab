"""Queries of manifests, sampling, hold-out, jobs and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.measure import valid_singing_alignment
from voxloom.operators import jobs, sampling, weights
from voxloom.plans import views as v
from voxloom.plans.queries_weights import ASSESSED, assessment
from voxloom.plans.registry import query

CANDIDATES = "job_of AS (SELECT concat(speaker_id, '/', target) AS job_id, * FROM assessed WHERE speaker_id IS NOT NULL)"


def _assessed_jobs(spark, sf_dir):
    return assessment(spark, sf_dir).where("speaker_id IS NOT NULL").withColumn("job_id", F.concat_ws("/", "speaker_id", "target"))


def _manifest(spark, sf_dir):
    assessed = _assessed_jobs(spark, sf_dir)
    kept = assessed.where("pmod(doc_id, 97) <> 5")  # a few candidates lost their assessment
    wanted = v.segments(spark, sf_dir).where("speaker_id IS NOT NULL AND content_type <> 'ambiguous'").select(
        F.concat_ws("/", "speaker_id", F.expr("CASE content_type WHEN 'speech' THEN 'talk' ELSE 'singing' END")).alias("job_id"), "segment_id"
    )
    return weights.weight_manifest(wanted, kept)


WANTED = CANDIDATES + """, wanted AS (SELECT concat(speaker_id, '/', CASE content_type WHEN 'speech' THEN 'talk' ELSE 'singing' END) AS job_id, segment_id
   FROM segments WHERE speaker_id IS NOT NULL AND content_type <> 'ambiguous'),
 lookup AS (SELECT w.job_id, w.segment_id, a.eligibility, a.reason_codes, a.training_weight FROM wanted w
   LEFT JOIN (SELECT * FROM job_of WHERE CAST(substr(segment_id, 5) AS BIGINT) % 97 <> 5) a USING (job_id, segment_id))
"""


@query("wgt_9_manifest_items", "segments aligned phonemes", ASSESSED + ", " + WANTED + """
SELECT job_id, segment_id, concat(segment_id, '.wav') AS audio_filename, round(training_weight, 9) AS training_weight FROM lookup WHERE eligibility = 'eligible'""")
def manifest_items(spark, sf_dir):
    return _manifest(spark, sf_dir)[0].withColumn("training_weight", F.round("training_weight", 9))


@query("wgt_9_manifest_skipped", "segments aligned phonemes", ASSESSED + ", " + WANTED + """
SELECT job_id, segment_id, eligibility, array_to_string(reason_codes, ',') AS reason_codes, '' AS problem FROM lookup WHERE eligibility <> 'eligible'
UNION ALL SELECT job_id, segment_id, NULL, NULL, 'assessment_missing' FROM lookup WHERE eligibility IS NULL""")
def manifest_skipped(spark, sf_dir):
    _, skipped, problems = _manifest(spark, sf_dir)
    return skipped.select("job_id", "segment_id", "eligibility", F.array_join("reason_codes", ",").alias("reason_codes"), F.lit("").alias("problem")).unionByName(
        problems, allowMissingColumns=True
    )


def _stored_manifest(spark, sf_dir):
    s, i = v.segments(spark, sf_dir), F.col("doc_id")
    items = s.select(
        F.concat(F.lit("job_"), F.col("source_id")).alias("job_id"), F.expr("doc_id div 20").alias("position"),
        F.when(i % 61 == 0, F.lit("aa")).otherwise(F.col("segment_id")).alias("segment_id"),
        F.when(i % 59 == 0, F.lit("same.wav")).when(i % 53 == 0, F.lit("a/b.wav")).otherwise(F.concat("segment_id", F.lit(".wav"))).alias("audio_filename"),
        F.when(i % 47 == 0, 2.5).when(i % 43 == 0, 0.1).otherwise(1.0).alias("training_weight"),
    )
    files = s.where("doc_id % 41 <> 0").select(F.concat(F.lit("job_"), F.col("source_id")).alias("job_id"), F.concat("segment_id", F.lit(".wav")).alias("audio_filename"))
    return items, files


@query("wgt_10_manifest_audit", "segments", """, items AS (SELECT concat('job_', source_id) AS job_id, doc_id // 20 AS position,
   CASE WHEN doc_id % 61 = 0 THEN 'aa' ELSE segment_id END AS segment_id,
   CASE WHEN doc_id % 59 = 0 THEN 'same.wav' WHEN doc_id % 53 = 0 THEN 'a/b.wav' ELSE concat(segment_id, '.wav') END AS audio_filename,
   CASE WHEN doc_id % 47 = 0 THEN 25e-1 WHEN doc_id % 43 = 0 THEN 1e-1 ELSE 1e0 END AS w FROM segments),
 files AS (SELECT concat('job_', source_id) AS job_id, concat(segment_id, '.wav') AS audio_filename FROM segments WHERE doc_id % 41 <> 0),
 r AS (SELECT *, lag(segment_id) OVER (PARTITION BY job_id ORDER BY position) AS prev FROM items)
SELECT job_id, segment_id AS subject, 'not_ascending' AS problem FROM r WHERE prev >= segment_id
UNION ALL SELECT job_id, segment_id, 'weight_range' FROM r WHERE w < 25e-2 OR w > 2
UNION ALL SELECT job_id, segment_id, 'unsafe_file_name' FROM r WHERE audio_filename LIKE '%/%'
UNION ALL SELECT job_id, audio_filename, 'file_name_repeated' FROM items GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT job_id, audio_filename, 'item_without_file' FROM (SELECT DISTINCT job_id, audio_filename FROM items EXCEPT SELECT job_id, audio_filename FROM files)
UNION ALL SELECT job_id, audio_filename, 'file_without_item' FROM (SELECT job_id, audio_filename FROM files EXCEPT SELECT job_id, audio_filename FROM items)""")
def manifest_audit(spark, sf_dir):
    return weights.manifest_problems(*_stored_manifest(spark, sf_dir))


LANES = ", ':', ".join(f"CAST(sum(CAST(concat('0x', substr(d, {1 + 15 * i}, 15)) AS BIGINT)) AS HUGEINT)" for i in range(4))


def digest_sql(*texts: str) -> str:
    """The SQL twin of a row digest."""
    return "sha256(concat_ws('|', " + ", ".join(f"CASE WHEN ({t}) IS NULL THEN 'n' ELSE concat('v', length(CAST({t} AS VARCHAR)), ':', {t}) END" for t in texts) + "))"


def billionths(number: str) -> str:
    return f"CAST(CAST(({number}) * 1e9 AS BIGINT) AS VARCHAR)"


def json_sql(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


def set_print_sql(source: str, keys: str, digest: str, out: str) -> str:
    """The SQL twin of a set fingerprint."""
    return f"SELECT {keys}, count(*) AS row_count, sha256(concat(count(*), ':', {LANES})) AS {out} FROM (SELECT *, {digest} AS d FROM {source}) GROUP BY {keys}"


def _sampled(spark, sf_dir):
    return v.segments(spark, sf_dir).where("speaker_id IS NOT NULL").select(
        F.col("speaker_id").alias("job_id"), F.expr("cast(floor(log10(length(transcript) + 1)) as int)").alias("bucket"),
        F.concat("segment_id", F.lit(".wav")).alias("name"), F.expr("25e-2 + (doc_id * 17 % 176) / 1e2").alias("weight"),
    )


def _draw_sql(keys: str, text: str) -> str:
    return f""", items AS (SELECT speaker_id AS job_id, CAST(floor(log10(length(transcript) + 1)) AS INTEGER) AS bucket, concat(segment_id, '.wav') AS name,
   CAST(round((25e-2 + (doc_id * 17 % 176) / 1e2) * 1000000) AS BIGINT) AS w FROM segments WHERE speaker_id IS NOT NULL),
 lined AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY md5(name), name) AS hi, row_number() OVER (PARTITION BY {keys} ORDER BY md5(name), name) - 1 AS draw,
   sum(w) OVER (PARTITION BY {keys}) AS total FROM items),
 points AS (SELECT {keys}, draw, (CAST(concat('0x', substr(md5(concat('7:3:', {text}, ':', draw)), 1, 15)) AS BIGINT)::HUGEINT * total::HUGEINT) // 1152921504606846976 AS point FROM lined)
SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.draw, l.name FROM points p JOIN lined l ON {' AND '.join(f'p.{k.strip()} = l.{k.strip()}' for k in keys.split(','))}
  AND l.hi - l.w <= p.point AND p.point < l.hi"""


@query("wgt_11_epoch_sample", "segments", _draw_sql("job_id", "job_id"))
def epoch_sample(spark, sf_dir):
    return sampling.draw_epoch(_sampled(spark, sf_dir), ["job_id"], 7, 3)


@query("wgt_12_bucket_sample", "segments", _draw_sql("job_id, bucket", "job_id, '/', bucket"))
def bucket_sample(spark, sf_dir):
    return sampling.draw_epoch(_sampled(spark, sf_dir), ["job_id", "bucket"], 7, 3)


def _reports(spark, sf_dir):
    """Reports of finished trainings: one job has none, one never drew, one used another seed, one saw
    other weights, one lost an item, and one belongs to no manifest."""
    items = _sampled(spark, sf_dir).where("job_id <> 'spk_6'")
    seen = items.withColumn("weight", F.col("weight") + F.when((F.col("job_id") == "spk_3") & (F.col("bucket") == 2), 0.01).otherwise(0.0)).where("job_id <> 'spk_4' OR name NOT LIKE '%00.wav'")
    seen = seen.unionByName(items.where("job_id = 'spk_7'").withColumn("job_id", F.lit("spk_ghost")))
    job = F.col("job_id")
    made = sampling.sampler_report(seen, ["job_id"], 7, 3, 3)
    return made.withColumns({"seed": F.when(job == "spk_1", 8).otherwise(F.col("seed")), "iterations": F.when(job == "spk_5", 0).otherwise(F.col("iterations")), "last_epoch": F.when(job != "spk_5", F.col("last_epoch"))})


_WEIGHED = """, it AS (SELECT speaker_id AS job_id, CAST(floor(log10(length(transcript) + 1)) AS INTEGER) AS bucket, concat(segment_id, '.wav') AS name, 25e-2 + (doc_id * 17 % 176) / 1e2 AS weight FROM segments WHERE speaker_id IS NOT NULL),
 saw AS (SELECT * REPLACE (weight + CASE WHEN job_id = 'spk_3' AND bucket = 2 THEN 1e-2 ELSE 0 END AS weight) FROM it WHERE job_id <> 'spk_6' AND (job_id <> 'spk_4' OR name NOT LIKE '%00.wav')
   UNION ALL SELECT * REPLACE ('spk_ghost' AS job_id) FROM it WHERE job_id = 'spk_7')
"""


@query("wgt_13_sampler_report", "segments", _WEIGHED + ", mp AS (" + set_print_sql("it", "job_id", digest_sql("name", billionths("weight")), "h") + "), rp AS (" + set_print_sql("saw", "job_id", digest_sql("name", billionths("weight")), "h") + """),
 rg AS (SELECT job_id, min(weight) AS min_weight, max(weight) AS max_weight FROM saw GROUP BY ALL), r AS (SELECT *, CASE WHEN job_id = 'spk_1' THEN 8 ELSE 7 END AS seed, CASE WHEN job_id = 'spk_5' THEN 0 ELSE 3 END AS iterations FROM rp JOIN rg USING (job_id))
SELECT coalesce(m.job_id, r.job_id) AS job_id, m.row_count AS manifest_items, r.row_count AS item_count, round(min_weight, 9) AS min_weight, round(max_weight, 9) AS max_weight, seed, iterations, CASE WHEN iterations > 0 THEN 3 END AS last_epoch, r.h AS manifest_hash,
  array_to_string(list_filter([CASE WHEN r.h IS NULL THEN 'report_missing' END, CASE WHEN m.h IS NULL THEN 'manifest_missing' END, CASE WHEN iterations < 1 THEN 'sampler_never_used' END, CASE WHEN seed <> 7 THEN 'seed_differs' END,
    CASE WHEN m.row_count <> r.row_count THEN 'item_count_differs' END, CASE WHEN m.h <> r.h THEN 'weights_changed' END], lambda x: x IS NOT NULL), ',') AS problems
FROM mp m FULL JOIN r ON m.job_id = r.job_id""")
def report(spark, sf_dir):
    out = sampling.report_problems(_sampled(spark, sf_dir), _reports(spark, sf_dir), ["job_id"], 7)
    return out.withColumns({"min_weight": F.round("min_weight", 9), "max_weight": F.round("max_weight", 9), "problems": F.array_join("problems", ",")})


@query("wgt_13_weight_guard", "segments", """SELECT speaker_id AS job_id, concat(segment_id, '.wav') AS name, CASE WHEN doc_id % 19 = 0 THEN 'missing_weight' ELSE 'bad_weight' END AS problem FROM segments
WHERE speaker_id IS NOT NULL AND (doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 31 = 0)""")
def weight_guard(spark, sf_dir):
    i = F.substring("name", 5, 8).cast("long")
    items = _sampled(spark, sf_dir).withColumn("weight", F.when(i % 19 == 0, F.lit(None)).when(i % 23 == 0, -F.col("weight")).when(i % 29 == 0, F.lit(float("nan"))).when(i % 31 == 0, F.lit(float("inf"))).otherwise(F.col("weight")))
    return sampling.weight_problems(items).select("job_id", "name", "problem")


@query("wgt_14_hold_out", "segments", """, named AS (SELECT source_id AS job_id, concat('segment_', sha256(segment_id)) AS name FROM segments),
 r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY name) - 1 AS r, count(*) OVER (PARTITION BY job_id) AS n FROM named),
 h AS (SELECT *, least(5, greatest(1, CAST(floor(n * 1e-1) AS BIGINT)), n - 1) AS held FROM r WHERE n >= 2)
SELECT job_id, name FROM h WHERE list_contains(list_transform(range(held), lambda i: CAST(floor(i * (n / held)) AS BIGINT)), r)""")
def hold_out(spark, sf_dir):
    named = v.segments(spark, sf_dir).select(F.col("source_id").alias("job_id"), F.concat(F.lit("segment_"), F.sha2("segment_id", 256)).alias("name"))
    return sampling.hold_out(named, ["job_id"], "name", bucket=F.substring("name", 9, 3))


def _selections(spark, sf_dir):
    """Customers stand in for the person who selects speakers: some ask for one target, some for both."""
    speakers = v.segments(spark, sf_dir).where("speaker_id IS NOT NULL").select("speaker_id").distinct()
    n = F.substring("speaker_id", 5, 9).cast("int")
    chosen = speakers.select("speaker_id", F.when(n % 3 == 0, 1).when(n % 3 == 1, 2).otherwise(3).alias("target_bits"), (n % 2 == 0).alias("auto_correction"))
    ghost = chosen.where("speaker_id = 'spk_0'").select(F.lit("spk_ghost").alias("speaker_id"), F.lit(3).alias("target_bits"), F.lit(False).alias("auto_correction"))
    return chosen.unionByName(ghost)


def _members(spark, sf_dir):
    segs = v.with_phones(v.segments(spark, sf_dir), v.WELL_TIMED, ("phonemes", "transcript"))
    segs = segs.withColumn("valid_alignment", valid_singing_alignment(well_timed=F.col("_well_timed"))).drop("_well_timed")
    return jobs.job_members(_selections(spark, sf_dir), segs)


SELECTED = """, chosen0 AS (SELECT DISTINCT speaker_id, CAST(substr(speaker_id, 5) AS INTEGER) AS n FROM segments WHERE speaker_id IS NOT NULL),
 chosen AS (SELECT speaker_id, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS target_bits, n % 2 = 0 AS auto_correction FROM chosen0
   UNION ALL SELECT 'spk_ghost', 3, false FROM chosen0 WHERE speaker_id = 'spk_0'),
 targets AS (SELECT speaker_id, auto_correction, 'talk' AS target, 'speech' AS content_type FROM chosen WHERE target_bits & 1 > 0
   UNION ALL SELECT speaker_id, auto_correction, 'singing', 'singing' FROM chosen WHERE target_bits & 2 > 0),
 members AS (SELECT concat(t.speaker_id, '/', t.target) AS job_id, t.speaker_id, t.target, t.auto_correction, s.segment_id, a.valid_alignment
   FROM segments s JOIN targets t USING (speaker_id, content_type) JOIN aligned a ON a.segment_id = s.segment_id)
"""
@query("wgt_15_job_members", "segments aligned", SELECTED + "SELECT job_id, speaker_id, target, auto_correction, segment_id, valid_alignment FROM members")
def job_members(spark, sf_dir):
    return _members(spark, sf_dir)


@query("wgt_15_jobs", "segments aligned", SELECTED + ", f AS (" + set_print_sql("members", "job_id, speaker_id, target, auto_correction", digest_sql("segment_id"), "member_fingerprint")
       + ") SELECT job_id, speaker_id, target, auto_correction, row_count AS members, member_fingerprint FROM f")
def job_table(spark, sf_dir):
    return jobs.fan_out(_selections(spark, sf_dir), _members(spark, sf_dir))[0]


@query("wgt_15_job_problems", "segments aligned", SELECTED + """SELECT job_id, segment_id, 'alignment_required' AS problem FROM members WHERE target = 'singing' AND NOT valid_alignment
  UNION ALL SELECT concat(t.speaker_id, '/', t.target), NULL, 'empty_selection' FROM targets t LEFT JOIN (SELECT DISTINCT speaker_id, content_type FROM segments) g USING (speaker_id, content_type) WHERE g.content_type IS NULL""")
def job_problems(spark, sf_dir):
    return jobs.fan_out(_selections(spark, sf_dir), _members(spark, sf_dir))[1]


@query("wgt_16_regroup", "segments", """, j AS (SELECT DISTINCT speaker_id, doc_id % 7 = 0 AND doc_id % 8 < 3 AS auto_correction, CASE content_type WHEN 'speech' THEN 1 ELSE 2 END AS bit
   FROM segments WHERE speaker_id IS NOT NULL AND content_type <> 'ambiguous'),
 g AS (SELECT speaker_id, auto_correction, CAST(bit_or(bit) AS INTEGER) AS target_bits FROM j GROUP BY ALL)
SELECT speaker_id, auto_correction, target_bits, count(*) OVER (PARTITION BY speaker_id) > 1 AS mixed_settings FROM g""")
def regroup(spark, sf_dir):
    made = v.segments(spark, sf_dir).where("speaker_id IS NOT NULL AND content_type <> 'ambiguous'").select(
        "speaker_id", F.expr("doc_id % 7 = 0 AND doc_id % 8 < 3").alias("auto_correction"), F.expr("CASE content_type WHEN 'speech' THEN 'talk' ELSE 'singing' END").alias("target")
    )
    return jobs.regroup(made)


def _stored_jobs(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders")
    return o.select(
        F.expr("concat('batch_', cast(o_custkey as varchar(20)))").alias("batch_id"),
        F.expr("concat('job_', cast(CASE WHEN o_orderkey % 50 = 1 THEN 0 ELSE o_orderkey END as varchar(20)))").alias("job_id"),
        F.expr("CASE WHEN o_orderkey % 71 = 0 THEN ' ' ELSE concat('spk_', cast(o_custkey % 8 as varchar(20))) END").alias("speaker_id"),
        F.expr("CASE WHEN o_orderkey % 67 = 0 THEN '' ELSE 'f' END").alias("dataset_fingerprint"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'talk' WHEN 1 THEN 'singing' WHEN 2 THEN 'both' ELSE CASE WHEN o_orderkey % 61 = 0 THEN 'dance' ELSE 'talk' END END").alias("target"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'fine_tune' WHEN 'O' THEN 'from_scratch' ELSE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'auto' END END").alias("requested_mode"),
        F.expr("CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'auto' WHEN 2 THEN 'fine_tune' ELSE 'from_scratch' END").alias("resolved_mode"),
        F.expr("CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'pretrained_checkpoint' WHEN 2 THEN 'pretrained_checkpoint' ELSE 'random_initialization' END").alias("initialization"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'builtin.natural' END").alias("texture"),
        F.expr("""CASE WHEN o_orderkey % 3 = 0 THEN array(named_struct('name', 'base', 'sha256',
            CASE WHEN o_orderkey % 2 = 0 THEN sha2('x', 256) ELSE 'short' END, 'path', CASE WHEN o_orderkey % 9 = 0 THEN '../up' ELSE 'models/base' END))
            ELSE cast(array() as array<struct<name:string,sha256:string,path:string>>) END""").alias("components"),
        F.expr("CASE WHEN o_orderkey % 5 <> 2 THEN concat('v', cast(o_orderkey % 3 as varchar(20))) END").alias("preset_version"),
        F.expr("CASE WHEN o_orderkey % 7 <> 3 THEN concat('soft \"voice\" ', cast(o_custkey as varchar(20))) END").alias("description"),
        F.expr("CASE WHEN o_orderkey % 8 < 3 THEN cast(array() as array<string>) ELSE array(concat('seg_', cast(o_custkey as varchar(20))), 'seg_0') END").alias("reference_ids"),
        F.expr("CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 1000 END").alias("seed"),
    )


STORED_JOBS = """WITH stored AS (SELECT concat('batch_', o_custkey) AS batch_id, concat('job_', CASE WHEN o_orderkey % 50 = 1 THEN 0 ELSE o_orderkey END) AS job_id,
   o_orderkey % 71 = 0 AS no_speaker, o_orderkey % 67 = 0 AS no_print, o_orderkey % 4 = 3 AND o_orderkey % 61 = 0 AS bad_target,
   CASE o_orderkey % 4 WHEN 0 THEN 'talk' WHEN 1 THEN 'singing' WHEN 2 THEN 'both' ELSE CASE WHEN o_orderkey % 61 = 0 THEN 'dance' ELSE 'talk' END END AS target,
   CASE o_orderstatus WHEN 'F' THEN 'fine_tune' WHEN 'O' THEN 'from_scratch' ELSE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'auto' END END AS req,
   CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'auto' WHEN 2 THEN 'fine_tune' ELSE 'from_scratch' END AS res,
   CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'pretrained_checkpoint' WHEN 2 THEN 'pretrained_checkpoint' ELSE 'random_initialization' END AS init,
   CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'builtin.natural' END AS texture, o_orderkey % 3 = 0 AS comp,
   CASE WHEN o_orderkey % 5 <> 2 THEN concat('v', o_orderkey % 3) END AS preset_version, CASE WHEN o_orderkey % 7 <> 3 THEN concat('soft "voice" ', o_custkey) END AS description,
   CASE WHEN o_orderkey % 8 < 3 THEN '[]' ELSE CAST(to_json(list_sort([concat('seg_', o_custkey), 'seg_0'])) AS VARCHAR) END AS refs, CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey % 1000 END AS seed,
   o_orderkey % 2 = 0 AS good_sha, o_orderkey % 9 = 0 AS up FROM orders)
"""


@query("wgt_18_job_contracts", sql=STORED_JOBS + """, r AS (SELECT *, count(*) OVER (PARTITION BY batch_id, job_id) AS n, req IS NOT NULL AND res IS NOT NULL AND res <> 'auto' AS checked FROM stored)
SELECT batch_id, job_id, unnest(list_filter([CASE WHEN n > 1 THEN 'job_id_repeated' END, CASE WHEN no_speaker THEN 'speaker_empty' END, CASE WHEN no_print THEN 'fingerprint_empty' END,
  CASE WHEN bad_target THEN 'target_vocabulary' END, CASE WHEN req IS NULL AND (res IS NOT NULL OR init IS NOT NULL OR texture IS NOT NULL) THEN 'legacy_job_with_contract' END,
  CASE WHEN req IS NOT NULL AND texture IS NULL THEN 'texture_missing' END, CASE WHEN req <> 'auto' AND res IS NULL THEN 'explicit_mode_unresolved' END,
  CASE WHEN req IS NOT NULL AND res IS NULL AND init IS NOT NULL THEN 'unresolved_with_initialization' END, CASE WHEN req IS NOT NULL AND res = 'auto' THEN 'resolved_to_auto' END,
  CASE WHEN checked AND req <> 'auto' AND req <> res THEN 'mode_mismatch' END, CASE WHEN checked AND init IS NULL THEN 'initialization_missing' END,
  CASE WHEN checked AND res = 'from_scratch' AND init IS NOT NULL AND (init <> 'random_initialization' OR comp) THEN 'scratch_initialization' END,
  CASE WHEN checked AND res = 'fine_tune' AND init IS NOT NULL AND (init <> 'pretrained_checkpoint' OR NOT comp) THEN 'fine_tune_initialization' END,
  CASE WHEN checked AND res = 'fine_tune' AND comp AND (NOT good_sha OR up) THEN 'component_invalid' END], lambda x: x IS NOT NULL)) AS problem FROM r""")
def job_contracts(spark, sf_dir):
    return jobs.contract_problems(_stored_jobs(spark, sf_dir))


_COMPONENTS = "CASE WHEN comp THEN CAST(to_json([['base', CASE WHEN good_sha THEN sha256('x') ELSE 'short' END, CASE WHEN up THEN '../up' ELSE 'models/base' END]]) AS VARCHAR) ELSE '[]' END"


@query("wgt_17_contract_fingerprint", sql=STORED_JOBS + "SELECT job_id, " + digest_sql(
    "'training-job-contract'", "target", "texture", "preset_version", "description", "refs", "req", "res", "seed", "init", _COMPONENTS)
    + " AS contract_fingerprint FROM stored WHERE req IS NOT NULL AND texture IS NOT NULL")
def contract_fingerprints(spark, sf_dir):
    return jobs.contract_fingerprint(_stored_jobs(spark, sf_dir))


def _inputs(spark, sf_dir):
    """Contexts of all jobs but one; that of another lacks its backend, and a third has a segment twice."""
    assessed = _assessed_jobs(spark, sf_dir)
    found = assessed.select("job_id", "speaker_id", "target").distinct().where("job_id <> 'spk_5/talk'")
    contexts = found.select(
        "job_id", "speaker_id", "target", F.sha2("speaker_id", 256).alias("dataset_fingerprint"), F.sha2("job_id", 256).alias("contract_fingerprint"),
        F.expr("CASE WHEN job_id = 'spk_6/talk' THEN ' ' ELSE concat(target, '-trainer') END").alias("backend"), F.lit("r1").alias("backend_revision"),
        F.expr("CASE WHEN target = 'talk' THEN sha2(target, 256) END").alias("trainer_config_sha256"), F.lit("p1").alias("policy_version"),
        F.lit("s1").alias("source_fingerprint"), F.expr("CASE WHEN speaker_id = 'spk_1' THEN 'o1' END").alias("override_revision"),
    )
    again = assessed.where("job_id = 'spk_7/talk'")
    return jobs.input_fingerprint(assessed.unionByName(again), ["job_id"], contexts)


def _status(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'unavailable' ELSE 'measured' END"


INPUTS = ASSESSED + ", " + CANDIDATES + """, parts AS (SELECT segment_id, target, """ + json_sql("list(" + json_sql("[name, " + json_sql(f"[{billionths('value')}, status]") + "]") + " ORDER BY name)") + """ AS parts FROM components GROUP BY ALL),
 f AS (""" + set_print_sql("(SELECT * FROM job_of JOIN parts USING (segment_id, target))", "job_id", digest_sql(
    "segment_id", "CAST(NULL AS VARCHAR)", "eligibility", json_sql("list_sort(reason_codes)"), _status("quality_value"), billionths("quality_value"), "parts",
    _status("utility_value"), billionths("utility_value"), billionths("raw_weight"), billionths("training_weight")), "s") + ")\n"


@query("wgt_17_input_fingerprint", "segments aligned phonemes", INPUTS + """, c AS (SELECT *, split_part(job_id, '/', 1) AS speaker_id, split_part(job_id, '/', 2) AS target FROM f)
SELECT job_id, row_count, """ + digest_sql(
    "'training-input'", "sha256(speaker_id)", "sha256(job_id)", "concat(target, '-trainer')", "'r1'", "CASE WHEN target = 'talk' THEN sha256(target) END", "'p1'",
    "speaker_id", "target", "'s1'", "CASE WHEN speaker_id = 'spk_1' THEN 'o1' END", "s") + " AS input_fingerprint FROM c WHERE job_id NOT IN ('spk_5/talk', 'spk_6/talk', 'spk_7/talk')")
def input_fingerprints(spark, sf_dir):
    return _inputs(spark, sf_dir)[0]


@query("wgt_17_input_problems", "segments aligned phonemes", INPUTS + """SELECT job_id, CASE job_id WHEN 'spk_5/talk' THEN 'context_missing' WHEN 'spk_6/talk' THEN 'backend_blank' ELSE 'segment_repeated' END AS problem
FROM f WHERE job_id IN ('spk_5/talk', 'spk_6/talk', 'spk_7/talk')""")
def input_problems(spark, sf_dir):
    return _inputs(spark, sf_dir)[1]
