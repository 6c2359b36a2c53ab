"""Queries of inventories, shared features, references and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import vocabulary as vocab
from voxloom.functions.measure import blank
from voxloom.operators import inventory as inv, selection as sel
from voxloom.plans import views as v
from voxloom.plans.queries_jobs import digest_sql
from voxloom.plans.queries_weights import DECIDED, KNOWN, ROUTED, _routed, eligible_input
from voxloom.plans.registry import query
from voxloom.session import durable


def _full(spark, sf_dir):
    """Segments with roles, eligibility columns, observed phones and bins."""
    base = v.embeddings_of_segments(inv.with_eligibility_columns(eligible_input(spark, sf_dir)))
    text = v.segments(spark, sf_dir).select("segment_id", blank(F.col("transcript")).alias("transcript_blank"))
    roles = _routed(spark, sf_dir).select("segment_id", "talk_role", "talk_reason", "singing_role", "singing_reason")
    return base.join(roles, "segment_id").join(text, "segment_id").withColumn("has_f0", F.col("mean_f0_hz") > 0).withColumn("has_embedding", F.size("speaker_embedding") > 0)


FULL = ROUTED + DECIDED + """, el AS (SELECT segment_id, max(CASE WHEN target = 'talk' THEN eligibility END) AS talk_eligibility, max(CASE WHEN target = 'singing' THEN eligibility END) AS singing_eligibility,
   max(CASE WHEN target = 'talk' THEN reason_codes[1] END) AS talk_first, max(CASE WHEN target = 'singing' THEN reason_codes[1] END) AS singing_first FROM decided GROUP BY ALL),
 full_rows AS (SELECT e.*, r.talk_role, r.talk_reason, r.singing_role, r.singing_reason, el.talk_eligibility, el.singing_eligibility, el.talk_first, el.singing_first
   FROM embedded e JOIN routed r USING (segment_id) JOIN el USING (segment_id))
"""
FV = "segments aligned phonemes embedded content_classes content_overrides"
DOMAIN = """, dom AS (SELECT *, 'speech' AS domain, talk_role AS role, talk_reason AS reason FROM full_rows WHERE speaker_id IS NOT NULL
   UNION ALL SELECT *, 'singing', singing_role, singing_reason FROM full_rows WHERE speaker_id IS NOT NULL),
 grp AS (SELECT DISTINCT speaker_id, domain FROM dom), mem AS (SELECT *, len(speaker_embedding) > 0 AND NOT list_contains(list_transform(speaker_embedding, lambda x: isnan(x)), true) AS has_vector,
   mean_f0_hz > 0 AND f0_std_dev_hz >= 0 AND pitch_reliability > 0 AS pitch_ok, speaking_rate <> 0 OR pitch_range_semitones <> 0 OR energy_variation <> 0 OR pause_ratio <> 0 AS style_ok FROM dom WHERE role = 'primary'),
 dims AS (SELECT speaker_id, domain, arg_min(len(speaker_embedding), segment_id) AS dim FROM mem WHERE has_vector GROUP BY ALL),
 sized AS (SELECT m.*, d.dim, CASE WHEN NOT has_vector THEN 'embedding_unavailable' WHEN len(speaker_embedding) <> dim THEN 'embedding_dimension_mismatch' END AS vreason FROM mem m LEFT JOIN dims d USING (speaker_id, domain))
"""


@query("inv_1_embedding_means", FV, FULL + DOMAIN + """, x AS (SELECT speaker_id, domain, unnest(speaker_embedding) AS val, generate_subscripts(speaker_embedding, 1) - 1 AS dim FROM sized WHERE vreason IS NULL)
SELECT speaker_id, domain, CAST(dim AS INTEGER) AS dim, count(*) AS count, round(avg(val), 9) AS value FROM x GROUP BY ALL""")
def embedding_means(spark, sf_dir):
    e = inv.shared_features(_full(spark, sf_dir))["embedding"]
    return e.select("speaker_id", "domain", "count", F.posexplode("vector").alias("dim", "x")).select("speaker_id", "domain", "count", "dim", F.round("x", 9).alias("value"))


@query("inv_1_pitch_and_style", FV, FULL + DOMAIN + """SELECT g.speaker_id, g.domain, count(*) FILTER (pitch_ok) AS pitch_count, round(avg(mean_f0_hz) FILTER (pitch_ok), 6) AS mean_f0_hz,
  round(sqrt(avg(f0_std_dev_hz * f0_std_dev_hz) FILTER (pitch_ok) + var_pop(mean_f0_hz) FILTER (pitch_ok)), 6) AS f0_std_dev_hz, count(*) FILTER (style_ok) AS style_count,
  """ + ", ".join(f"round(avg({c}) FILTER (style_ok), 6) AS {c}" for c in inv.STYLE) + " FROM grp g LEFT JOIN mem m USING (speaker_id, domain) GROUP BY ALL")
def pitch_and_style(spark, sf_dir):
    s = inv.shared_features(_full(spark, sf_dir))["scalars"]
    return s.select("speaker_id", "domain", "pitch_count", "style_count", *[F.round(c, 6).alias(c) for c in ("mean_f0_hz", "f0_std_dev_hz", *inv.STYLE)])


@query("inv_1_skipped", FV, FULL + DOMAIN + """SELECT segment_id, domain, unnest(['speaker_embedding', 'f0_distribution', 'style_prosody']) AS feature, coalesce(reason, role) AS reason FROM dom WHERE role <> 'primary'
UNION ALL SELECT segment_id, domain, 'speaker_embedding', vreason FROM sized WHERE vreason IS NOT NULL
UNION ALL SELECT segment_id, domain, 'f0_distribution', 'f0_unavailable' FROM mem WHERE NOT pitch_ok
UNION ALL SELECT segment_id, domain, 'style_prosody', 'style_unavailable' FROM mem WHERE NOT style_ok""")
def skipped(spark, sf_dir):
    return inv.shared_features(_full(spark, sf_dir))["skipped"]


def _stat(cond, good):
    return f"CASE WHEN count(*) FILTER ({cond}) = 0 OR count(*) FILTER (({cond}) AND ({good})) = 0 THEN 'unavailable' WHEN count(*) FILTER ({cond}) = count(*) FILTER (({cond}) AND ({good})) THEN 'measured' ELSE 'partially_measured' END"


def _ms(seconds):
    return f"CAST(round({seconds} * 1000) AS BIGINT)"


INVENTORY = FULL + KNOWN + """, flags AS (SELECT *, coalesce(duration_sec, 0) AS sec, talk_role = 'primary' AS sp, talk_role = 'primary' AND talk_eligibility = 'eligible' AS spe, singing_role = 'primary' AS si,
   singing_role = 'primary' AND singing_eligibility = 'eligible' AS sie, (talk_role IN ('primary', 'feature_only') OR singing_role IN ('primary', 'feature_only')) AND talk_eligibility <> 'excluded' AS idn,
   CASE asr_status WHEN 'measured' THEN true WHEN 'legacy_unknown' THEN asr_confidence > 0 ELSE false END AS asr_ok FROM full_rows WHERE speaker_id IS NOT NULL),
 base AS (SELECT speaker_id, """ + ", ".join(f"coalesce(sum(sec) FILTER ({c}), 0) AS {n}" for c, n in (("sp", "speech_raw_seconds"), ("spe", "speech_eligible_seconds"), ("si", "singing_raw_seconds"), ("sie", "singing_eligible_seconds"), ("idn", "identity_seconds"))) + """,
   count(DISTINCT source_id) FILTER (spe) AS speech_recordings, count(DISTINCT cache_key) FILTER (spe) AS speech_utterances, count(*) FILTER (spe AND trim(transcript) <> '') AS transcript_usable,
   count(DISTINCT source_id) FILTER (sie) AS singing_recordings, count(DISTINCT cache_key) FILTER (sie) AS singing_phrases, count(DISTINCT source_id) FILTER (idn) AS identity_sources,
   """ + f"{_stat('true', 'duration_sec IS NOT NULL')} AS status_duration, {_stat('spe', 'asr_ok')} AS status_transcription, {_stat('sie', 'mean_f0_hz > 0')} AS status_singing_f0, {_stat('idn', 'len(speaker_embedding) > 0')} AS status_speaker_identity," + """
   concat(CASE WHEN count(*) FILTER (spe) > 0 THEN 'has_speech_teacher' ELSE 'speech_teacher_absent' END, ',', CASE WHEN count(*) FILTER (sie) > 0 THEN 'has_singing_teacher' ELSE 'singing_teacher_absent' END,
     CASE WHEN count(*) FILTER (idn) > 0 THEN ',has_identity_reference' ELSE '' END) AS derived_tags FROM flags GROUP BY speaker_id),
 cov AS (SELECT speaker_id, count(DISTINCT phoneme) AS phoneme_coverage FROM flags JOIN observed USING (segment_id) WHERE spe GROUP BY ALL),
 bin AS (SELECT speaker_id, count(DISTINCT pitch_bin) AS pitch_bins FROM flags JOIN bins USING (segment_id) WHERE sie GROUP BY ALL),
 inv0 AS (SELECT base.*, coalesce(phoneme_coverage, 0) AS phoneme_coverage, coalesce(pitch_bins, 0) AS pitch_bins FROM base LEFT JOIN cov USING (speaker_id) LEFT JOIN bin USING (speaker_id)),
 inv AS (SELECT *, """ + digest_sql(
    "'1'", "'dataset-1'", "CAST(NULL AS VARCHAR)", "speaker_id", _ms("speech_raw_seconds"), _ms("speech_eligible_seconds"), "speech_recordings", "speech_utterances", "transcript_usable", "phoneme_coverage",
    _ms("singing_raw_seconds"), _ms("singing_eligible_seconds"), "singing_recordings", "singing_phrases", "pitch_bins", _ms("identity_seconds"), "identity_sources",
    "status_duration", "status_transcription", "status_singing_f0", "status_speaker_identity") + """ AS inventory_revision FROM inv0)
"""
SECONDS = ("speech_raw_seconds", "speech_eligible_seconds", "singing_raw_seconds", "singing_eligible_seconds", "identity_seconds")


def _inventory(spark, sf_dir):
    return durable(inv.speaker_inventory(_full(spark, sf_dir), "dataset-1"))


@query("inv_2_speaker_inventory", FV, INVENTORY + "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in SECONDS) + ") FROM inv")
def speaker_inventory(spark, sf_dir):
    out = _inventory(spark, sf_dir).withColumn("derived_tags", F.array_join("derived_tags", ","))
    return out.withColumns({c: F.round(c, 6) for c in SECONDS})


TIMBRE = FULL + """, refs AS (SELECT speaker_id, 'talk' AS target, segment_id, source_id, cache_key, CASE WHEN singing_role = 'primary' AND talk_eligibility <> 'excluded' THEN 'reference' ELSE 'skipped' END AS kind,
   CASE WHEN singing_role = 'primary' THEN CASE WHEN talk_eligibility = 'excluded' THEN talk_first END ELSE coalesce(talk_reason, talk_role) END AS reason
   FROM full_rows WHERE speaker_id IS NOT NULL AND (singing_role = 'primary' OR talk_role <> 'primary')
  UNION ALL SELECT speaker_id, 'singing', segment_id, source_id, cache_key, CASE WHEN talk_role = 'primary' AND singing_eligibility <> 'excluded' THEN 'reference' ELSE 'skipped' END,
   CASE WHEN talk_role = 'primary' THEN CASE WHEN singing_eligibility = 'excluded' THEN singing_first END ELSE coalesce(talk_reason, talk_role) END
   FROM full_rows WHERE speaker_id IS NOT NULL AND (talk_role = 'primary' OR singing_role <> 'primary'))
"""


@query("inv_3_timbre_references", FV, TIMBRE + "SELECT speaker_id, target, segment_id, kind, reason FROM refs")
def timbre(spark, sf_dir):
    return inv.timbre_references(_full(spark, sf_dir)).select("speaker_id", "target", "segment_id", "kind", "reason")


def _print_sql():
    from voxloom.plans.queries_jobs import set_print_sql

    return set_print_sql("(SELECT * FROM refs WHERE kind = 'reference')", "speaker_id, target", "sha256(concat_ws('|', concat('v', length(CAST(segment_id AS VARCHAR)), ':', segment_id), concat('v', length(CAST(source_id AS VARCHAR)), ':', source_id), concat('v', length(CAST(cache_key AS VARCHAR)), ':', cache_key)))", "input_hash")


@query("inv_3_reference_hash", FV, TIMBRE + _print_sql())
def reference_hash(spark, sf_dir):
    return inv.reference_fingerprint(inv.timbre_references(_full(spark, sf_dir)))


@query("inv_4_consumption", FV, TIMBRE + """, used AS (SELECT speaker_id, target, segment_id FROM refs WHERE CAST(substr(segment_id, 5) AS BIGINT) % 13 <> 1 AND (kind = 'reference' OR CAST(substr(segment_id, 5) AS BIGINT) % 17 = 1))
SELECT speaker_id, target, segment_id, 'not_consumed' AS problem FROM (SELECT speaker_id, target, segment_id FROM refs WHERE kind = 'reference' EXCEPT SELECT * FROM used)
UNION ALL SELECT speaker_id, target, segment_id, 'not_chosen' FROM (SELECT * FROM used EXCEPT SELECT speaker_id, target, segment_id FROM refs WHERE kind = 'reference')""")
def consumption(spark, sf_dir):
    refs = inv.timbre_references(_full(spark, sf_dir))
    n = F.substring("segment_id", 5, 20).cast("long")
    used = refs.where((n % 13 != 1) & ((F.col("kind") == "reference") | (n % 17 == 1)))
    return inv.consumption_problems(refs.where("kind = 'reference'"), used, ["speaker_id", "target"])


def _styles(spark, sf_dir):
    vectors = v.speaker_vectors(spark, sf_dir).select(
        F.expr("concat('model_', cast(label as varchar(20)))").alias("model_id"), F.col("segment_id").alias("vector_id"),
        F.expr("CASE WHEN label % 4 = 3 THEN 'NATION_3' ELSE 'ref_voice' END").alias("style_name"),
        F.expr("CASE WHEN vec_id % 7 = 0 THEN slice(embedding, 1, 63) WHEN vec_id % 11 = 0 THEN concat(slice(embedding, 1, 63), array(double('nan'))) ELSE embedding END").alias("embedding"),
    )
    styles = v.table(spark, sf_dir, "nation").select(
        F.expr("concat('model_', cast(n_regionkey as varchar(20)))").alias("model_id"), F.expr("n_name").alias("style_name"), F.expr("n_nationkey div 5").alias("style_index")
    )
    return vectors, styles


STYLES = """, vec AS (SELECT concat('model_', label) AS model_id, segment_id AS vector_id, CASE WHEN label % 4 = 3 THEN 'NATION_3' ELSE 'ref_voice' END AS style_name, embedding,
   CASE WHEN vec_id % 7 = 0 THEN 'wrong_dimension' WHEN vec_id % 11 = 0 THEN 'not_finite' END AS problem FROM speaker_vectors),
 styles AS (SELECT concat('model_', n_regionkey) AS model_id, n_name AS style_name, n_nationkey // 5 AS style_index FROM nation)
"""


@query("inv_5_reference_style", "speaker_vectors", STYLES + """, ex AS (SELECT model_id, count(*) AS n, max(style_index) AS m FROM styles GROUP BY ALL),
 x AS (SELECT model_id, style_name, unnest(embedding) AS val, generate_subscripts(embedding, 1) - 1 AS dim FROM vec WHERE problem IS NULL),
 mean AS (SELECT model_id, style_name, dim, avg(val) AS val, count(*) AS reference_count FROM x GROUP BY ALL)
SELECT model_id, style_name, reference_count, CASE WHEN t.style_name IS NULL THEN coalesce(n, 0) END AS style_index, CAST(dim AS INTEGER) AS dim, round(val, 7) AS value,
  CASE WHEN t.style_name IS NOT NULL THEN 'name_taken' WHEN m + 1 <> n THEN 'index_list_broken' END AS problem
FROM mean LEFT JOIN ex USING (model_id) LEFT JOIN styles t USING (model_id, style_name)""")
def reference_style(spark, sf_dir):
    made, _ = inv.reference_style(*_styles(spark, sf_dir), 64)
    return made.select("model_id", "style_name", "reference_count", "style_index", "problem", F.posexplode("vector").alias("dim", "x")).withColumn("value", F.round("x", 7)).drop("x")


@query("inv_5_skipped_vectors", "speaker_vectors", STYLES + "SELECT model_id, style_name, vector_id, problem FROM vec WHERE problem IS NOT NULL")
def skipped_vectors(spark, sf_dir):
    return inv.reference_style(*_styles(spark, sf_dir), 64)[1]


def _clock(c):
    w = f"CAST(round_even({c}, 0) AS BIGINT)"
    return f"CASE WHEN {w} < 60 THEN concat({w}, 's') ELSE concat({w} // 60, 'm', lpad(CAST({w} % 60 AS VARCHAR), 2, '0'), 's') END"


def _amount(e, r):
    main = f"CASE WHEN {e} <= 0 THEN 'none' ELSE {_clock(e)} END"
    return main if r is None else f"CASE WHEN {r} > 0 THEN concat({main}, ' (assigned ', {_clock(r)}, ')') ELSE {main} END"


def _note(s, label):
    return f"CASE {s} WHEN 'measured' THEN '' WHEN 'partially_measured' THEN ' / {label} partly unmeasured' ELSE ' / {label} unmeasured' END"


@query("inv_6_material_lines", FV, INVENTORY + f""", l AS (SELECT speaker_id, [concat('speech: ', {_amount('speech_eligible_seconds', 'speech_raw_seconds')}, ' / utterances ', speech_utterances, ' / transcripts ', transcript_usable, {_note('status_transcription', 'transcription')}),
   concat('singing: ', {_amount('singing_eligible_seconds', 'singing_raw_seconds')}, ' / phrases ', singing_phrases, ' / pitch bins ', pitch_bins, {_note('status_singing_f0', 'pitch')}),
   concat('identity: ', {_amount('identity_seconds', None)}, ' / recordings ', identity_sources, {_note('status_speaker_identity', 'speaker feature')}),
   CASE WHEN status_duration <> 'measured' THEN concat('note:', {_note('status_duration', 'duration')}) END] AS lines FROM inv),
 u AS (SELECT speaker_id, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no FROM l)
SELECT * FROM u WHERE line IS NOT NULL""")
def material_lines(spark, sf_dir):
    return inv.material_lines(_inventory(spark, sf_dir))


def _requests(spark, sf_dir):
    speakers = v.segments(spark, sf_dir).where("speaker_id IS NOT NULL").select("speaker_id").distinct()
    return speakers.select(
        "speaker_id", F.explode(F.array(F.lit("talk"), F.lit("singing"))).alias("target"),
        F.expr("CASE WHEN cast(substring(speaker_id, 5) as int) % 2 = 0 THEN 'builtin.natural' ELSE 'builtin.powerful' END").alias("preset_id"),
    )


# Extra catalog rows so that version order matters: (id, version, target, preset ids, available).
_EXTRA = (
    ("community.talk_plain", "1.9.0", "talk", (), True), ("community.talk_plain", "1.10.0", "talk", (), True),
    ("community.talk_plain", "1.10.0-rc.1", "talk", ("builtin.powerful",), True), ("community.duet", "2.0.0", "singing", ("builtin.powerful",), True),
)
_EXTRA_RULES = (
    ("community.talk_plain", "speech_teacher", "eligible_seconds", "gt", 10.0), ("community.talk_plain", "feature_only", "eligible_seconds", "gte", 1.0),
    ("community.duet", "singing_teacher", "distinct_sources", "lte", 3.0), ("community.duet", "identity_reference", "distinct_sources", "gte", 1.0),
)
_EXTRA_STAGES = (("community.talk_plain", "base", True, ("singing_teacher",), ("tts_base",)), ("community.duet", "base", True, ("speech_teacher",), ("singing_base",)))


def _catalog(spark):
    strategies = vocab.fixed_table(spark, [(i, ver, t, list(p), a) for i, ver, t, p, a in vocab.STRATEGIES + _EXTRA],
                                   "strategy_id string, version string, target string, preset_ids array<string>, available boolean")
    rules = vocab.fixed_table(spark, vocab.REQUIREMENTS + _EXTRA_RULES, "strategy_id string, role string, metric string, op string, required double")
    stages = vocab.fixed_table(spark, [(i, s, t, list(a), list(b)) for i, s, t, a, b in vocab.STAGES + _EXTRA_STAGES],
                               "strategy_id string, stage_id string, trains boolean, input_roles array<string>, output_types array<string>")
    return strategies, rules, stages


def _values(rows):
    def lit(x):
        if isinstance(x, tuple):
            return "CAST([" + ", ".join(lit(y) for y in x) + "] AS VARCHAR[])"
        return repr(x) if isinstance(x, str) else ("true" if x is True else "false" if x is False else f"{x}::DOUBLE")
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


RULED = INVENTORY + f""", strategies AS (SELECT * FROM (VALUES {_values(vocab.STRATEGIES + _EXTRA)}) x(strategy_id, version, supported_target, preset_ids, available)),
 rules AS (SELECT * FROM (VALUES {_values(vocab.REQUIREMENTS + _EXTRA_RULES)}) x(strategy_id, role, metric, op, required)),
 requests AS (SELECT DISTINCT speaker_id, t AS target, CASE WHEN CAST(substr(speaker_id, 5) AS INTEGER) % 2 = 0 THEN 'builtin.natural' ELSE 'builtin.powerful' END AS preset_id
   FROM segments CROSS JOIN (VALUES ('talk'), ('singing')) k(t) WHERE speaker_id IS NOT NULL),
 long AS (SELECT speaker_id, status_duration, unnest([{{'role': 'speech_teacher', 'metric': 'eligible_seconds', 'actual': speech_eligible_seconds::DOUBLE}}, {{'role': 'speech_teacher', 'metric': 'independent_utterances', 'actual': speech_utterances::DOUBLE}},
   {{'role': 'speech_teacher', 'metric': 'distinct_sources', 'actual': speech_recordings::DOUBLE}}, {{'role': 'speech_teacher', 'metric': 'phoneme_coverage_count', 'actual': phoneme_coverage::DOUBLE}},
   {{'role': 'singing_teacher', 'metric': 'eligible_seconds', 'actual': singing_eligible_seconds::DOUBLE}}, {{'role': 'singing_teacher', 'metric': 'independent_phrases', 'actual': singing_phrases::DOUBLE}},
   {{'role': 'singing_teacher', 'metric': 'distinct_sources', 'actual': singing_recordings::DOUBLE}}, {{'role': 'singing_teacher', 'metric': 'pitch_bins_observed', 'actual': pitch_bins::DOUBLE}},
   {{'role': 'identity_reference', 'metric': 'eligible_seconds', 'actual': identity_seconds::DOUBLE}}, {{'role': 'identity_reference', 'metric': 'distinct_sources', 'actual': identity_sources::DOUBLE}}], recursive := true) FROM inv),
 meas AS (SELECT speaker_id, role, metric, CASE WHEN NOT (metric = 'eligible_seconds' AND status_duration = 'unavailable') THEN actual END AS actual, metric <> 'eligible_seconds' OR status_duration = 'measured' AS complete FROM long),
 held AS (SELECT q.speaker_id, q.target, q.preset_id, s.strategy_id, s.version, s.supported_target, s.preset_ids, s.available, r.role, r.metric, r.op, r.required, m.actual, m.complete,
   CASE r.op WHEN 'gte' THEN actual >= required WHEN 'gt' THEN actual > required WHEN 'lte' THEN actual <= required WHEN 'lt' THEN actual < required ELSE actual = required END AS holds
   FROM requests q CROSS JOIN strategies s JOIN rules r USING (strategy_id) LEFT JOIN meas m ON m.speaker_id = q.speaker_id AND m.role = r.role AND m.metric = r.metric),
 results AS (SELECT *, CASE WHEN actual IS NULL THEN 'unknown' WHEN NOT complete AND NOT (holds AND op IN ('gte', 'gt')) THEN 'unknown' WHEN holds THEN 'met' ELSE 'unmet' END AS outcome FROM held),
 fits0 AS (SELECT speaker_id, target, preset_id, strategy_id, version, list_contains(preset_ids, preset_id) AS preset_specific,
   list_concat(list_filter([CASE WHEN supported_target <> target THEN 'target_unsupported' END, CASE WHEN len(preset_ids) > 0 AND NOT list_contains(preset_ids, preset_id) THEN 'preset_unsupported' END,
     CASE WHEN NOT available THEN 'capability_missing' END], lambda x: x IS NOT NULL),
     coalesce(list(DISTINCT concat('requirement:', role, ':', metric) ORDER BY concat('requirement:', role, ':', metric)) FILTER (outcome = 'unmet'), CAST([] AS VARCHAR[]))) AS refusals,
   bool_or(outcome = 'unknown') AS unk FROM results GROUP BY speaker_id, target, preset_id, strategy_id, version, supported_target, preset_ids, available),
 fits AS (SELECT * EXCLUDE (unk), CASE WHEN len(refusals) > 0 THEN 'unmet' WHEN unk THEN 'unknown' ELSE 'met' END AS outcome FROM fits0)
"""
VERSION_ORDER = """CAST(split_part(split_part(version, '-', 1), '.', 1) AS BIGINT) DESC, CAST(split_part(split_part(version, '-', 1), '.', 2) AS BIGINT) DESC,
  CAST(split_part(split_part(version, '-', 1), '.', 3) AS BIGINT) DESC, CASE WHEN contains(version, '-') THEN 1 ELSE 0 END, split_part(version, '-', 2) DESC"""


def _results(spark, sf_dir):
    strategies, rules, _ = _catalog(spark)
    return sel.requirement_results(_requests(spark, sf_dir), _inventory(spark, sf_dir), strategies, rules)


def _fits(spark, sf_dir):
    return sel.strategy_fits(_requests(spark, sf_dir), _results(spark, sf_dir), _catalog(spark)[0])


@query("sel_1_requirements", FV, RULED + "SELECT speaker_id, target, strategy_id, version, role, metric, op, required, round(actual, 6) AS actual, outcome FROM results")
def requirement_results(spark, sf_dir):
    return _results(spark, sf_dir).withColumn("actual", F.round("actual", 6))


@query("sel_1_strategy_fit", FV, RULED + "SELECT speaker_id, target, preset_id, strategy_id, version, outcome, array_to_string(refusals, ',') AS refusals, preset_specific FROM fits")
def strategy_fit(spark, sf_dir):
    return _fits(spark, sf_dir).withColumn("refusals", F.array_join("refusals", ","))


@query("sel_2_ranking", FV, RULED + f"""SELECT speaker_id, target, strategy_id, version, outcome, CAST(row_number() OVER (PARTITION BY speaker_id, target ORDER BY CASE outcome WHEN 'met' THEN 0 ELSE 1 END,
  CASE WHEN preset_specific THEN 0 ELSE 1 END, strategy_id, {VERSION_ORDER}) AS INTEGER) AS rank FROM fits WHERE outcome <> 'unmet'""")
def ranking(spark, sf_dir):
    return sel.ranked_candidates(_fits(spark, sf_dir)).select("speaker_id", "target", "strategy_id", "version", "outcome", "rank")


@query("sel_3_plan", FV, RULED + f""", stages AS (SELECT * FROM (VALUES {_values(vocab.STAGES + _EXTRA_STAGES)}) x(strategy_id, stage_id, trains, ins, outs)),
 facts AS (SELECT strategy_id, bool_or(list_contains(ins, 'singing_teacher') AND NOT list_contains(ins, 'speech_teacher') AND trains AND list_has_any(outs, ['tts_base', 'talk_model'])) AS tg,
   bool_or(list_contains(outs, 'singing_base') AND NOT list_contains(ins, 'singing_teacher')) AS sg, bool_or(list_contains(ins, 'speech_teacher')) AS sp, bool_or(list_contains(ins, 'singing_teacher')) AS si FROM stages GROUP BY ALL),
 judged AS (SELECT f.*, CASE WHEN target = 'talk' THEN sp ELSE si END AS direct, CASE WHEN target = 'talk' AND tg THEN 'singing_as_speech_teacher' WHEN target = 'singing' AND sg THEN 'speech_as_singing_teacher' END AS guard FROM fits f JOIN facts USING (strategy_id)),
 ok AS (SELECT *, len(refusals) = 0 AND guard IS NULL AS ok FROM judged)
SELECT speaker_id, target, strategy_id, version, CASE WHEN ok THEN 'candidate' ELSE 'rejected' END AS kind,
  CAST(CASE WHEN ok THEN row_number() OVER (PARTITION BY speaker_id, target, ok ORDER BY CASE outcome WHEN 'met' THEN 0 ELSE 1 END, CASE WHEN direct THEN 0 ELSE 1 END, CASE WHEN preset_specific THEN 0 ELSE 1 END, strategy_id, {VERSION_ORDER}) END AS INTEGER) AS rank,
  CASE WHEN ok THEN CASE WHEN target = 'talk' THEN CASE WHEN direct THEN 'speech_teacher_based' ELSE 'singing_timbre_reference' END ELSE CASE WHEN direct THEN 'singing_teacher_based' ELSE 'speech_timbre_reference' END END END AS variant,
  CASE WHEN ok THEN outcome END AS outcome, array_to_string(list_concat(refusals, CASE WHEN guard IS NULL THEN CAST([] AS VARCHAR[]) ELSE [guard] END), ',') AS reasons FROM ok""")
def plan(spark, sf_dir):
    return sel.plan(_fits(spark, sf_dir), _catalog(spark)[2]).withColumn("reasons", F.array_join("reasons", ","))


def intake_items(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("position"), F.expr("CASE doc_id % 13 WHEN 0 THEN 'mp3' WHEN 1 THEN 'WAV' ELSE 'wav' END").alias("extension"),
        F.expr("doc_id % 17 <> 0").alias("exists"), F.expr("CASE WHEN doc_id % 19 = 0 THEN NULL ELSE n_chars / 5e1 END").alias("seconds"), F.sha2("text", 256).alias("sha256"),
    )


#: The intake as a recursion: from what a job holds to the first later clip that fits.
INTAKE = """WITH RECURSIVE items AS (SELECT source AS job_id, doc_id AS position, doc_id % 13 = 0 AS mp3, doc_id % 17 = 0 AS gone, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE n_chars / 5e1 END AS seconds, sha256(text) AS sha256 FROM documents),
 judged AS (SELECT *, CASE WHEN mp3 THEN 'not_wav' WHEN gone THEN 'missing' WHEN seconds IS NULL OR seconds <= 0 THEN 'unreadable' WHEN seconds > 30 THEN 'too_long' END AS own FROM items),
 fit AS (SELECT * FROM judged WHERE own IS NULL),
 held(job_id, n, position, spent, seen) AS (SELECT job_id, 0, -1::BIGINT, 0e0, CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT job_id FROM items WHERE job_id IS NOT NULL)
  UNION ALL SELECT job_id, n + 1, nxt.position, spent + nxt.seconds, list_append(seen, nxt.sha256)
  FROM (SELECT h.job_id, h.n, h.spent, h.seen, arg_min({'position': f.position, 'seconds': f.seconds, 'sha256': f.sha256}, f.position) AS nxt FROM held h JOIN fit f ON f.job_id = h.job_id AND f.position > h.position AND h.spent + f.seconds <= 120
    AND NOT list_contains(h.seen, f.sha256) WHERE h.n < 8 GROUP BY h.job_id, h.n, h.spent, h.seen)),
 got AS (SELECT h.job_id, h.position, f.seconds FROM held h JOIN fit f USING (job_id, position)),
 seen AS (SELECT i.job_id, i.position, count(g.position) AS n, coalesce(sum(g.seconds), 0) AS spent FROM judged i LEFT JOIN got g ON g.job_id = i.job_id AND g.position < i.position GROUP BY ALL)
"""


@query("sel_4_reference_intake", sql=INTAKE + """SELECT i.job_id, i.position, i.sha256, i.seconds, g.position IS NOT NULL AS accepted, CASE WHEN g.position IS NOT NULL THEN NULL WHEN n >= 8 THEN 'too_many' WHEN own IS NOT NULL THEN own
  WHEN spent + i.seconds > 120 THEN 'over_budget' ELSE 'repeated_content' END AS reason FROM judged i JOIN seen s ON s.job_id IS NOT DISTINCT FROM i.job_id AND s.position = i.position LEFT JOIN got g ON g.job_id = i.job_id AND g.position = i.position""")
def reference_intake(spark, sf_dir):
    return sel.reference_intake(intake_items(spark, sf_dir))
