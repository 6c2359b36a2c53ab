"""Domain views over the driver tables, as DataFrames and as the same views in ANSI SQL.

There is no audio in the driver data. Each view derives a domain table from whole driver tables with
integer arithmetic and double literals, so that Spark and a SQL engine give the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voxloom.functions import phone_arrays
from voxloom.functions.vocabulary import KNOWN_PHONES
from voxloom.operators.sequences import position_in
from voxloom.plans import phones
from voxloom.session import ship_package

PHONES = T.ArrayType(T.StructType([
    T.StructField("phoneme", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("start_sec", "end_sec", "confidence")]]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows over all cores, whatever files they come from.

    Row-wise work on texts is CPU-bound. The number of splits says nothing about where the rows are: a
    Parquet row group is read by one task, so a file of one group has all its rows in one of many splits.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if splits < cores else max(splits, 4 * cores), key)


# Expressions below are valid in both dialects; {sha} is the only dialect difference.
SEGMENT_COLUMNS = [
    ("doc_id", "d.doc_id"),
    ("segment_id", "concat('seg_', lpad(cast(d.doc_id as varchar(20)), 8, '0'))"),
    ("source_id", "d.source"),
    ("speaker_id", "CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE concat('spk_', cast(d.doc_id % 8 as varchar(20))) END"),
    ("content_type", "CASE WHEN d.lang = 'es' THEN 'ambiguous' WHEN d.lang = 'en' AND d.doc_id % 3 <> 0 THEN 'speech' ELSE 'singing' END"),
    ("cache_key", "{sha}"),
    ("transcript", "d.text"),
    ("asr_confidence", "(d.doc_id * 37 % 101) / 1e2"),
    ("asr_status", "CASE d.doc_id % 7 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'uncalibrated' WHEN 2 THEN 'legacy_unknown' ELSE 'measured' END"),
    ("alignment_confidence", "(d.doc_id * 53 % 101) / 1e2"),
    ("alignment_status", "CASE WHEN d.doc_id % 4 = 1 THEN 'uncalibrated' WHEN d.doc_id % 27 = 0 THEN 'unavailable' ELSE 'measured' END"),
    ("alignment_method", "CASE WHEN d.doc_id % 5 = 0 THEN 'legacy-uniform-placeholder' ELSE 'mfa-japanese-phone-forced-alignment-v1' END"),
    ("has_measurement", "d.doc_id % 5 <> 0"),
    ("voiced_ratio", "(d.doc_id % 11) / 1e1"),
    ("voicing_path", "CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE concat('features/', cast(d.doc_id as varchar(20)), '.json') END"),
    ("audio_readable", "d.doc_id % 37 <> 0"),
    ("mean_f0_hz", "CASE WHEN d.doc_id % 13 = 0 THEN 0e0 ELSE 8e1 + d.doc_id % 400 END"),
    ("f0_std_dev_hz", "(d.doc_id % 50) * 1e0"),
    ("pitch_reliability", "(d.doc_id * 29 % 101) / 1e2"),
    ("duration_sec", "CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE d.n_chars / 15e0 END"),
    ("speaking_rate", "CASE WHEN d.doc_id % 30 = 0 THEN 0e0 ELSE (d.doc_id % 9) / 2e0 END"),
    ("pitch_range_semitones", "CASE WHEN d.doc_id % 30 = 0 THEN 0e0 ELSE (d.doc_id % 12) / 2e0 END"),
    ("energy_variation", "CASE WHEN d.doc_id % 30 = 0 THEN 0e0 ELSE (d.doc_id % 10) / 1e1 END"),
    ("pause_ratio", "CASE WHEN d.doc_id % 30 = 0 THEN 0e0 ELSE (d.doc_id % 8) / 1e1 END"),
    ("user_excluded", "coalesce(l.toxic, 0) = 1"),
    ("wrong_speaker", "coalesce(l.quality, 1) = 0 AND d.doc_id % 2 = 0"),
    ("quality_label", "l.quality"),
]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without their phones."""
    d, l = spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_doc_id")
    joined = d.alias("d").join(l.alias("l"), F.expr("d.doc_id = l.l_doc_id"), "left")
    return joined.select(*[F.expr(e.format(sha="sha2(d.text, 256)")).alias(n) for n, e in SEGMENT_COLUMNS])


def folded_phones(segs: DataFrame, fold, schema: T.StructType | str) -> DataFrame:
    """What ``fold`` makes of batches of ``segs`` with ``phonemes``: every letter a-z of the whole text, in
    order, as timed phones.

    They are made as arrays, a few documents at a time, and after whatever ``segs`` filters or joins.
    ``segs`` brings ``doc_id`` and the text, as ``transcript`` or in lower case as ``_lower``.
    """
    ship_package(segs.sparkSession)
    lowered = segs if "_lower" in segs.columns else segs.withColumn("_lower", F.lower("transcript"))
    return lowered.mapInArrow(lambda batches: fold(phones.append_phones(batches)), schema)


def with_phones(segs: DataFrame, kernels: dict | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``phonemes`` and what ``kernels`` (name: kernel of ``phone_arrays`` and type) make of them; ``drop``
    names columns, ``phonemes`` among them, that need not leave the task."""
    kernels = kernels or {}
    early = [c for c in drop if c not in ("phonemes", "doc_id")]
    lean = segs.withColumn("_lower", F.lower("transcript")).drop(*early)
    fields = [f for f in segs.schema if f.name not in drop] + [T.StructField("phonemes", PHONES)] * ("phonemes" not in drop)
    schema = T.StructType([*fields, *[T.StructField(n, kind) for n, (_, kind) in kernels.items()]])
    return folded_phones(lean, phone_arrays.added({n: k for n, (k, _) in kernels.items()}, drop), schema)


#: Kernels of ``with_phones``: alignment as singing data needs it, lists of singing sets, phones of the catalog.
WELL_TIMED = {"_well_timed": (phone_arrays.well_timed, T.BooleanType())}
LISTS = {n: (k, T.ArrayType(T.StringType() if n == "phones" else T.DoubleType())) for n, k in phone_arrays.ITEM_LISTS.items()}
KNOWN = {"_known": (phone_arrays.known_phones(KNOWN_PHONES), T.ArrayType(T.StringType()))}


def phoned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_phones(segments(spark, sf_dir))


def embeddings_of_segments(segs: DataFrame) -> DataFrame:
    """Add ``speaker_embedding``: some empty, some of another dimension, some not finite."""
    i = F.col("doc_id")
    base = F.array((i % 3 + 1) * F.lit(1.0), (i % 5) * F.lit(1.0), (i % 7) * F.lit(1.0), (i % 2) * F.lit(1.0))
    empty = F.array().cast("array<double>")
    return segs.withColumn(
        "speaker_embedding",
        F.when(i % 9 == 0, empty).when(i % 41 == 0, F.slice(base, 1, 3))
        .when(i % 43 == 0, F.array(F.lit(float("nan")), F.lit(1.0), F.lit(1.0), F.lit(1.0))).otherwise(base),
    )


def content_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic classes; a few segments are classified twice (the last row counts) and some never."""
    once = segments(spark, sf_dir).where("doc_id % 19 <> 0").select(
        "segment_id", "content_type", F.expr("(doc_id * 41 % 101) / 1e2").alias("confidence"),
        F.expr("doc_id % 29 = 0").alias("user_overridden"), F.lit(1).alias("position"), "doc_id",
    )
    again = once.where("doc_id % 31 = 0").withColumn("content_type", F.lit("speech")).withColumn("position", F.lit(2))
    return once.unionByName(again).drop("doc_id")


def content_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit log of content types, from conversation turns; two turns share one time."""
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select(
        F.expr("concat('seg_', lpad(cast(conv_id * 3 as varchar(20)), 8, '0'))").alias("segment_id"),
        F.expr("CASE turn % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'ambiguous' ELSE 'singing' END").alias("original_type"),
        F.expr("CASE (turn + conv_id) % 3 WHEN 0 THEN 'singing' WHEN 1 THEN 'speech' ELSE 'ambiguous' END").alias("new_type"),
        F.expr("turn div 2").alias("changed_at"), F.col("turn").alias("seq"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit log of features, from conversation turns; two turns share one time."""
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat('seg_', lpad(cast(conv_id as varchar(20)), 8, '0'))").alias("segment_id"),
        F.expr("turn div 2").alias("changed_at"), F.col("turn").alias("seq"),
        F.expr("CASE role WHEN 'user' THEN 'transcript' WHEN 'system' THEN 'Transcript' ELSE 'note' END").alias("field"),
        F.col("text").alias("value"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature frames of one clip per user, in event time order."""
    events = table(spark, sf_dir, "events").select(
        F.expr("concat('clip_', cast(user_id as varchar(20)))").alias("segment_id"),
        "event_id", "ts", "event_type", "value", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour"),
    )
    placed = position_in(events, ["segment_id"], "hour", ["ts", "event_id"], "idx")
    return placed.select(
        "segment_id", "idx", "event_id", "event_type", "value",
        (F.col("idx") * F.lit(0.01)).alias("time_sec"),
        F.expr("CASE WHEN event_type = 'error' THEN 0e0 ELSE 2e2 + event_id % 7 END").alias("f0"),
        F.expr("CASE WHEN event_type = 'error' THEN 0e0 ELSE 9e-1 END").alias("f0_conf"),
        F.least(F.lit(1.0), F.col("value") / 1000.0).alias("energy"),
        F.expr("CASE WHEN event_type = 'error' THEN 0e0 ELSE 1e0 END").alias("voicing"),
        F.expr("85e-2 + (event_id % 15) / 1e2").alias("periodicity"),
        (F.col("value") * 10.0).alias("rms"),
    )


def clip_phones(spark: SparkSession, sf_dir: str, placed: DataFrame | None = None) -> DataFrame:
    """One long vowel per 40 frames of every clip, with a consonant across some borders."""
    source = frames(spark, sf_dir) if placed is None else placed
    spans = source.groupBy("segment_id", F.expr("idx div 40").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    vowel = spans.select(
        "segment_id",
        F.expr("CASE block % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'i' ELSE 'u' END").alias("phoneme"),
        F.expr("block * 4e-1").alias("start_sec"), F.expr("block * 4e-1 + 4e-1").alias("end_sec"),
        F.expr("CASE WHEN block % 4 = 3 THEN 5e-1 ELSE 9e-1 END").alias("confidence"),
    )
    consonant = spans.where("block % 2 = 1").select(
        "segment_id", F.lit("k").alias("phoneme"), F.expr("block * 4e-1 - 1e-2").alias("start_sec"),
        F.expr("block * 4e-1 + 2e-2").alias("end_sec"), F.lit(0.9).alias("confidence"),
    )
    return vowel.unionByName(consonant)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCM samples in long form: every order is a clip, its line items are its samples."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"),
        F.expr("l_partkey * 10 + l_linenumber").alias("sample_key"),
        F.expr("cast(floor(l_quantity * 65e1) as int) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END").alias("sample"),
        F.expr("cast(floor(l_discount * 32e4) as int)").alias("other_channel"),
    )


def speaker_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("concat('seg_', lpad(cast(vec_id as varchar(20)), 8, '0'))").alias("segment_id"),
        F.expr("concat('spk_', cast(label as varchar(20)))").alias("speaker_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.expr("1e0 + vec_id % 20").alias("duration_sec"),
        F.col("vec_id"), F.col("label"),
    )


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder listing: one media file per page."""
    return table(spark, sf_dir, "pages").select(
        F.expr(
            "concat('/media/p', cast(page_id as varchar(20)), CASE page_id % 5 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP4' "
            "WHEN 2 THEN '.txt' WHEN 3 THEN '.Opus' ELSE '.mkv' END)"
        ).alias("path"),
        F.encode("html", "utf-8").alias("content"),
        F.expr("page_id * 1000").alias("modified_ms"), "page_id",
    )


def benchmark_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated supplement candidates with verification metrics around every gate."""
    return table(spark, sf_dir, "documents").where("length(text) > 0").select(
        F.expr("concat('cand_', cast(doc_id as varchar(20)))").alias("candidate_id"),
        F.expr("concat('spk_', cast(doc_id % 8 as varchar(20)))").alias("speaker_id"),
        F.expr("-1e-2 * (doc_id % 60)").alias("asr_avg_logprob"),
        F.expr("75e-2 + (doc_id % 26) / 1e2").alias("speaker_similarity"),
        F.expr("(doc_id % 25) / 1e2").alias("no_speech_probability"),
        F.expr("1e0 + doc_id % 15").alias("duration_sec"),
        F.expr("4e-3 + (doc_id % 30) / 1e3").alias("rms"),
        F.expr("(doc_id % 12) / 1e4").alias("clipping_ratio"),
        F.expr("(doc_id % 70) / 1e2").alias("silence_ratio"),
        F.expr("doc_id % 9 <> 0").alias("fingerprint_current"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'kw' WHEN 1 THEN 'gw' WHEN 2 THEN 'ts' ELSE 'py' END").alias("rare_phone"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'a' ELSE 'o' END").alias("common_phone"),
        F.expr("doc_id % 10 = 0").alias("misrecognized"), F.expr("sha2(text, 256)").alias("audio_sha256"), "doc_id",
    )


# ---------------------------------------------------------------- the same views in SQL

def _columns(sha: str) -> str:
    return ",\n  ".join(f"{e.format(sha=sha)} AS {n}" for n, e in SEGMENT_COLUMNS)


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "segments": ((), f"SELECT {_columns('sha256(d.text)')} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "letters": (("segments",), """SELECT segment_id, doc_id, unnest(ls) AS c, generate_subscripts(ls, 1) - 1 AS pos
        FROM (SELECT segment_id, doc_id, regexp_extract_all(lower(transcript), '[a-z]') AS ls FROM segments)"""),
    "phonemes": (("letters",), """SELECT segment_id, doc_id, CAST(pos AS BIGINT) AS pos,
        CASE c WHEN 'c' THEN 'cl' WHEN 'l' THEN 'N' WHEN 'q' THEN 'ky' WHEN 'x' THEN 'sh' ELSE c END AS phoneme,
        pos * 4e-1 AS start_sec, pos * 4e-1 + (CASE WHEN pos % 5 = 0 THEN 35e-2 ELSE 1e-1 END) AS end_sec,
        ((doc_id * 31 + pos * 7) % 101) / 1e2 AS confidence FROM letters"""),
    "aligned": (("segments", "phonemes"), """SELECT s.segment_id,
        has_measurement AND alignment_method = 'mfa-japanese-phone-forced-alignment-v1'
        AND alignment_confidence BETWEEN 0 AND 1 AND p.n IS NOT NULL AND p.ok AS valid_alignment
        FROM segments s LEFT JOIN (
          SELECT segment_id, count(*) AS n, bool_and(good AND (prev IS NULL OR start_sec >= prev - 1e-6)) AS ok FROM (
            SELECT segment_id, start_sec, start_sec >= 0 AND end_sec > start_sec AND confidence BETWEEN 0 AND 1 AS good,
              lag(end_sec) OVER (PARTITION BY segment_id ORDER BY pos) AS prev FROM phonemes) GROUP BY segment_id) p
        ON s.segment_id = p.segment_id"""),
    "embedded": (("segments",), """SELECT *, CASE WHEN doc_id % 9 = 0 THEN CAST([] AS DOUBLE[])
        WHEN doc_id % 41 = 0 THEN [(doc_id % 3 + 1) * 1e0, (doc_id % 5) * 1e0, (doc_id % 7) * 1e0]
        WHEN doc_id % 43 = 0 THEN [CAST('nan' AS DOUBLE), 1e0, 1e0, 1e0]
        ELSE [(doc_id % 3 + 1) * 1e0, (doc_id % 5) * 1e0, (doc_id % 7) * 1e0, (doc_id % 2) * 1e0] END AS speaker_embedding
        FROM segments"""),
    "content_classes": (("segments",), """SELECT segment_id, content_type, (doc_id * 41 % 101) / 1e2 AS confidence,
        doc_id % 29 = 0 AS user_overridden, 1 AS position FROM segments WHERE doc_id % 19 <> 0
        UNION ALL SELECT segment_id, 'speech', (doc_id * 41 % 101) / 1e2, doc_id % 29 = 0, 2 FROM segments
        WHERE doc_id % 19 <> 0 AND doc_id % 31 = 0"""),
    "content_overrides": ((), """SELECT concat('seg_', lpad(cast(conv_id * 3 as varchar(20)), 8, '0')) AS segment_id,
        CASE turn % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'ambiguous' ELSE 'singing' END AS original_type,
        CASE (turn + conv_id) % 3 WHEN 0 THEN 'singing' WHEN 1 THEN 'speech' ELSE 'ambiguous' END AS new_type,
        turn // 2 AS changed_at, turn AS seq FROM conversations WHERE role <> 'system'"""),
    "edits": ((), """SELECT concat('seg_', lpad(cast(conv_id as varchar(20)), 8, '0')) AS segment_id, turn // 2 AS changed_at, turn AS seq,
        CASE role WHEN 'user' THEN 'transcript' WHEN 'system' THEN 'Transcript' ELSE 'note' END AS field, text AS value FROM conversations"""),
    "frames": ((), """SELECT segment_id, idx, event_id, event_type, value, idx * 1e-2 AS time_sec,
        CASE WHEN event_type = 'error' THEN 0e0 ELSE 2e2 + event_id % 7 END AS f0,
        CASE WHEN event_type = 'error' THEN 0e0 ELSE 9e-1 END AS f0_conf, least(1e0, value / 1e3) AS energy,
        CASE WHEN event_type = 'error' THEN 0e0 ELSE 1e0 END AS voicing,
        85e-2 + (event_id % 15) / 1e2 AS periodicity, value * 1e1 AS rms FROM (
          SELECT concat('clip_', cast(user_id as varchar(20))) AS segment_id, event_id, event_type, value,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"""),
    "clip_phones": (("frames",), """SELECT segment_id, CASE block % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'i' ELSE 'u' END AS phoneme,
        block * 4e-1 AS start_sec, block * 4e-1 + 4e-1 AS end_sec,
        CASE WHEN block % 4 = 3 THEN 5e-1 ELSE 9e-1 END AS confidence
        FROM (SELECT DISTINCT segment_id, idx // 40 AS block FROM frames)
        UNION ALL SELECT segment_id, 'k', block * 4e-1 - 1e-2, block * 4e-1 + 2e-2, 9e-1
        FROM (SELECT DISTINCT segment_id, idx // 40 AS block FROM frames) WHERE block % 2 = 1"""),
    "samples": ((), """SELECT l_orderkey AS clip_id, l_partkey * 10 + l_linenumber AS sample_key,
        cast(floor(l_quantity * 65e1) as int) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sample,
        cast(floor(l_discount * 32e4) as int) AS other_channel FROM lineitem"""),
    "speaker_vectors": ((), """SELECT concat('seg_', lpad(cast(vec_id as varchar(20)), 8, '0')) AS segment_id,
        concat('spk_', cast(label as varchar(20))) AS speaker_id, CAST(embedding AS DOUBLE[]) AS embedding,
        1e0 + vec_id % 20 AS duration_sec, vec_id, label FROM embeddings"""),
    "media_files": ((), """SELECT concat('/media/p', cast(page_id as varchar(20)), CASE page_id % 5 WHEN 0 THEN '.wav'
        WHEN 1 THEN '.MP4' WHEN 2 THEN '.txt' WHEN 3 THEN '.Opus' ELSE '.mkv' END) AS path, html,
        octet_length(encode(html)) AS size, page_id * 1000 AS modified_ms, page_id FROM pages"""),
    "candidates": ((), """SELECT concat('cand_', cast(doc_id as varchar(20))) AS candidate_id,
        concat('spk_', cast(doc_id % 8 as varchar(20))) AS speaker_id, -1e-2 * (doc_id % 60) AS asr_avg_logprob,
        75e-2 + (doc_id % 26) / 1e2 AS speaker_similarity, (doc_id % 25) / 1e2 AS no_speech_probability,
        1e0 + doc_id % 15 AS duration_sec, 4e-3 + (doc_id % 30) / 1e3 AS rms, (doc_id % 12) / 1e4 AS clipping_ratio,
        (doc_id % 70) / 1e2 AS silence_ratio, doc_id % 9 <> 0 AS fingerprint_current,
        CASE doc_id % 4 WHEN 0 THEN 'kw' WHEN 1 THEN 'gw' WHEN 2 THEN 'ts' ELSE 'py' END AS rare_phone,
        CASE doc_id % 6 WHEN 0 THEN 'a' ELSE 'o' END AS common_phone, doc_id % 10 = 0 AS misrecognized,
        sha256(text) AS audio_sha256, doc_id FROM documents WHERE length(text) > 0"""),
}


def _closure(names, seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _closure(SQL_VIEWS[name][0], seen)
            seen.append(name)
    return seen


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views (and what they need) in front of ``body``.

    ``body`` may open with its own named views, written as ``, name AS (...), ... SELECT``.
    """
    chain = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in _closure(names.split(), []))
    return f"WITH {chain}\n{body}"
