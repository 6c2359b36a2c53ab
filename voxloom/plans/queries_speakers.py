"""Queries of speaker grouping and speaker edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions.vectors import cosine, norm, unit
from voxloom.operators import speakers as s
from voxloom.plans import views as v
from voxloom.plans.registry import query

DIMS = "SELECT segment_id, speaker_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM speaker_vectors"
CENTER = f""", dims AS ({DIMS}), mean AS (SELECT speaker_id, dim, avg(x) AS m FROM dims GROUP BY ALL),
 nrm AS (SELECT speaker_id, sqrt(sum(m * m)) AS l FROM mean GROUP BY ALL), center AS (SELECT speaker_id, dim, m / l AS c FROM mean JOIN nrm USING (speaker_id)),
 dist AS (SELECT segment_id, d.speaker_id, 1 - sum(x * c) / sqrt(sum(x * x)) AS distance FROM dims d JOIN center USING (speaker_id, dim) GROUP BY ALL)
"""


@query("spk_1_unit_vectors", "speaker_vectors", f""", dims AS ({DIMS}), scaled AS (SELECT segment_id, dim, CASE WHEN CAST(substr(segment_id, 5) AS BIGINT) % 10 = 0 THEN 0 ELSE x * 3 END AS x FROM dims),
 l AS (SELECT segment_id, sqrt(sum(x * x)) AS l FROM scaled GROUP BY ALL) SELECT segment_id, CAST(dim - 1 AS INTEGER) AS dim, round(CASE WHEN l > 0 THEN x / l ELSE x END, 7) AS value FROM scaled JOIN l USING (segment_id)""")
def unit_vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x * 3))
    return v.speaker_vectors(spark, sf_dir).select("segment_id", F.posexplode(unit(scaled)).alias("dim", "x")).select("segment_id", "dim", F.round("x", 7).alias("value"))


@query("spk_2_clusters")
def clusters(spark, sf_dir):
    """Average linkage over all vectors. The stop distance is above the default because these vectors lie far apart."""
    return s.speaker_labels(s.cluster(v.speaker_vectors(spark, sf_dir), 0.70))


@query("spk_3_centroids", "speaker_vectors", CENTER + "SELECT speaker_id, CAST(dim - 1 AS INTEGER) AS dim, round(c, 7) AS value FROM center")
def centroids(spark, sf_dir):
    return s.centroids(v.speaker_vectors(spark, sf_dir)).select("speaker_id", F.posexplode("centroid").alias("dim", "x")).select("speaker_id", "dim", F.round("x", 7).alias("value"))


@query("spk_4_representatives", "speaker_vectors", CENTER + """SELECT speaker_id, segment_id, round(distance, 7) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY speaker_id ORDER BY distance, segment_id) AS INTEGER) AS rank FROM dist) WHERE rank <= 3""")
def representatives(spark, sf_dir):
    vectors = v.speaker_vectors(spark, sf_dir)
    return s.representatives(vectors, s.centroids(vectors)).withColumn("distance", F.round("distance", 7))


@query("spk_5_assignments", "speaker_vectors", CENTER + "SELECT segment_id, speaker_id, round(least(1e0, greatest(0e0, 1 - distance)), 7) AS confidence FROM dist")
def assignments(spark, sf_dir):
    vectors = v.speaker_vectors(spark, sf_dir)
    return s.assignments(vectors, s.centroids(vectors)).withColumn("confidence", F.round("confidence", 7))


@query("spk_5_durations", "speaker_vectors", "SELECT speaker_id, sum(duration_sec) AS total_sec FROM speaker_vectors GROUP BY ALL")
def durations(spark, sf_dir):
    return v.speaker_vectors(spark, sf_dir).groupBy("speaker_id").agg(F.sum("duration_sec").alias("total_sec"))


def _speakers(spark, sf_dir):
    vectors = v.speaker_vectors(spark, sf_dir)
    reps = s.representatives(vectors, s.centroids(vectors)).groupBy("speaker_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment_id"))), lambda x: x["segment_id"]).alias("representatives"))
    totals = vectors.groupBy("speaker_id").agg(F.sum("duration_sec").alias("total_sec"), (F.max("label") % 2 == 0).alias("selected"))
    old = F.when(F.col("speaker_id") == "spk_1", F.array(F.lit("spk_old"))).otherwise(F.array().cast("array<string>"))
    return s.centroids(vectors).join(totals, "speaker_id").join(reps, "speaker_id").withColumn("merged_from", old)


def _merges(spark, sf_dir):
    """Odd speakers fold into spk_0. Refused: a request for a stranger, and two that chain over spk_8."""
    labels = v.speaker_vectors(spark, sf_dir).select("label").distinct()
    return labels.select(
        F.expr("concat('spk_', cast(label as varchar(20)))").alias("source_id"),
        F.expr("CASE WHEN label % 2 = 1 THEN 'spk_0' WHEN label = 4 THEN 'spk_ghost' WHEN label = 6 THEN 'spk_8' ELSE 'spk_2' END").alias("target_id"), F.col("label").cast("int").alias("order"),
    ).where("source_id NOT IN ('spk_0', 'spk_2')")


def _excluded(spark, sf_dir):
    return v.speaker_vectors(spark, sf_dir).where("vec_id % 3 = 0").select("segment_id")


def _merged(spark, sf_dir):
    return s.merge_speakers(_speakers(spark, sf_dir), v.speaker_vectors(spark, sf_dir), _merges(spark, sf_dir), _excluded(spark, sf_dir))


MERGED = CENTER + """, info AS (SELECT speaker_id, sum(duration_sec) AS total_sec, max(label) % 2 = 0 AS selected FROM speaker_vectors GROUP BY ALL),
 mrg AS (SELECT DISTINCT speaker_id AS source_id, 'spk_0' AS target_id, label AS ord FROM speaker_vectors WHERE label % 2 = 1),
 part AS (SELECT source_id AS speaker_id, target_id, ord FROM mrg UNION ALL SELECT 'spk_0', 'spk_0', -1),
 ms AS (SELECT dim, sum(c * total_sec) AS s FROM center JOIN info USING (speaker_id) JOIN part USING (speaker_id) GROUP BY ALL)
"""


@query("spk_6_merged_centroid", "speaker_vectors", MERGED + "SELECT 'spk_0' AS speaker_id, CAST(dim - 1 AS INTEGER) AS dim, round(s / (SELECT sqrt(sum(s * s)) FROM ms), 7) AS value FROM ms UNION ALL SELECT speaker_id, CAST(dim - 1 AS INTEGER), round(c, 7) FROM center WHERE speaker_id NOT IN (SELECT speaker_id FROM part)")
def merged_centroid(spark, sf_dir):
    return _merged(spark, sf_dir)["speakers"].select("speaker_id", F.posexplode("centroid").alias("dim", "x")).select("speaker_id", "dim", F.round("x", 7).alias("value"))


@query("spk_6_merged_speaker", "speaker_vectors", MERGED + """, reps AS (SELECT p.ord, r.rank, r.segment_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY distance, segment_id) AS rank FROM dist) r JOIN part p USING (speaker_id)
    WHERE rank <= 3 AND CAST(substr(r.segment_id, 5) AS BIGINT) % 3 <> 0),
 three AS (SELECT segment_id, row_number() OVER (ORDER BY ord, rank) AS k FROM reps)
SELECT 'spk_0' AS speaker_id, (SELECT sum(total_sec) FROM info JOIN part USING (speaker_id)) AS total_sec, (SELECT bool_or(selected) FROM info JOIN part USING (speaker_id)) AS selected,
  (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT source_id AS x FROM mrg UNION SELECT 'spk_old' FROM mrg WHERE source_id = 'spk_1')) AS merged_from,
  (SELECT string_agg(segment_id, ',' ORDER BY k) FROM three WHERE k <= 3) AS representatives""")
def merged_speaker(spark, sf_dir):
    out = _merged(spark, sf_dir)["speakers"].where("speaker_id = 'spk_0'")
    return out.select("speaker_id", "total_sec", "selected", F.array_join("merged_from", ",").alias("merged_from"), F.array_join("representatives", ",").alias("representatives"))


@query("spk_6_merged_assignments", "speaker_vectors", "SELECT segment_id, CASE WHEN label % 2 = 1 THEN 'spk_0' ELSE speaker_id END AS speaker_id FROM speaker_vectors")
def merged_assignments(spark, sf_dir):
    return _merged(spark, sf_dir)["assignments"]


@query("spk_6_merge_problems", "speaker_vectors", """SELECT DISTINCT CASE label WHEN 4 THEN 'spk_ghost' WHEN 6 THEN 'spk_8' ELSE 'spk_2' END AS target_id, speaker_id, CASE label WHEN 4 THEN 'unknown_target' ELSE 'chained' END AS problem
FROM speaker_vectors WHERE label IN (4, 6, 8)""")
def merge_problems(spark, sf_dir):
    return _merged(spark, sf_dir)["problems"]


@query("spk_7_usable_durations", "speaker_vectors", "SELECT speaker_id, sum(duration_sec) AS total_sec, coalesce(sum(duration_sec) FILTER (vec_id % 3 <> 0), 0) AS usable_sec FROM speaker_vectors GROUP BY ALL")
def usable(spark, sf_dir):
    vectors = v.speaker_vectors(spark, sf_dir)
    return s.usable_durations(vectors, vectors.select("segment_id", "duration_sec"), _excluded(spark, sf_dir))


@query("spk_8_duration_problems", "speaker_vectors", """SELECT segment_id, 'invalid_duration' AS problem FROM speaker_vectors WHERE vec_id % 17 = 0
UNION ALL SELECT segment_id, 'contradicting_durations' FROM speaker_vectors WHERE vec_id % 13 = 0 AND vec_id % 11 <> 0 UNION ALL SELECT segment_id, 'missing_duration' FROM speaker_vectors WHERE vec_id % 11 = 0 AND vec_id % 17 <> 0""")
def duration_problems(spark, sf_dir):
    vectors = v.speaker_vectors(spark, sf_dir)
    first = vectors.where("vec_id % 11 <> 0 OR vec_id % 17 = 0").select("segment_id", F.lit(1.0).alias("start_sec"), F.expr("CASE WHEN vec_id % 17 = 0 THEN 5e-1 ELSE 1e0 + duration_sec END").alias("end_sec"))
    again = vectors.where("vec_id % 13 = 0 AND vec_id % 11 <> 0").select("segment_id", F.lit(2.0).alias("start_sec"), F.lit(2.25).alias("end_sec"))
    return s.duration_problems(vectors, first.unionByName(again))


@query("spk_9_selection", "speaker_vectors", """, e AS (SELECT concat('spk_', conv_id % 6) AS speaker_id, arg_max(role = 'user', conv_id * 100 + turn) AS sel FROM conversations GROUP BY ALL),
 i AS (SELECT speaker_id, max(label) % 2 = 0 AS selected FROM speaker_vectors GROUP BY ALL) SELECT speaker_id, coalesce(sel, selected) AS selected FROM i LEFT JOIN e USING (speaker_id)""")
def selection(spark, sf_dir):
    log = v.table(spark, sf_dir, "conversations").select(F.expr("concat('spk_', cast(conv_id % 6 as varchar(20)))").alias("speaker_id"), (F.col("role") == "user").alias("selected"), F.expr("conv_id * 100 + turn").alias("changed_at"))
    known = v.speaker_vectors(spark, sf_dir).groupBy("speaker_id").agg((F.max("label") % 2 == 0).alias("selected"))
    return s.select_speakers(known, log)


@query("spk_10_similarity", "speaker_vectors", """, p AS (SELECT a.segment_id, b.segment_id AS other, a.embedding AS ea, b.embedding AS eb, a.vec_id FROM speaker_vectors a JOIN speaker_vectors b ON b.vec_id = a.vec_id + 1)
SELECT segment_id, other, CASE WHEN vec_id % 9 <> 0 THEN round(least(1e0, greatest(-1e0, list_inner_product(ea, eb) / sqrt(list_inner_product(ea, ea) * list_inner_product(eb, eb)))), 7) END AS similarity FROM p""")
def similarity(spark, sf_dir):
    a = v.speaker_vectors(spark, sf_dir).select("segment_id", "vec_id", F.expr("CASE WHEN vec_id % 9 = 0 THEN slice(embedding, 1, 10) ELSE embedding END").alias("a"))
    b = v.speaker_vectors(spark, sf_dir).select(F.col("segment_id").alias("other"), (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("segment_id", "other", F.round(cosine(F.col("a"), F.col("b")), 7).alias("similarity"))
