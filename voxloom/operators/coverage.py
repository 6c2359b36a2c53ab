"""Phone and pitch coverage per scope: whole set, speaker, speaker × content type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.measure import blank, clamp
from voxloom.functions.phone_arrays import counted
from voxloom.functions.vocabulary import CORE_PHONES, KANA_PHONES, VOWELS, category_phones
from voxloom.session import ship_package

LOW_COUNT, GOOD_RATIO, WARNING_RATIO = 3, 0.80, 0.50
SUSTAINED_SEC, LOW_HZ, HIGH_HZ = 0.30, 165.0, 330.0
SCOPE = ["scope", "speaker_id", "content_type"]


def grade_rank(grade: Column) -> Column:
    return F.when(grade == "good", 0).when(grade == "warning", 1).otherwise(2)


def scopes_of(segments: DataFrame) -> DataFrame:
    """All scopes, including those without a segment: one row overall, three per speaker."""
    speakers = segments.where(~blank(F.col("speaker_id"))).select("speaker_id").distinct()
    kinds = F.explode(F.array(
        F.struct(F.lit("speaker").alias("scope"), F.lit("").alias("content_type")),
        F.struct(F.lit("speaker_type").alias("scope"), F.lit("speech").alias("content_type")),
        F.struct(F.lit("speaker_type").alias("scope"), F.lit("singing").alias("content_type")),
    ))
    per_speaker = speakers.select("speaker_id", kinds.alias("k")).select("k.scope", "speaker_id", "k.content_type")
    whole = segments.sparkSession.range(1).select(F.lit("all").alias("scope"), F.lit("").alias("speaker_id"), F.lit("").alias("content_type"))
    return whole.unionByName(per_speaker)


def _scope_rows(base: DataFrame, item: list[str], total: str) -> DataFrame:
    """Roll a (speaker, type, item) count table up to every scope with grouping sets.

    The base table is already aggregated, so only speakers × types × items rows are regrouped.
    """
    rolled = base.groupingSets(
        [item, ["speaker_id", *item], ["speaker_id", "content_type", *item]], "speaker_id", "content_type", *item
    ).agg(F.sum(total).alias(total), F.grouping("speaker_id").alias("gs"), F.grouping("content_type").alias("gt"))
    kept = rolled.where((F.col("gs") == 1) | (~blank(F.col("speaker_id")) & ((F.col("gt") == 1) | F.col("content_type").isin("speech", "singing"))))
    return kept.select(
        F.when(F.col("gs") == 1, "all").when(F.col("gt") == 1, "speaker").otherwise("speaker_type").alias("scope"),
        F.when(F.col("gs") == 1, "").otherwise(F.col("speaker_id")).alias("speaker_id"),
        F.when(F.col("gt") == 1, "").otherwise(F.col("content_type")).alias("content_type"),
        *item, total,
    )


def _counts(segments: DataFrame, item: str, around: bool, folded) -> DataFrame:
    """Counts per (speaker, type, item), added up inside the tasks first."""
    keys = ["speaker_id", "content_type"]
    fold = counted(keys, item, around)
    schema = ", ".join([*[f"{k} {dict(segments.dtypes)[k]}" for k in keys], f"{item} string", "n bigint"])
    if folded is None:
        ship_package(segments.sparkSession)
        partial = segments.select(*keys, "phonemes").mapInArrow(fold, schema)
    else:
        partial = folded(segments, fold, schema)
    return _scope_rows(partial.groupBy(*keys, item).agg(F.sum("n").alias("n")), [item], "n")


def phone_counts(segments: DataFrame, folded=None) -> DataFrame:
    """Phone counts per scope (only phones that occur).

    ``folded(segments, fold, schema)`` hands phones to ``fold`` where ``segments`` does not hold them yet.
    """
    return _counts(segments, "phoneme", False, folded)


def scope_summary(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Every scope with its total and distinct phones, empty scopes included."""
    sums = counts.groupBy(*SCOPE).agg(F.sum("n").alias("phone_total"), F.count(F.lit(1)).alias("phone_kinds"))
    return scopes_of(segments).join(sums, SCOPE, "left").na.fill(0, ["phone_total", "phone_kinds"])


def context_counts(segments: DataFrame, folded=None) -> DataFrame:
    """Phone trigram counts per scope, with sentence borders as context; ``folded`` as in :func:`phone_counts`."""
    return _counts(segments, "context", True, folded)


def core_gaps(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Core phones that are missing or seen fewer than three times, per scope."""
    expected = scopes_of(segments).withColumn("phoneme", F.explode(F.array(*[F.lit(p) for p in CORE_PHONES])))
    found = expected.join(counts.where(F.col("phoneme").isin(*CORE_PHONES)), [*SCOPE, "phoneme"], "left").na.fill(0, ["n"])
    return found.where(F.col("n") < LOW_COUNT).withColumn("level", F.when(F.col("n") == 0, "missing").otherwise("low"))


def categories(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Observed share of each phone category per scope."""
    expected = category_phones(segments.sparkSession)
    sizes = expected.groupBy("category").agg(F.count(F.lit(1)).alias("expected"))
    every = scopes_of(segments).withColumn(
        "category", F.explode(F.array(*[F.lit(c) for c in ("palatalized", "voiced", "semi_voiced", "special", "foreign")]))
    ).join(F.broadcast(sizes), "category")
    seen = counts.where("n > 0").join(expected, "phoneme").groupBy(*SCOPE, "category").agg(F.count(F.lit(1)).alias("observed"))
    graded = every.join(seen, [*SCOPE, "category"], "left").na.fill(0, ["observed"]).withColumn("ratio", F.col("observed") / F.col("expected"))
    return graded.withColumn(
        "quality", F.when(F.col("ratio") >= GOOD_RATIO, "good").when(F.col("ratio") >= WARNING_RATIO, "warning").otherwise("missing")
    )


def kana_counts(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Coverage of each kana: the count of its rarest phone."""
    needed = sorted({p for key in KANA_PHONES.values() for p in key.split(" ")})
    small = counts.where(F.col("phoneme").isin(*needed)).groupBy(*SCOPE).agg(
        F.map_from_entries(F.collect_list(F.struct("phoneme", "n"))).alias("_counts")
    )
    every = scopes_of(segments).join(small, SCOPE, "left").withColumn(
        "k", F.explode(F.array(*[F.struct(F.lit(k).alias("kana"), F.lit(p).alias("phoneme_key")) for k, p in KANA_PHONES.items()]))
    ).select(*SCOPE, "_counts", "k.kana", "k.phoneme_key")
    worst = F.array_min(F.transform(F.split("phoneme_key", " "), lambda p: F.coalesce(F.try_element_at(F.col("_counts"), p), F.lit(0).cast("long"))))
    graded = every.withColumn("n", worst).withColumn(
        "quality", F.when(F.col("n") == 0, "missing").when(F.col("n") < LOW_COUNT, "warning").otherwise("good")
    )
    return graded.select(*SCOPE, "kana", "phoneme_key", "n", "quality")


def overall(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Grade per scope: five missing core phones, or any smaller gap."""
    gaps = core_gaps(segments, counts).groupBy(*SCOPE).agg(
        F.count_if(F.col("level") == "missing").alias("missing"), F.count_if(F.col("level") == "low").alias("low")
    )
    weak = categories(segments, counts).groupBy(*SCOPE).agg(F.count_if(F.col("quality") != "good").alias("weak_categories"))
    joined = scopes_of(segments).join(gaps, SCOPE, "left").join(weak, SCOPE, "left").na.fill(0, ["missing", "low", "weak_categories"])
    return joined.withColumn(
        "quality",
        F.when(F.col("missing") >= 5, "missing")
        .when((F.col("missing") > 0) | (F.col("low") > 0) | (F.col("weak_categories") > 0), "warning").otherwise("good"),
    )


def pitch_range(f0: Column) -> Column:
    """An unknown pitch counts as the middle range."""
    return F.when(f0 <= 0, "mid").when(f0 < LOW_HZ, "low").when(f0 >= HIGH_HZ, "high").otherwise("mid")


def singing_scopes(segments: DataFrame) -> DataFrame:
    """Singing diagnosis for the whole set (speaker_id '') and per speaker.

    Phones are folded per segment row first; sums then aggregate over speakers with partial
    aggregation, once per speaker and once overall.
    """
    singing = segments.where("content_type = 'singing'")
    p = F.col("phonemes")
    vowels = F.filter(p, lambda x: x["phoneme"].isin(*VOWELS))
    lengths = F.filter(
        F.transform(vowels, lambda x: F.greatest(F.lit(0.0), x["end_sec"] - x["start_sec"])), lambda d: d >= SUSTAINED_SEC
    )
    folded = singing.select(
        "speaker_id", "mean_f0_hz", "pitch_reliability", pitch_range(F.col("mean_f0_hz")).alias("range"),
        F.coalesce(F.array_max(F.transform(p, lambda x: x["end_sec"])), F.lit(0.0)).alias("seconds"),
        F.size(lengths).alias("sustained"), F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x).alias("sustained_sec"),
        F.transform(vowels, lambda x: x["phoneme"]).alias("vowel_list"),
    )
    counted = [
        F.sum(F.when(F.col("range") == r, F.size(F.filter("vowel_list", lambda x: x == v))).otherwise(0)).alias(f"vowel_{r}_{v}")
        for r in ("low", "mid", "high") for v in VOWELS
    ]
    f0 = F.when(F.col("mean_f0_hz") > 0, F.col("mean_f0_hz"))
    agg = [
        F.count(F.lit(1)).alias("segment_count"), F.sum("seconds").alias("total_sec"),
        F.min(f0).alias("min_f0_hz"), F.max(f0).alias("max_f0_hz"), F.sum("pitch_reliability").alias("_reliability"),
        *[F.sum(F.when(F.col("range") == r, F.col("seconds")).otherwise(0.0)).alias(f"{r}_sec") for r in ("low", "mid", "high")],
        F.sum("sustained").alias("sustained_count"), F.sum("sustained_sec").alias("sustained_sec"), *counted,
    ]
    per = folded.groupBy("speaker_id").agg(*agg)
    merged = [
        (F.min if c == "min_f0_hz" else F.max if c == "max_f0_hz" else F.sum)(c).alias(c) for c in per.columns if c != "speaker_id"
    ]
    whole = per.agg(*merged).na.fill(0, [c for c in per.columns if c not in ("speaker_id", "min_f0_hz", "max_f0_hz")]).withColumn("speaker_id", F.lit(""))
    every = per.where(~blank(F.col("speaker_id"))).unionByName(whole)
    reliability = F.when(F.col("segment_count") > 0, F.col("_reliability") / F.col("segment_count")).otherwise(0.0)
    missing_vowel = {r: F.least(*[F.col(f"vowel_{r}_{v}") for v in VOWELS]) == 0 for r in ("low", "mid", "high")}
    no_f0 = F.col("min_f0_hz").isNull()
    warnings = F.array_compact(F.array(
        F.when(no_f0, F.lit("no_f0")).when(F.col("max_f0_hz") / F.greatest(F.col("min_f0_hz"), F.lit(1.0)) < 1.5, F.lit("narrow_range")),
        F.when(F.col("low_sec") < 5, F.lit("little_low_range")), F.when(F.col("high_sec") < 5, F.lit("little_high_range")),
        F.when(F.col("sustained_count") < 5, F.lit("few_sustained_vowels")), F.when(F.col("pitch_reliability") < 0.60, F.lit("low_reliability")),
        *[F.when(missing_vowel[r], F.lit(f"missing_vowels_{r}")) for r in ("low", "mid", "high")],
    ))
    return (
        every.withColumn("pitch_reliability", reliability).withColumn("warnings", warnings)
        .withColumn(
            "long_tone_quality",
            F.when(F.col("sustained_count") == 0, 0.0).otherwise(clamp(F.col("pitch_reliability") * F.least(F.lit(1.0), F.col("sustained_sec") / 8.0))),
        )
        .withColumn("quality", F.when((F.col("total_sec") < 10) | no_f0, "insufficient").when(F.size("warnings") > 0, "warning").otherwise("good"))
        .withColumn("min_f0_hz", F.coalesce("min_f0_hz", F.lit(0.0))).withColumn("max_f0_hz", F.coalesce("max_f0_hz", F.lit(0.0)))
        .drop("_reliability")
    )


def singing_transitions(segments: DataFrame) -> DataFrame:
    """Consonant→vowel transitions per speaker and overall (speaker_id '')."""
    names = F.transform("phonemes", lambda x: x["phoneme"])
    step = F.zip_with(
        names, F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))),
        lambda x, y: F.when(~x.isin(*VOWELS) & y.isin(*VOWELS), F.concat(x, F.lit("->"), y)),
    )
    pairs = F.filter(step, lambda t: t.isNotNull())
    per = segments.where("content_type = 'singing'").select("speaker_id", F.explode(pairs).alias("transition")).groupBy(
        "speaker_id", "transition"
    ).agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("transition").agg(F.sum("n").alias("n")).withColumn("speaker_id", F.lit(""))
    return per.where(~blank(F.col("speaker_id"))).unionByName(whole)


def project_grade(scopes: DataFrame) -> DataFrame:
    """Number of scopes and the worst grade among them."""
    rank = F.max(F.when(F.col("quality") == "good", 0).when(F.col("quality") == "warning", 1).otherwise(2))
    return scopes.agg(F.count(F.lit(1)).alias("scope_count"), rank.alias("_r")).select(
        "scope_count", F.when(F.col("_r") == 2, "insufficient").when(F.col("_r") == 1, "warning").otherwise("good").alias("overall_quality")
    )
