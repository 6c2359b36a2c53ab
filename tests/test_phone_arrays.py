"""Phones looked at as arrays against the same questions asked of each phone."""

from __future__ import annotations

import math

from pyspark.sql import functions as F, types as T

from voxloom.functions import phone_arrays as arrays
from voxloom.functions.fingerprints import plain
from voxloom.functions.measure import valid_singing_alignment
from voxloom.functions.vocabulary import FORCED_ALIGNMENT, KNOWN_PHONES
from voxloom.operators import coverage, text, weights
from voxloom.plans import views
from voxloom.plans.catalog import load_all
from voxloom.plans.registry import QUERIES
from voxloom.session import ship_package

load_all()
NAN, INF = math.nan, math.inf
LISTS = [
    None, [], [("a", 0.0, 0.5, 0.9), ("k", 0.5, 0.75, 1.0), ("a", 0.75, 0.8, 0.0)], [("zz", 0.1, 0.2, 0.5), ("ky", 0.3, 0.4, 0.5), ("b", 0.4, 0.6, 0.5)],
    [("a", 0.0, 0.5, 0.9), ("k", 0.4, 0.75, 1.0)], [(" ", 0.0, 0.5, 0.9)], [("\x1c", 0.0, 0.5, 0.9)], [(None, 0.0, 0.5, 0.9)], [("a", None, 0.5, 0.9), ("o", 0.6, 0.7, None)],
    [("a", 0.0, NAN, 0.9)], [("a", NAN, 1.0, 0.9)], [("a", 0.0, INF, 0.9)], [("a", 0.0, 0.5, NAN)], [("a", -0.5, 0.5, 0.9)], [("a", 0.5, 0.5, 0.9)], [("a", 0.0, 0.5, 1.5)],
    [('q"\\/\x1f\x7fé', 0.0004, 123456.5, 1e-10), ("a", 9e9, 1.5e300, -1.25e10)], [("a", 9.5e9, -INF, 9e15), (None, 1.0, 2.0, 3.0), ("u", 3.0, 4.0, 5.0)],
]


def _rows(spark):
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("speaker_id", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("phonemes", views.PHONES)])
    rows = [(i, None if i % 5 == 3 else f"spk_{i % 2}", "speech", p) for i, p in enumerate(LISTS)]
    return spark.createDataFrame(rows, kind).withColumns({"has_measurement": F.lit(True), "alignment_method": F.lit(FORCED_ALIGNMENT), "alignment_confidence": F.lit(0.5), "alignment_status": F.lit("measured")})


def test_arrays_answer_as_single_phones_do(spark):
    ship_package(spark)
    rows = _rows(spark)
    kernels = {"well": (arrays.well_timed, "boolean"), "known": (arrays.known_phones(KNOWN_PHONES), "array<string>"), "text": (arrays.plain_phones, "string")}
    fields = ", ".join(f"{n} {k}" for n, (_, k) in kernels.items())
    got = rows.select("doc_id", "phonemes").mapInArrow(arrays.added({n: k for n, (k, _) in kernels.items()}), f"doc_id bigint, {fields}")
    want = rows.select("doc_id", valid_singing_alignment().alias("well"), weights.observed_phones().alias("known"), plain(F.col("phonemes"), views.PHONES).alias("text"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_intervals_of_arrays(spark):
    """The gaps of the column form; without phones all of the duration is one."""
    ship_package(spark)

    def fold(batches):
        import pyarrow as pa

        for b in batches:
            p = arrays.Phones(b.column("phonemes"))
            owner, start, end = arrays.unobserved(p, p.numbers("start_sec"), p.numbers("end_sec"), b.column("dur").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(end)], ["doc_id", "start_sec", "end_sec"])

    rows = _rows(spark).where("doc_id IN (1, 2, 3, 4, 13, 14)").withColumn("dur", F.when(F.col("doc_id") == 2, 0.8).otherwise(1.0))
    entries = F.transform("phonemes", lambda p: F.struct(p["start_sec"].alias("start"), p["end_sec"].alias("end")))
    want = rows.select("doc_id", F.explode(text.unobserved_intervals(entries, F.col("dur"))).alias("g")).select("doc_id", "g.start_sec", "g.end_sec")
    got = rows.select("doc_id", "phonemes", "dur").mapInArrow(fold, "doc_id bigint, start_sec double, end_sec double")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("doc_id = 1").count() == 1


def _phone_arrays_in(df) -> bool:
    return "confidence:double>>" in "".join(p.schema().simpleString() for p in _plans(df._jdf.queryExecution().optimizedPlan()))


def _plans(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _plans(children.apply(i))


def test_no_phone_reaches_the_engine(spark):
    """the queries that only fold phones get the folded columns out of their tasks, never the phones."""
    for name in ("txt_10_intervals", "txt_10_unobserved", "dat_8_snapshot_fingerprint", "txt_11_alignment_validity", "wgt_15_job_members"):
        assert not _phone_arrays_in(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_eligible_input_gets_no_phones(spark, monkeypatch):
    """F14, F16 to F19, F21: what inventories, selection and weights read is folded before it leaves the tasks."""
    from voxloom.plans import queries_weights

    seen = []
    monkeypatch.setattr(queries_weights, "durable", lambda df: seen.append(df) or df)
    queries_weights.eligible_input(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and not _phone_arrays_in(seen[0])


def test_contexts_are_counted_inside_the_tasks(spark):
    """counts of names and of names between their neighbours, no name where there is none; no phone leaves the tasks."""
    from collections import Counter

    rows = _rows(spark)
    want, single = Counter(), Counter()
    for i, p in enumerate(LISTS):
        names = [x[0] for x in p or []]
        for j, n in enumerate(names):
            before = names[j - 1] if j and names[j - 1] is not None else "<BOS>"
            after = names[j + 1] if j + 1 < len(names) and names[j + 1] is not None else "<EOS>"
            want["|".join(x for x in (before, n, after) if x is not None)] += 1
            single[n] += 1
    got = {r.context: r.n for r in coverage.context_counts(rows).where("scope = 'all'").collect()}
    assert got == dict(want)
    assert {r.phoneme: r.n for r in coverage.phone_counts(rows).where("scope = 'all'").collect()} == dict(single)
    assert not _phone_arrays_in(QUERIES["cov_2_phone_contexts"](spark, "/root/testdata/sf0.001"))


def test_singing_sets_are_dealt_as_texts(spark, tmp_path):
    """no list is shuffled on its way to the files, and text files are packed."""
    from voxloom.plans.queries_sources import _singing
    from voxloom.sinks import files

    items = _singing(spark, "/root/testdata/sf0.001", "speaker_id")
    dealt = [p for p in _plans(items._jdf.queryExecution().optimizedPlan()) if p.nodeName().startswith("Repartition")]
    assert dealt and not any("array<" in p.schema().simpleString() for p in dealt)
    back = files.publish(items, str(tmp_path / "set"), "speaker_id", "json", deal=False)
    assert back.count() == items.count() > 0
    written = [f.name for f in tmp_path.glob("set/speaker_id=*/part-*")]
    assert written and all(n.endswith(".json.gz") for n in written)


def test_only_what_is_asked_for_is_made(spark):
    """phones of reliable speech only, reviews of the targets only, and no phones of reviews that are too long."""
    from voxloom.operators import completion
    from voxloom.plans.queries_text import _applied

    segs, asked = views.segments(spark, "/root/testdata/sf0.001"), []

    def maker(rows):
        asked.append(rows.count())
        return views.with_phones(rows)

    lean, whole = completion.observation_prints(segs, maker), completion.observation_prints(views.with_phones(segs))
    assert sorted(map(tuple, lean.collect())) == sorted(map(tuple, whole.collect())) and 0 < asked[0] < segs.count() / 4
    targets = spark.createDataFrame([("short", "s", "x"), ("long", "s", "x"), ("none", "s", "x")], "segment_id string, speaker_id string, transcript string")
    made = [("short", "y", ["a"] * 512, 0.9, 5.0, True, True, []), ("long", "y", ["a"] * 513, 0.9, 5.0, True, True, []), ("none", "y", [], 0.9, 5.0, True, True, [])]
    reviews = spark.createDataFrame(made, "segment_id string, candidate_transcript string, candidate_phones array<string>, confidence double, duration_sec double, changed boolean, machine_passed boolean, reasons array<string>")
    corrected, log = text.apply_reviews(targets, reviews)
    assert [(r.segment_id, len(r.phonemes)) for r in corrected.collect()] == [("short", 512)]
    assert {r.segment_id: r.application_status for r in log.collect()} == {"short": "applied", "long": "invalid", "none": "invalid"}
    extracted = [p for p in _plans(_applied(spark, "/root/testdata/sf0.001")[1]._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Project" and "regexp_extract_all" in p.toString().split("\n")[0]]
    assert extracted and all("LeftAnti" in p.toString() for p in extracted)


def test_intervals_are_read_as_arrays(spark):
    """txt_8: the arrays say what the column form says, and no step of the query runs once for each phone in the engine."""
    ship_package(spark)
    one, two = (0.0, 0.4, "a"), (0.4, 0.5, "sil")
    cases = [
        (["a"], 1.0, [one, two]), (["a"], 1.0, [one, (0.5, 0.5, "sil")]), (["a"], 0.3, [one]), (["a"], 1.0, []), (["a"], 1.0, None), ([], 1.0, [two]), (None, 1.0, [one]), (["?"], 1.0, [one]),
        ([None], 1.0, [one]), (["a"], None, [one]), (["a"], NAN, [one]), (["a"], INF, [one]), (["a"], -1.0, [one]), (["a"], 1.0, [(0.0, 0.4, None)]), (["a"], 1.0, [(None, 0.4, "a")]),
        (["a"], 1.0, [(0.0, NAN, "a")]), (["a", "u"], 1.0, [one, (0.4, 0.6, "ɯ"), (0.6, 0.7, "")]), (["a", "u"], 1.0, [one, (0.3, 0.6, "ɯ")]), (["a", "u"], 1.0, [one, (0.4, 0.6, "a")]),
        (["a"], 1.0, [one, (0.4, 0.6, "a")]), (["a", "k"], 1.0, [one]), (["u"], 1.0, [(-1e-7, 0.5, "ɯ"), (0.5 - 1e-7, 1.0, "sil")]), (["k"], 1.0, [(-0.1, 0.5, "k")]), (["a"], 1.0, [(0.0, 0.4, "zz")]),
    ]
    kind = "doc_id bigint, phones array<string>, duration_sec double, entries array<struct<start:double,end:double,label:string>>"
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], kind)

    def fold(batches):
        import pyarrow as pa
        from voxloom.functions.vocabulary import ALIGNER_ALPHABET

        for b in batches:
            problem, timed = arrays.read_intervals(b.column("phonemes"), b.column("entries"), b.column("duration_sec"), ALIGNER_ALPHABET, 1e-6)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), problem, timed], ["doc_id", "problem", "timed"])

    times = [F.lit(None).cast("double").alias(n) for n in ("start_sec", "end_sec", "confidence")]
    named = rows.withColumn("phonemes", F.transform("phones", lambda p: F.struct(p.alias("phoneme"), *times)))
    want = text.read_intervals(rows).select("doc_id", "problem", "timed")
    got = named.mapInArrow(fold, want.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.where("problem IS NULL").count() >= 3
    assert want.select("problem").distinct().count() == 6
    assert "transform(" not in QUERIES["txt_8_read_intervals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_an_audit_asks_arrays(spark):
    """txt_12: no step runs once for each phone in the engine, and prints made with the phones are those made of columns."""
    from voxloom.functions.vocabulary import ALIGNER_ALPHABET

    assert "transform(" not in QUERIES["txt_12_measurement_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    rows = _rows(spark).withColumn("duration_sec", F.when(F.col("doc_id") == 4, NAN).otherwise(0.8)).withColumn("entries", F.transform("phonemes", lambda p: F.struct(
        F.when(p["phoneme"] == "k", "sil").otherwise(p["phoneme"]).alias("label"), p["start_sec"].alias("start"), p["end_sec"].alias("end"))))

    def fold(batches):
        import pyarrow as pa

        for b in batches:
            made = [arrays.segment_prints(b.column("phonemes"), ALIGNER_ALPHABET), arrays.record_prints(b.column("phonemes"), b.column("entries"), b.column("duration_sec"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", "s", "r"])

    got = rows.select("doc_id", "phonemes", "entries", "duration_sec").mapInArrow(fold, f"doc_id bigint, s {text.SEGMENT_PRINTS}, r {text.RECORD_PRINTS}").collect()
    want = rows.select("doc_id", text.segment_prints(rows).alias("s"), text.record_prints(rows).alias("r")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    facts = {r.doc_id: (r.s, r.r) for r in got}
    assert facts[0][0].n is None and facts[1][0].n == 0 and facts[2][0].n == 3 and facts[2][1].voiced == 2 and facts[2][1].inside and facts[4][1].inside and not facts[9][1].inside and not facts[11][1].inside
    assert facts[2][0].phones == facts[2][1].phones and facts[2][0].phones_whole and not facts[8][0].phones_whole and not facts[3][0].labels_whole
    assert len({f[0].phones for f in facts.values()}) == len(facts)
