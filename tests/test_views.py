"""How the views deal their rows, and the phones they make, against plain definitions."""

from __future__ import annotations

import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from voxloom.functions.vectors import unit
from voxloom.functions.vocabulary import ALIGNER_ALPHABET, FORCED_ALIGNMENT
from voxloom.operators import dataset, text
from voxloom.plans import views
from voxloom.plans.catalog import load_all
from voxloom.plans.registry import QUERIES
from voxloom.sinks import datasets

load_all()
SF = "/root/testdata/sf0.001"


def test_rows_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path):
    """A file that is cut into as many splits as there are cores, with all its rows in one of them."""
    pq.write_table(pa.table({"doc_id": list(range(4000)), "text": [f"text {i * 7919}" for i in range(4000)]}), tmp_path / "documents.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in old:
            spark.conf.set(key, "2048")
        docs = views.table(spark, str(tmp_path), "documents")
        assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        counts = [r["count"] for r in views.spread(docs, "doc_id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sum(counts) == 4000 and max(counts) < 2000


def test_phones_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (-3, "KK İ cClqx9"), (None, "abc"), (5, "é!"), (7, "ab" * 300_000)]
    got = {r["doc_id"]: r["phonemes"] for r in views.with_phones(spark.createDataFrame(rows, "doc_id bigint, transcript string")).collect()}
    spelled = {"c": "cl", "l": "N", "q": "ky", "x": "sh"}
    for key, text in rows:
        letters = None if text is None else [c for c in text.lower() if "a" <= c <= "z"]
        sign = -1 if (key or 0) < 0 else 1  # the remainder has the sign of the number
        want = None if letters is None else [
            (spelled.get(c, c), i * 0.4, i * 0.4 + (0.35 if i % 5 == 0 else 0.1),
             None if key is None else sign * (abs(key * 31 + i * 7) % 101) / 100 if key * 31 + i * 7 < 0 else (key * 31 + i * 7) % 101 / 100)
            for i, c in enumerate(letters)]
        assert (None if got[key] is None else [tuple(p) for p in got[key]]) == want
    assert views.with_phones(spark.createDataFrame([], "doc_id bigint, transcript string")).count() == 0


def _carried(df) -> str:
    """The types that meet in the joins of a plan: what every shuffle before them has to carry."""
    joins, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Join":
            joins += [c.schema().simpleString() for c in children]
        todo += children
    return " ".join(joins)


def test_no_phones_travel_to_meet_an_edit(spark):
    """dat_3 and dat_4: phones made after the join are those made before it."""
    segs = views.segments(spark, SF)
    for query in ("dat_3_transcript_edits", "dat_4_set_transcript"):
        assert "confidence:double>>" not in _carried(QUERIES[query](spark, SF))
    late = dataset.apply_transcript_edits(segs, views.edits(spark, SF), views.with_phones)
    early = dataset.apply_transcript_edits(views.with_phones(segs), views.edits(spark, SF))
    assert late.select(*early.columns).exceptAll(early).isEmpty() and late.count() == early.count()


def test_records_meet_segments_by_digests(spark):
    """txt_12: no array travels; equal zeros of any sign are equal, a billionth of a billionth is not."""
    assert "array<" not in _carried(QUERIES["txt_12_measurement_audit"](spark, SF))
    phone, entry = "struct<phoneme:string,start_sec:double,end_sec:double,confidence:double>", "struct<start:double,end:double,label:string>"
    common = f"segment_id string, phonemes array<{phone}>, audio_sha256 string, conditions string"
    seg = lambda name, phones: (name, phones, "x", "c", 1.0, FORCED_ALIGNMENT)
    rec = lambda name, phones, entries: (name, phones, "x", "c", 1.0, entries)
    one, said = ("a", 0.0, 0.5, 0.9), (0.0, 0.5, ALIGNER_ALPHABET["a"])
    segments = [seg("same", [one]), seg("close", [one]), seg("none", [("a", None, 0.5, 0.9)]), seg("empty", []), seg("odd", [("?", 0.0, 0.5, 0.9)]), seg("long", [("a", 0.0, 1.5, 0.9)])]
    records = [
        rec("same", [("a", -0.0, 0.5, 0.9)], [said, (0.5, 0.6, "sil"), (0.6, 0.7, "")]), rec("close", [("a", 1e-18, 0.5, 0.9)], [(1e-18, 0.5, said[2])]), rec("none", [("a", None, 0.5, 0.9)], [said]),
        rec("empty", [], []), rec("odd", [("?", 0.0, 0.5, 0.9)], [(0.0, 0.5, None)]), rec("long", [("a", 0.0, 1.5, 0.9)], [(0.0, 1.5, said[2])]), rec("lone", [one], [said]),
    ]
    s = spark.createDataFrame(segments, common + ", clip_sec double, alignment_method string")
    r = spark.createDataFrame(records, common + f", duration_sec double, entries array<{entry}>")
    known = r.select("segment_id", text.record_print(r).alias("reference_sha256"))
    got = {(x["segment_id"], x["problem"]) for x in text.measurement_problems(s.join(known, "segment_id", "left"), r).collect()}
    assert got == {
        ("close", "phones_differ"), ("close", "intervals_differ"), ("none", "phones_differ"), ("none", "intervals_differ"), ("odd", "intervals_differ"),
        ("long", "phones_differ"), ("lone", "segment_missing")}


def test_a_unit_vector_takes_its_length_once(spark):
    """spk_2: the length is not summed again for every number of the vector, so long vectors take no quadratic time."""
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x * 1.0).alias("v"))
    start = time.monotonic()
    total = wide.select(F.aggregate(unit(F.col("v")), F.lit(0.0), lambda a, x: a + x * x)).first()[0]
    assert abs(total - 1) < 1e-9 and time.monotonic() - start < 15
    assert spark.sql("SELECT array(0D, 0D) AS v").select(unit(F.col("v"))).first()[0] == [0.0, 0.0]


def test_items_meet_a_snapshot_by_digests(spark):
    """snk_7: neither texts nor lists travel; values that are nothing are equal, and order and nothing in a list count."""
    assert "array<" not in _carried(QUERIES["snk_7_training_set_audit"](spark, SF)) and "transcript:string" not in _carried(QUERIES["snk_7_training_set_audit"](spark, SF))
    kind = "id string, text string, names array<string>, times array<double>, n int"
    base = ("t", ["a", "b"], [0.0, 1.5], 1)
    changes = {
        "same": ("t", ["a", "b"], [-0.0, 1.5], 1), "text": ("u", *base[1:]), "names": ("t", ["b", "a"], *base[2:]), "joined": ("t", ["ab", ""], *base[2:]), "nothing": ("t", ["a", "b", None], *base[2:]),
        "times": (*base[:2], [0.0, 1.5 + 1e-15], 1), "n": (*base[:3], None), "lost": (None, None, None, None)}
    stored = spark.createDataFrame([*[(k, *v) for k, v in changes.items()], ("void", None, None, None, None), ("more", *base)], kind)
    snapshot = spark.createDataFrame([*[(k, *base) for k in changes], ("void", None, None, None, None), ("less", *base)], kind)
    got = {(r["id"], r["problem"]) for r in datasets.training_set_problems(stored, snapshot, ["id"]).collect()}
    assert got == {
        ("text", "differs:text"), ("names", "differs:names"), ("joined", "differs:names"), ("nothing", "differs:names"), ("times", "differs:times"), ("n", "differs:n"),
        *[("lost", f"differs:{f}") for f in ("text", "names", "times", "n")], ("more", "item_unexpected"), ("less", "item_missing")}
