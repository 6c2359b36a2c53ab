"""Literal input/output cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from voxloom.operators import completion, routing, selection, text, weights
from voxloom.sources import media


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def weighed(spark, pairs):
    data = [("s", "talk", f"seg{i:03d}", "eligible", q, u) for i, (q, u) in enumerate(pairs)]
    df = rows(spark, data, "speaker_id string, target string, segment_id string, eligibility string, quality_value double, utility_value double")
    return {r["segment_id"]: r for r in weights.weigh(df).collect()}


@pytest.mark.parametrize("q,u,raw", [(1.0, 0.0, 1.0), (0.0, 1.0, 0.6125), (None, None, (0.35 + 0.65 * 0.5) * (1 + 0.75 * 0.5))])
def test_raw_weight(spark, q, u, raw):
    assert weighed(spark, [(q, u)])["seg000"]["raw_weight"] == pytest.approx(raw)


def test_weight_is_clamped(spark):
    assert weighed(spark, [(0.0, 0.0)] * 20 + [(1.0, 1.0)])["seg020"]["training_weight"] == 2.0
    assert weighed(spark, [(1.0, 1.0)] * 20 + [(0.0, 0.0)])["seg020"]["training_weight"] == 0.25


def test_weights_do_not_depend_on_the_order_of_rows(spark):
    """wgt_17: a mean whose last bits hang on partial sums made fingerprints differ from run to run."""
    kinds = "speaker_id string, target string, segment_id string, eligibility string, quality_value double, utility_value double"
    data = [("s", "talk", f"seg{i:05d}", "eligible", i * 37 % 101 / 100, 1 / math.sqrt(1 + i % 977)) for i in range(20_000)]
    raws = [(0.35 + 0.65 * r[4]) * (1.0 + 0.75 * r[5]) for r in data]
    mean = math.fsum(raws) / len(raws)
    want = {r[2]: min(max(x / mean, 0.25), 2.0) for r, x in zip(data, raws, strict=True)}
    for some in (data, sorted(data, key=lambda r: r[4]), sorted(data, key=lambda r: r[5])):
        got = {r["segment_id"]: r["training_weight"] for r in weights.weigh(rows(spark, some, kinds)).collect()}
        assert all(abs(got[k] - w) <= math.ulp(w) for k, w in want.items())
    odd = weights.weigh(rows(spark, [("s", "talk", "a", "eligible", float("nan"), 0.5), ("t", "talk", "b", "eligible", 1e6, 0.0)], kinds)).collect()
    assert {r["segment_id"]: math.isnan(r["training_weight"]) or r["training_weight"] for r in odd}.get("b") == 1.0


def test_measured_zero_is_not_unknown(spark):
    out = weighed(spark, [(0.0, 0.5), (None, 0.5)])
    assert out["seg000"]["raw_weight"] < out["seg001"]["raw_weight"]


def test_quality_uses_measured_components_only(spark):
    df = spark.sql("""SELECT map('a', named_struct('value', 0.8D, 'status', 'measured'), 'b', named_struct('value', 0.4D, 'status', 'measured'),
        'c', named_struct('value', 0.0D, 'status', 'legacy_unknown')) AS components""")
    assert df.select(weights.quality_value()).collect()[0][0] == pytest.approx(0.6)


def test_rarity(spark):
    data = [("s", "talk", f"g{i}", "eligible", True, ["a"] + (["ky"] if i == 3 else []), []) for i in range(4)]
    df = rows(spark, data, "speaker_id string, target string, segment_id string, eligibility string, valid_alignment boolean, phones array<string>, bins array<int>")
    out = {r["segment_id"]: r for r in weights.utility(df).collect()}
    assert out["g0"]["utility_value"] == 0.5 and out["g0"]["utility_reasons"] == []
    assert out["g3"]["utility_value"] == 1.0 and out["g3"]["utility_reasons"] == ["rare_phoneme"]


def test_pitch_bin_edges(spark):
    df = rows(spark, [(54.99,), (55.0,), (77.78,), (77.79,)], "f double")
    a, b, c, d = [r[0] for r in df.select(weights.pitch_bin(F.col("f"))).collect()]
    assert a != b and c != d and b == c


def gap_input(spark, change=None, phones=None, gap=(4, 5)):
    frames = []
    for i in range(20):
        frames.append({"segment_id": "s", "idx": i, "time_sec": i * 0.01, "f0": 0.0 if i in gap else (220.0 if i < gap[0] else 246.0), "f0_conf": 0.0 if i in gap else 0.95,
                       "energy": 0.05, "voicing": 0.0 if i in gap else 1.0, "periodicity": 0.99, "rms": 0.05})
    if change:
        change(frames)
    f = spark.createDataFrame([tuple(x.values()) for x in frames], "segment_id string, idx bigint, time_sec double, f0 double, f0_conf double, energy double, voicing double, periodicity double, rms double")
    p = spark.createDataFrame(phones if phones is not None else [("s", "a", 0.0, 0.30, 0.95)], "segment_id string, phoneme string, start_sec double, end_sec double, confidence double")
    return f, p


def test_gap_is_filled_on_a_log_line(spark):
    f, p = gap_input(spark)
    decisions, estimates = completion.gap_decisions(f, p)
    d = decisions.collect()
    assert len(d) == 1 and d[0]["applied"] and d[0]["state"] == "estimated" and d[0]["confidence"] == pytest.approx(0.65)
    got = {r["idx"]: r["f0"] for r in completion.filled_frames(f, decisions, estimates).collect()}
    assert got[4] == pytest.approx(220 * (246 / 220) ** (1 / 3)) and got[5] == pytest.approx(220 * (246 / 220) ** (2 / 3))
    assert got[3] == 220.0 and got[6] == 246.0


def put(field, value, *at):
    def change(frames):
        for i in at:
            frames[i][field] = value
    return change


REFUSED = [
    (dict(gap=(0, 1)), "not_enough_anchors"), (dict(gap=(18, 19)), "not_enough_anchors"), (dict(gap=tuple(range(4, 11))), "gap_too_long"),
    (dict(change=put("f0_conf", 0.7, 3)), "weak_anchor"), (dict(change=put("voicing", 0.0, 6)), "weak_anchor"), (dict(change=put("energy", 0.001, 7)), "weak_anchor"),
    (dict(change=put("f0", 400.0, *range(6, 20))), "pitch_jump"), (dict(change=put("f0", 180.0, 2)), "pitch_jump"), (dict(change=put("energy", 0.009, 4)), "energy_drop"),
    (dict(phones=[("s", "k", 0.0, 0.3, 0.95)]), "not_one_vowel"), (dict(phones=[("s", "a", 0.0, 0.05, 0.95), ("s", "i", 0.05, 0.3, 0.95)]), "not_one_vowel"),
    (dict(phones=[("s", "a", 0.0, 0.3, 0.5)]), "not_one_vowel"), (dict(phones=[]), "not_one_vowel"), (dict(change=put("periodicity", 0.5, 5)), "no_periodicity"), (dict(change=put("rms", 0.001, 4)), "no_periodicity"),
]


@pytest.mark.parametrize("case,reason", REFUSED)
def test_gap_is_refused(spark, case, reason):
    f, p = gap_input(spark, **case)
    decisions, estimates = completion.gap_decisions(f, p)
    assert [r["reason"] for r in decisions.collect()] == [reason]
    before = {r["idx"]: r["f0"] for r in f.collect()}
    assert {r["idx"]: r["f0"] for r in completion.filled_frames(f, decisions, estimates).collect()} == before


def test_gap_settings_are_checked():
    with pytest.raises(ValueError):
        completion.GapSettings(max_gap_sec=0.5)


def test_manifest_notices_content_and_version(spark):
    current = rows(spark, [("/a.wav", "audio", 3, 10, "h2"), ("/b.wav", "audio", 3, 10, "h1"), ("/c.wav", "audio", 3, 10, "h1")], "path string, media_type string, size bigint, modified_ms bigint, content_hash string")
    old = rows(spark, [("1", "/A.wav", 3, 10, "h1", "v2", "ready", "x", None), ("2", "/b.wav", 3, 10, "H1", "v1", "ready", "x", None), ("3", "/c.wav", 3, 10, "h1", "v2", "ready", "x", None), ("4", "/gone.wav", 3, 10, "h1", "v2", "ready", "x", None)],
               "source_id string, path string, size bigint, modified_ms bigint, content_hash string, analysis_version string, state string, extracted_path string, error string")
    out = {r["source_id"]: r for r in media.manifest_diff(current, old, "v2").collect()}
    assert {k: r["change"] for k, r in out.items()} == {"1": "changed", "2": "changed", "3": "unchanged"}
    assert out["1"]["state"] == "pending" and out["3"]["extracted_path"] == "x"


def test_folder_scan(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.WAV", "deep/b.mkv", "c.txt"):
        (tmp_path / name).write_bytes(b"abc")
    found = media.supported(media.read_folder(spark, str(tmp_path), with_content=True)).select("media_type", media.fingerprint(F.col("content")).alias("h")).collect()
    assert sorted(r["media_type"] for r in found) == ["audio", "video"] and len({r["h"] for r in found}) == 1


def moras(spark, phones):
    sizes, problem = text.mora_groups(F.col("p"))
    r = rows(spark, [(phones,)], "p array<string>").select(sizes.alias("s"), problem.alias("x")).collect()[0]
    return r["x"] or r["s"]


def test_moras(spark):
    assert moras(spark, ["k", "a", "N", "sh", "i", "cl", "t", "e"]) == [2, 1, 2, 1, 2]
    assert moras(spark, ["k", "s", "a"]) == "consonant_cluster"
    assert moras(spark, ["k", "N"]) == "consonant_without_vowel"
    assert moras(spark, ["a", "k"]) == "trailing_consonant"
    assert moras(spark, ["a", "??"]) == "unknown_phone"


def test_versions_compare_by_number(spark):
    df = rows(spark, [("1.9.0",), ("1.10.0",), ("1.10.0-rc.1",), ("2.0.0-a",)], "version string")
    assert [r[0] for r in df.orderBy(*selection.version_order("version")).collect()] == ["2.0.0-a", "1.10.0", "1.10.0-rc.1", "1.9.0"]


def test_eligibility_reasons_are_ordered(spark):
    df = rows(spark, [("x", None, True, True, False, 0.0, "p", "ambiguous", False)],
              "segment_id string, speaker_id string, user_excluded boolean, wrong_speaker boolean, audio_readable boolean, voiced_ratio double, voicing_path string, content_type string, valid_alignment boolean")
    out = {r["target"]: r for r in routing.eligibility(df).collect()}
    assert out["singing"]["reason_codes"] == ["user_excluded", "wrong_speaker", "unreadable_audio", "wrong_content_type", "alignment_required"]
    assert out["talk"]["eligibility"] == "excluded" and out["talk"]["shared"]


def test_decode_confidence(spark):
    got = rows(spark, [(-1.0, True), (None, True), (None, False)], "m double, t boolean").select(text.decode_confidence(F.col("m"), F.col("t"))).collect()
    assert [r[0] for r in got] == [0.5, 0.5, 0.0]
    assert math.isclose(1 / (1 + math.exp(-2 * (0 + 1))), 0.8807970779778823)


def test_frames_and_periodicity_reach_over_several_chunks(spark):
    import numpy as np
    from voxloom.operators import signal
    from voxloom.operators.sequences import CHUNK

    rng = np.random.default_rng(2)
    for rate in (96_000, 192_000):
        wave = rng.integers(-9000, 9000, 40_000).tolist()
        rows = [("c", k, wave[k * CHUNK : (k + 1) * CHUNK], rate) for k in range(-(-len(wave) // CHUNK))]
        chunks = spark.createDataFrame(rows, "clip_id string, chunk long, samples array<int>, sample_rate int")
        size, hop = rate * 4 // 100, rate // 100
        want = {f: wave[f * hop : f * hop + size] for f in range((len(wave) - size) // hop + 1)}
        assert {r.frame: r.samples for r in signal.frames(chunks).collect()} == want
        first, count, lag = 4000, -(-rate // 20), round(rate / 60)
        request = spark.createDataFrame([("c", first / rate, 60.0, 0.01)], "clip_id string, time_sec double, f0 double, step_sec double")
        s = np.array(wave[first : first + count]) / 32768
        s = s - s.mean()
        a, b = s[:-lag], s[lag:]
        got = signal.periodicity(request, chunks).first().periodicity
        assert abs(got - np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))) < 1e-9


def test_periodicity_at_every_position_of_every_clip(spark):
    import numpy as np
    from voxloom.plans import queries_signal as q

    sf_dir = "/root/testdata/sf0.001"
    waves = {}
    for r in q._placed(spark, sf_dir).select("clip_id", "idx", "sample").collect():
        waves.setdefault(r.clip_id, {})[r.idx] = r["sample"]
    got = {(r.clip_id, round(r.time_sec * q.RATE)): r for r in q.periodicity(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert got.keys() == {(c, i) for c, w in waves.items() for i in w}
    for (c, i), r in got.items():
        f0, wave = 60 + i % 300, waves[c]
        n, lag = math.ceil(max(0.04, 3 / f0) * q.RATE), int(np.round(q.RATE / f0))
        value = rms = 0.0
        if i + n <= len(wave):
            s = np.array([wave[k] for k in range(i, i + n)]) / 32768
            s -= s.mean()
            a, b = s[: n - lag], s[lag:]
            scale = np.sqrt(np.dot(a, a) * np.dot(b, b))
            value, rms = (np.dot(a, b) / scale if scale > 1e-12 else 0.0), s[:4].std()
        assert r.periodicity == pytest.approx(value, abs=1e-9) and r.rms == pytest.approx(rms, abs=1e-9)


def test_bad_weights_are_rows_and_stop_only_their_key(spark):
    from voxloom.operators import sampling

    items = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", None), ("b", "y", 1.0), ("c", "z", float("nan"))], "job_id string, name string, weight double")
    assert {r.job_id for r in sampling.draw_epoch(items, ["job_id"], 1, 0).collect()} == {"a"}
    assert sorted((r.job_id, r.name) for r in sampling.weight_problems(items).collect()) == [("b", "x"), ("c", "z")]


def test_digests_nulls_blanks_and_unvoiced_frames(spark):
    from pyspark.sql import functions as F
    from voxloom.functions.fingerprints import row_digest
    from voxloom.functions.measure import blank
    from voxloom.operators import signal
    from voxloom.sinks import datasets

    rows = spark.createDataFrame([("a|vb", "c"), ("a", "b|vc"), ("a", None), ("a", "")], "x string, y string")
    assert rows.select(row_digest(F.col("x"), F.col("y")).alias("d")).distinct().count() == 4
    texts = spark.createDataFrame([("　",), ("\t",), (None,), (" a　",)], "t string").select(blank(F.col("t")).alias("b"))
    assert [r.b for r in texts.collect()] == [True, True, True, False]
    manifest = spark.createDataFrame([("j", "p", None)], "job_id string, path string, sha256 string")
    actual = spark.createDataFrame([("j", "p", 5, "ff")], "job_id string, path string, size long, sha256 string")
    assert [r.problem for r in datasets.artifact_problems(manifest, actual, manifest.select("job_id")).collect()] == ["hash_mismatch"]
    series = spark.createDataFrame([("s", float("nan"), 0.9, 0.1, 0.0), ("s", 100.0, 0.9, 0.1, 1.0)], "segment_id string, f0 double, f0_conf double, energy double, voicing double")
    assert signal.summarize(series).first().mean_f0_hz == 100.0


def test_a_refused_merge_changes_nothing(spark):
    from voxloom.operators import speakers

    people = spark.createDataFrame(
        [(s, [float(x) for x in c], False, [], []) for s, c in [("a", [1, 0]), ("b", [0, 1]), ("c", [1, 0, 0]), ("d", [1, 1]), ("e", []), ("f", [2, 0])]],
        "speaker_id string, centroid array<double>, selected boolean, merged_from array<string>, representatives array<string>")
    assigned = spark.createDataFrame([(f"s_{s}", s, 2.0) for s in "abcdef"], "segment_id string, speaker_id string, duration_sec double")
    none = spark.createDataFrame([], "segment_id string")

    def run(*pairs):
        merges = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(pairs)], "source_id string, target_id string, order int")
        out = speakers.merge_speakers(people, assigned, merges, none)
        problems = {(r.target_id, r.speaker_id, r.problem) for r in out["problems"].collect()}
        moved = sorted((r.segment_id, r.speaker_id) for r in out["assignments"].collect())
        assert len(moved) == 6
        return problems, {s[2:]: t for s, t in moved if s[2:] != t}, {r.speaker_id: r for r in out["speakers"].collect()}

    problems, moved, left = run(("b", "a"), ("e", "a"), ("a", "a"), ("d", "ghost"), ("zz", "f"))
    assert problems == {("ghost", "d", "unknown_target"), ("f", "zz", "unknown_source")} and moved == {"b": "a", "e": "a"}
    assert sorted(left) == ["a", "c", "d", "f"] and left["a"].total_sec == 6.0 and left["a"].merged_from == ["b", "e"]
    assert [round(x, 6) for x in left["a"].centroid] == [0.707107, 0.707107]
    problems, moved, left = run(("b", "a"), ("c", "a"))
    assert {p[2] for p in problems} == {"dimension_mismatch"} and not moved and len(left) == 6
    problems, moved, _ = run(("b", "a"), ("b", "d"), ("e", "f"))
    assert problems == {("a", "b", "repeated_source"), ("d", "b", "repeated_source")} and moved == {"e": "f"}
    problems, moved, _ = run(("a", "b"), ("b", "d"))
    assert {p[2] for p in problems} == {"chained"} and not moved


def test_twelve_significant_digits(spark):
    from pyspark.sql import functions as F
    from voxloom.sinks.datasets import significant

    values = [0.25, 5e-05, 1e-4, 0.1 + 0.2, 1 / 3, 7.0, 100.0, 123456.789, 1.5e-9, 0.0001000000000001, 2.50000000000004, 99999999999.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", significant(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == {v: f"{v:.12g}" for v in values}


def test_noise_and_reverb_of_a_clip_without_samples_on_the_grid(spark):
    from voxloom.operators import signal

    chunks = spark.createDataFrame([("c", 0, [5], 8000), ("e", 0, [], 8000)], "clip_id string, chunk bigint, samples array<int>, sample_rate int")
    assert {r.clip_id: r.reverb_score for r in signal.reverb_scores(chunks).collect()} == {"c": 0.0, "e": 0.0}
    assert [r.clip_id for r in signal.noise_scores(chunks).collect()] == ["c"]


def test_every_field_of_a_contract_counts(spark):
    from voxloom.operators import jobs

    schema = ("job_id string, target string, texture string, preset_version string, description string, reference_ids array<string>, requested_mode string, "
              "resolved_mode string, seed bigint, initialization string, components array<struct<name:string,sha256:string,path:string>>")
    one, two = {"name": "a", "sha256": "FF", "path": "p"}, {"name": "b", "sha256": "00", "path": "q"}
    base = {"target": "talk", "texture": "t", "preset_version": "1", "description": "d", "reference_ids": ["x", "y"], "requested_mode": "auto", "resolved_mode": "fine_tune",
            "seed": 7, "initialization": "pretrained_checkpoint", "components": [one, two]}
    other = {"target": "singing", "texture": "u", "preset_version": None, "description": "", "reference_ids": ["x,y"], "requested_mode": "fine_tune", "resolved_mode": None,
             "seed": None, "initialization": "none", "components": [one]}
    data = [{"job_id": "base", **base}, {"job_id": "same", **base, "reference_ids": ["y", "x"], "components": [two, {**one, "sha256": "ff"}]}]
    data += [{"job_id": k, **base, k: v} for k, v in other.items()]
    prints = {r.job_id: r.contract_fingerprint for r in jobs.contract_fingerprint(spark.createDataFrame(data, schema)).collect()}
    assert len(prints) == len(data) and prints.pop("same") == prints["base"] and len(set(prints.values())) == len(prints)


def test_every_field_of_a_training_input_counts(spark):
    from voxloom.operators import jobs

    kinds = "role string, eligibility string, reason_codes array<string>, quality_status string, quality_value double, components map<string,struct<value:double,status:string>>, utility_status string, utility_value double, raw_weight double, training_weight double"
    item = {"role": "primary", "eligibility": "eligible", "reason_codes": ["a"], "quality_status": "measured", "quality_value": 0.5, "components": {"asr": (0.5, "measured")},
            "utility_status": "measured", "utility_value": 0.25, "raw_weight": 1.0, "training_weight": 2.0}
    changed = {"role": None, "eligibility": "excluded", "reason_codes": ["a", "b"], "quality_status": "legacy", "quality_value": None, "components": {"asr": (0.5, "legacy")},
               "utility_status": "unavailable", "utility_value": 0.5, "raw_weight": 1.5, "training_weight": 2.5}
    fields = {c: "v" for c in jobs.CONTEXT}
    items = [{"job": "base", "segment_id": "s", **item}, *[{"job": k, "segment_id": "s", **item, k: v} for k, v in changed.items()], {"job": "segment", "segment_id": "z", **item}]
    items += [{"job": f"c_{c}", "segment_id": "s", **item} for c in jobs.CONTEXT] + [{"job": "lost", "segment_id": "s", **item}] + [{"job": "twice", "segment_id": "s", **item}] * 2
    contexts = [{"job": j, **fields} for j in {i["job"] for i in items} - {"lost"} if not j.startswith("c_")] + [{"job": f"c_{c}", **fields, c: "w"} for c in jobs.CONTEXT]
    contexts = [{**c, "backend": "　"} if c["job"] == "segment" else c for c in contexts]
    prints, problems = jobs.input_fingerprint(
        rows(spark, items, f"job string, segment_id string, {kinds}"), ["job"], rows(spark, contexts, "job string, " + ", ".join(f"{c} string" for c in jobs.CONTEXT)))
    found = {r.job: r.input_fingerprint for r in prints.collect()}
    assert len(set(found.values())) == len(found) == 1 + len(changed) + len(jobs.CONTEXT)
    assert {(r.job, r.problem) for r in problems.collect()} == {("lost", "context_missing"), ("twice", "segment_repeated"), ("segment", "backend_blank")}


def test_every_column_of_a_snapshot_counts(spark):
    from voxloom.operators import dataset

    schema = "segment_id string, transcript string, confidence double, phonemes array<struct<phoneme:string,start:double>>, tags map<string,int>"
    base = ("s", "t", 0.5, [("a", 0.1), ("o", 0.2)], {"x": 1, "y": 2})
    others = [("z", *base[1:]), ("s", None, *base[2:]), (*base[:2], 0.25, *base[3:]), (*base[:2], float("nan"), *base[3:]), (*base[:3], [("a", 0.1), ("o", 0.3)], base[4]),
              (*base[:3], [("o", 0.2), ("a", 0.1)], base[4]), (*base[:4], {"x": 2, "y": 1}), (*base[:4], None)]
    edits = spark.createDataFrame([("s", "e")], "segment_id string, value string")

    def fingerprint(row, settings={"enabled": "true", "pitch": None}, log=edits):
        return dataset.snapshot_fingerprint(rows(spark, [row], schema), log, settings).first().fingerprint

    found = [fingerprint(r) for r in [base, *others]]
    found += [fingerprint(base, {"enabled": "false", "pitch": None}), fingerprint(base, {"enabled": "true", "pitch": "fill"}), fingerprint(base, log=edits.limit(0))]
    assert len(set(found)) == len(found) and fingerprint((*base[:4], {"y": 2, "x": 1})) == found[0]


def test_equal_times_and_labels_of_any_script(spark):
    from voxloom.operators import classification, dataset, speakers

    log = rows(spark, [("s", 5, 1, "speech"), ("s", 5, 3, "singing"), ("s", 5, 2, "ambiguous"), ("s", 4, 9, "speech")], "segment_id string, changed_at long, seq long, new_type string")
    classes = rows(spark, [("s", "speech", 0.5, False)], "segment_id string, content_type string, confidence double, user_overridden boolean")
    assert classification.reapply_overrides(classes, log).first().content_type == "singing"
    edits = log.select("segment_id", "changed_at", "seq", F.lit("transcript").alias("field"), F.col("new_type").alias("value"))
    assert dataset.latest_transcripts(edits).first().new_transcript == "singing"
    people = rows(spark, [("s", True)], "speaker_id string, selected boolean")
    picks = log.select(F.col("segment_id").alias("speaker_id"), "changed_at", "seq", (F.col("new_type") != "singing").alias("selected"))
    assert speakers.select_speakers(people, picks).first().selected is False
    names = rows(spark, [("　calm",), ("calm ",), ("a\u0085b",), ("ca lm",), ("a\tb",), ("calm\n",)], "name string").select("name", F.lit("user").alias("source"), F.lit(None).cast("double").alias("confidence"))
    assert [r.p for r in names.select(dataset.emotion_problem().alias("p")).collect()] == ["blank_or_padded", "blank_or_padded", "control_character", None, "control_character", "blank_or_padded"]


def test_window_sums_inside_chunks_equal_plain_windows(spark):
    import numpy as np
    from voxloom.operators import signal

    rng = np.random.default_rng(5)
    clips = {"a": (rng.integers(-32768, 32768, 10_000), 16_000), "b": (np.full(5_000, -32768), 96_000), "c": (rng.integers(-9, 9, 100), 8_000)}
    data = [(c, k, [int(x) for x in s[k * 4096 : (k + 1) * 4096]], rate) for c, (s, rate) in clips.items() for k in range(-(-len(s) // 4096) + 1)]
    chunks = rows(spark, data, "clip_id string, chunk long, samples array<int>, sample_rate int")
    found = {(r.clip_id, r.idx): r.rms for r in signal.rms_windows(chunks).collect()}
    stats = {r.clip_id: r for r in signal.wave_stats(chunks).collect()}
    facts = {r.clip_id: r for r in signal.reference_facts(chunks).collect()}
    windows = 0
    for c, (s, rate) in clips.items():
        width, level = int(rate * 0.03), np.abs(s)
        for i in range(-(-len(s) // width)):
            windows += 1
            assert found[c, i] == pytest.approx(np.sqrt(np.mean(s[i * width : (i + 1) * width].astype(float) ** 2)))
        assert stats[c].sample_count == len(s) and stats[c].peak == level.max() / 32768 and stats[c].rms == pytest.approx(np.sqrt(np.mean(s.astype(float) ** 2)) / 32768)
        assert stats[c].clipping_ratio == pytest.approx((level >= 32700).mean()) and stats[c].silence_ratio == pytest.approx((level <= 180).mean())
        block = rate // 50
        quiet = [np.sqrt(np.mean(s[i : i + block].astype(float) ** 2)) / 32768 < 0.008 for i in range(0, len(s), block)]
        assert facts[c].silence_ratio == pytest.approx(np.mean(quiet)) and facts[c].clipping_ratio == pytest.approx((level >= 32760).mean())
    assert windows == len(found)


def test_a_record_is_known_by_its_digest(spark):
    from voxloom.operators import text

    kind = "segment_id string, audio_sha256 string, duration_sec double, conditions struct<model:string,rate:int>, phonemes array<struct<phoneme:string,start_sec:double,end_sec:double,confidence:double>>, entries array<struct<start:double,end:double,label:string>>"
    row = ("s", "a", 1.5, ("m", 16000), [("a", 0.1, 0.4, 0.9)], [(0.1, 0.4, "a"), (0.4, 0.5, "sil")])
    tampered = [
        ("s", "a", 1.5, ("m", 16001), *row[4:]), (*row[:4], [("a", 0.1, 0.4, 0.91)], row[5]), (*row[:4], [("a", 0.1, 0.4000001, 0.9)], row[5]), (*row[:5], [(0.1, 0.4, "a"), (0.4, 0.6, "sil")]),
        (*row[:5], row[5][:1]), (*row[:2], 1.6, *row[3:]), (*row[:5], None), ("s", None, *row[2:]),
    ]
    df = spark.createDataFrame([row, row, *tampered], kind)
    found = [r[0] for r in df.select(text.record_print(df)).collect()]
    assert found[0] == found[1] and len(set(found)) == 1 + len(tampered)


def test_observations_are_known_by_their_phones(spark):
    from voxloom.operators import completion

    kind = "segment_id string, speaker_id string, source_id string, content_type string, asr_confidence double, alignment_confidence double, phonemes array<struct<phoneme:string,start_sec:double,end_sec:double,confidence:double>>"

    def prints(*phones, source="src"):
        rows = [("s1", "spk", source, "speech", 0.9, 0.9, list(phones)), ("s2", "spk", "src", "speech", 0.1, 0.9, [("x", 0.0, 1.0, 0.9)])]
        return [r.observation_fingerprint for r in completion.observation_prints(spark.createDataFrame(rows, kind)).collect()]

    a, o = ("a", 0.0, 0.1, 0.9), ("o", 0.1, 0.2, 0.9)
    assert prints(a, o, ("k", 0.2, 0.3, 0.1)) == prints(a, o)  # unreliable phones do not count
    assert prints(a, o, source="generated:1") == []
    assert len({prints(*x)[0] for x in ((a, o), (o, a), (a,), (a, a), (a, ("o", 0.1, 0.2001, 0.9)), (a, ("o", 0.1, 0.2, 0.91)))}) == 6
