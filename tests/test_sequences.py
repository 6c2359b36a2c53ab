"""Two-level helpers against plain Python, with tiny buckets so that every border is crossed."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions.measure import high_rank, low_rank
from voxloom.operators import inventory, sampling, segmentation, selection, sequences as seq, signal, speakers
from voxloom.operators.completion import choose_prompts
from voxloom.sinks import files, versioned


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(5)
    data = [(k, i, rng.choice([None, None, rng.randint(0, 9)]), float(rng.randint(0, 50))) for k in "ab" for i in range(60)]
    return data, spark.createDataFrame(data, "k string, i bigint, v int, x double").repartition(7)


def test_running_sum_and_position(spark, numbers):
    data, df = numbers
    out = seq.running_sum(df.withColumn("b", F.col("i") % 1000 - F.col("i") % 7), ["k"], "b", ["i"], F.col("x"), "s")
    want = {}
    for k, i, _, x in data:
        want[k, i] = want.get((k, i - 1), 0.0) + x
    assert {(r["k"], r["i"]): r["s"] for r in out.collect()} == want
    pos = seq.position_in(df.withColumn("b", F.col("i") - F.col("i") % 5), ["k"], "b", ["i"])
    assert all(r["pos"] == r["i"] for r in pos.collect())


def test_neighbours_cross_chunks(spark, numbers):
    data, df = numbers
    by = {(k, i): x for k, i, _, x in data}
    out = seq.with_neighbours(df, ["k"], "i", {"l2": (F.col("x"), -2), "r1": (F.col("x"), 1)}, size=4).collect()
    assert len(out) == len(data)
    assert all(r["l2"] == by.get((r["k"], r["i"] - 2)) and r["r1"] == by.get((r["k"], r["i"] + 1)) for r in out)


@pytest.mark.parametrize("forward,inclusive", [(True, False), (True, True), (False, False), (False, True)])
def test_carry(spark, numbers, forward, inclusive):
    data, df = numbers
    out = {(r["k"], r["i"]): r["o"] for r in seq.carry(df, ["k"], "i", F.col("v"), "o", forward, inclusive, size=4).collect()}
    for k in "ab":
        rows = [v for kk, _, v, _ in data if kk == k]
        for i in range(60):
            past = rows[: i + inclusive][::-1] if forward else rows[i + (not inclusive):]
            assert out[k, i] == next((v for v in past if v is not None), None)


def test_order_picks(spark, numbers):
    data, df = numbers
    out = {r["k"]: r for r in seq.order_picks(df, ["k"], "x", {"lo": lambda n: low_rank(n, 0.2), "hi": lambda n: high_rank(n, 0.9)}).collect()}
    for k in "ab":
        xs = sorted(x for kk, _, _, x in data if kk == k)
        assert out[k]["lo"] == xs[max(0, int(60 * 0.2) - 1)] and out[k]["hi"] == xs[min(59, int(60 * 0.9))]


def test_global_rank(spark, numbers):
    data, df = numbers
    out = seq.global_rank(df, ["k"], ["x", "i"]).collect()
    for k in "ab":
        want = sorted((x, i) for kk, i, _, x in data if kk == k)
        assert [(r["x"], r["i"]) for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["rank"])] == want


def close_groups(voiced):
    """Voiced places fall apart wherever neighbours are ten or more apart."""
    at = np.flatnonzero(voiced)
    groups = np.split(at, np.flatnonzero(np.diff(at) >= 10) + 1)
    return [(int(g[0]), int(g[-1]) + 1) for g in groups if len(g)]


def test_voice_ranges_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(seq.carry, "__defaults__", (True, False, 16))
    rng = random.Random(9)
    clips = {f"c{n}": [1000.0 if rng.random() < rng.choice([0.05, 0.2]) else 1.0 for _ in range(200)] for n in range(25)}
    df = spark.createDataFrame([(c, i, x) for c, xs in clips.items() for i, x in enumerate(xs)], "clip_id string, idx bigint, rms double")
    got = {}
    for r in segmentation.voice_ranges(df).collect():
        got.setdefault(r["clip_id"], []).append((r["start_idx"], r["end_idx"]))
    for c, xs in clips.items():
        limit = max(350.0, sorted(xs)[max(0, int(len(xs) * 0.2) - 1)] * 3)
        assert sorted(got.get(c, [])) == close_groups([x >= limit for x in xs])


def tail_share(samples, rate):
    """Twice the share of quiet steps that have their latest loud step 1 to 21 steps behind."""
    env = np.abs(np.asarray(samples)[:: max(1, rate // 200)])
    if len(samples) < rate // 2 or len(env) < 20 or not env.any():
        return 0.0
    loud = np.flatnonzero(env >= env.max() * 0.35)
    behind = [s - loud[loud <= s].max() for s in range(len(env)) if (loud <= s).any()]
    return min(1.0, sum(1 <= d <= 21 for d in behind) / len(env) * 2.0)


def chunked(spark, clips, rate):
    size = seq.CHUNK
    data = [(c, k, [int(x) for x in xs[k * size:(k + 1) * size]], rate) for c, xs in clips.items() for k in range(-(-len(xs) // size))]
    return spark.createDataFrame(data, "clip_id string, chunk bigint, samples array<int>, sample_rate int")


def test_reverb_equals_the_definition(spark):
    rng = random.Random(4)
    clips = {f"c{n}": [rng.choice([0, 0, 0, 5, 9000]) if rng.random() < 0.04 else 3 for _ in range(9000)] for n in range(4)}
    out = {r["clip_id"]: r["reverb_score"] for r in signal.reverb_scores(chunked(spark, clips, 800)).collect()}
    for c, xs in clips.items():
        assert out[c] == pytest.approx(tail_share(xs, 800))


def direct_pitch(frame, rate, low_hz, high_hz, accept):
    x = np.asarray(frame, dtype=float) - np.mean(frame)
    best, lag_best = 0.0, 0
    for lag in range(max(1, int(rate / high_hz)), min(len(x) - 2, int(rate / low_hz)) + 1):
        a, b = x[:-lag], x[lag:]
        scale = np.sqrt(np.sum(a * a) * np.sum(b * b))
        if scale > 1e-9 and np.dot(a, b) / scale > best + 1e-12:
            best, lag_best = np.dot(a, b) / scale, lag
    return rate / lag_best if lag_best and best >= accept else None


def value(x):
    return None if np.isnan(x) else x


@pytest.mark.parametrize("rate", [8000, 12000, 48000])
def test_pitch_equals_the_direct_definition(rate):
    t = np.arange(int(rate * 0.04)) / rate
    rng = np.random.default_rng(7)
    for noise in (0, 800, 9000):
        frame = np.round(6000 * np.sin(2 * np.pi * 233 * t) + 2500 * np.sin(2 * np.pi * 518 * t) + noise * rng.standard_normal(len(t)))
        (pitch, _), (sure, _) = signal.feature_pitch(np.stack([frame, frame]), rate)
        assert value(pitch) == direct_pitch(frame, rate, 60, 1200, 0.45) and 0 <= sure <= 1
        assert value(signal.classifier_pitch(frame[None], rate)[0][0]) == direct_pitch(frame, rate, 70, 1000, 0.55)
    silent = signal.feature_pitch(np.zeros((1, 400)), rate)
    assert np.isnan(silent[0][0]) and silent[1][0] == 0


def test_frames_and_periodicity_across_chunks(spark):
    rate = 16000
    xs = np.round(8000 * np.sin(2 * np.pi * 200 * np.arange(10000) / rate))
    chunks = chunked(spark, {"c": xs}, rate)
    framed = signal.frames(chunks).collect()
    assert len(framed) == len(range(0, 10000 - 640 + 1, 160))
    assert all(list(r["samples"]) == [int(v) for v in xs[r["frame"] * 160: r["frame"] * 160 + 640]] for r in framed)
    pitches = signal.with_pitch(signal.frames(chunks), signal.feature_pitch).collect()
    assert all(abs(r["pitch_hz"] - 200) < 1 for r in pitches)
    asked = spark.createDataFrame([("c", 0.25, 200.0, 0.01), ("c", 0.1, 200.0, 0.01), ("c", 9.0, 200.0, 0.01), ("c", 0.1, 20.0, 0.01)], "clip_id string, time_sec double, f0 double, step_sec double")
    out = {(r["time_sec"], r["f0"]): r for r in signal.periodicity(asked, chunks).collect()}
    assert out[0.25, 200.0]["periodicity"] > 0.999 and out[0.25, 200.0]["rms"] > 0.1
    assert out[9.0, 200.0]["periodicity"] == 0 and out[0.1, 20.0]["periodicity"] == 0


def average_linkage(vectors, limit):
    groups = [[i] for i in range(len(vectors))]
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - u @ u.T
    while len(groups) > 1:
        best = min((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] >= limit:
            break
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("block", [2048, 12])
def test_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(speakers, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((5, 6))
    vectors = np.concatenate([centers[i % 5] + 0.45 * rng.standard_normal(6) for i in range(45)]).reshape(45, 6)
    vectors[40:43] = vectors[7]  # copies
    df = spark.createDataFrame([(f"s{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "segment_id string, embedding array<double>")
    found = {}
    members = speakers.cluster(df, 0.30)
    for r in members.collect():
        found.setdefault(r["cluster"], set()).add(int(r["segment_id"][1:]))
    assert {frozenset(g) for g in found.values()} == average_linkage(vectors, 0.30)
    labels = {r["segment_id"]: r["speaker_id"] for r in speakers.speaker_labels(members).collect()}
    assert labels["s000"] == "spk_01" and len(set(labels.values())) == len(found)


@pytest.mark.parametrize("alone", [0, 30])
def test_clusters_of_blocks_and_of_one_task_agree(spark, monkeypatch, alone):
    """spk_2: rounds over blocks, of what changed alone, and rounds in one task give the tree of brute force."""
    monkeypatch.setattr(speakers, "BLOCK_ROWS", 12)
    monkeypatch.setattr(speakers, "ALONE", alone)
    rng = np.random.default_rng(7)
    vectors = np.repeat(rng.standard_normal((6, 5)), 8, axis=0) + 0.4 * rng.standard_normal((48, 5))
    df = spark.createDataFrame([(f"s{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "segment_id string, embedding array<double>")
    found = {}
    for r in speakers.cluster(df, 0.30).collect():
        found.setdefault(r["cluster"], set()).add(int(r["segment_id"][1:]))
    assert {frozenset(g) for g in found.values()} == average_linkage(vectors, 0.30) and all(min(g) == int(k[1:]) for k, g in found.items())
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    end = speakers._rounds(unit, np.ones(48), 0.30)
    assert {frozenset(np.flatnonzero(end == e).tolist()) for e in set(end.tolist())} == average_linkage(vectors, 0.30)


def test_reference_intake_equals_the_fold(spark):
    rng = random.Random(1)
    data = [(f"j{n % 4}", n, rng.choice(["wav", "wav", "wav", "mp3"]), rng.random() > 0.1, rng.choice([None, 5.0, 12.0, 18.0, 29.0, 31.0]), f"h{rng.randint(0, 25)}") for n in range(160)]
    df = spark.createDataFrame(data, "job_id string, position bigint, extension string, exists boolean, seconds double, sha256 string")
    out = {(r["job_id"], r["position"]): (r["accepted"], r["reason"]) for r in selection.reference_intake(df).collect()}
    state = {}
    for job, at, ext, there, sec, sha in data:
        n, total, seen = state.get(job, (0, 0.0, frozenset()))
        reason = ("too_many" if n >= 8 else "not_wav" if ext != "wav" else "missing" if not there else "unreadable" if not sec else "too_long" if sec > 30
                  else "over_budget" if total + sec > 120 else "repeated_content" if sha in seen else None)
        assert out[job, at] == (reason is None, reason)
        if reason is None:
            state[job] = (n + 1, total + sec, seen | {sha})


def test_prompts_equal_greedy_cover(spark):
    prompts = [("p0", ["a", "k"]), ("p1", ["k", "s", "t"]), ("p2", ["t", "N", "I"]), ("p3", ["py"]), ("p4", ["a", "s"])]
    needs = [("x", ["N", "a", "i", "k", "s", "t"]), ("y", ["py", "zz"]), ("z", ["zz"])]
    out = {r["speaker_id"]: r for r in choose_prompts(spark.createDataFrame(needs, "speaker_id string, missing array<string>"), prompts, 3).collect()}
    for who, missing in needs:
        left, picks = set(missing), []
        for _ in range(3):
            cover = [({q.lower() if q in "IU" else q for q in ph} & left, -i) for i, (_, ph) in enumerate(prompts)]
            targets, back = max(cover, key=lambda c: (len(c[0]), c[1]))
            if not targets:
                break
            picks.append((-back, sorted(targets)))
            left -= targets
        assert [(p["prompt"], p["targets"]) for p in out[who]["picks"]] == picks and out[who]["uncovered"] == sorted(left)


def test_samples_follow_weights_and_repeat(spark):
    items = spark.createDataFrame([("j", f"n{i}", 2.0 if i % 2 else 0.5) for i in range(2000)], "job_id string, name string, weight double")
    one = sampling.draw_epoch(items, ["job_id"], 1, 0)
    drawn = one.collect()
    assert len(drawn) == 2000 and len({r["draw"] for r in drawn}) == 2000
    heavy = sum(int(r["name"][1:]) % 2 for r in drawn) / 2000
    assert abs(heavy - 0.8) < 0.04
    again = sampling.draw_epoch(items.repartition(11), ["job_id"], 1, 0).collect()
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, again))
    other = sampling.draw_epoch(items, ["job_id"], 1, 1).collect()
    assert sorted(map(tuple, drawn)) != sorted(map(tuple, other))


@pytest.mark.parametrize("n,held", [(1, 0), (2, 1), (9, 1), (25, 2), (200, 5)])
def test_hold_out(spark, n, held):
    names = [f"name{i:04d}" for i in range(n)]
    df = spark.createDataFrame([("j", x) for x in names], "job_id string, name string")
    got = sorted(r["name"] for r in sampling.hold_out(df, ["job_id"], "name").collect())
    count = min(5, max(1, n // 10), n - 1) if n > 1 else 0
    assert count == held and got == [names[int(i * (n / count))] for i in range(count)]


def test_stale_writer_is_refused(spark, tmp_path):
    current = spark.createDataFrame([("a", 3), ("b", 1)], "dataset_id string, revision long")
    saves = spark.createDataFrame(
        [("a", 3, 2, "x"), ("a", 3, 1, "y"), ("a", 2, 0, "z"), ("b", None, 3, "u"), ("new", None, 5, "v"), ("new", None, 9, "w"), ("new2", 1, 1, "t")],
        "dataset_id string, expected long, place long, body string")
    judged = versioned.judge_saves(saves, current)
    won = {(r.dataset_id, r.body, r.revision) for r in judged.collect() if r.outcome == "saved"}
    assert won == {("a", "y", 4), ("new", "v", 1)} and judged.count() == 7
    folder = str(tmp_path / "saves")
    saved = versioned.save_all(judged, folder)
    assert {(r.dataset_id, r.body, r.revision) for r in saved.collect()} == won
    with pytest.raises(Exception, match="(?i)exists"):
        versioned.save_all(judged, folder)
    assert dict(map(tuple, versioned.advance(current, saved).collect())) == {"a": 4, "b": 1, "new": 1}
    history = saved.unionByName(saved.withColumn("revision", F.col("revision") - 1).withColumn("body", F.lit("old")))
    assert {r.body for r in versioned.latest_rows(history).collect()} == {"y", "v"}


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_what_is_published_comes_back(spark, tmp_path, form):
    rows = [("j1", "a", "x \"y\", z\n\\q", 0.1 + 0.2), ("j1", "b", "", -1e-300), ("j2", "c", None, None), (" j 3/ü", "d", " s ", 1e17)]
    df = spark.createDataFrame(rows, "job string, id string, text string, x double")
    if form == "csv":
        df = df.where("id <> 'a'")  # a line break inside a cell needs a reader that cannot split files
    back = files.publish(df, str(tmp_path / "set"), "job", form)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert files.differences(back, df, ["id"]).count() == 0
    assert [r.id for r in files.differences(back.where("id <> 'b'"), df, ["id"]).collect()] == ["b"]
    with pytest.raises(Exception, match="(?i)exists"):
        files.publish(df, str(tmp_path / "set"), "job", form)


def test_corrections_know_their_input(spark):
    from voxloom.operators import completion

    frames = spark.createDataFrame(
        [("s", i, i * 0.01, 0.0 if i in (3, 4, 8) else 200.0 + i, 0.9, 0.5, 1.0, 0.95, 0.1) for i in range(14)],
        "segment_id string, idx long, time_sec double, f0 double, f0_conf double, energy double, voicing double, periodicity double, rms double")
    phones = spark.createDataFrame([("s", "a", 0.0, 1.0, 0.9)], "segment_id string, phoneme string, start_sec double, end_sec double, confidence double")
    records = completion.correction_records(frames, phones, *completion.gap_decisions(frames, phones)).collect()
    gaps = {r.start_frame: r for r in records if r.start_frame is not None}
    assert len(records) == 3 and set(gaps) == {3, 8} and len({r.input_fingerprint for r in records}) == 1
    for r in gaps.values():
        assert len(r.original_values) == r.end_frame - r.start_frame and set(r.original_values) == {0.0}
        assert (len(r.result_values) == len(r.original_values)) == (r.application_status == "applied")
    before = completion.input_fingerprints(frames, phones).first().input_fingerprint
    changed = [
        completion.input_fingerprints(frames.withColumn("energy", F.when(F.col("idx") == 13, 0.4).otherwise(F.col("energy"))), phones),
        completion.input_fingerprints(frames.where("idx <> 13"), phones), completion.input_fingerprints(frames, phones.withColumn("confidence", F.lit(0.8))),
        completion.input_fingerprints(frames, phones, completion.GapSettings(max_gap_sec=0.05)),
    ]
    assert len({before, *(x.first().input_fingerprint for x in changed)}) == 5


def test_assessment_ignores_input_order(spark):
    from voxloom.operators import routing, weights
    from voxloom.plans.queries_weights import eligible_input

    rows = eligible_input(spark, "/root/testdata/sf0.001")
    pick = ["segment_id", "target", "eligibility", F.round("training_weight", 12).alias("w")]
    a = weights.assess(routing.eligibility(rows)).select(*pick).collect()
    b = weights.assess(routing.eligibility(rows.repartition(13, "cache_key"))).select(*pick).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_provenance_notices_changed_files_and_jobs_without_any(spark, tmp_path):
    folder = str(tmp_path / "set")
    rows = [("a b/+", "x", 1.0), ("a b/+", "y", 0.5), (None, "z", 2.0), ("c", "w", 1.0)]
    accepted = spark.createDataFrame(rows, "job_id string, name string, training_weight double")
    held = spark.createDataFrame([("c", "h"), ("d%", "i"), ("d%", "j")], "job_id string, segment_id string")
    files.publish(accepted, folder, "job_id", "csv")
    told = {r.job_id: r for r in files.record_provenance(accepted, held, folder, "job_id", "f1").collect()}
    assert {k: (r.status, r.accepted, r.held, r.files > 0) for k, r in told.items()} == {
        "a b/+": ("written", 2, 0, True), None: ("written", 1, 0, True), "c": ("written", 1, 1, True), "d%": ("none_accepted", 0, 2, False)}
    assert files.provenance_problems(spark, folder, "job_id").collect() == []
    part = next(tmp_path.glob("set/job_id=c/part-*"))
    for crc in tmp_path.glob("set/job_id=*/.*.crc"):
        crc.unlink()
    part.write_bytes(part.read_bytes() + b" ")
    next(tmp_path.glob("set/job_id=__HIVE*/part-*")).unlink()
    found = {r.job_id: r.problem for r in files.provenance_problems(spark, folder, "job_id").collect()}
    assert found == {"c": "files_differ", None: "files_missing"}


def test_reports_are_held_against_the_manifest(spark):
    items = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 2.0), ("c", "z", 1.0)], "job string, name string, weight double")
    fine = sampling.sampler_report(items.where("job <> 'c'"), ["job"], 7, 2, 1)

    def codes(reports, seed=7):
        return {r.job: r.problems for r in sampling.report_problems(items, reports, ["job"], seed).collect()}

    assert codes(fine) == {"a": [], "b": [], "c": ["report_missing"]}
    assert codes(fine, 8)["a"] == ["seed_differs"]
    assert codes(sampling.sampler_report(items, ["job"], 7, 0, None))["b"] == ["sampler_never_used"]
    moved = items.withColumn("weight", F.when(F.col("name") == "y", 0.75).otherwise(F.col("weight")))
    assert codes(sampling.sampler_report(moved, ["job"], 7, 2, 1)) == {"a": ["weights_changed"], "b": [], "c": []}
    less = items.where("name <> 'y'").unionByName(items.limit(1).withColumn("job", F.lit("ghost")))
    assert codes(sampling.sampler_report(less, ["job"], 7, 2, 1)) == {"a": ["item_count_differs", "weights_changed"], "b": [], "c": [], "ghost": ["manifest_missing"]}
    odd = spark.createDataFrame([("a", "x", None), ("a", "y", float("nan")), ("a", "z", -1.0), ("a", "w", 0.0)], "job string, name string, weight double")
    assert {r.name: r.problem for r in sampling.weight_problems(odd).collect()} == {"x": "missing_weight", "y": "bad_weight", "z": "bad_weight"}


def test_inventory_counts_equal_plain_sets(spark):
    rng = random.Random(5)
    rows = [
        (f"g{i}", rng.choice(["a", "b", " ", None]), rng.choice(["s1", "s2", "", None]), rng.choice(["k1", "k2", "k3", None]), rng.choice([None, 1.0, 2.5, -1.0]), rng.choice(["primary", "excluded", "feature_only"]), rng.choice(["primary", "none"]),
         rng.choice(["eligible", "excluded", "needs_review"]), rng.choice(["eligible", "excluded"]), rng.sample(["a", "k", "s"], rng.randint(0, 3)), rng.choice([None, [1, 2], [2]]), rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5, "measured", 0.9)
        for i in range(150)]
    names = "segment_id speaker_id source_id cache_key duration_sec talk_role singing_role talk_eligibility singing_eligibility phones bins transcript_blank has_f0 has_embedding asr_status asr_confidence".split()
    kinds = ["string"] * 4 + ["double"] + ["string"] * 4 + ["array<string>", "array<int>"] + ["boolean"] * 3 + ["string", "double"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    got = {r.speaker_id: r for r in inventory.speaker_inventory(df, "f").collect()}
    all_rows = [dict(zip(names, r, strict=True)) for r in rows]
    assert set(got) == {"a", "b"}
    for speaker, r in got.items():
        own = [x for x in all_rows if x["speaker_id"] == speaker]
        sp = [x for x in own if x["talk_role"] == "primary" and x["talk_eligibility"] == "eligible"]
        si = [x for x in own if x["singing_role"] == "primary" and x["singing_eligibility"] == "eligible"]
        idn = [x for x in own if ({x["talk_role"], x["singing_role"]} & {"primary", "feature_only"}) and x["talk_eligibility"] != "excluded"]
        several = lambda part, name: len({x[name] for x in part} - {None})
        assert (r.speech_recordings, r.speech_utterances) == (several(sp, "source_id"), several(sp, "cache_key"))
        assert (r.singing_recordings, r.singing_phrases, r.identity_sources) == (several(si, "source_id"), several(si, "cache_key"), several(idn, "source_id"))
        assert r.phoneme_coverage == len({p for x in sp for p in x["phones"]}) and r.pitch_bins == len({b for x in si for b in x["bins"] or []})
        assert r.speech_eligible_seconds == sum(max(x["duration_sec"] or 0, 0) for x in sp) and r.transcript_usable == sum(not x["transcript_blank"] for x in sp)
