"""Operators on whole documents against brute force: exact, near, quality, mixing, packing."""

from collections import Counter, defaultdict
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

from rows import CLASHES, frame, given, same, with_clashes
from voxloom.llm import exact, mixing, packing, quality, simhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least(ids):
    ids = [i for i in ids if i is not None]
    return min(ids) if ids else None


@pytest.mark.parametrize("make", [frame, given])
@pytest.mark.parametrize("bits,capacity", [(64, 4096), (4, 3)])
def test_exact(spark, make, bits, capacity):
    docs = make(spark)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r.text or "").translate(UPPER)].append(r.doc_id)
    want = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(body.encode()).hexdigest()
        want += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    same(exact.resolve(docs, capacity, bits).collect(), want)


def test_exact_keeps_one_row_of_each_text(spark):
    docs = with_clashes(frame(spark))
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    got = [((r.text or "").translate(UPPER), r.doc_id) for r in kept.collect()]
    want = {}
    for r in docs.collect():
        body = (r.text or "").translate(UPPER)
        want[body] = max(want.get(body, -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted(got) == sorted(want.items())


def test_directory_doubles(spark):
    entries = spark.range(20000).select(F.xxhash64("id").alias("key"))
    slots, depth = exact.directory(entries, 300)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(1 << depth))
    sizes = Counter(r["bucket"] for r in entries.join(slots, F.shiftrightunsigned("key", 64 - depth) == F.col("slot")).select(F.struct("local_depth", "bucket").alias("bucket")).collect())
    assert sum(sizes.values()) == 20000 and max(sizes.values()) <= 300


def fp(text):
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values):
    """Component of each distinct value at three bits or fewer."""
    values = sorted(set(values))
    v = np.array(values, dtype=np.uint64)
    label = np.arange(len(v))
    close = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    while True:
        new = np.where(close, label[None, :], len(v)).min(axis=1)
        if (new == label).all():
            return dict(zip(values, label))
        label = new


@pytest.mark.parametrize("make", [frame, given])
def test_simhash(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, fp(r.text)) for r in docs.collect()]
    label = linked([f for _, f in rows])
    members = defaultdict(list)
    for i, f in rows:
        members[label[f]].append(i)
    same(simhash.report(docs).collect(), [(i, f"{f:016x}", least(members[label[f]])) for i, f in rows])


@pytest.mark.parametrize("largest", [2048, 3])
def test_simhash_links_of_dense_balls(spark, largest):
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(60):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            values.add(x)
    values |= {int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    fps = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "key long, fp long")
    got = simhash.groups(fps, largest=largest).collect()
    label, key_of = linked(values), {x: i for i, x in enumerate(signed)}
    lowest = defaultdict(lambda: 1 << 60)
    for x, g in label.items():
        lowest[g] = min(lowest[g], key_of[x - (1 << 64) if x >> 63 else x])
    assert {r.fp: r.component for r in got} == {(x - (1 << 64) if x >> 63 else x): lowest[g] for x, g in label.items()}


def test_simhash_keeps_one_of_each_group(spark):
    docs = with_clashes(frame(spark))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    label = linked([fp(r.text) for r in docs.collect()])
    assert Counter(label[fp(r.text)] for r in kept.collect()) == Counter(set(label.values()))


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    at = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at), len(lines)


def host_rule(rows):
    """(doc_id, ..., kept) by plain loops."""
    broken, n = defaultdict(Counter), Counter()
    measured = []
    for i, source, text in rows:
        m = measure(text)
        own = [m[0] < 50, 100 * m[4] > 50 * m[0], m[2] > m[0], 2 * m[3] > m[5], m[1] > 15 * m[0] or m[1] < 2 * m[0]]
        measured.append((i, source, m, own))
        n[source] += 1
        for k, x in enumerate(own):
            broken[source][k] += x
    refused = set()
    for k in range(5):
        rates = np.array([broken[s][k] / n[s] for s in n]) if n else np.zeros(1)
        mean, var = rates.mean(), rates.var()
        strength = min(max(mean * (1 - mean) / var - 1, 0), 1e6) if var > 1e-12 else 1e6
        refused |= {s for s in n if (broken[s][k] + mean * strength) / (n[s] + strength) > quality.HOST_LIMIT}
    return [(i, *m[:5], own[0] or own[1], not any(own) and s not in refused) for i, s, m, own in measured]


@pytest.mark.parametrize("make", [frame, given])
def test_quality(spark, make):
    docs = make(spark)
    want = host_rule([(r.doc_id, r.source, r.text) for r in docs.collect()])
    got = quality.report(docs)
    same(got.select(*got.columns[:8]).collect(), want)
    bad = with_clashes(docs)
    kept = quality.keep_good(bad)
    assert kept.columns == bad.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[-1])


def test_quality_refuses_a_bad_host(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "too short" if i % 10 else good, "en", "bad", 1) for i in range(200)]
    rows += [(1000 + i, good if i % 10 else "too short", "en", f"h{i % 7}", 1) for i in range(700)]
    out = {r.doc_id: r for r in quality.report(frame(spark, rows)).collect()}
    assert not out[0].kept and not out[0].base_failed and out[0].host_refused
    assert out[1001].kept and not out[1000].kept


def fill(sizes):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), list(names)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in free:
            target[s] += share[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        free = [s for s in free if target[s] < 2 * sizes[s]]
    return target


@pytest.mark.parametrize("make", [frame, given])
def test_mixing(spark, make):
    docs = make(spark)
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = fill(sizes)
    got = mixing.report(docs).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(i), str(s), n) for i, s, n in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 2.5 * min(mixing.BLOCK_WORDS, sizes[s])), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.report(docs.repartition(5)).collect())) or any(r.doc_id is None for r in got)


def test_mixing_emits_what_it_counts(spark):
    docs = with_clashes(given(spark))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counted = Counter()
    for r in out.collect():
        counted[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert counted == Counter({r.doc_id: r.taken for r in mixing.report(docs).collect() if r.taken})


def test_small_sources_among_many_shards(spark):
    """Every source gets its rounded share, whatever the number of shards, and no slot is left empty."""
    wanted = {0: 9001.4, 1: 0.8, **{r: 2.0 for r in range(2, 42)}, 42: 80.3, 43: 1000.0}
    plan = spark.createDataFrame([(r, 10000 if r == 0 else max(1, round(w / 2)), float(w)) for r, w in wanted.items()], "rank int, source_size long, target double")
    rows = mixing.block_uses(plan, block_words=1, shard_slots=8).collect()
    assert Counter(r["rank"] for r in rows) == {r: max(1, round(w)) for r, w in wanted.items()}
    assert len({(r["rank"], r.epoch, r.block) for r in rows}) == len(rows) and max(r.epoch for r in rows) == 1
    filled = defaultdict(set)
    for r in rows:
        filled[r.shard].add(r.slot)
    full, rest = divmod(len(rows), 8)
    assert full > 1000 and rest and sorted(filled) == list(range(full + 1))
    assert all(filled[k] == set(range(8 if k < full else rest)) for k in filled) and sum(map(len, filled.values())) == len(rows)
    held = Counter(r.shard for r in rows if r["rank"] == 0)
    assert all(abs(held[k] - 8 * 9001 / len(rows)) < 2 for k in range(full))


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_token_ids_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for df in (frame(spark), given(spark, "sf0.01")) for r in df.collect()]
    for text, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        assert packing.token_ids(text).tolist() == [*e.ids, 2]


@pytest.mark.parametrize("make", [frame, given])
def test_packing(spark, make):
    docs = make(spark)
    got = packing.report(with_clashes(docs)).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = []
    for r in docs.collect():
        ids = packing.token_ids(r.text)
        head = (len(ids) - 1) % 1024 + 1
        for k, s in enumerate([0, *range(head, len(ids), 1024)]):
            part = ids[s : s + (head if k == 0 else 1024)]
            want.append((r.doc_id, k, s, len(part), zlib.crc32(part.tobytes())))
    same([tuple(r)[:5] for r in got], want)
    total = sum(r.length for r in got)
    assert len(bins) <= 1.03 * total / 1024 + 2


def test_packing_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(4, 60))
        lengths = Counter(rng.integers(1, capacity + 1, int(rng.integers(1, 400))).tolist())
        made = packing.plan(dict(lengths), capacity)
        packed = Counter()
        for n, content in made:
            assert n > 0 and sum(x * y for x, y in content) <= capacity
            assert sum(y for x, y in content if x > capacity // 3) <= 2
            for x, y in content:
                packed[x] += n * y
        assert packed == lengths


def test_packed_sequences(spark):
    docs = given(spark)
    ids = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(docs).collect()}
    for r in packing.report(docs).collect():
        assert zlib.crc32(ids[r.sequence_id][r.offset : r.offset + r.length].tobytes()) == r.ids_crc32


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (exact.resolve, exact.keep_one, simhash.report, simhash.keep_one, quality.report, quality.keep_good, mixing.report, mixing.mix, packing.report):
        assert f(none).count() == 0
