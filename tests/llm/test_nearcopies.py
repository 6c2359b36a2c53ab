"""Near copies against all pairs: what goes, what stays, whatever the size of a group."""

import random

import numpy as np
import pytest
from rows import frame, given, with_clashes
from voxloom.llm import nearcopies


def pairs_of(rows, similarity=0.8):
    sets = [(k, nearcopies.shingles(t, 5)) for k, t in rows]
    return [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if nearcopies.alike(x, y) >= similarity]


def planted(groups, size, words=120, block=False):
    """Groups of copies with a few words changed, far apart or in one block, and texts of their own."""
    rng = random.Random(groups * size)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            copy, at = list(base), rng.randrange(words - 4)
            for k in range(4 if block else 1):
                copy[at + k if block else rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(200)]
    return [(i, t, "en", "s", 1) for i, t in enumerate(rows)]


def check(docs, recall):
    rows = [(i, r.text) for i, r in enumerate(docs.collect())]
    out = nearcopies.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    texts = {}
    for r in kept:
        texts[r.text] = texts.get(r.text, 0) + 1
    stays = set()
    for i, t in rows:
        if texts.get(t, 0) > 0:
            texts[t] -= 1
            stays.add(i)
    assert len(stays) == len(kept)
    close = pairs_of(rows)
    both = [p for p in close if p[0] in stays and p[1] in stays]
    assert len(both) <= (1 - recall) * len(close)
    partner = {x for p in close for x in p}
    assert all(i in stays or i in partner for i, _ in rows)  # nothing goes without a near copy
    return len(rows), len(kept)


def test_given_documents(spark):
    check(given(spark), 0.95)


@pytest.mark.parametrize("block", [False, True])
def test_planted_copies(spark, block):
    n, kept = check(frame(spark, planted(60, 4, block=block)), 0.9)
    assert kept < n - 20


def test_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SMALL", 8)
    n, kept = check(frame(spark, planted(1, 400)), 0.98)
    assert kept <= 200 + 20


def test_odd_rows(spark):
    docs = with_clashes(frame(spark))
    n, kept = check(docs, 1.0)
    assert sum(not (r.text or "").split() for r in nearcopies.keep_one(docs).collect()) == 1  # blank texts are alike
    assert nearcopies.keep_one(frame(spark, [])).count() == 0
    same = nearcopies.keep_one(frame(spark, [(None, "a b c", "en", "s", 1), (4, "A  B c", "en", "s", 1), (2, "a\nb c", "en", "s", 1)])).collect()
    assert [r.doc_id for r in same] == [2]


def test_shape_grows_slowly():
    for n in (0, 1, 1000, 10**6, 10**10):
        width, segments = nearcopies.shape(n)
        p = 0.1515
        assert 2**width >= n and 1 - (1 - (1 - p) ** width - width * p * (1 - p) ** (width - 1)) ** segments > 0.949


def test_leaders_cover_all():
    rng = np.random.default_rng(2)
    check_words = rng.integers(0, 2**63, 500, dtype=np.uint64)
    check_words[100:] = check_words[0] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    pairs, leaders = nearcopies._led(np.arange(500), check_words)
    linked = {tuple(p) for x in pairs for p in x.tolist()}
    assert len(leaders) == 100 and all((0, i) in linked for i in range(100, 500))


def test_followers_are_in_one_pair():
    rng = np.random.default_rng(3)
    sketches = np.full(600, 0x0123456789ABCDEF, dtype=np.uint64)
    for i in range(600):  # 9 to 2 bits off one centre, so up to 18 off each other
        for bit in rng.choice(64, 9 - i % 8, replace=False):
            sketches[i] ^= np.uint64(1) << np.uint64(bit)
    pairs, leaders = nearcopies._led(np.arange(600), sketches)
    linked = np.concatenate([p for p in pairs if len(p)])
    linked = linked[linked[:, 0] != linked[:, 1]]
    assert len(linked) == 600 - len(leaders) == len(np.unique(linked[:, 1]))


def meetings(fps, width, segments):
    """All pairs that differ in at most one bit of a segment and pass the sketch, by looking at all pairs."""
    words = np.stack([np.frombuffer(f, dtype="<u8") for f in fps])
    bits = np.unpackbits(np.ascontiguousarray(words[:, nearcopies.SKETCH:]).view(np.uint8), axis=1, bitorder="little")[:, : width * segments].reshape(len(fps), segments, width)
    found = set()
    for i in range(len(fps) - 1):
        meets = ((bits[i + 1 :] != bits[i]).sum(axis=2) <= 1).any(axis=1)
        close = nearcopies._apart(words[i + 1 :, : nearcopies.SKETCH], words[i, : nearcopies.SKETCH]) <= nearcopies.LOOSE
        found |= {(i, i + 1 + int(j)) for j in np.flatnonzero(meets & close)}
    return found


def test_no_meeting_is_left_out(spark, monkeypatch):
    """Each pair that meets is a candidate, or both its documents meet again; without leaders all are candidates."""
    rng, (width, segments) = np.random.default_rng(5), nearcopies.shape(500)
    longs = -(-width * segments // 64)
    base, fps = rng.integers(0, 2**63, nearcopies.SKETCH + longs, dtype=np.uint64), []
    for i in range(500):
        made = base.copy() if i < 300 else rng.integers(0, 2**63, len(base), dtype=np.uint64)
        for bit in rng.choice(64 * nearcopies.SKETCH, 3 + i % 18, replace=False):
            made[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        for bit in rng.choice(64 * longs, 30, replace=False):
            made[nearcopies.SKETCH + bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        fps.append(made.tobytes())
    want = meetings(fps, width, segments)
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(fps)], "node bigint, fp binary").repartition(4)
    found = {tuple(r) for r in nearcopies.candidates(df, width, segments).collect()}
    marked = {a for a, b in found if a == b}
    left_out = [p for p in want - found if not set(p) <= marked]
    assert len(want - found) > 1000 and not left_out
    for cell in (nearcopies.CELL, 50):  # whole variants, and variants cut into cells
        monkeypatch.setattr(nearcopies, "CELL", cell)
        assert {tuple(r) for r in nearcopies.all_candidates(df, width, segments).collect()} == want


def test_no_near_pair_that_meets_stays(spark):
    """A crowd of texts about as far from each other as the bound: what leaders leave out is compared in the end."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    kinds = [[f"x{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in base] for _ in range(60)]
    rows = []
    for i in range(420):
        copy = list(kinds[i % 60])
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en", "s", 1))
    width, segments = nearcopies.shape(len(rows))
    longs = -(-width * segments // 64)
    met = meetings([nearcopies.sketch(r[1]).tobytes() + nearcopies.fingerprint(r[1], longs).tobytes() for r in rows], width, segments)
    sets = [nearcopies.shingles(r[1], 5) for r in rows]
    stays = {r.doc_id for r in nearcopies.keep_one(frame(spark, rows)).collect()}
    assert stays and not [p for p in met if set(p) <= stays and nearcopies.alike(sets[p[0]], sets[p[1]]) >= 0.8]
