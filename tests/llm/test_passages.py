"""Repeated passages against brute force: 50 bytes and 13 words."""

import hashlib
import random
import re

import numpy as np
import pytest

from rows import frame, given, same, with_clashes
from voxloom.llm import recompression, repeats, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(rows, window):
    """rows: (id, sequence). Which units lie in a window that starts in a row with a smaller id."""
    order = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, s in rows:
        for k in range(len(s) - window + 1):
            w = s[k : k + window]
            first[w] = min(first.get(w, order(i)), order(i))
    for i, s in rows:
        mark = [False] * len(s)
        for k in range(len(s) - window + 1):
            if first[s[k : k + window]] < order(i):
                mark[k : k + window] = [True] * window
        yield i, s, mark


def by_bytes(rows):
    for i, s, mark in covered([(i, (t or "").encode()) for i, t in rows], 50):
        kept = bytes(b for b, m in zip(s, mark) if not m)
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        yield i, len(s), sum(mark), spans, hashlib.sha256(kept).hexdigest()


def by_words(rows):
    for i, s, mark in covered([(i, tuple(WORD.findall(t or ""))) for i, t in rows], 13):
        kept = " ".join(w for w, m in zip(s, mark) if not m)
        yield i, len(s), sum(mark), hashlib.sha256(kept.encode()).hexdigest()


def shuffled_passages():
    """Few words, so that runs, periods and chance repeats abound, with passages cut out of one another."""
    rng = random.Random(5)
    texts = []
    for i in range(120):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split(" ")
            a = rng.randrange(len(w))
            w = w[a : a + rng.randrange(1, 60)]
        else:
            w = []
        vocabulary = rng.choice([["a"], ["a", "b"], [f"word{k}" for k in range(40)], [f"w{k}" for k in range(400)]])
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40))] + w + [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        texts.append(rng.choice([" ", " ", "\n"]).join(w))
    return [(rng.randrange(90) if i % 7 else None, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("make", [frame, given, lambda s: frame(s, shuffled_passages())])
@pytest.mark.parametrize("size", [3000, 1 << 21])
def test_passages(spark, make, size, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", size)
    docs = with_clashes(make(spark)) if size > 3000 else make(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same(suffixes.dedup(docs).collect(), by_bytes(rows))
    same(recompression.dedup(docs).collect(), by_words(rows))


def test_kept_bytes_are_given(spark):
    docs = given(spark)
    for r in suffixes.dedup(docs, with_kept=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    for r in recompression.dedup(docs, with_kept=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_symbols_inside_equal_windows_are_equal():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 30, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.zeros(len(words), dtype=np.int32)
    anchors = recompression._anchors(words, doc, repeats.Rolling(words))
    copy = np.r_[rng.integers(0, 30, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), words[100:3000], words[7:50]]
    again = recompression._anchors(copy, np.zeros(len(copy), dtype=np.int32), repeats.Rolling(copy))
    assert (again[500 : 500 + 2900 - 12] == anchors[100 : 3000 - 12]).all()


def test_empty_table(spark):
    assert suffixes.dedup(frame(spark, [])).count() == 0 and recompression.dedup(frame(spark, [])).count() == 0
