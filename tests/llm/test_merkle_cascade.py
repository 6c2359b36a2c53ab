"""Merkle manifest and URL filters: odd rows, several rounds, several slices, against plain definitions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import frame, odd_rows, same, with_clashes
from voxloom.llm import cascade, merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def rise(level):
    """Root, and for each leaf its siblings as (left?, digest or None)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            o = p ^ 1
            paths[i].append((o < p, level[o] if o < len(level) else None))
            at[i] = p // 2
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def brute(rows):
    langs, found, out = {}, {}, []
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in order:
        found[x] = rise([h for _, _, h, _ in sorted(langs[x], key=lambda t: t[:3])])
    root, tops = rise([found[x][0] for x in order])
    for x, top in zip(order, tops, strict=True):
        for (_, _, h, r), path in zip(sorted(langs[x], key=lambda t: t[:3]), found[x][1], strict=True):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, 1) if hit else h
            for before, other in path + top:
                fold = sha(*([fold] if other is None else [other, fold] if before else [fold, other]))
            out.append((r[0], h, found[x][0], root, sha(*[o for _, o in path + top if o]), fold, fold == root))
    return out


def test_manifest_of_odd_rows(spark):
    got = merkle.report(with_clashes(frame(spark).drop("doc_id").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(got) == len(odd_rows()) and all(r.verified for r in got)
    same(merkle.report(frame(spark)).collect(), brute(odd_rows()))
    assert merkle.report(frame(spark, [])).count() == 0


def test_manifest_over_several_rounds(spark):
    # 257 and 4097 leaves end on a lone node; one language holds nearly all rows; one has a single row.
    rows = [(i, f"text {i}", "big", None, i % 5) for i in range(4097)] + [(i, "t", "mid", "s", None) for i in range(257)] + [(5, "x", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle.report(df).collect()
    same(got, brute(rows))
    assert {r.verified for r in got} == {True, False}


def test_proofs_of_the_manifest_fold_to_the_root(spark):
    rows = merkle.manifest(frame(spark)).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert rows and all(r.back == r.root for r in rows)


def digests(values):
    return np.frombuffer(b"".join(hashlib.sha256(str(v).encode()).digest() for v in values), dtype="<u8").reshape(-1, 4)[:, :2]


@pytest.mark.parametrize("n", [0, 1, 7, 500, 5000])
def test_cascade_is_exact(n):
    inside, outside = digests(range(n)), digests(range(n, 5000))
    levels = cascade.build(inside, outside)
    assert cascade.listed(levels, inside).all() and not cascade.listed(levels, outside).any()
    assert sum(f.n_bits for f in levels) < 20 * min(n, 5000) + 64 * (len(levels) + 1) + 8


PAGES = [
    (1, "http://A.Net/x"), (2, "https://example.net/en/"), (3, "http://m.Example.NET/en/1?q=://b"), (4, "http://example.net"), (5, "ftp://example.com/de/#top"),
    (6, "http://notexample.com/de/"), (7, "http://x.org/fr/"), (8, "http://org/fr"), (9, None), (10, "no scheme"), (11, "://h.test/p?x"), (11, "://h.test/p?x"),
    (None, "http://"), (12, "http://é.test/ü#"), (13, "http://spam.test/any"), (14, "http://h.test/other"), (15, "http://h.test?p=/"), (16, "http://h.test#://"),
] + [(100 + i, f"http://host{i % 9}.test/page/{i}") for i in range(300)]


def judged(rows, listed):
    def one(page_id, url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end : min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
        hit = bool(host) and (host in listed or host + path in listed)
        fits = [(len(h + p), h + p, v) for v, h, p in cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if hit else "allow")
        return page_id, host, path, rule, verdict, hit

    return [one(*r) for r in rows]


@pytest.mark.parametrize(("slice_keys", "wave_bytes"), [(1 << 18, 1 << 20), (16, 64)])
def test_url_verdicts(spark, slice_keys, wave_bytes):
    names = ["spam.test", "h.test/p", "not.seen", "a.net/x", "", None, *[f"host{i % 9}.test/page/{i}" for i in range(0, 300, 7)]]
    pages = spark.createDataFrame(PAGES, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "listed", "rule", "key", "slice")})
    keys = spark.createDataFrame([(n,) for n in names], "key string")
    got = cascade.verdicts(pages.repartition(4), keys, slice_keys=slice_keys, wave_bytes=wave_bytes)
    same(got.collect(), judged(PAGES, {n for n in names if n}))


def test_empty_list_and_empty_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    same(cascade.verdicts(pages, none).collect(), judged(PAGES, set()))
    assert cascade.verdicts(pages.limit(0), none).count() == 0
    empty = spark.createDataFrame([(None, None)], "url string, html string")
    assert cascade.junk_list(empty).count() == 0
