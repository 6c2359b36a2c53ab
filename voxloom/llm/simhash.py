"""SimHash near-deduplication by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in three bits or fewer have, of two halves, one that
differs in at most one bit. So each half is indexed under every variant with one bit wiped out
(64 signatures a fingerprint), equal signatures meet, and each meeting is verified. A signature that
too many fingerprints share is refined: the half it does not cover is cut again in the same way,
until at most ``LARGEST`` can share one. Copies share one fingerprint and enter once.

Inside a signature only the links of a spanning forest leave the task, never a list of pairs. Groups
over the whole corpus come from star contraction, a few shuffles over the remaining links.

Null and blank texts have fingerprint zero and are linked like any other. A null ``doc_id`` counts
as larger than all others. Repeated rows are returned as often as they come. Empty tables give empty
tables; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from voxloom.llm.common import fresh, stored
from voxloom.session import ship_package

DISTANCE = 3
#: Fingerprints of one signature that are compared in one task; three refinements leave 2048 at most.
LARGEST = 2048
_BLOCK = 1 << 14


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the XXH64 values (seed 42) of all shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) > words else [b" ".join(w)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), _BLOCK):
        bits = np.unpackbits(hashed[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp) with the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"key {kind}, fp bigint")


def signatures(rows: DataFrame) -> DataFrame:
    """From (sig, fp, rest, width) to the signatures of the next level, ``width`` of them a row."""
    half = "(width div 2)"
    return rows.selectExpr(
        "sig", "fp", "width", f"explode(transform(sequence(0, width - 1), k -> named_struct('s', k div {half}, 'b', k % {half}))) as v", "rest"
    ).selectExpr(
        "sig", "fp", "v", f"cast(width div 2 as int) as width", f"shiftrightunsigned(rest, v.s * {half}) & (shiftleft(1L, {half}) - 1) as part",
        f"shiftrightunsigned(rest, (1 - v.s) * {half}) & (shiftleft(1L, {half}) - 1) as rest",
    ).selectExpr("xxhash64(sig, v.s, v.b, width, part & ~shiftleft(1L, v.b)) as sig", "fp", "rest", "width")


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked, by steps, among a few different fingerprints."""
    n, bits = len(fp), fp.view(np.uint64)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 256):
            close = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= distance
            new[at : at + 256] = np.where(close, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(n)
    return fp[label[off]], fp[off]


def _meet(distance: int, largest: int):
    """Over rows sorted by signature: verified links, and the rows of signatures that are too full."""

    def group(sig: int, fp: np.ndarray, out: list) -> None:
        fp = np.unique(fp)
        if len(fp) > 1:
            out.append(_forest(fp, distance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the signature that may go on in the next batch
        for b in batches:
            sig, fp, rest, width = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if held:
                sig, fp, rest, width = (np.concatenate([h[i] for h in held] + [x]) for i, x in enumerate((sig, fp, rest, width)))
            cut = len(sig) if not len(sig) else np.searchsorted(sig, sig[-1])
            yield from pairs(sig[:cut], fp[:cut], rest[:cut], width[:cut])
            held = [(sig[cut:], fp[cut:], rest[cut:], width[cut:])]
            if len(held[0][0]) > largest:  # full for certain: pass on what is there, keep enough to stay full
                full = held[0]
                yield table(full[0], full[1], full[1], full[2], full[3], True)
                held = [tuple(x[: largest + 1] for x in full)]
        if held:
            yield from pairs(*held[0])

    def table(sig, lo, hi, rest, width, full) -> pa.RecordBatch:
        n = len(lo)
        return pa.RecordBatch.from_arrays(
            [pa.array(sig, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(rest, pa.int64()), pa.array(width, pa.int32()), pa.array(np.full(n, full))],
            ["sig", "lo", "hi", "rest", "width", "full"],
        )

    def pairs(sig, fp, rest, width) -> Iterator[pa.RecordBatch]:
        if not len(sig):
            return
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (a != b)
        lo, hi = [np.minimum(a, b)[near]], [np.maximum(a, b)[near]]
        fulls = []
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if n > largest:
                fulls.append(np.arange(s, s + n))
                continue
            out: list = []
            group(sig[s], fp[s : s + n], out)
            for x, y in out:
                lo.append(np.minimum(x, y))
                hi.append(np.maximum(x, y))
        lo_all, hi_all = np.concatenate(lo), np.concatenate(hi)
        if len(lo_all):
            zero = np.zeros(len(lo_all), dtype=np.int64)
            yield table(zero, lo_all, hi_all, zero, zero.astype(np.int32), False)
        if fulls:
            at = np.concatenate(fulls)
            yield table(sig[at], fp[at], fp[at], rest[at], width[at], True)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, largest: int = LARGEST) -> DataFrame:
    """Links (lo, hi) between different fingerprints, enough to join all that are within
    ``distance`` (3 at most) of each other by steps. ``fps`` has distinct longs in ``fp``."""
    level = fps.selectExpr("0L as sig", "fp", "fp as rest", "64 as width")
    found = None
    while True:
        rows = signatures(level).repartition("sig").sortWithinPartitions("sig")
        met = stored(rows.mapInArrow(_meet(distance, largest), "sig bigint, lo bigint, hi bigint, rest bigint, width int, full boolean"))
        pairs = met.where("not full").select("lo", "hi")
        found = pairs if found is None else found.unionByName(pairs)
        level = met.where("full").select("sig", F.col("lo").alias("fp"), "rest", "width").distinct()
        if level.isEmpty():
            return found.distinct()
        if level.where("width <= 8").limit(1).count():
            largest = 1 << 62  # eleven bits are left: 2048 fingerprints at most


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (lo, hi).

    Alternates the two star steps: larger neighbours move to the smallest neighbour, then smaller
    ones do, until nothing changes. Each round is one stored table; only its count and checksum
    come to the driver.
    """
    edges = stored(edges.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())

    def mark(t: DataFrame):
        return tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())

    seen = mark(edges)
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.join(least, "u").where("v > u and v > m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(down, "hi")
        edges = stored(moved.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo < hi").distinct())
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
        seen = now


def groups(fps: DataFrame, distance: int = DISTANCE, largest: int = LARGEST) -> DataFrame:
    """From stored rows (key, fp) to (fp, component): the smallest key of all linked fingerprints."""
    distinct = stored(fps.groupBy("fp").agg(F.min("key").alias("least")))
    member = components(links(distinct.select("fp"), distance, largest)).select(F.col("node").alias("fp"), "root")
    member = stored(distinct.join(member, "fp"))
    best = member.groupBy("root").agg(F.min("least").alias("component"))
    found = member.join(best, "root").select("fp", "component")
    return stored(distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    fps = stored(fingerprints(docs))
    return fps.join(groups(fps), "fp").select(F.col("key").alias("doc_id"), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest ``doc_id`` (of equal ids, one row)."""
    uid = fresh(docs, "uid")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()))
    ids = rows.select(uid, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(uid).alias("u")).alias("key"), F.col("text"))
    fps = stored(fingerprints(ids, uid))
    keyed = stored(fps.join(ids.select(F.col(uid).alias("key0"), F.col("key").alias("order")), F.col("key") == F.col("key0")).select(F.col("order").alias("key"), "fp"))
    stay = groups(keyed).select(F.col("component")["u"].alias(uid)).distinct()
    # The list grows with the corpus: one plan at every size, a sort-merge join, never a broadcast.
    return rows.join(stored(stay).hint("merge"), uid, "left_semi").select(*docs.columns)
