"""URL filters: rules by host and path, and a list of any size held in a cascade of Bloom filters.

Level 0 encodes the listed keys; level 1 the unlisted keys of the corpus that level 0 lets through;
level 2 the listed keys that level 1 lets through; and so on until a level lets nothing wrong through.
The first level that stops a key tells what it is, exactly, for every key of the corpus. Levels are
small (about 1.4 bits a key and level), so pages are judged where they are, without a join.

Keys are a page's host and its address (host and path). All keys of the pages, listed or not, meet in
one aggregation with partial sums, so a host with a third of all pages is one row per task there. Keys
are dealt by hash into slices of about ``SLICE_KEYS``, and a task builds the cascade of a slice. The
slices are broadcast in waves of at most ``WAVE_BYTES``: the driver and the executors hold one wave
at a time, whatever the length of the list.

A null url, or one without ``://``, has an empty host and path; no rule fits and no key is listed. A
null in the list is ignored. Repeated rows are judged alike. Of rules that fit, the longest wins (of
equal length the one with the longer host). Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.llm.common import ascii_lower, stored
from voxloom.session import ship_package

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SLICE_KEYS = 1 << 18
#: Filters of a wave; one slice is at most a third of a megabyte (see ``build``).
WAVE_BYTES = 32 << 20
_LEVELS = 200


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is none."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def keys_of(host: Column, path: Column) -> Column:
    """The keys under which a page can be listed: host and address."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(host, F.concat(host, path))))


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Filter:
    """One Bloom filter over 128-bit digests (rows of two unsigned longs)."""

    n_bits: int
    n_hashes: int
    salt: int
    bits: np.ndarray

    @classmethod
    def over(cls, keys: np.ndarray, rate: float, salt: int) -> Filter:
        n_bits = -(-max(64, int(np.ceil(len(keys) * -np.log(rate) / np.log(2) ** 2))) // 8) * 8
        made = cls(n_bits, max(1, round(-np.log2(rate))), salt, np.zeros(n_bits // 8, dtype=np.uint8))
        for at in made.places(keys):
            np.bitwise_or.at(made.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return made

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        first, step = _spread(keys[:, 0], self.salt), _spread(keys[:, 1], self.salt) | np.uint64(1)
        for i in range(self.n_hashes):
            yield (first + np.uint64(i) * step) % np.uint64(self.n_bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self.places(keys):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return found


def build(listed: np.ndarray, others: np.ndarray) -> list[Filter]:
    """Levels for two disjoint sets of digests, none if nothing is listed.

    The first level's rate of false positives leaves about as many others as are listed, over the
    root of two; all further levels have one half, so that each is about half as long as the last.
    The whole takes about 1.44 log2(others / listed) + 4 bits for each listed key.
    """
    levels: list[Filter] = []
    inside, outside = listed, others
    rate = min(0.5, len(listed) / max(1, len(others)) * 0.5**0.5)
    while len(inside):
        if len(levels) == _LEVELS:
            raise ValueError("a listed and an unlisted key have the same 128-bit digest")
        levels.append(Filter.over(inside, rate, len(levels)))
        inside, outside, rate = outside[levels[-1].holds(outside)], inside, 0.5
    return levels


def listed(levels: list[Filter], keys: np.ndarray) -> np.ndarray:
    """Which keys are listed: the level that stops a key says so by its number."""
    out = np.full(len(keys), len(levels) % 2 == 1, dtype=bool)
    left = np.arange(len(keys))
    for n, level in enumerate(levels):
        passed = level.holds(keys[left])
        out[left[~passed]] = n % 2 == 1
        left = left[passed]
    return out


def _digests(column: pa.Array) -> np.ndarray:
    """Rows of two unsigned longs: the first 16 bytes of SHA-256."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 4)[:, :2]


def universe(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, listed): every key of the pages and of the list, once; stored."""
    seen = pages.select(F.explode(keys_of(F.col("host"), F.col("path"))).alias("key"), F.lit(False).alias("listed"))
    named = keys.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("listed")).where("key is not null and key <> ''")
    return stored(seen.unionByName(named).groupBy("key").agg(F.max("listed").alias("listed")))


def cascade(keys: DataFrame, slice_keys: int = SLICE_KEYS) -> tuple[DataFrame, int]:
    """The stored cascade (slice, level, n_bits, n_hashes, bits), and the number of slices."""
    ship_package(keys.sparkSession)
    slices = max(1, -(-keys.count() // slice_keys))

    def one(number: int, digests: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        made = build(digests[marks], digests[~marks])
        columns = [[number] * len(made), list(range(len(made))), [f.n_bits for f in made], [f.n_hashes for f in made], [f.bits.tobytes() for f in made]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "level", "n_bits", "n_hashes", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for b in batches:
            number, digests, marks = b.column(0).to_numpy(), _digests(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(number):  # rows come sorted by slice
                if s != now and held:
                    yield one(now, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                now = int(s)
                held.append((digests[number == s], marks[number == s]))
        if held:
            yield one(now, *map(np.concatenate, zip(*held, strict=True)))

    dealt = keys.select(_slice(F.col("key"), slices).alias("slice"), _digest(F.col("key")).alias("digest"), "listed").repartition("slice").sortWithinPartitions("slice")
    return stored(dealt.mapInArrow(run, "slice int, level int, n_bits bigint, n_hashes int, bits binary")), slices


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(key, 256))


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")


def _waves(filters: DataFrame, slices: int, wave_bytes: int) -> list[tuple[int, int]]:
    """Ranges of slices whose filters take ``wave_bytes`` at most (one slice at least)."""
    top = filters.groupBy("slice").agg(F.sum(F.length("bits")).alias("n")).agg(F.max("n")).first()[0] or 1
    step = max(1, wave_bytes // top)
    return [(a, min(a + step, slices)) for a in range(0, slices, step)]


def judged(rows: DataFrame, filters: DataFrame, slices: int, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``rows`` with (host, path) and one more column ``listed``: is the host or the address listed?

    Exact for keys of the universe. Each wave of filters passes over the rows once; between waves the
    rows are stored, so that a wave is forgotten before the next is broadcast.
    """
    spark = rows.sparkSession
    ship_package(spark)
    keys = keys_of(F.col("host"), F.col("path"))
    asked = F.transform(keys, lambda k: F.struct(_slice(k, slices).alias("s"), _digest(k).alias("d")))
    columns = rows.columns
    rows = rows.select(*columns, F.lit(False).alias("listed"))
    waves = _waves(filters, slices, wave_bytes)
    for a, b in waves:
        found: dict[int, list[Filter]] = {}
        for r in filters.where(F.col("slice").between(a, b - 1)).orderBy("slice", "level").collect():  # at most WAVE_BYTES
            found.setdefault(r["slice"], []).append(Filter(r["n_bits"], r["n_hashes"], r["level"], np.frombuffer(r["bits"], dtype=np.uint8)))
        sent = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, old = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                owner, number = lists.value_parent_indices().to_numpy(), flat.field("s").to_numpy()
                hit, digests = old.copy(), _digests(flat.field("d"))
                for s in np.unique(number):
                    if int(s) in sent.value:
                        at = np.flatnonzero(number == s)
                        hit[owner[at[listed(sent.value[int(s)], digests[at])]]] = True
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(hit)], names=[*columns, "listed"])

        rows = rows.select(*columns, "listed", asked.alias("asked")).mapInArrow(run, rows.schema)
        if (a, b) != waves[-1]:
            rows = stored(rows)
    return rows


def verdicts(pages: DataFrame, keys: DataFrame, rules=RULES, slice_keys: int = SLICE_KEYS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``keys`` has a column ``key``: hosts, or addresses (host and path). A rule's verdict counts; without
    a rule a listed page is blocked, any other allowed.
    """
    host, path = parts(F.col("url"))
    rows = stored(pages.select("page_id", host.alias("host"), path.alias("path")))
    filters, slices = cascade(universe(rows, keys), slice_keys)
    rule = ruled(F.col("host"), F.col("path"), rules)
    seen = judged(rows, filters, slices, wave_bytes).withColumn("fit", rule)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return seen.select("page_id", "host", "path", F.col("fit")["rule"].alias("rule"), F.coalesce(F.col("fit")["verdict"], own).alias("verdict"), "listed")


def junk_list(pages: DataFrame) -> DataFrame:
    """(key): the list that the pages themselves give.

    A page is junk if its title holds three of ``%*#`` in a row. Its address is listed, and so is a
    host of which at least half of the pages are junk. Partial sums by host: no host is a burden.
    """
    host, path = parts(F.col("url"))
    junk = F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)</title>", 1).rlike(r"%%%|\*\*\*|###")
    rows = pages.select(host.alias("host"), path.alias("path"), junk.alias("junk")).where("host <> ''")
    hosts = rows.groupBy("host").agg(F.avg(F.col("junk").cast("int")).alias("share")).where("share >= 0.5").select(F.col("host").alias("key"))
    return rows.where("junk").select(F.concat("host", "path").alias("key")).unionByName(hosts).distinct()
