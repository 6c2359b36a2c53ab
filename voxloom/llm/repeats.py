"""Passages that an earlier document already holds: the exchange behind suffix-array and substring dedup.

Both operators ask, for every window of W units (50 bytes, 13 words), whether the same window starts in
a document with a smaller ``doc_id``. Sending every window through a shuffle would move many times
the corpus. Instead:

1. Documents are packed into chunks of about ``CHUNK_BYTES``, stored once in a bucketed table, so that
   later joins by chunk do not move the texts.
2. Every window picks an *anchor* inside itself by its content alone. Neighbouring windows with the same
   anchor form a *run*. A chunk sends, for each anchor, a short hash and a hash of the run's whole
   content (or a mark that its runs differ), once, however often it occurs: a passage in a third of
   all documents is one entry per chunk. Owners of key ranges answer only for anchors that another
   chunk has too: either all runs are alike, then the smallest document is the answer for all their
   windows, or runs differ.
3. Only for anchors whose runs differ, windows themselves are sent (96 bits each, once per chunk) and
   answered with the smallest document.
4. Each chunk marks its windows and writes out its documents.

No task holds more than one chunk, or the entries of one key range (about ``ENTRIES``); the number of
ranges grows with the corpus. No window is skipped and no candidate list is cut.

A null ``doc_id`` sorts below all others; rows with equal ids are not earlier than one another. Null
text is empty. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
import zstandard

from voxloom.llm.common import stored
from voxloom.session import ship_package

CHUNK_BYTES = 2 << 20
ENTRIES = 1 << 20
NULL_ID = np.iinfo(np.int64).min
NEVER = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFFFFF)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base = int(_BASES[which])
        make = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            make.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (make[0], make[1])
    return have


class Rolling:
    """Polynomial hashes of any stretch of a sequence of unsigned 64-bit units."""

    def __init__(self, units: np.ndarray, which: int = 0):
        self.up, self.down = _powers(which, max(len(units) + 1, CHUNK_BYTES * 5 // 4))
        self.sums = np.zeros(len(units) + 1, dtype=np.uint64)
        np.cumsum(units * self.up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return mix(raw + np.uint64(0x632BE59BD9B4E019) * np.asarray(length).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


@dataclass
class Chunk:
    ids: np.ndarray  # of documents
    data: bytes
    lens: np.ndarray  # bytes of each document
    units: np.ndarray
    counts: np.ndarray  # units of each document
    extra: tuple = ()

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)


#: From (bytes, byte lengths) to (units, units per document, extra); and from (units, document of each
#: unit, rolling hash) to one anchor per window start.
Units = Callable[[np.ndarray, np.ndarray], tuple]
Anchors = Callable[[np.ndarray, np.ndarray, Rolling], np.ndarray]


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _restore(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _planes(a: np.ndarray, width: int | None = None) -> bytes:
    """The bytes of an array, those of equal weight together (they compress better)."""
    raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize)
    return raw[:, : width or a.dtype.itemsize].T.tobytes()


def _unplanes(b: bytes, n: int, dtype, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    out = np.zeros((n, size), dtype=np.uint8)
    out[:, : width or size] = np.frombuffer(b, dtype=np.uint8).reshape(width or size, n).T
    return out.reshape(-1).view(dtype)


def _blob(*parts: tuple[np.ndarray, int]) -> bytes:
    """Equally long arrays, with the bytes to keep of each value."""
    return _squeeze(np.uint32(len(parts[0][0])).tobytes() + b"".join(_planes(a, w) for a, w in parts))


def _unblob(blob: bytes, *kinds: tuple) -> list[np.ndarray]:
    raw = _restore(blob)
    n, at, out = int(np.frombuffer(raw[:4], dtype=np.uint32)[0]), 4, []
    for dtype, width in kinds:
        out.append(_unplanes(raw[at : at + n * width], n, dtype, width))
        at += n * width
    return out


def chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """(chunk, ids, lens, data, n_bytes), bucketed by chunk."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = b"".join(texts)
            row = [(part << 32) + n, np.array(ids, dtype=np.int64).tobytes(), np.array([len(t) for t in texts], dtype=np.int64).tobytes(), _squeeze(data), len(data)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["chunk", "ids", "lens", "data", "n_bytes"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(NULL_ID if i.as_py() is None else i.as_py())
                texts.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    yield flush()
                    n, size = n + 1, 0
                    ids.clear()
                    texts.clear()
        if ids:
            yield flush()

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "chunk bigint, ids binary, lens binary, data binary, n_bytes bigint")
    return stored(made, (buckets, "chunk"))


class Passages:
    """One kind of window: how texts become units, how windows pick anchors, how long they are."""

    def __init__(self, units: Units, anchors: Anchors, window: int, report: Callable, schema: str):
        self.units, self.anchors, self.window, self.report, self.schema = units, anchors, window, report, schema

    # ---- inside one chunk

    def read(self, ids: bytes, lens: bytes, data: bytes) -> Chunk:
        raw, sizes = _restore(data), np.frombuffer(lens, dtype=np.int64)
        units, counts, extra = self.units(np.frombuffer(raw, dtype=np.uint8), sizes)
        return Chunk(np.frombuffer(ids, dtype=np.int64), raw, sizes, units, counts, extra)

    def runs(self, c: Chunk):
        """Runs of windows: first start, last start, key of the anchor, hash of the content, document."""
        doc, w = c.doc, self.window
        n = len(c.units) - w + 1
        none = np.zeros(0, dtype=np.int64)
        if n <= 0:
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none, None
        roll = Rolling(c.units)
        anchor = self.anchors(c.units, doc, roll)
        at = np.flatnonzero(doc[:n] == doc[w - 1 :])
        if not len(at):
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none, roll
        a, d = anchor[at], doc[at]
        new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]
        first = np.flatnonzero(new)
        s, e = at[first], at[np.r_[first[1:] - 1, len(at) - 1]]
        content = roll.of(s, e - s + w)
        return s, e, a[first], content, d[first].astype(np.int64), roll

    def entries(self, c: Chunk, parts: int):
        """One entry per anchor key: key, content (0: several), smallest document; the entry of each run."""
        s, e, h, content, d, roll = self.runs(c)
        key = ((h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (h & _LOW)
        order = np.argsort(key, kind="stable")
        if not len(order):
            zero = np.zeros(0, dtype=np.uint64)
            return s, e, d, roll, order, zero, zero, np.zeros(0, dtype=np.int64)
        sorted_key = key[order]
        starts = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        short = (content[order] & np.uint64(0xFFFFFFFFFFFF)) | np.uint64(1)
        same = np.minimum.reduceat(short, starts) == np.maximum.reduceat(short, starts)
        least = np.minimum.reduceat(c.ids[d[order]], starts)
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        return s, e, d, roll, entry, sorted_key[starts], np.where(same, short[starts], np.uint64(0)), least

    def windows(self, c: Chunk, s, e, d, roll, parts: int):
        """The windows of some runs: start, document, place among the different ones; those by (part, hashes)."""
        sizes = e - s + 1
        at = np.repeat(s - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(s) else np.zeros(0, dtype=np.int64)
        doc = np.repeat(d, sizes)
        if not len(at):
            zero = np.zeros(0, dtype=np.uint64)
            return at, doc, at, zero, zero, zero, np.zeros(0, dtype=np.int64)
        w1 = roll.of(at, self.window)
        w2 = Rolling(c.units, 1).of(at, self.window) >> np.uint64(32)
        part = (w1 >> np.uint64(20)) % np.uint64(parts)
        order = np.lexsort((w2, w1, part))
        a, b = w1[order], w2[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        place = np.empty(len(at), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
        return at, doc, place, part[order][starts], a[starts], b[starts], np.minimum.reduceat(c.ids[doc[order]], starts)

    # ---- messages

    def _send_anchors(self, parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, *row in zip(*[b.column(x).to_pylist() for x in ("chunk", "ids", "lens", "data")], strict=True):
                    _, _, _, _, _, key, content, least = self.entries(self.read(*row), parts)
                    yield from _by_part(chunk, key >> np.uint64(32), lambda x: _blob(((key[x] & _LOW).astype(np.uint32), 4), (content[x], 6), (least[x], 8)))

        return run

    def _send_windows(self, parts: int, window_parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, answers, *row in zip(*[b.column(x).to_pylist() for x in ("chunk", "anchors", "ids", "lens", "data")], strict=True):
                    c = self.read(*row)
                    s, e, d, roll, entry, key, _, _ = self.entries(c, parts)
                    differ = _answers(answers, key >> np.uint64(32), len(key)) == NEVER
                    use = differ[entry] if len(entry) else np.zeros(0, dtype=bool)
                    _, _, _, part, w1, w2, least = self.windows(c, s[use], e[use], d[use], roll, window_parts)
                    yield from _by_part(chunk, part, lambda x: _blob((w1[x], 8), (w2[x].astype(np.uint32), 4), (least[x], 8)))

        return run

    def _mark(self, parts: int, window_parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for anchors, found, *row in zip(*[b.column(x).to_pylist() for x in ("anchors", "windows", "ids", "lens", "data")], strict=True):
                    c = self.read(*row)
                    s, e, d, roll, entry, key, content, least = self.entries(c, parts)
                    answer = _answers(anchors, key >> np.uint64(32), len(key), NULL_ID + 1)
                    told = answer != NULL_ID + 1
                    differ = told & (answer == NEVER)
                    # Runs that are all alike: one answer for all their windows.
                    first = np.where(told & ~differ, np.minimum(answer, least), least)
                    look = differ | (content == 0)
                    covered = np.zeros(len(c.units) + 1, dtype=np.int64)
                    if len(entry):
                        plain = ~look[entry] & (first[entry] < c.ids[d])
                        np.add.at(covered, s[plain], 1)
                        np.add.at(covered, e[plain] + self.window, -1)
                        # The others: each window has its own. Those that were sent come back by place.
                        near, sent = look[entry], differ[entry]
                        at, doc, place, _, _, _, low = self.windows(c, s[near], e[near], d[near], roll, window_parts)
                        if sent.any():
                            at2, doc2, place2, part2, _, _, low2 = self.windows(c, s[sent], e[sent], d[sent], roll, window_parts)
                            back = _answers(found, part2, len(low2), NEVER)
                            hit = np.minimum(back, low2)[place2] < c.ids[doc2]
                            np.add.at(covered, at2[hit], 1)
                            np.add.at(covered, at2[hit] + self.window, -1)
                        hit = low[place] < c.ids[doc] if len(at) else np.zeros(0, dtype=bool)
                        np.add.at(covered, at[hit], 1)
                        np.add.at(covered, at[hit] + self.window, -1)
                    yield self.report(c, np.cumsum(covered[:-1]) > 0)

        return run

    # ---- over the table

    def marked(self, docs: DataFrame) -> DataFrame:
        """What ``report`` makes of every document and its repeated units."""
        spark = docs.sparkSession
        table = chunks(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
        size = table.agg(F.sum("n_bytes")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (14 * ENTRIES)))
        window_parts = 2 * parts
        sent = table.select("chunk", "ids", "lens", "data").mapInArrow(self._send_anchors(parts), _MESSAGE)
        anchors = stored(_exchange(sent, parts, ((np.uint32, 4), (np.uint64, 6), (np.int64, 8)), _same_runs, "anchors"))
        told = table.join(anchors, "chunk", "left").select("chunk", "anchors", "ids", "lens", "data")
        sent = told.mapInArrow(self._send_windows(parts, window_parts), _MESSAGE)
        windows = stored(_exchange(sent, window_parts, ((np.uint64, 8), (np.uint32, 4), (np.int64, 8)), _smallest, "windows"))
        both = told.join(windows, "chunk", "left").select("anchors", "windows", "ids", "lens", "data")
        return both.mapInArrow(self._mark(parts, window_parts), self.schema)


_MESSAGE = "chunk bigint, part int, blob binary"


def _by_part(chunk: int, part: np.ndarray, blob: Callable) -> Iterator[pa.RecordBatch]:
    """One message for each part; entries come sorted by part."""
    if not len(part):
        return
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    made = [blob(slice(a, b)) for a, b in zip(starts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(made), pa.int64()), pa.array(part[starts].astype(np.int32)), pa.array(made, pa.binary())], ["chunk", "part", "blob"])


def _answers(rows: list | None, part: np.ndarray, n: int, empty: int = NULL_ID + 1) -> np.ndarray:
    """The answers to a chunk's entries; ``empty`` where nobody else has the key."""
    out = np.full(n, empty, dtype=np.int64)
    for r in rows or []:
        at, value = _unblob(r["blob"], (np.uint32, 4), (np.int64, 8))
        out[np.searchsorted(part, np.uint64(r["part"])) + at.astype(np.int64)] = value
    return out


def _same_runs(key, content, least):
    """Order, starts of groups, and the answer of each: its smallest document, or NEVER if runs differ."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    low, high = np.minimum.reduceat(content[order], starts), np.maximum.reduceat(content[order], starts)
    return order, starts, np.where((low == high) & (low != 0), np.minimum.reduceat(least[order], starts), NEVER)


def _smallest(w1, w2, least):
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order, starts, np.minimum.reduceat(least[order], starts)


def _exchange(sent: DataFrame, parts: int, kinds: tuple, resolve: Callable, name: str) -> DataFrame:
    """(chunk, name): for every chunk the answers of all parts, as (part, blob of places and values)."""

    def answer(part: int, rows: list) -> Iterator[pa.RecordBatch]:
        arrays = [_unblob(blob, *kinds) for _, blob in rows]
        columns = [np.concatenate(x) for x in zip(*arrays, strict=True)]
        order, starts, value = resolve(*columns)
        sizes = np.diff(np.r_[starts, len(order)])
        shared, back = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=np.int64)
        shared[order], back[order] = np.repeat(sizes > 1, sizes), np.repeat(value, sizes)
        at, out = 0, []
        for (chunk, _), a in zip(rows, arrays, strict=True):
            n = len(a[0])
            mine = np.flatnonzero(shared[at : at + n])
            if len(mine):
                out.append((chunk, part, _blob((mine.astype(np.uint32), 4), (back[at : at + n][mine], 8))))
            at += n
        if out:
            c, p, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(b, pa.binary())], ["chunk", "part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            for chunk, part, blob in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if part != held and rows:
                    yield from answer(held, rows)
                    rows = []
                held = part
                rows.append((chunk, blob))
        if rows:
            yield from answer(held, rows)

    answers = sent.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, _MESSAGE)
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "blob")).alias(name))
