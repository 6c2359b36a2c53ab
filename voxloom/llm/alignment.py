"""Alignment of the tokens of two tokenizers over the same text, and how often ids stand for each other.

Both tokenizers spell the same bytes (a blank, then the text). The byte offsets where tokens end are
two rising lists; where both end, the text is cut into groups. The shorter list drives: each of its
ends gallops into the longer one, by steps that double from where its rank lets it expect the place,
then by halving. Common places cut the groups, and the differences of the ranks found are the ranges
of overlapping tokens (links). All documents of a chunk gallop together, as arrays.

1. Documents are tokenised once and stored in chunks of about ``CHUNK_BYTES``, bucketed by chunk.
2. Each chunk counts, for each pair of ids, its documents that link it: one row a pair and chunk, so a
   pair that every document holds is one row a chunk.
3. Pairs are added up over the corpus; the best of each A id is a table no longer than the vocabulary.
4. Each chunk gets the counts of its own pairs back, and reports its documents.

A document has no tokens (zeros) if its text is null or empty or one of the tokenizers does not spell
blank and text byte by byte. Every row counts as a document of its own, also where ``doc_id`` is null or
repeated. Empty tables give empty tables; extra columns are ignored. A document is never cut: a text
of 20 MB takes a task about 1 GB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
import zstandard

from voxloom.llm.common import stored
from voxloom.llm.tokens import encoder, spelling
from voxloom.session import ship_package

A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
CHUNK_BYTES = 2 << 20
#: Bits of an id in a pair of ids.
_BITS = 20
#: Texts tokenised at once.
_TEXTS = 256


def gallop(keys: np.ndarray, into: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each key the first place in ``into`` (rising) that is not below it; the last place is not below any.

    From ``guess`` steps of 1, 2, 4, ... go towards the key until it is passed; halving does the rest.
    """
    last = len(into) - 1
    low, high = guess.copy(), guess.copy()  # into[low - 1] < key <= into[high] in the end
    below = into[guess] < keys
    for sign, at in ((1, np.flatnonzero(below)), (-1, np.flatnonzero(~below))):
        step = 1
        while len(at):
            if sign > 0:
                low[at] = high[at] + 1
                high[at] = np.minimum(high[at] + step, last)
                at = at[into[high[at]] < keys[at]]
            else:
                high[at] = low[at]
                low[at] = np.maximum(low[at] - step, 0)
                at = at[(low[at] > 0) & (into[np.maximum(low[at] - 1, 0)] >= keys[at])]
            step *= 2
    at = np.flatnonzero(low < high)
    while len(at):
        middle = (low[at] + high[at]) >> 1
        right = into[middle] < keys[at]
        low[at[right]], high[at[~right]] = middle[right] + 1, middle[~right]
        at = at[low[at] < high[at]]
    return low


@dataclass
class Aligned:
    """Links and cuts of some documents: per link its document and its two tokens; per cut the number of
    tokens up to it on either side, and its document."""

    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut_doc: np.ndarray


def _drive(short: np.ndarray, long: np.ndarray, n_short: np.ndarray, n_long: np.ndarray):
    """Place of the short ends among the long, cuts, and links as (short, long, document)."""
    doc = np.repeat(np.arange(len(n_short)), n_short)
    rank = np.arange(len(short)) - (np.cumsum(n_short) - n_short)[doc]
    guess = (np.cumsum(n_long) - n_long)[doc] + rank * n_long[doc] // n_short[doc]
    place = gallop(short, long, guess)
    common = long[place] == short
    first = np.r_[0, (place + common)[:-1]]
    many = place - first + 1
    left = np.repeat(np.arange(len(short)), many)
    right = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(left))
    cut = np.flatnonzero(common)
    return left, right, doc[left], cut + 1, place[cut] + 1, doc[cut]


def align(size_a: np.ndarray, size_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
    """From the byte sizes of all tokens and the tokens per document to links and cuts, by document.

    Tokens of a document take equally many bytes on both sides.
    """
    parts = []
    none = np.zeros(0, dtype=np.int64)
    for by_a in (True, False):
        use = (n_a > 0) & ((n_a <= n_b) == by_a)
        at_a, at_b = np.flatnonzero(np.repeat(use, n_a)), np.flatnonzero(np.repeat(use, n_b))
        if not len(at_a):
            continue
        ends_a, ends_b = np.cumsum(size_a[at_a]), np.cumsum(size_b[at_b])
        if by_a:
            x, y, d, cut_a, cut_b, cut_doc = _drive(ends_a, ends_b, n_a[use], n_b[use])
        else:
            y, x, d, cut_b, cut_a, cut_doc = _drive(ends_b, ends_a, n_b[use], n_a[use])
        real = np.flatnonzero(use)
        parts.append((real[d], at_a[x], at_b[y], at_a[cut_a - 1] + 1, at_b[cut_b - 1] + 1, real[cut_doc]))
    if not parts:
        return Aligned(*[none] * 6)
    joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
    if len(parts) > 1:
        links, cuts = np.argsort(joined[0], kind="stable"), np.argsort(joined[5], kind="stable")
        joined = [c[links] for c in joined[:3]] + [c[cuts] for c in joined[3:]]
    return Aligned(*joined)


@dataclass
class Chunk:
    """Documents of one stored row: ids and numbers of tokens, and all token ids."""

    ids: pa.Array
    n_a: np.ndarray
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def aligned(self, sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
        return align(sizes[0][self.a], sizes[1][self.b], self.n_a, self.n_b)

    def pairs(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's different pairs of ids, sorted by document: document, pair, links."""
        bits = np.uint64(self._bits)
        key = (x.doc.astype(np.uint64) << (bits + bits)) | (self.a[x.a].astype(np.uint64) << bits) | self.b[x.b].astype(np.uint64)
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        many = np.diff(np.r_[starts, len(key)])
        key = key[starts]
        mask = (np.uint64(1) << bits) - np.uint64(1)
        pair = ((key >> bits & mask) << np.uint64(_BITS)) | (key & mask)
        return (key >> (bits + bits)).astype(np.int64), pair.astype(np.int64), many

    @property
    def _bits(self) -> int:
        """Bits that hold every id of this chunk."""
        return int(max(self.a.max(initial=1), self.b.max(initial=1))).bit_length()

    @classmethod
    def read(cls, row: dict) -> Chunk:
        n_a, n_b = (np.frombuffer(row[c], dtype="<i8") for c in ("n_a", "n_b"))
        a, b = (np.frombuffer(zstandard.ZstdDecompressor().decompress(row[c]), dtype="<u4") for c in ("a", "b"))
        return cls(row["ids"], n_a, n_b, a, b)


def _sizes(name: str) -> np.ndarray:
    return np.array([len(x) for x in spelling(name)], dtype=np.int64)


def _tokens(texts: list[str | None], names: tuple[str, str]) -> list[tuple[list[int], list[int]]]:
    """Ids on both sides; none unless both sides spell blank and text."""
    some = [t for t in texts if t]
    spell = [spelling(n).__getitem__ for n in names]
    made = iter(zip(some, *[encoder(n)(some) for n in names], strict=True))
    out = []
    for t in texts:
        found: tuple[list[int], list[int]] = ([], [])
        if t:
            text, *ids = next(made)
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if all(b"".join(map(s, i)) == whole for s, i in zip(spell, ids, strict=True)):
                found = (ids[0], ids[1])
        out.append(found)
    return out


def chunks(docs: DataFrame, names: tuple[str, str] = (A, B), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, n_a, n_b, a, b): tokenised documents, stored, bucketed by chunk."""
    spark = docs.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        part, n, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        tokens: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            sides = [[t[k] for t in tokens] for k in (0, 1)]
            counts = [np.array([len(x) for x in s], dtype="<i8").tobytes() for s in sides]
            flat = [squeeze(np.concatenate(s).astype("<u4").tobytes()) for s in sides]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n]), pa.array([ids], pa.list_(kind)), *[pa.array([x], pa.binary()) for x in (*counts, *flat)]], ["chunk", "ids", "n_a", "n_b", "a", "b"]
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(at, _TEXTS)
                texts = some.column(1).to_pylist()
                for i, t, (a, b) in zip(some.column(0).to_pylist(), texts, _tokens(texts, names), strict=True):
                    ids.append(i)
                    tokens.append((np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)))
                    size += 64 + len(t or "")
                    if size >= chunk_bytes:
                        yield flush()
                        n, size = n + 1, 0
                        ids.clear()
                        tokens.clear()
        if ids:
            yield flush()

    schema = f"chunk bigint, ids array<{dict(docs.dtypes)['doc_id']}>, n_a binary, n_b binary, a binary, b binary"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), (buckets, "chunk"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other; answers stay Arrow arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield {k: v.values if isinstance(v, pa.ListScalar) else v.as_py() for k, v in row.items()}


def chunk_pairs(table: DataFrame, names: tuple[str, str] = (A, B)) -> DataFrame:
    """(pair, chunk, n): documents of the chunk that link the pair of ids; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = (_sizes(names[0]), _sizes(names[1]))
        for row in _rows(batches):
            c = Chunk.read(row)
            pair = np.sort(c.pairs(c.aligned(sizes))[1])
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
            n = np.diff(np.r_[starts, len(pair)])
            yield pa.RecordBatch.from_arrays([pa.array(pair[starts]), pa.array(np.full(len(starts), row["chunk"])), pa.array(n.astype(np.int32))], ["pair", "chunk", "n"])

    return stored(table.mapInArrow(run, "pair bigint, chunk bigint, n int"))


def pair_counts(sent: DataFrame) -> DataFrame:
    """(pair, count, best): documents of the corpus that link the pair, and whether no pair of its A id has more."""
    totals = stored(sent.groupBy("pair").agg(F.sum("n").alias("count")))
    side = F.shiftright("pair", _BITS)
    best = totals.groupBy(side.alias("a")).agg(F.max("count").alias("most"))  # a row for each id of vocabulary A at most
    return totals.join(F.broadcast(best), side == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _marks(c: Chunk, x: Aligned) -> list[str]:
    """For each document the groups as text, hashed; empty without tokens."""
    text_a, text_b = [np.array([str(i) for i in range(int(v.max(initial=0)) + 1)], dtype=object) for v in (c.a, c.b)]
    size = len(x.cut_a)
    if not size:
        return [""] * len(c.n_a)
    tokens_a, tokens_b = np.diff(np.r_[0, x.cut_a]), np.diff(np.r_[0, x.cut_b])
    group_a, group_b = np.repeat(np.arange(size), tokens_a), np.repeat(np.arange(size), tokens_b)
    out = np.empty(len(c.a) + len(c.b), dtype=object)
    end = np.full(len(c.a), ",", dtype=object)
    end[x.cut_a - 1] = "|"
    out[np.arange(len(c.a)) + np.r_[0, x.cut_b[:-1]][group_a]] = text_a[c.a] + end
    end = np.full(len(c.b), ",", dtype=object)
    end[x.cut_b - 1] = ";"
    end[np.cumsum(c.n_b)[c.n_b > 0] - 1] = ""
    out[np.arange(len(c.b)) + x.cut_a[group_b]] = text_b[c.b] + end
    ends = np.cumsum(c.n_a + c.n_b)
    return [hashlib.sha256("".join(out[e - n : e].tolist()).encode()).hexdigest() if n else "" for e, n in zip(ends, c.n_a + c.n_b, strict=True)]


def report(docs: DataFrame, names: tuple[str, str] = (A, B), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    table = chunks(docs, names, chunk_bytes)
    sent = chunk_pairs(table, names)
    told = sent.select("pair", "chunk").join(pair_counts(sent), "pair")
    back = stored(told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("told")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = (_sizes(names[0]), _sizes(names[1]))
        for row in _rows(batches):
            c = Chunk.read(row)
            x = c.aligned(sizes)
            doc, pair, many = c.pairs(x)
            total = len(c.n_a)
            best, added = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
            if len(pair):
                known, count, top = (row["told"].field(f).to_numpy(zero_copy_only=False) for f in ("pair", "count", "best"))
                at = np.searchsorted(known, pair)
                np.add.at(best, doc, many * top[at])
                np.add.at(added, doc, many * count[at])
            numbers = [c.n_a, c.n_b, np.bincount(x.cut_doc, minlength=total), np.bincount(x.doc, minlength=total), best, added]
            yield pa.RecordBatch.from_arrays(
                [row["ids"], *[pa.array(v.astype(np.int64)) for v in numbers], pa.array(_marks(c, x), pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return table.join(back, "chunk", "left").mapInArrow(run, schema)


def groups(docs: DataFrame, names: tuple[str, str] = (A, B), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id and its groups, each with the ids of both sides."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = (_sizes(names[0]), _sizes(names[1]))
        for row in _rows(batches):
            c = Chunk.read(row)
            x = c.aligned(sizes)
            sides = [pa.ListArray.from_arrays(pa.array(np.r_[0, cut].astype(np.int32)), pa.array(v.astype(np.int32))) for cut, v in ((x.cut_a, c.a), (x.cut_b, c.b))]
            per_doc = np.r_[0, np.cumsum(np.bincount(x.cut_doc, minlength=len(c.n_a)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(per_doc), pa.StructArray.from_arrays(sides, ["a", "b"]))
            yield pa.RecordBatch.from_arrays([row["ids"], lists], ["doc_id", "groups"])

    return chunks(docs, names, chunk_bytes).mapInArrow(run, f"doc_id {kind}, groups array<struct<a array<int>, b array<int>>>")
