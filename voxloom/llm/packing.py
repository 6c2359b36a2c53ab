"""Best-fit packing of tokenised documents.

Only a piece's length matters for packing, and there are at most ``capacity`` lengths. So Spark
counts pieces by length, the packing is worked out on those counts (bounded, whatever the corpus),
and every piece finds its place from its rank among pieces of its length. Ranks are local numbers
plus the counts of earlier tasks; no task sees all pieces.

Large pieces, above a third of the capacity, go at most two to a sequence: the largest is matched
with the largest that still fits, greedily. Smaller pieces, longest first, go to the fullest
sequence that still has room.

Token ids are those of ``byte_bpe_50k.json``; the same vocabulary in rank form is read by the faster
of the two installed libraries, and the other takes texts that this one gives up on, such as a million
blanks in a row (tests compare ids). Null text is empty: one piece with the end
mark alone. Repeated rows are packed as often as they come. A null ``doc_id`` is kept. Extra columns
are left alone; an empty table gives an empty table. Only lone surrogates, which UTF-8 cannot hold,
are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.llm.common import stored
from voxloom.llm.tokens import byte_ids
from voxloom.session import ship_package

CAPACITY = 1024
END = 2


def token_ids(text: str | None, name: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """Ids of a whole text and the end mark; ``<|endoftext|>`` in a text is its special token, as in the JSON form."""
    found = byte_ids(text or "", name, plain=False)
    found.append(END)
    return np.array(found, dtype="<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth[, ids]); stored.

    A document longer than ``capacity`` is cut into full pieces, the first of which may be shorter.
    ``part`` is the task that cut it and ``nth`` its number among pieces of its length there.
    """
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            rows, numbers, blobs = [], [], []
            for i, text in enumerate(b.column(1)):
                ids = token_ids(text.as_py(), vocabulary)
                head = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(head, len(ids), capacity)]):
                    length = head if k == 0 else capacity
                    raw = ids[start : start + length].tobytes()
                    rows.append(i)
                    numbers.append((k, start, length, zlib.crc32(raw), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        blobs.append(raw)
            table = np.array(numbers, dtype=np.int64).reshape(-1, 6)
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(table[:, 0], pa.int32()), *[pa.array(table[:, j]) for j in (1, 2, 3)], pa.array(table[:, 4], pa.int32()), pa.array(table[:, 5])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * with_ids, schema=wanted(b))

    def wanted(b: pa.RecordBatch) -> pa.Schema:
        names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        fields = [pa.field("doc_id", b.schema.field(0).type), *map(pa.field, names, kinds)]
        return pa.schema(fields + [pa.field("ids", pa.binary())] * with_ids)

    return stored(docs.select("doc_id", "text").mapInArrow(run, schema))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """The packing of ``counts`` pieces by length: (number of sequences, [(length, how many), ...])."""
    left = {length: n for length, n in counts.items() if n}
    third = capacity // 3
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # room -> kinds of sequences with that room

    def put(n: int, content: list[tuple[int, int]]) -> None:
        bins.setdefault(capacity - sum(length * k for length, k in content), []).append((n, content))

    large = sorted(length for length in left if length > third)
    for a in reversed(large):
        while left.get(a):
            fits = [b for b in large if b <= capacity - a and left.get(b)]
            b = fits[-1] if fits else 0
            if not b or a == b and left[a] < 2:
                n, content = left[a], [(a, 1)]
                if b == a:  # one of its own kind is left over: the next smaller may join it
                    lower = [x for x in fits if x != a]
                    if lower:
                        n, content = 1, [(a, 1), (lower[-1], 1)]
                        left[lower[-1]] -= 1
                left[a] -= n
            elif a == b:
                n, content = left[a] // 2, [(a, 2)]
                left[a] -= 2 * n
            else:
                n, content = min(left[a], left[b]), [(a, 1), (b, 1)]
                left[a] -= n
                left[b] -= n
            put(n, content)
    rooms = sorted(bins)
    for length in sorted((x for x in left if x <= third), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                new = [(full, [(length, each)])] * bool(full) + [(1, [(length, rest)])] * bool(rest)
                n = 0
            else:
                room = rooms[at]
                have, content = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
                each = min(room // length, n)
                use = min(have, n // each)
                n -= use * each
                new = [(use, [*content, (length, each)])] + [(have - use, content)] * (have > use)
            for k, content in new:
                room = capacity - sum(x * y for x, y in content)
                if room not in bins:
                    bins[room] = []
                    rooms.insert(bisect_left(rooms, room), room)
                bins[room].append((k, content))
    return [x for room in sorted(bins) for x in bins[room]]


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: columns first rank, first sequence, pieces a sequence, offset of the first."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, content in made:
        offset = 0
        for length, each in content:
            out.setdefault(length, []).append((used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored rows of ``pieces`` with sequence_id and offset."""
    ship_package(cut.sparkSession)
    counts = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    table = places(plan(totals, capacity))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    # These grow with the number of tasks: one plan at every size, a sort-merge join, never a broadcast.
    ranked = cut.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before")
    columns = [c for c in cut.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for value in np.unique(length):
                at, rows = length == value, table[int(value)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + inside // row[:, 2], row[:, 3] + inside % row[:, 2] * value
            yield pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id bigint, offset bigint"
    return ranked.select(*columns, "rank").mapInArrow(run, schema)


def report(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, little-endian unsigned 32-bit ids."""
    packed = pack(pieces(docs, capacity, with_ids=True), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"))
