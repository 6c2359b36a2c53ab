"""Suffix-array deduplication of bytes: later copies of passages go, the first stays.

The longest previous factor of a position is the longest string from there that also starts at an
earlier place; in suffix order it is found beside the previous and the next suffix of an earlier
document. Only whether it reaches 50 bytes matters here, so suffixes are ordered by their first 50
bytes, in which those that agree that far stand together, and the smallest document among them is the
earlier one to both sides. The suffix array is sparse: suffixes are sampled by the smallest of the
22-byte hashes in each 50-byte window (every window has one, the same wherever it occurs), and only
where the sampled contexts differ are all their suffixes ordered one by one (see ``repeats``).

Texts are whole UTF-8 texts (null: empty); matches never cross documents; strings are judged on the
input. Ties of ``doc_id`` are not earlier than one another; null ids come first. Repeated rows, extra
columns and empty tables are fine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.repeats import Chunk, NULL_ID, Passages, Rolling

WINDOW = 50
GRAM = 22


def _units(data: np.ndarray, lens: np.ndarray) -> tuple:
    return data.astype(np.uint64) + np.uint64(1), lens, ()


def _anchors(units: np.ndarray, doc: np.ndarray, roll: Rolling) -> np.ndarray:
    """The smallest gram hash of each window, by doubling."""
    span, have = WINDOW - GRAM + 1, 1
    low = roll.all(GRAM)
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (span - have)], low[span - have :]) if have < span else low


def spans_of(mask: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: marked units, and maximal runs of them."""
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.r_[0, np.cumsum(mask)]
    rise = mask.copy()
    rise[1:] &= ~mask[:-1]
    inner = starts[counts > 0]
    rise[inner] = mask[inner]
    rises = np.r_[0, np.cumsum(rise)]
    return total[ends] - total[starts], rises[ends] - rises[starts]


def _report(with_kept: bool):
    def run(c: Chunk, mask: np.ndarray) -> pa.RecordBatch:
        removed, spans = spans_of(mask, c.lens)
        kept, at, data = [], 0, np.frombuffer(c.data, dtype=np.uint8)
        for n, gone in zip(c.lens.tolist(), removed.tolist(), strict=True):
            kept.append(data[at : at + n][~mask[at : at + n]].tobytes() if gone else c.data[at : at + n])
            at += n
        columns = [
            pa.array(c.ids, mask=c.ids == NULL_ID), pa.array(c.lens), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_kept, names + ["kept"] * with_kept)

    return run


def dedup(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return Passages(_units, _anchors, WINDOW, _report(with_kept), schema).marked(docs)
