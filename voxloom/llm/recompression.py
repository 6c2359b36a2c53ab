"""Substring deduplication by recompression: repeated windows of 13 words go, the first stays.

Words are named by a hash of their bytes under a key drawn for each run, the same everywhere in it, so
that no two words can be chosen to share a name. A round then names runs of one word (the word and its
length) as one symbol; two further rounds split the symbols into left and right ones by a bit of their
names and name every adjacent left-right pair as one new symbol. What a round does to a symbol depends
on its neighbours only, so equal substrings get equal symbols inside, whatever surrounds them: a second
level symbol covers four words at most and is settled by three words to either side. Every 13-word
window therefore holds settled symbols; it picks the longest, and of those the one with the smallest name. Windows with the same
symbol meet and are verified word by word hash (see ``repeats``). Windows that hold two equal
neighbouring words, where runs reach out of the window, meet under the name of the whole window.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; a null text has none. Ties of ``doc_id``
are not earlier than one another; null ids come first. Repeated rows, extra columns and empty tables
are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
import hashlib
from itertools import compress
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.repeats import Chunk, NULL_ID, Passages, Rolling, mix

WINDOW = 13
MARGIN = 3
LONGEST = 4
_PRIME = np.uint64(0xC2B2AE3D27D4EB4F)


def _names(words: list[bytes], key: bytes) -> np.ndarray:
    """64-bit keyed hashes of words; each different word is hashed once."""
    known = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8, key=key).digest(), "little") for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _split(data: bytes, lens: np.ndarray) -> Iterator[list[bytes]]:
    """The words of each document; ``bytes.split`` cuts at the same six characters."""
    ends = np.cumsum(lens)
    for x, y in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        yield data[x:y].split()


def _units(data: np.ndarray, lens: np.ndarray, key: bytes = b"") -> tuple:
    """Names of words and words per document."""
    words, counts = [], np.zeros(len(lens), dtype=np.int64)
    for i, own in enumerate(_split(data.tobytes(), lens)):
        words += own
        counts[i] = len(own)
    return _names(words, key), counts, ()


def _pair(name: np.ndarray, kind: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int):
    """One round of pairs: (name, document, start, end) of the new symbols. ``kind`` splits the old ones."""
    left = (mix(kind + np.uint64(salt)) & np.uint64(1)).astype(bool)
    joined = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
    first = np.r_[joined, False]
    stays = ~np.r_[False, joined]
    following = np.r_[name[1:], name[-1:]]
    new = np.where(first, mix(name * _PRIME + following + np.uint64(salt)), name)
    stop = np.where(first, np.r_[end[1:], end[-1:]], end)
    return new[stays], doc[stays], start[stays], stop[stays]


def symbols(words: np.ndarray, doc: np.ndarray):
    """The second-level symbols: name, first word, end."""
    new = np.r_[True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(words)]
    word = words[start]
    name = mix(word ^ mix((end - start).astype(np.uint64)))
    name, owner, start, end = _pair(name, word, doc[start], start, end, 1)
    name, _, start, end = _pair(name, name, owner, start, end, 2)
    return name, start, end


def _anchors(units: np.ndarray, doc: np.ndarray, roll: Rolling) -> np.ndarray:
    n = len(units) - WINDOW + 1
    name, start, end = symbols(units, doc)
    short = np.clip(LONGEST - (end - start), 0, LONGEST).astype(np.uint64)
    name = (name >> np.uint64(3)) | (short << np.uint64(61))  # long symbols first
    picked = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for t in range(WINDOW - 2 * MARGIN):
        at = end + MARGIN - WINDOW + t  # windows in which the symbol and its margins lie, the t-th of them
        good = (at >= 0) & (at < n) & (at <= start - MARGIN)
        picked[at[good]] = np.minimum(picked[at[good]], name[good])
    equal = np.r_[0, np.cumsum((units[1:] == units[:-1]) & (doc[1:] == doc[:-1]))]
    runs = equal[WINDOW - 1 :] > equal[:n]
    picked[runs] = roll.all(WINDOW)[runs]
    return picked


def _report(with_kept: bool):
    def run(c: Chunk, mask: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(c.counts)
        total = np.r_[0, np.cumsum(mask)]
        removed = total[ends] - total[ends - c.counts]
        kept = []
        for a, b, words in zip((ends - c.counts).tolist(), ends.tolist(), _split(c.data, c.lens), strict=True):
            kept.append(b" ".join(compress(words, (~mask[a:b]).tobytes())))
        columns = [
            pa.array(c.ids, mask=c.ids == NULL_ID), pa.array(c.counts), pa.array(removed.astype(np.int64)),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_kept, names + ["kept"] * with_kept)

    return run


def dedup(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * with_kept
    return Passages(partial(_units, key=secrets.token_bytes(16)), _anchors, WINDOW, _report(with_kept), schema).marked(docs)
