"""Near-copy removal for a corpus: SimHash candidates by deletion variants, exact similarity, one row of a group.

Two texts are near copies if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or
more. The fingerprint is long: it has segments whose width grows with the
corpus (two bits more than its number of documents has). At similarity 0.8 about 15 % of the bits
differ, so a segment differs in at most one bit with a known probability; there are as many segments as
make one such segment 95 % likely at exactly 0.8 (more above). Each segment is indexed under every
variant with one bit wiped out; equal variants meet.

* A meeting is checked by a sketch of the shingles, 128 one-bit min-hashes. It differs by half of what the sets
  differ, whatever the texts have in common otherwise, and passes 99.5 % of pairs at exactly 0.8.
* A batch of documents first settles variants that many of its own documents share: near copies of one
  text follow a *leader*, and only leaders leave the task. So a group with a third of all rows is a few
  rows a task in the shuffle, and never a list of pairs: in a variant each follower is in one pair.
* What meets is only a candidate. The texts of a candidate pair are compared exactly before any row
  goes: at first one pair for each document, then up to 16 more, then all others, each time only pairs
  whose two documents both stand. New pairs of later turns are compared all at once.
* Of a near pair the later document goes. The first document of a chain of near copies has none before it,
  so something of every group stays, and no two documents that stay were found alike.
* Documents of a variant in which someone followed and that still stand are signed again, with other leaders
  each time, until hardly any goes. What stands then meets once more without leaders: all pairs of every variant,
  a crowded one cut into cells whose pairs are dealt over the tasks. So each pair that meets is looked at, or one
  of its documents is gone. Where many texts are just not near copies, this last turn is quadratic in their number.

Shingles are those of the whole text after lower-casing A-Z (fewer than five words: all words together);
texts without a word are alike. The smaller ``doc_id`` comes first (null last; equal ids in the order of
rows). Every other column is left alone; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
import xxhash

from voxloom.llm.common import fresh, stored
from voxloom.session import ship_package

SIMILARITY, WORDS = 0.8, 5
#: Words of a feature of the fingerprint: edits of single words spoil fewer short features than long ones.
FEATURE = 3
#: Words of the sketch a meeting is checked by: bits of 64 smallest hashes each, of which 10 % differ at similarity 0.8.
SKETCH = 2
#: Share of differing bits of the sketch up to which a meeting is a candidate, and one follows a leader.
LOOSE = 0.175
#: Up to so many documents of a variant all pairs are looked at.
SMALL = 16
#: Pairs of a document that are compared before the gone ones are taken out: one, up to 17, all others.
TURNS = (1, 17, None)
#: Leaders are not worth another turn when fewer than one in so many documents that still stand went.
FEW = 50
#: Documents of a crowded variant that one task holds twice at most in the turn without leaders, and pairs it holds.
CELL, _HELD = 2048, 1 << 19
_BLOCK = 1 << 13
#: Under this node a signature says that some of its documents stayed in the task.
_FOLLOWED = -1


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    made = map(b" ".join, zip(*[w[i:] for i in range(words)])) if len(w) > words else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in made), dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shape(documents: int, likely: float = 0.95) -> tuple[int, int]:
    """Width and number of segments for a corpus of that size."""
    width = max(16, math.ceil(math.log2(max(documents, 1))) + 2)
    differ = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    meets = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
    return width, math.ceil(math.log(1 - likely) / math.log(1 - meets))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(text: str | None, longs: int) -> np.ndarray:
    """64 bits a long, each set if over half of the features have it."""
    hashed = shingles(text, FEATURE)
    ones = np.zeros(64 * longs, dtype=np.int64)
    for at in range(0, len(hashed), _BLOCK):
        some = np.stack([_mixed(hashed[at : at + _BLOCK], k) for k in range(longs)], axis=1)
        bits = np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashed), bitorder="little").view("<u8")


_ODD = _mixed(np.arange(64 * SKETCH, dtype=np.uint64), 7) | np.uint64(1)


def sketch(text: str | None) -> np.ndarray:
    """One bit each of the smallest of differently mixed shingles: two texts differ in half of 1 - Jaccard of the bits."""
    hashed = shingles(text, WORDS)
    if not len(hashed):
        return np.zeros(SKETCH, dtype="<u8")
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashed), _BLOCK):
        least = np.minimum(least, (hashed[at : at + _BLOCK, None] * _ODD).min(axis=0))
    return np.packbits((_mixed(least, 11) & np.uint64(1)).astype(bool), bitorder="little").view("<u8")


def fingerprints(texts: DataFrame, longs: int) -> DataFrame:
    """(node, fp): the sketch and ``longs`` words of fingerprint, of 64 bits each, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(t).tobytes() + fingerprint(t, longs).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["node", "fp"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, fp binary")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of differing bits of sketches, one (of one word or more) a row."""
    return np.bitwise_count(a ^ b).reshape(len(a), -1).mean(axis=1) / 64 if len(a) else np.zeros(0)


def _led(node: np.ndarray, check: np.ndarray, turn: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Candidates among many documents of one variant, and the places of those that lead.

    The smallest node leads (in later turns the smallest by a hash): all within ``LOOSE`` are its candidates,
    follow it and leave, so there are fewer pairs than documents. If someone followed, not all pairs were looked
    at, and all documents are marked by a candidate of the node with itself.
    """
    left = np.argsort(_mixed(node.astype(np.uint64), turn) if turn else node, kind="stable")
    pairs, leaders = [], []
    while len(left):
        lead, rest = left[0], left[1:]
        leaders.append(lead)
        apart = _apart(check[rest], check[lead])
        follow = rest[apart <= LOOSE]
        if len(follow):
            pairs.append(np.stack([np.full(len(follow), node[lead]), node[follow]], axis=1))
        left = rest[apart > LOOSE]
    if pairs:
        pairs.append(np.stack([node, node], axis=1))
    return pairs, np.array(leaders)


def _groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    return starts, np.diff(np.r_[starts, len(sig)])


_SIGNED = ["sig", "node", *(f"word{k}" for k in range(SKETCH))]


def _variants(b: pa.RecordBatch, width: int, segments: int) -> tuple[np.ndarray, ...]:
    """Nodes and their words; for every variant of each its signature, the place of the node, and the bit wiped out."""
    place = np.arange(width, dtype=np.uint64)
    number = np.arange(segments * width, dtype=np.uint64).reshape(segments, width) << np.uint64(width)
    node = b.column(0).to_numpy()
    fp = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u8").reshape(len(node), -1)
    bits = np.unpackbits(np.ascontiguousarray(fp[:, SKETCH:]).view(np.uint8), axis=1, bitorder="little")[:, : segments * width]
    value = bits.reshape(len(node), segments, width) @ (np.uint64(1) << place)
    sig = (number[None] | (value[:, :, None] & ~(np.uint64(1) << place))).reshape(-1).astype(np.int64)
    return node, fp, sig, np.repeat(np.arange(len(node)), segments * width), bits.reshape(-1)


def _sign(width: int, segments: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, sig, at, _ = _variants(b, width, segments)
            order = np.argsort(sig, kind="stable")
            starts, many = _groups(sig[order])
            stay, found, led = np.ones(len(sig), dtype=bool), [], []
            for s, n in zip(starts[many > SMALL], many[many > SMALL], strict=True):
                rows = order[s : s + n]
                pairs, leaders = _led(node[at[rows]], fp[at[rows], :SKETCH], turn)
                found += pairs
                stay[rows] = False
                stay[rows[leaders]] = True
                if pairs:
                    led.append(sig[rows[0]])
            rows = np.flatnonzero(stay)
            words = fp[at[rows], :SKETCH].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.array(node[at[rows]]), *map(pa.array, words.T.copy())], _SIGNED)
            if led:  # whoever meets the leaders of these has not met their followers
                none = pa.array(np.full(len(led), _FOLLOWED))
                yield pa.RecordBatch.from_arrays([pa.array(led, pa.int64()), *[none] * (1 + SKETCH)], _SIGNED)
            if found:  # candidates travel as they are, under negative numbers
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - pairs[:, 1]), pa.array(pairs[:, 0]), *[pa.array(pairs[:, 1])] * SKETCH], _SIGNED)

    return run


def _meet(turn: int):
    """Candidates (lo, hi) from rows sorted by variant."""

    def out(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both = np.concatenate([np.zeros((0, 2), dtype=np.int64), *pairs])
        if len(both):
            both = np.unique(np.sort(both, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["lo", "hi"])

    def settle(sig: np.ndarray, node: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
        ready = sig < 0
        pairs = [np.stack([node[ready], words[0][ready]], axis=1)]
        led = np.unique(sig[~ready & (node == _FOLLOWED)])
        here = ~ready & (node != _FOLLOWED)
        sig, node, check = sig[here], node[here], np.stack([w[here] for w in words], axis=1).view(np.uint64)
        marked = node[np.isin(sig, led)]
        pairs.append(np.stack([marked, marked], axis=1))
        starts, many = _groups(sig)
        for step in range(1, SMALL):  # rows so far apart in the same variant
            a = np.flatnonzero(sig[:-step] == sig[step:]) if len(sig) > step else np.zeros(0, dtype=np.int64)
            if not len(a):
                break
            size = np.repeat(many, many)[a]
            a = a[(size <= SMALL) & (_apart(check[a], check[a + step]) <= LOOSE)]
            pairs.append(np.stack([node[a], node[a + step]], axis=1))
        for s, n in zip(starts[many > SMALL], many[many > SMALL], strict=True):
            pairs += _led(node[s : s + n], check[s : s + n], turn)[0]
        yield from out(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the variant that may go on in the next batch
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            if held:
                columns = [np.concatenate([*[h[i] for h in held], x]) for i, x in enumerate(columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            yield from settle(*[x[:cut] for x in columns])
            held = [tuple(x[cut:] for x in columns)]
        if held:
            yield from settle(*held[0])

    return run


_ALL = ["sig", "node", "bit", *_SIGNED[2:]]


def _sign_all(width: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, sig, at, bit = _variants(b, width, segments)
            words = fp[at, :SKETCH].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node[at]), pa.array(bit.astype(np.int64)), *map(pa.array, words.T.copy())], _ALL)

    return run


def _meet_all(width: int):
    """Candidates (lo, hi) from rows (sig, low, high, cell, node, bit, words) sorted by the first three: all pairs.

    Documents equal in a segment meet in each of its variants, so they are looked at in the first only, and
    in the others those that differ in the bit wiped out.
    """

    def settle(sig: np.ndarray, low: np.ndarray, high: np.ndarray, cell: np.ndarray, node: np.ndarray, bit: np.ndarray, *words: np.ndarray) -> Iterator[np.ndarray]:
        check = np.stack(words, axis=1).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        many = np.diff(np.r_[starts, len(sig)])
        group, size = np.repeat(np.arange(len(starts)), many), np.repeat(many, many)
        first, apart = (sig >> width) % width == 0, low != high

        def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = (first[a] | (bit[a] != bit[b])) & (~apart[a] | (cell[a] != cell[b]))
            a, b = a[ok], b[ok]
            ok = _apart(check[a], check[b]) <= LOOSE
            return np.stack([node[a[ok]], node[b[ok]]], axis=1)

        for step in range(1, SMALL):
            a = np.flatnonzero((group[:-step] == group[step:]) & (size[:-step] <= SMALL)) if len(sig) > step else np.zeros(0, dtype=np.int64)
            if not len(a):
                break
            yield close(a, a + step)
        for s, n in zip(starts[many > SMALL], many[many > SMALL], strict=True):
            if first[s] or (bit[s : s + n] != bit[s]).any():
                for a in range(s, s + n - 1):
                    b = np.arange(a + 1, s + n)
                    yield close(np.full(len(b), a), b)

    def out(pairs: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, rows = [], 0
        for columns in _by_key(batches, 3):
            for made in settle(*columns):
                pairs.append(made)
                rows += len(made)
                if rows > _HELD:
                    yield out(pairs)
                    pairs, rows = [], 0
        if pairs:
            yield out(pairs)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, never cut inside a group of equal first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy() for c in b.columns]
        new = np.zeros(b.num_rows, dtype=bool)
        for c, h in zip(columns[:keys], held[-1] if held else columns, strict=False):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= c[0] != h[-1] if held else True
        cuts = np.flatnonzero(new)
        if len(cuts):
            cut = int(cuts[-1])
            whole = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns], strict=True)]
            if len(whole[0]):
                yield whole
            held, columns = [], [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def all_candidates(fps: DataFrame, width: int, segments: int) -> DataFrame:
    """(lo, hi) of all nodes that meet in any variant. A variant of more than ``CELL`` is cut into cells by a hash,
    and each pair of cells is a group of its own."""
    signed = fps.mapInArrow(_sign_all(width, segments), ", ".join(f"{c} bigint" for c in _ALL))
    crowds = signed.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells")).where("cells > 1")
    placed = signed.join(crowds, "sig", "left").withColumn("cells", F.coalesce("cells", F.lit(1).cast("bigint"))).withColumn(
        "cell", F.pmod(F.xxhash64("node"), F.col("cells")))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)))
    rows = each.select("sig", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", *_ALL[1:])
    key = ["sig", "low", "high"]
    return stored(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_meet_all(width), "lo bigint, hi bigint").distinct())


def candidates(fps: DataFrame, width: int, segments: int, turn: int = 0) -> DataFrame:
    """(lo, hi) pairs of nodes that meet; lo = hi marks nodes of a variant where not all pairs were looked at."""
    signed = fps.mapInArrow(_sign(width, segments, turn), ", ".join(f"{c} bigint" for c in _SIGNED))
    met = signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_meet(turn), "lo bigint, hi bigint")
    return stored(met.distinct())


def later_copies(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node): of each pair whose texts are alike enough the later document; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, last = None, ""  # rows of one leader often follow each other
            good = np.zeros(b.num_rows, dtype=bool)
            for i in range(b.num_rows):
                x, y = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                if seen is None or x != last:
                    seen, last = shingles(x, words), x
                good[i] = alike(seen, shingles(y, words)) >= similarity
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.flatnonzero(good)))], ["node"])

    def side(node: str, text: str, place: str) -> DataFrame:
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node").alias("n"))
        return texts.select(F.col("node").alias(node), F.col("text").alias(text), order.alias(place))

    both = pairs.join(side("lo", "a", "at_a"), "lo").join(side("hi", "b", "at_b"), "hi")
    later = F.when(F.col("at_a") > F.col("at_b"), F.col("lo")).otherwise(F.col("hi"))
    return stored(both.select(later.alias("node"), "a", "b").mapInArrow(run, "node bigint").distinct())


def settled(edges: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame | None:
    """(node): what goes because of the candidate pairs (lo, hi), or None.

    The pairs of every ``hi`` are numbered once, and ``TURNS`` says which numbers are compared together.
    Pairs with a document that is gone meanwhile need no look any more.
    """
    place = F.row_number().over(Window.partitionBy("hi").orderBy("lo"))
    edges, gone = stored(edges.withColumn("place", place)), None
    for most in TURNS:
        upto = F.lit(True) if most is None else F.col("place") <= most
        now = edges.where(upto).select("lo", "hi")
        if now.isEmpty():
            continue
        going = later_copies(now, texts, words, similarity)
        gone = going if gone is None else gone.unionByName(going)
        if most is not None:
            edges = edges.where(~upto)
            for c in ("lo", "hi"):
                edges = edges.join(going.withColumnRenamed("node", c), c, "left_anti")
            edges = stored(edges.select("lo", "hi", "place"))
    return gone


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``."""
    ship_package(docs.sparkSession)
    uid = fresh(docs, "uid")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()))
    texts = rows.select(F.col(uid).alias("node"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    width, segments = shape(rows.count())
    left, gone, seen, turn, everyone = stored(fingerprints(texts, -(-width * segments // 64))), None, None, 0, False
    while True:
        found = all_candidates(left, width, segments) if everyone else candidates(left, width, segments, turn)
        pairs = found.where("lo <> hi")
        if seen is None:
            going = settled(pairs, texts, words, similarity)
        else:  # few go in later turns, so nothing is gained by rounds
            going = later_copies(pairs.join(seen, ["lo", "hi"], "left_anti"), texts, words, similarity)
        seen = pairs if seen is None else seen.unionByName(pairs)  # none of these is alike with both standing
        if going is not None:
            gone = going if gone is None else gone.unionByName(going)
        if everyone:  # no pair is left that was not looked at
            break
        again = found.where("lo = hi").select(F.col("lo").alias("node"))
        again = again if going is None else again.join(going, "node", "left_anti")
        left, turn = stored(left.join(again, "node", "left_semi")), turn + 1
        count = left.count()
        if not count:
            break
        everyone = going is None or FEW * going.count() < count
    if gone is None:
        return rows.select(*docs.columns)
    # The list grows with the corpus: one plan at every size, a sort-merge join, never a broadcast.
    return rows.join(gone.withColumnRenamed("node", uid).hint("merge"), uid, "left_anti").select(*docs.columns)
