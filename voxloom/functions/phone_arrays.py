"""What operators ask of the phones of many segments, worked out on whole Arrow arrays in the tasks.

Each phone is a struct of phoneme, start_sec, end_sec and confidence; a segment has a list of them. A step
in the engine for each phone costs microseconds, a pass over an array a few nanoseconds. The functions here
give what the column forms of the operators give; a test holds the two against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Java's ``(?U)\\s`` has it.
_NOT_BLANK = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Counted rows that a task holds before it passes them on.
_HELD = 1 << 20
Kernel = Callable[[pa.Array], pa.Array]


class Phones:
    """The fields of all phones one after the other, and the segment that owns each."""

    def __init__(self, lists: pa.Array):
        values = lists.flatten()
        self.segments = len(lists)
        self.none = lists.is_null()
        self.counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(self.segments), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.fields = dict(zip([f.name for f in values.type], values.flatten(), strict=True))

    def numbers(self, name: str) -> np.ndarray:
        """A field as numbers; none is NaN."""
        return self.fields[name].to_numpy(zero_copy_only=False).astype(np.float64, copy=False)

    def names(self) -> tuple[np.ndarray, list[str | None]]:
        """The place of each phoneme in the list of the different ones."""
        coded = self.fields["phoneme"]
        coded = coded if pa.types.is_dictionary(coded.type) else coded.dictionary_encode(null_encoding="encode")
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()

    def place(self) -> np.ndarray:
        return np.arange(len(self.owner)) - np.repeat(self.first, self.counts)


def _timed(p: Phones) -> np.ndarray:
    start, end = p.numbers("start_sec"), p.numbers("end_sec")
    return (start >= 0) & (end > start) & (end < np.inf)


def well_timed(lists: pa.Array) -> pa.Array:
    """Are there phones, all of them named, in range, ordered and without overlap?"""
    p = Phones(lists)
    start, end, confidence = (p.numbers(n) for n in ("start_sec", "end_sec", "confidence"))
    codes, names = p.names()
    good = _timed(p) & (confidence >= 0) & (confidence <= 1) & np.array([n is not None and _NOT_BLANK.search(n) is not None for n in names], dtype=bool)[codes]
    good[1:] &= (p.owner[1:] != p.owner[:-1]) | (start[1:] >= end[:-1] - 1e-6)
    return pa.array((p.counts > 0) & (np.bincount(p.owner[~good], minlength=p.segments) == 0))


def known_phones(known: tuple[str, ...]) -> Kernel:
    """The different soundly timed phonemes of each segment that ``known`` has, in order of appearance."""
    place = {n: i for i, n in enumerate(known)}

    def run(lists: pa.Array) -> pa.Array:
        p = Phones(lists)
        codes, names = p.names()
        number = np.array([place.get(n, -1) for n in names], dtype=np.int64)[codes]
        at = np.flatnonzero(_timed(p) & (number >= 0))
        first = np.full(p.segments * len(known), -1, dtype=np.int64)
        first[(p.owner[at] * len(known) + number[at])[::-1]] = at[::-1]  # the last one written is the earliest
        found = np.sort(first[first >= 0])
        ends = np.cumsum(np.bincount(p.owner[found], minlength=p.segments))
        offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[p.none.to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, pa.array(known, pa.string()).take(pa.array(number[found])))

    return run


def _listed(value: Callable[[Phones], pa.Array]) -> Kernel:
    def run(lists: pa.Array) -> pa.Array:
        p = Phones(lists)
        offsets = pa.array(np.r_[0, np.cumsum(p.counts)].astype(np.int32), mask=np.r_[p.none.to_numpy(zero_copy_only=False), False])
        return pa.ListArray.from_arrays(offsets, value(p))

    return run


#: Parallel lists of names, lengths and times, as singing sets have them.
ITEM_LISTS: dict[str, Kernel] = {
    "phones": _listed(lambda p: p.fields["phoneme"]),
    "durations": _listed(lambda p: pa.array(np.maximum(0.0, p.numbers("end_sec") - p.numbers("start_sec")))),
    "starts": _listed(lambda p: p.fields["start_sec"]), "ends": _listed(lambda p: p.fields["end_sec"]),
}


def _double_text(x: float) -> str:
    """A large or odd number as the engine writes it."""
    if x != x:
        return "NaN"
    if abs(x) == np.inf:
        return "Infinity" if x > 0 else "-Infinity"
    mantissa, power = repr(x), 0
    sign, mantissa = ("-", mantissa[1:]) if mantissa.startswith("-") else ("", mantissa)
    if "e" in mantissa:
        mantissa, exponent = mantissa.split("e")
        power = int(exponent)
    whole, _, rest = mantissa.partition(".")
    rest = "" if rest == "0" else rest
    power += len(whole) - 1
    shown = (whole[1:] + rest).rstrip("0") or "0"
    return f"{sign}{whole[0]}.{shown}E{power}"


def _quoted(text: str) -> str:
    """A JSON string as the engine writes it: control characters with capital digits."""
    return re.sub(r"\\u00[0-9a-f]{2}", lambda m: m[0][:2] + m[0][2:].upper(), json.dumps(text, ensure_ascii=False))


def plain_phones(lists: pa.Array) -> pa.Array:
    """The text that ``fingerprints.plain`` gives for a list of phones: times in billionths, in a JSON list of JSON lists."""
    p = Phones(lists)
    codes, names = p.names()
    values = [p.numbers(n) for n in ("start_sec", "end_sec", "confidence")]
    usual = None not in names and all((np.abs(x) < 9e9).all() for x in values)
    if usual:
        heads = pa.array(['"[' + _quoted(_quoted(n))[1:-3] for n in names], pa.string()).take(pa.array(codes))
        numbers = [pa.array(np.rint(x * 1e9).astype(np.int64)).cast(pa.string()) for x in values]
        each, between, close = pc.binary_join_element_wise(heads, *numbers, '\\",\\"'), '\\"]",', '\\"]"'
    else:
        def text(x: float, none: bool) -> str | None:
            return None if none else str(int(np.rint(x * 1e9))) if abs(x) < 9e9 else _double_text(x)

        nulls = [p.fields[n].is_null().to_pylist() for n in ("start_sec", "end_sec", "confidence")]
        shown = [[text(x, none) for x, none in zip(v.tolist(), m, strict=True)] for v, m in zip(values, nulls, strict=True)]
        rows = ([names[c], *more] for c, *more in zip(codes.tolist(), *shown, strict=True))
        each = pa.array([_quoted("[" + ",".join("null" if x is None else _quoted(x) for x in r) + "]") for r in rows], pa.string())
        between, close = ",", ""
    offsets = pa.array(np.r_[0, np.cumsum(p.counts)].astype(np.int64))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, each), between)
    ends = pa.array([close + "]", "]"]).take(pa.array((p.counts == 0).astype(np.int8)))
    made = pc.binary_join_element_wise(pa.array(["["]).take(pa.array(np.zeros(p.segments, dtype=np.int8))), joined.cast(pa.string()), ends, "")
    return pc.if_else(p.none, pa.scalar(None, pa.string()), made)


def _number_parts(values: pa.Array, rounded: bool) -> list[np.ndarray]:
    """Eight bytes a number, and what they are: billionths, the number itself (zero without a sign), or nothing."""
    kind = np.where(values.is_null().to_numpy(zero_copy_only=False), 2, 1).astype(np.uint8)
    if pa.types.is_integer(values.type):
        return [values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), kind]
    x = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) + 0.0
    odd = np.isnan(x)
    if odd.any():
        x[odd] = np.nan
    bits = x.view(np.int64)
    if rounded:
        small = np.abs(x) < 9e9
        if small.all():
            return [np.rint(x * 1e9).astype(np.int64), np.zeros(len(x), dtype=np.uint8)]
        bits = np.where(small, np.rint(np.where(small, x, 0.0) * 1e9).astype(np.int64), bits)
        kind[small] = 0
    return [bits, kind]


def _text_parts(values: pa.Array) -> list:
    """The length of each text (-1 for none), and the bytes of all with the place where each starts."""
    none = values.is_null().to_numpy(zero_copy_only=False)
    texts = pa.array([""], pa.string()).take(pa.array(np.zeros(len(values), dtype=np.int8))) if pa.types.is_null(values.type) else values.cast(pa.string()).fill_null("")
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    lengths = np.where(none, -1, np.diff(starts)).astype(np.int32)
    return [lengths, (memoryview(texts.buffers()[2] or b""), starts)]


def _prints(counts: np.ndarray, none: np.ndarray, fields: list[pa.Array], rounded: bool = False) -> pa.Array:
    """SHA-256 of each list of values, field by field in their binary form; equal if and only if all values are."""
    parts = []
    for f in fields:
        text = pa.types.is_string(f.type) or pa.types.is_dictionary(f.type) or pa.types.is_null(f.type)
        parts += _text_parts(f) if text else _number_parts(f, rounded)
    ends, made = np.cumsum(counts), []
    for first, last, n, nothing in zip((ends - counts).tolist(), ends.tolist(), counts.tolist(), none.tolist(), strict=True):
        if nothing:
            made.append(None)
            continue
        h = hashlib.sha256(b"%d:" % n)
        for part in parts:
            h.update(part[0][part[1][first] : part[1][last]] if isinstance(part, tuple) else part[first:last])
        made.append(h.digest())
    return pa.array(made, pa.binary())


def list_print(lists: pa.Array) -> pa.Array:
    """SHA-256 of each list of numbers or texts; no list, no digest."""
    counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _prints(counts, lists.is_null().to_numpy(zero_copy_only=False), [lists.flatten()])


def _encoded(p: Phones, alphabet: dict[str, str]) -> pa.Array:
    """The aligner's spelling of every phone, or none."""
    codes, names = p.names()
    return pa.array([alphabet.get(n) for n in names], pa.string()).take(pa.array(codes))


def _whole(p: Phones, fields: list[pa.Array], none: np.ndarray) -> pa.Array:
    missing = np.zeros(len(p.owner), dtype=bool)
    for f in fields:
        missing |= f.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.bincount(p.owner[missing], minlength=p.segments) == 0, mask=none)


_TIMES = ["start_sec", "end_sec", "confidence"]


def segment_prints(lists: pa.Array, alphabet: dict[str, str]) -> pa.StructArray:
    """What an audit asks of a segment's phones: how many, and digests of them and of the labels an aligner gives them."""
    p = Phones(lists)
    none = p.none.to_numpy(zero_copy_only=False)
    phones, labels = [p.fields[f] for f in ("phoneme", *_TIMES)], [_encoded(p, alphabet), p.fields["start_sec"], p.fields["end_sec"]]
    return pa.StructArray.from_arrays([
        pa.array(p.counts.astype(np.int32), mask=none), _prints(p.counts, none, phones), _whole(p, phones, none),
        _prints(p.counts, none, labels), _whole(p, labels, none)], ["n", "phones", "phones_whole", "labels", "labels_whole"])


def known_by(lists: pa.Array, entries: pa.Array) -> pa.StructArray:
    """Digests of a record's phones and intervals, in billionths."""
    p, e = Phones(lists), Phones(entries)
    return pa.StructArray.from_arrays([
        _prints(p.counts, p.none.to_numpy(zero_copy_only=False), [p.fields[f] for f in ("phoneme", *_TIMES)], True),
        _prints(e.counts, e.none.to_numpy(zero_copy_only=False), [e.fields[f] for f in ("label", "start", "end")], True)], ["phones_print", "entries_print"])


def record_prints(lists: pa.Array, entries: pa.Array, duration: pa.Array) -> pa.StructArray:
    """What an audit asks of a record: its phones, whether they are inside, its voiced intervals, and what it is known by."""
    p, e = Phones(lists), Phones(entries)
    none, no_entries = p.none.to_numpy(zero_copy_only=False), e.none.to_numpy(zero_copy_only=False)
    phones, said = [p.fields[f] for f in ("phoneme", *_TIMES)], [e.fields[f] for f in ("label", "start", "end")]
    length, end = duration.to_numpy(zero_copy_only=False).astype(np.float64)[p.owner], p.numbers("end_sec")
    there = p.fields["end_sec"].is_valid().to_numpy(zero_copy_only=False) & duration.is_valid().to_numpy(zero_copy_only=False)[p.owner]
    outside = ~(there & ((end <= length) | np.isnan(length)))  # NaN is above every number
    voiced = pc.invert(pc.is_in(said[0], value_set=pa.array(["", "sil"]))).to_numpy(zero_copy_only=False) & said[0].is_valid().to_numpy(zero_copy_only=False)
    at = pa.array(np.flatnonzero(voiced))
    many, labels = np.bincount(e.owner[voiced], minlength=e.segments), [f.take(at) for f in said]
    missing = np.zeros(len(at), dtype=bool)
    for f in labels:
        missing |= f.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([
        pa.array(p.counts.astype(np.int32), mask=none), pa.array(np.bincount(p.owner[outside], minlength=p.segments) == 0, mask=none),
        pa.array(many.astype(np.int32), mask=no_entries), _prints(p.counts, none, phones), _whole(p, phones, none), _prints(many, no_entries, labels),
        pa.array(np.bincount(e.owner[voiced][missing], minlength=e.segments) == 0, mask=no_entries), *known_by(lists, entries).flatten(),
    ], ["n", "inside", "voiced", "phones", "phones_whole", "labels", "labels_whole", "phones_print", "entries_print"])


def read_intervals(lists: pa.Array, entries: pa.Array, duration: pa.Array, alphabet: dict[str, str], eps: float) -> tuple[pa.Array, pa.Array]:
    """(problem, timed) as ``text.read_intervals`` has them; ``lists`` are the expected phones, named only."""
    p, e = Phones(lists), Phones(entries)
    codes, names = p.names()
    labels = e.fields["label"] if pa.types.is_dictionary(e.fields["label"].type) else e.fields["label"].dictionary_encode()
    said, number = labels.dictionary.to_pylist(), {}
    want = np.array([number.setdefault(alphabet[n], len(number)) if n in alphabet else -1 for n in names], dtype=np.int64)[codes]
    label = labels.indices.fill_null(len(said)).to_numpy(zero_copy_only=False).astype(np.int64)
    voiced = np.array([x not in ("", "sil") for x in said] + [False], dtype=bool)[label]
    spoken = np.array([number.get(x, -2) for x in said] + [-2], dtype=np.int64)[label]
    bad = lambda owner: np.bincount(owner, minlength=p.segments) > 0
    without = bad(p.owner[want < 0]) | (p.counts == 0)
    length = duration.to_numpy(zero_copy_only=False).astype(np.float64)
    no_length = ~((length > 0) & (length < np.inf))
    start, end = e.numbers("start"), e.numbers("end")
    before = np.r_[0.0, end[:-1]][: len(end)]
    before[e.first[e.counts > 0]] = 0.0
    named = np.array([x is not None for x in said] + [False], dtype=bool)[label]
    good = np.isfinite(start) & np.isfinite(end) & (start >= before - eps) & (end > start) & (end <= length[e.owner]) & named
    many = np.bincount(e.owner[voiced], minlength=e.segments)
    same = many == p.counts
    mine, theirs = same[p.owner], np.flatnonzero(voiced)[same[e.owner[voiced]]]
    other = ~same | bad(p.owner[mine][want[mine] != spoken[theirs]])
    rules = [(without, "phone_without_code"), (no_length, "bad_duration"), (e.counts == 0, "no_intervals"), (bad(e.owner[~good]), "bad_interval"), (other, "labels_disagree")]
    code = np.select([r for r, _ in rules], list(range(len(rules))), len(rules))
    problem = pa.array([*[n for _, n in rules], None], pa.string()).take(pa.array(code))
    fine = code == len(rules)
    rows, at = pa.array(np.flatnonzero(fine[p.owner])), pa.array(np.flatnonzero(voiced)[fine[e.owner[voiced]]])
    fields = [p.fields["phoneme"].take(rows), e.fields["start"].take(at), e.fields["end"].take(at), pa.array(np.zeros(len(rows)))]
    offsets = pa.array(np.r_[0, np.cumsum(np.where(fine, p.counts, 0))].astype(np.int32), mask=np.r_[~fine, False])
    return problem, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["phoneme", *_TIMES]))


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def unobserved(p: Phones, start: np.ndarray, end: np.ndarray, duration: np.ndarray, eps: float = 1e-6) -> Spans:
    """Owner, start and end of the parts of [0, duration] that no interval covers."""
    before = np.r_[0.0, end[:-1]][: len(end)]
    before[p.first[p.counts > 0]] = 0.0
    gap = start > before + eps
    last = np.zeros(p.segments)
    last[p.counts > 0] = end[(p.first + p.counts - 1)[p.counts > 0]]
    tail = np.flatnonzero(duration > last + eps)
    return np.r_[p.owner[gap], tail], np.r_[before[gap], last[tail]], np.r_[start[gap], duration[tail]]


def totals(segments: int, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """How many spans each segment has, and their seconds."""
    owner, start, end = spans
    return np.bincount(owner, minlength=segments), np.bincount(owner, weights=end - start, minlength=segments)


def longest(p: Phones, end: np.ndarray) -> np.ndarray:
    """The latest end of each segment, zero without phones."""
    out = np.zeros(p.segments)
    some = p.counts > 0
    if some.any():
        out[some] = np.maximum.reduceat(end, p.first[some])
    return out


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of whole numbers below ``sizes``, and how often each occurs."""
    space = 1
    for s in sizes:
        space *= max(s, 1)
    if space >= 1 << 62:
        rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(rows.T), n
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c, s in zip(columns, sizes, strict=True):
        code = code * max(s, 1) + c
    if space <= 4 * len(code) + (1 << 16):
        n = np.bincount(code)
        code = np.flatnonzero(n)
        n = n[code]
    else:
        code, n = np.unique(code, return_counts=True)
    out = []
    for s in reversed(sizes):
        out.append(code % max(s, 1))
        code = code // max(s, 1)
    return out[::-1], n


def counted(keys: list[str], item: str, around: bool):
    """Rows (keys, item, n): how often each phoneme, or each phoneme between its two neighbours, occurs.

    Sums inside a task, a partial aggregate for the shuffle that follows.
    """

    def one(b: pa.RecordBatch) -> pa.Table:
        p = Phones(b.column("phonemes"))
        codes, names = p.names()
        groups = [b.column(k).dictionary_encode(null_encoding="encode") for k in keys]
        columns = [g.indices.to_numpy(zero_copy_only=False).astype(np.int64)[p.owner] for g in groups]
        sizes = [len(g.dictionary) for g in groups]
        shown = pa.array([*names, "<BOS>", "<EOS>"], pa.string())
        known = np.array([n is not None for n in names], dtype=bool)
        if around:
            first, last = p.first[p.counts > 0], (p.first + p.counts - 1)[p.counts > 0]
            before, after = np.roll(codes, 1), np.roll(codes, -1)
            if len(codes):
                before, after = np.where(known[before], before, len(names)), np.where(known[after], after, len(names) + 1)
                before[first], after[last] = len(names), len(names) + 1
            columns += [before, codes, after]
            sizes += [len(names) + 2] * 3
        else:
            columns.append(codes)
            sizes.append(len(names))
        found, n = _distinct(columns, sizes)
        taken = [g.dictionary.take(pa.array(f)) for g, f in zip(groups, found, strict=False)]
        parts = [shown.take(pa.array(f)) for f in found[len(keys):]]
        text = pc.binary_join_element_wise(*parts, "|", null_handling="skip") if around else parts[0]
        return pa.table([*taken, text, pa.array(n.astype(np.int64))], names=[*keys, item, "n"])

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by([*keys, item]).aggregate([("n", "sum")])
        return t.select([*keys, item, "n_sum"]).rename_columns([*keys, item, "n"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(one(b))
            rows += held[-1].num_rows
            if rows > _HELD:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > _HELD // 2:  # they are different: nothing is gained by holding them
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    return run


def added(kernels: dict[str, Kernel], drop: tuple[str, ...] = ("phonemes",)):
    """The batches without the columns in ``drop``, with a column for each kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [n for n in b.schema.names if n not in drop]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], *[k(b.column("phonemes")) for k in kernels.values()]], [*kept, *kernels])

    return run
