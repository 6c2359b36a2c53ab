"""Personal data by weak supervision.

Emails, addresses of machines, payment cards and phone numbers are found by rule and always stay. Other
candidates, long tokens that mix letters and digits, are labelled by four voters: the shape of the
token (a regular expression), a gazetteer of credential prefixes, the word before it, and its mix of
digits. Expectation-maximisation over the counts of vote patterns estimates how reliable each voter
is. Its posteriors train the final classifier, a naive Bayes model over votes, length and digit share;
candidates it gives ``ACCEPT`` or more become spans of the kind ``secret``.

There are at most 81 vote patterns and 20 feature cells, so the table of counts that comes to the
driver has at most 1,620 rows whatever the corpus; texts and spans never do. All work on rows is
DataFrame functions.

Null text is empty. Texts of any length are searched whole; work grows with the text and, by a
logarithm more, with its hits. Repeated rows and null ids
are returned as they come; extra columns are not read; an empty table gives an empty table. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.measure import let
from voxloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: The rules, with possessive repeats where a repeat cannot give back, so that no text is searched twice.
#: Digits or name characters right after an earlier hit may start a new one: \\G is the end of the last.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"

#: Prefixes that credentials carry, and words that announce one.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "hf_", "npm_")
WORDS = ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "credential", "bearer", "auth", "access_key", "id_token", "session", "passport", "iban", "ssn")
ACCEPT = 0.9
VOTERS = 4
_SPAN = "array<struct<start: int, end: int, hit: string, before: string>>"


def scan(values: Column, combine) -> Column:
    """Running ``combine`` (of two numbers) over an array, in as many rounds as its length has binary digits.

    Each round takes in the value 1, 2, 4, ... places before; a fold that appends would copy its result
    at every step.
    """
    rounds = F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), F.when(F.size(values) > 1, F.length(F.bin(F.size(values) - 1))).otherwise(F.lit(0)))

    def one(done: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(done, lambda v, i: F.when(i < back, v).otherwise(combine(v, F.get(done, i - back))))

    return F.aggregate(rounds, values, one)


def hits(text: Column, rule: str) -> Column:
    """All leftmost non-overlapping hits: (start, end, hit, the 40 characters before it)."""
    found, between = F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.split(text, rule, -1)
    pairs = F.filter(F.zip_with(between, found, lambda b, h: F.struct(b.alias("between"), h.alias("hit"))), lambda p: p["hit"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = scan(F.transform(pairs, lambda p: F.length(p["between"]) + F.length(p["hit"])), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, end: F.struct(
            (end - F.length(p["hit"])).alias("start"), end.alias("end"), p["hit"].alias("hit"), F.right(p["between"], F.lit(40)).alias("before"),
        ))

    return let(pairs, lambda p: F.when(F.size(p) == 0, F.array().cast(_SPAN)).otherwise(placed(p)))


def apart(tokens: Column, others: Column) -> Column:
    """The tokens that overlap none of the other spans.

    Both stand in one array by start; running maxima of the ends before, and of the negated starts after,
    tell what is next to each token.
    """
    last = F.lit(2**31 - 1)
    marked = F.concat(
        F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t.alias("token"))),
        F.transform(others, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast(_SPAN[6:-1]).alias("token"))),
    )

    def free(rows: Column) -> Column:
        ends = scan(F.transform(rows, lambda r: F.when(r["token"].isNull(), r["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(scan(F.transform(F.reverse(rows), lambda r: F.when(r["token"].isNull(), -r["start"]).otherwise(-last)), F.greatest))
        joined = F.zip_with(F.zip_with(rows, ends, lambda r, e: F.struct(r["token"].alias("token"), e.alias("before"))), starts, lambda r, s: F.struct(
            r["token"].alias("token"), ((r["before"] <= r["token"]["start"]) & (-s >= r["token"]["end"])).alias("free")))
        return F.transform(F.filter(joined, lambda r: F.coalesce(r["free"], F.lit(False))), lambda r: r["token"])

    return F.when((F.size(tokens) == 0) | (F.size(others) == 0), tokens).otherwise(let(F.sort_array(marked), free))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    figures = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(figures, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid spans by kind as listed, then start: (kind, start, end)."""
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    digit = text.rlike("[0-9]")
    ways = {"email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, digit), "card": (CARD, digit), "phone": (PHONE, F.contains(text, F.lit("+")) & digit)}
    found = []
    for kind, (rule, possible) in ways.items():
        found.append(F.when(possible, _checked(text, kind, rule)).otherwise(none))
    return F.concat(*found)


def _checked(text: Column, kind: str, rule: str) -> Column:
    good = F.filter(hits(text, rule), lambda s: _valid(kind, s["hit"]))
    return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _votes(s: Column) -> Column:
    """Votes of 0 (no), 1 (none) or 2 (yes), and the feature cell, packed into one number."""
    hit, before = s["hit"], F.lower(s["before"])
    figures = F.length(_digits(hit)) / F.length(hit)
    shape = F.when(hit.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Z]{4}[0-9A-Z]{16}|[A-Za-z0-9_-]{36,})$"), 2).when(hit.rlike(r"^[0-9-]+$"), 0).otherwise(1)
    prefix = F.when(hit.rlike("^(?:" + "|".join(PREFIXES) + ")"), 2).otherwise(1)
    word = F.regexp_extract(before, r"([a-z_]+)[^a-z_]*$", 1)
    context = F.when(word.isin(*WORDS), 2).when(before.rlike(r"[=:][\x20\"']*$"), 1).otherwise(0)
    mixed = F.when(hit.rlike("[A-Za-z]") & figures.between(0.15, 0.85), 2).when(figures > 0.95, 0).otherwise(1)
    length = F.least(F.floor(F.length(hit) / 8), F.lit(6)) - 2
    share = F.least(F.floor(figures * 4), F.lit(3))
    code = ((shape * 3 + prefix) * 3 + context) * 3 + mixed
    return (code * 20 + F.greatest(length, F.lit(0)) * 4 + share).cast("int")


def expectation(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list, dict]:
    """EM over vote patterns with two classes: the share of true ones, each voter's vote rates by class,
    and the posterior of each pattern. Starts from the majority of the votes."""
    yes = {p: 1 / (1 + math.exp(-1.5 * sum(v - 1 for v in p))) for p in counts}
    share, rates = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * (yes[p] if c else 1 - yes[p]) for p, n in counts.items()) for c in (0, 1)]
        share = (mass[1] + 1) / (sum(mass) + 2)
        rates = [
            [[(sum(n * (yes[p] if c else 1 - yes[p]) for p, n in counts.items() if p[k] == v) + 1) / (mass[c] + 3) for v in range(3)] for c in (0, 1)]
            for k in range(VOTERS)
        ]
        for p in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(p))
            yes[p] = 1 / (1 + math.exp(-max(min(odds, 500), -500)))
    return share, rates, yes


def _unpack(code: int) -> tuple[tuple[int, ...], int]:
    votes, cell = divmod(code, 20)
    return tuple(votes // 3**k % 3 for k in reversed(range(VOTERS))), cell


def accepted(counts: dict[int, int]) -> list[int]:
    """The packed votes and features that the trained classifier accepts."""
    patterns: dict[tuple[int, ...], float] = {}
    for code, n in counts.items():
        patterns[_unpack(code)[0]] = patterns.get(_unpack(code)[0], 0) + n
    if not patterns:
        return []
    share, rates, yes = expectation(patterns)
    cells = [[1.0] * 20, [1.0] * 20]
    for code, n in counts.items():
        votes, cell = _unpack(code)
        cells[1][cell] += n * yes[votes]
        cells[0][cell] += n * (1 - yes[votes])
    out = []
    for code in counts:
        votes, cell = _unpack(code)
        odds = math.log(share / (1 - share)) + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(votes))
        odds += math.log(cells[1][cell] / sum(cells[1])) - math.log(cells[0][cell] / sum(cells[0]))
        if 1 / (1 + math.exp(-max(min(odds, 500), -500))) >= ACCEPT and sum(v - 1 for v in votes) > 0:
            out.append(code)
    return sorted(out)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra): arrays of (kind, start, end) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", base_spans(F.col("text")).alias("base"),
        F.when(F.col("text").rlike("[0-9]"), hits(F.col("text"), TOKEN)).otherwise(F.array().cast(_SPAN)).alias("tokens"),
    )
    free = apart(F.col("tokens"), F.col("base"))
    voted = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), _votes(t).alias("code")))
    table = stored(rows.select("doc_id", "base", voted.alias("tokens")))
    codes = table.select(F.explode("tokens.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    take = accepted({r["code"]: r["n"] for r in codes.collect()})  # at most 1,620 rows
    good = F.filter("tokens", lambda t: t["code"].isin(take) if take else F.lit(False))
    extra = F.transform(good, lambda t: F.struct(F.lit("secret").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return table.select("doc_id", "base", extra.alias("extra"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    return spans(docs).select(
        "doc_id", *map(_count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans")
    )


def mask(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every span replaced by its kind in brackets; overlapping spans by that of the first."""
    found = spans(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"))
    every = F.sort_array(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        text, free = done["text"], s["start"] >= done["at"]
        piece = F.concat(F.substring(done["text"], done["at"] + 1, s["start"] - done["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(free, F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"), text.alias("text"))

    text = F.coalesce(F.col("doc_id.text"), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), text.alias("text"))
    whole = F.aggregate(every, start, step, lambda d: F.concat(d["out"], F.substring(d["text"], d["at"] + 1, F.length(d["text"]))))
    return found.select("doc_id.doc_id", whole.alias("text"))
