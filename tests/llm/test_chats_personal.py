"""Chat formatting by exact round trips, personal data by plain loops."""

import hashlib
import random
import re

import pytest
from hypothesis import given as drawn, settings, strategies as st
from pyspark.sql import functions as F

from rows import frame, given, same, with_clashes
from voxloom.llm import chats, personal

turns = st.lists(st.tuples(st.text(alphabet="aé\\#:<>/turn\n ", max_size=20), st.text(alphabet="aé\\#:<>/turn \n", max_size=60)), max_size=6)


@settings(max_examples=300, deadline=None)
@drawn(turns)
def test_round_trip(said):
    said = said + [("assistant", "\\### Assistant: </turn> ok")]
    text, spans = chats.render(said)
    assert chats.parse(text) == said
    assert [chats.unescape(text[a:b]) for a, b in spans] == [t for r, t in said if r == "assistant"]
    assert text.count("###") == text.count("</turn>") == len(said)


def conversation_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn> ### x \\"), (1, 1, "assistant", None), (2, None, None, ""), (None, 3, "assistant", "é"),
            (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 5, "assistant", "x" * 100_000)] + [(5, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(37)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("node", "parent", "spans", "up")})


def expected(rows):
    none = lambda x: (x is not None, x if x is not None else 0)
    by = {}
    for r in sorted(rows, key=lambda r: (none(r.turn), (r.role is not None, r.role or ""), (r.text is not None, r.text or ""))):
        by.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    for conv, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        yield conv, len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chats.render(said)[0])


def test_conversations(spark):
    for table in (conversation_rows(spark), spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")):
        same(chats.report(table).collect(), expected(table.select("conv_id", "turn", "role", "text").collect()))
    assert chats.report(conversation_rows(spark).limit(0)).count() == 0


@pytest.mark.parametrize("branches", [1, 3])
def test_best_paths_of_trees(spark, branches):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        for node in range(1, 40):
            parent = rng.choice([None] * (node < 3) + list(range(max(1, node - 6), node)) or [None])
            rows.append((conv, node, parent, rng.randrange(9) / 4))
    table = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    up, score = {(c, n): (c, p) if p else None for c, n, p, _ in rows}, {(c, n): s for c, n, _, s in rows}
    ranked = {}
    for leaf in set(up) - set(up.values()):
        path = [leaf]
        while up[path[-1]]:
            path.append(up[path[-1]])
        ranked.setdefault(path[-1], []).append((-sum(score[x] for x in path) / len(path), leaf, path))
    want = [(n[0], leaf[1], n[1], k) for found in ranked.values() for _, leaf, path in sorted(found)[:branches] for k, n in enumerate(path)]
    same(chats.best_paths(table, branches).collect(), want)


def test_a_circle_is_an_error(spark):
    with pytest.raises(ValueError):
        chats.best_paths(spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], "conv_id long, node long, parent long, score double"))


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    good = {
        "email": lambda h: True, "ip": lambda h: all(int(p) <= 255 for p in h.split(".")),
        "card": lambda h: 13 <= len(d := re.sub("[^0-9]", "", h)) <= 19 and luhn(d), "phone": lambda h: 9 <= len(re.sub("[^0-9]", "", h)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, rule in RULES.items() for m in re.finditer(rule, text) if good[k](m[0])]


def odd_texts():
    rng = random.Random(8)
    texts = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485", "+1 ((((", "é a.b+c@x-y.zz é"]
    texts += ["".join(rng.choice("ab1.@+-() _%é") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -.+") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    texts += ["1 " * 20_000, "a" * 60_000, "1" * 40_000, "x@" + "a." * 9000, "+" + "1(" * 15_000]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("make", [frame, given, lambda s: frame(s, odd_texts())])
def test_personal_base(spark, make):
    docs = with_clashes(make(spark))
    rows = docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        found = base(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want.append((r.doc_id, *[sum(k == x[0] for x in found) for k in RULES], hashlib.sha256(joined.encode()).hexdigest()))
    out = personal.report(docs)
    same(out.select(*out.columns[:6]).collect(), want)


def test_personal_method(spark):
    docs = given(spark, "sf0.01")
    secret = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b[0-9a-f]{40}\b")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("secret:")] for r in personal.report(docs).collect()}
    assert sum(map(len, found.values())) > 0
    for i, text in texts.items():
        assert {f"secret:{m.start()}:{m.end()}" for m in secret.finditer(text)} <= set(found[i])
        for x in found[i]:
            _, a, b = x.split(":")
            assert re.fullmatch("[A-Za-z0-9_-]{16,}", text[int(a) : int(b)])
    masked = {r.doc_id: r.text for r in personal.mask(docs).collect()}
    for i, text in texts.items():
        assert not base(masked[i]) and (masked[i] == text or found[i] or base(text))
    assert personal.report(frame(spark, [])).count() == 0


def test_expectation_finds_the_reliable_voters():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        true = rng.random() < 0.3
        votes = tuple(2 * (true if rng.random() < p else not true) for p in (0.95, 0.9, 0.85, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    share, rates, yes = personal.expectation(counts)
    assert abs(share - 0.3) < 0.05 and rates[0][1][2] > 0.9 and rates[3][1][2] < 0.7
    assert yes[(2, 2, 2, 0)] > 0.9 > 0.1 > yes[(0, 0, 0, 2)]
