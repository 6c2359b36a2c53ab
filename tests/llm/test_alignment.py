"""Token alignment against the definition: bytes, offsets and pairs, one document after the other."""

from collections import Counter, defaultdict
from functools import cache
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from rows import frame, given, same, with_clashes
import sentencepiece
from tokenizers import Tokenizer
from voxloom.llm import alignment, tokens


@cache
def loaded():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def both(text):
    """Tokens of either side as (id, start, end), or none."""
    a, b = loaded()
    letters = tokens.letters()
    if not text:
        return [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text, num_threads=1)
    spelt_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    spelt_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(spelt_a) != (" " + text).encode() or b"".join(spelt_b) != (" " + text).encode():
        return [], []

    def placed(ids, spelt):
        at, out = 0, []
        for i, s in zip(ids, spelt, strict=True):
            out.append((i, at, at + len(s)))
            at += len(s)
        return out

    return placed(ids_a, spelt_a), placed(ids_b, spelt_b)


def brute(rows):
    docs, held = [], Counter()
    for doc_id, text in rows:
        a, b = both(text)
        links, i = [], 0
        for x, s, e in a:
            while i and b[i - 1][2] > s:
                i -= 1
            while i < len(b) and b[i][1] < e:
                if b[i][2] > s:
                    links.append((x, b[i][0]))
                i += 1
        held.update(set(links))
        docs.append((doc_id, a, b, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, a, b, links in docs:
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        text = ";".join(
            ",".join(str(i) for i, _, e in a if s < e <= t) + "|" + ",".join(str(i) for i, _, e in b if s < e <= t) for s, t in zip([0, *cuts], cuts)
        ) if len(cuts) < 400 else None
        out.append((
            doc_id, len(a), len(b), len(cuts), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
            ("" if not a else hashlib.sha256(text.encode()).hexdigest()) if text is not None else None,
        ))
    return out


def check(got, rows):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(rows)
    long = {w[0] for w in want if w[-1] is None}
    got = [tuple(r[n] for n in names) for r in got.collect()]
    same([g if g[0] not in long else (*g[:-1], None) for g in got], want)


ODD = [
    (1, "plain words, and more"), (2, None), (3, ""), (4, "<|endoftext|> and <s> are text"), (5, "a▁b is spelt otherwise"), (6, "\x00 nul \t tab\n\n"),
    (7, "  blanks   before"), (8, "日本語 é ß 🙂🙂"), (8, "日本語 é ß 🙂🙂"), (None, "no id"), (9, "<0x41> is no byte"), (10, " "), (11, "x" * 3000), (12, "ab" * 900 + " \r\n"),
]


def test_against_the_definition(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    check(alignment.report(odd, chunk_bytes=200), ODD)
    docs = given(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(alignment.report(docs.repartition(4), chunk_bytes=50_000), rows)


def test_odd_rows_clashing_names_and_empty_tables(spark):
    docs = frame(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(alignment.report(with_clashes(docs)), rows)
    assert alignment.report(frame(spark, [])).count() == 0


def test_groups_hold_all_tokens_in_order(spark):
    docs = spark.createDataFrame([x for x in ODD if x[0] != 8], "doc_id long, text string")
    texts = {x[0]: x[1] for x in ODD}
    for r in alignment.groups(docs).collect():
        a, b = both(texts[r.doc_id])
        assert [i for g in r.groups for i in g.a] == [i for i, _, _ in a] and [i for g in r.groups for i in g.b] == [i for i, _, _ in b]
        assert all(len(g.a) and len(g.b) for g in r.groups)


@pytest.mark.parametrize("seed", range(5))
def test_gallop(seed):
    rng = np.random.default_rng(seed)
    into = np.cumsum(rng.integers(1, 1 + 10**seed, 500))
    keys = np.sort(rng.integers(0, into[-1] + 1, 300))
    guess = rng.integers(0, 500, 300)
    assert (alignment.gallop(keys, into, guess) == np.searchsorted(into, keys)).all()


def test_long_texts_and_blank_runs():
    for text in (" " * 1_500_000 + "end", "word " * 200_000, "\n" * 300_000):
        ids = tokens.byte_ids(text)
        assert b"".join(map(tokens.spelling(alignment.A).__getitem__, ids)).decode() == text
