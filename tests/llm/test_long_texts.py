"""Texts of a few megabytes, and words made to collide."""

import re
import time

from pyspark.sql import functions as F
import pytest
from rows import frame
from voxloom.llm import languages, packing, personal, recompression


def timed(limit, run):
    start = time.perf_counter()
    out = run()
    assert time.perf_counter() - start < limit
    return out


@pytest.fixture(scope="module")
def warm(spark):
    rows = [(1, "call 10.0.0.1 or ghp_0123456789abcdef", "en", "a", 1)]
    personal.report(frame(spark, rows)).collect()
    packing.report(frame(spark, rows)).collect()
    return spark


def test_two_million_blanks_are_packed(warm):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = " " * 2_000_000
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text).tolist() == [*ids, 2]
    out = timed(20, lambda: packing.report(frame(warm, [(1, text, "en", "a", 1)])).collect())
    assert sum(r.length for r in out) == len(ids) + 1


def test_many_hits_in_one_text(warm):
    text = "10.0.0.1, 4111111111111111 key=ghp_0123456789abcdef0123 " * 36_000  # 2 MB
    out = timed(20, lambda: personal.report(frame(warm, [(1, text, "en", "a", 1)])).collect())[0]
    assert (out.n_ip, out.n_card, out.n_email) == (36_000, 36_000, 0)
    assert [x for x in out.spans.split(",") if x.startswith("ip")] == [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"10\.0\.0\.1", text)]


def test_tokens_apart_from_other_spans(spark):
    import random

    rng = random.Random(3)

    def some(n):
        return sorted((s, s + rng.randrange(1, 9)) for s in (rng.randrange(120) for _ in range(rng.randrange(n))))

    rows = [(i, [(s, e, "h", "b") for s, e in some(9)], [("ip", s, e) for s, e in some(7)]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t array<struct<start:int,end:int,hit:string,before:string>>, o array<struct<kind:string,start:int,end:int>>")
    for r, (_, tokens, others) in zip(sorted(df.select("i", personal.apart(F.col("t"), F.col("o")).alias("x")).collect()), rows, strict=True):
        want = [(s, e) for s, e, _, _ in tokens if not any(a < e and s < b for _, a, b in others)]
        assert sorted((x.start, x.end) for x in r.x) == sorted(want)


@pytest.mark.parametrize("page", ["<!--" * 500_000, "<script" * 280_000, "<" * 2_000_000, "<style></script><" * 100_000])
def test_unclosed_markup(page):
    hidden = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    assert timed(10, lambda: languages.visible(page)) is not None
    small = page[:600]
    assert languages.visible(small) == hidden.sub(" ", small)


def test_words_that_collide_under_fixed_polynomials(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    head = "one two three four five six seven eight nine ten eleven twelve "
    rows = [(1, head + word, "en", "s", 1), (2, head + other, "en", "s", 1), (3, head + word, "en", "s", 1)]
    assert {r.doc_id: r.n_removed for r in recompression.dedup(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 13}
