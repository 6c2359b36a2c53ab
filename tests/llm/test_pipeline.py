"""The five stages, each on what the one before kept, against brute force."""

from collections import Counter
import zlib

import corpus_pipeline
from rows import frame, given, with_clashes
from test_documents import UPPER, host_rule
from test_nearcopies import pairs_of
from voxloom.llm import mixing, packing
from voxloom.llm.common import stored

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = given(spark)
    rows = docs.collect()
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5

    good = {w[0] for w in host_rule([(r.doc_id, r.source, r.text) for r in rows]) if w[-1]}
    kept = stored(stage["quality rules"](spark, docs, SF_DIR))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good

    last = {}
    for r in rows:
        if r.doc_id in good:
            last[r.text.translate(UPPER)] = max(r.doc_id, last.get(r.text.translate(UPPER), -1))
    kept = stored(stage["exact dedup"](spark, kept, SF_DIR))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(last.values())

    before = {r.doc_id: r.text for r in kept.collect()}
    kept = stored(stage["SimHash near-dedup"](spark, kept, SF_DIR))
    stays = {r.doc_id for r in kept.collect()}
    close = pairs_of(list(before.items()))
    assert kept.columns == docs.columns and len(close) >= 2 and not [p for p in close if set(p) <= stays]
    assert all(i in stays or any(i in p for p in close) for i in before)

    taken = {r.doc_id: r.taken for r in mixing.report(kept).collect() if r.taken}
    mixed = stored(stage["mixing sources"](spark, kept, SF_DIR))
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert mixed.columns == docs.columns and words.keys() == taken.keys()

    want = Counter()
    for r in mixed.collect():
        ids = packing.token_ids(r.text)
        head = (len(ids) - 1) % 1024 + 1
        for k, s in enumerate([0, *range(head, len(ids), 1024)]):
            want[(r.doc_id, k, zlib.crc32(ids[s : s + (head if k == 0 else 1024)].tobytes()))] += 1
    packed = stage["best-fit packing"](spark, mixed, SF_DIR).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want
    same = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in same) == want


def test_stages_take_odd_rows_and_empty_tables(spark):
    clashing = with_clashes(frame(spark))
    for docs in (frame(spark), frame(spark, []), clashing):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stored(stage(spark, docs, SF_DIR))
            if name != "best-fit packing":
                assert docs.columns == before.columns
            if name in ("quality rules", "exact dedup", "SimHash near-dedup"):
                assert docs.exceptAll(before).count() == 0  # rows go, none is new or changed
            assert (docs.count() == 0) == (before.count() == 0)
