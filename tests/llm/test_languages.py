"""Language identification: accuracy on rows the model has not seen, and each kind of evidence."""

import numpy as np
import pytest

from rows import frame, given, with_clashes
from voxloom.llm import languages
from voxloom.llm.common import stored


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(languages, "TRAIN_DOCS", 40)
    docs = given(spark, "sf0.01")
    langs, logs = languages.fit(docs.select("doc_id", "text", "lang"))
    assert len(langs) == 4
    out = languages.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(out) == len(lang) and sum(r.lang == lang[r.doc_id] for r in out) > 0.97 * len(out)


def test_pages_follow_their_evidence(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = languages.identify(given(spark), pages).where("page_id is not null").collect()
    assert len(out) == pages.count()
    told = [r for r in out if r.declared]
    assert told and sum(r.lang == r.declared for r in told) > 0.9 * len(told)


def test_hosts_decide_where_text_is_silent(spark):
    docs = given(spark, "sf0.01")
    texts = {lang: [r.text for r in docs.where(f"lang = '{lang}'").limit(40).collect()] for lang in ("fr", "de")}
    rows = [(k, f"http://{lang}.site.org/x{k}", f"<p>{t}") for lang, found in texts.items() for k, t in enumerate(found, 100 * len(lang))]
    rows += [(9000, "http://fr.site.org/", ""), (9001, "http://de.site.org/", None), (9002, "http://new.site.org/de/", '<html lang="de">'), (9003, None, None), (None, "nonsense", "<p>")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = {r.page_id: r for r in languages.identify(docs, pages).where("doc_id is null").collect()}
    assert (out[9000].lang, out[9001].lang, out[9002].lang) == ("fr", "de", "de")
    assert out[9003].lang and out[None].lang and 0 < out[9003].posterior < out[9000].posterior


def test_odd_rows(spark):
    docs = with_clashes(frame(spark))
    out = languages.identify(docs).collect()
    assert len(out) == docs.count() and all(r.lang for r in out)
    none = frame(spark, [])
    assert languages.identify(none).count() == 0
    blank = frame(spark, [(1, "text", None, "a", 4)])
    assert [r.lang for r in languages.identify(blank).collect()] == [None]


def test_many_labels_and_whole_subtags(spark):
    docs = frame(spark, [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} " * 30, f"l{i:02d}", f"s{i % 9}", 1) for i in range(66)])
    out = languages.identify(docs).collect()
    assert len(out) == 66 and sum(r.lang == f"l{r.doc_id:02d}" for r in out) >= 60
    pages = spark.createDataFrame([(1, None, '<html lang="fil-PH">'), (2, None, "<html lang=EN>"), (3, None, '<html lang="english">')], "page_id long, url string, html string")
    found = {r.page_id: r.declared for r in languages.from_pages(pages).collect()}
    assert found == {1: "fil", 2: "en", 3: None}


def test_fusion_against_plain_counts(spark):
    docs = given(spark)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    langs, logs = languages.fit(docs.select("doc_id", "text", "lang"))
    items = languages.scored(languages.from_documents(docs), logs, False).unionByName(languages.scored(languages.from_pages(pages), logs, True))
    rows, n = items.collect(), len(langs)
    best = [int(np.argmax(r.likes)) if max(r.likes) < 0 else None for r in rows]

    def counts(pick):
        held = {}
        for r, b in zip(rows, best):
            if pick(r) is not None:
                held.setdefault(pick(r), np.zeros(n))[b if b is not None else slice(0, 0)] += 1
        return held

    def evidence(pick):
        held = counts(pick)
        total = sum(held.values(), np.zeros(n)) + 0.5 * len(held) + languages.HONEST
        said = {v: np.array([languages.HONEST * (v == x or v.endswith("/" + x)) for x in langs]) for v in held}
        return {v: np.log((c + said[v] + 0.5) / total) for v, c in held.items()}

    whole = sum(counts(lambda r: 0).values())
    flat = (whole + 1) / (whole.sum() + n)
    under = lambda c, p: (c + languages.STRENGTH * p) / (c.sum() + languages.STRENGTH)
    domains = {d: under(c, flat) for d, c in counts(lambda r: r.domain).items()}
    owner = {r.host: r.domain for r in rows}
    hosts = {h: under(c, domains.get(owner[h], flat)) for h, c in counts(lambda r: r.host).items()}
    declared, suffix = evidence(lambda r: r.declared), evidence(lambda r: r.suffix)
    got = {(r.doc_id, r.page_id): (r.lang, r.posterior) for r in languages.fuse(stored(items), langs).collect()}
    for r in rows:
        score = np.array(r.likes) + declared.get(r.declared, 0) + suffix.get(r.suffix, 0) + np.log(hosts.get(r.host, flat))
        lang, posterior = got[r.doc_id, r.page_id]
        mass = np.exp(score - score.max())
        assert lang == langs[int(np.argmax(score))] and abs(posterior - 1 / mass.sum()) < 2e-6


@pytest.mark.parametrize("page,text", [("<p>a&amp;b<script>x<y</script>c<!-- d -->e", "a&bce"), (None, "")])
def test_visible(page, text):
    assert languages.visible(page).replace(" ", "") == text
