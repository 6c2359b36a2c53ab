"""Language identification by fusing evidence.

The text gives likelihoods under byte-trigram models, one per language, fitted to a bounded sample of
labelled documents: at most ``TRAIN_DOCS`` per language, picked by a hash. The language that the markup
declares and the suffix of the address (top domain and a two-letter first path part) are noisy
observations; how they go with languages is counted over all items by grouped aggregation. Each host
has a prior: its own counts smoothed by those of its domain, which are smoothed by those of the whole
corpus. The posterior multiplies the four.

Items are documents (host: their source; no markup or address) and pages. Null or empty text leaves the
other evidence to decide, and with none the corpus prior. A null host is a host of its own. Ties go to
the language that sorts first. Repeated rows are items of their own; null ids are returned; extra
columns are not read. Without labelled documents the language is null. Any number of languages:
the driver and each task hold ``BINS`` numbers a language.
"""

from __future__ import annotations

from collections.abc import Iterator
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.llm.common import stored
from voxloom.session import ship_package

TRAIN_DOCS = 500
BINS = 1 << 13
#: Trigrams of a text are far from independent: their evidence counts this much.
TEMPER = 0.05
STRENGTH = 10.0
#: Before any count: so many items are taken to declare, or to have in their address, the language they are in.
HONEST = 5.0
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_OPEN = re.compile(r"(script|style)\b", re.I)


def _hidden(page: str, at: int, never: set[str]) -> int:
    """End of what the ``<`` at this place hides, or -1. ``never``: closings that do not come any more."""

    def closing(name: str, start: int) -> int:
        if name in never:
            return -1
        if name in _CLOSE:
            found = _CLOSE[name].search(page, start)
            end = found.end() if found else -1
        else:
            end = page.find(name, start)
            end += len(name) if end >= 0 else 0
        if end < 0:
            never.add(name)
        return end

    opened = _OPEN.match(page, at + 1)
    if opened and (end := closing(opened[1].lower(), opened.end())) >= 0:
        return end
    if page.startswith("<!--", at) and (end := closing("-->", at + 4)) >= 0:
        return end
    return closing(">", at + 1)


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags, in one pass."""
    text, out, at, never = page or "", [], 0, set()
    while (start := text.find("<", at)) >= 0:
        out.append(text[at:start])
        end = _hidden(text, start, never)
        out.append(" " if end >= 0 else "<")
        at = end if end >= 0 else start + 1
    return html.unescape("".join([*out, text[at:]]))


def trigrams(text: str | None) -> np.ndarray:
    """How often each hashed byte trigram occurs in a whole text."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BINS, dtype=np.int64)
    code = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BINS)


def fit(labelled: DataFrame, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of trigrams) from rows (doc_id, text, lang)."""
    ship_package(labelled.sparkSession)
    # First within buckets of each language, then among what they leave: no task ranks a whole language.
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    ids = labelled.where("lang is not null and doc_id is not null").select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("bucket"))
    for keys in (["lang", "bucket"], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= TRAIN_DOCS).drop("r")
    sample = labelled.select("doc_id", "lang", "text").join(stored(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[lang] = sums.get(lang, 0) + trigrams(text.as_py())
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bin", "n"])

    rows = sample.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()  # languages x BINS at most
    named = rows.column("lang").to_pylist()
    langs = sorted(set(named))
    place = {lang: k for k, lang in enumerate(langs)}
    counts = np.full((len(langs), BINS), 0.1)
    np.add.at(counts, ([place[lang] for lang in named], rows.column("bin").to_numpy()), rows.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def scored(items: DataFrame, logs: np.ndarray, markup: bool) -> DataFrame:
    """The items with ``likes``: the tempered log likelihood of their text under each language."""
    ship_package(items.sparkSession)
    names = [c for c in items.columns if c != "text"]
    table = logs.T.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            likes = []
            for text in b.column("text"):
                value = text.as_py()
                likes.append((trigrams(visible(value) if markup else value) @ table * TEMPER).tolist())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(likes, pa.list_(pa.float64()))], [*names, "likes"])

    kinds = dict(items.dtypes)
    return items.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", likes array<double>")


def from_documents(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def from_pages(pages: DataFrame) -> DataFrame:
    found = lambda text, rule: F.nullif(F.regexp_extract(text, rule, 1), F.lit(""))
    host = F.lower(found(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"))
    path = found(F.lower(F.col("url")), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)")
    rows = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    top = found(F.col("host"), r"\.([a-z]+)$")
    return rows.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"),
        F.lower(found(F.col("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})(?![a-z])")).alias("declared"),
        F.nullif(F.concat_ws("/", top, F.col("path")), F.lit("")).alias("suffix"), "host", found(F.col("host"), r"([^.]+\.[^.]+)$").alias("domain"),
    )


def fuse(items: DataFrame, langs: list[str]) -> DataFrame:
    """Posterior of every scored item: doc_id, page_id, lang, posterior, declared, host."""
    n = len(langs)
    if not n:
        return items.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), "declared", "host")
    best = F.array_position("likes", F.array_max("likes")).cast("int")
    told = F.coalesce(F.array_max("likes") < 0, F.lit(False))  # a text without trigrams says nothing
    rows = items.withColumn("best", F.when(told, best))

    def tallied(keys: list[str]) -> DataFrame:
        """By ``keys`` the number of items of each language, as an array ``n``; counted as (keys, language) rows."""
        pairs = rows.groupBy(*keys, "best").agg(F.count(F.lit(1)).alias("count"))
        held = pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "count")))).alias("held"))
        return held.withColumn("n", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))).drop("held")

    whole = (tallied([]).first() or {"n": [0] * n})["n"]  # one number a language
    total = sum(whole)
    prior = [(w + 1) / (total + n) for w in whole]

    def seen(column: str) -> DataFrame:
        """By value of noisy evidence: its log likelihood under each language, smoothed."""
        counts = tallied([column]).where(F.col(column).isNotNull())
        kinds = counts.agg(F.array(*[F.coalesce(F.sum(F.col("n")[k]), F.lit(0)) for k in range(n)]).alias("n"), F.count(F.lit(1)).alias("kinds")).first()
        scale = F.array(*[F.lit(float(x + 0.5 * kinds["kinds"] + HONEST)) for x in kinds["n"]])
        named = F.array(*[F.when((F.col(column) == x) | F.endswith(F.col(column), F.lit(f"/{x}")), HONEST).otherwise(0.0) for x in langs])
        held = F.zip_with("n", named, lambda a, b: a + b + 0.5)
        return stored(counts.select(column, F.zip_with(held, scale, lambda a, b: F.ln(a / b)).alias(f"{column}_log")))

    def smoothed(counts: Column, above: Column) -> Column:
        size = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    flat = F.array(*[F.lit(p) for p in prior])
    domains = tallied(["domain"]).where("domain is not null").select("domain", smoothed(F.col("n"), flat).alias("domain_prior"))
    of_host = rows.where("host is not null").groupBy("host").agg(F.max("domain").alias("domain"))
    hosts = tallied(["host"]).join(of_host, "host")
    hosts = hosts.join(domains, "domain", "left").select("host", F.transform(smoothed(F.col("n"), F.coalesce("domain_prior", flat)), F.ln).alias("host_log"))
    zero = F.array(*[F.lit(0.0)] * n)

    def told_by(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        """A left join in which rows without a value are dealt to a thousand keys that match nothing."""
        dealt = F.when(F.col(column).isNull(), 1 + F.pmod(F.xxhash64("doc_id", "page_id"), F.lit(1000))).otherwise(F.lit(0)).cast("int")
        left = left.withColumns({"key": F.coalesce(column, F.lit("")), "deal": dealt})
        right = right.withColumnRenamed(column, "key").withColumn("deal", F.lit(0))
        return left.join(right, ["key", "deal"], "left").drop("key", "deal")

    out = told_by(rows, seen("declared"), "declared")
    out = told_by(out, seen("suffix"), "suffix")
    out = told_by(out, stored(hosts), "host")
    parts = [F.col("likes"), F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero), F.coalesce("host_log", F.transform(flat, F.ln))]
    score = parts[0]
    for p in parts[1:]:
        score = F.zip_with(score, p, lambda a, b: a + b)
    out = out.select("doc_id", "page_id", "declared", "host", score.alias("score")).withColumn("high", F.array_max("score"))
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("high")))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select("doc_id", "page_id", F.get(names, F.array_position("score", F.col("high")).cast("int") - 1).alias("lang"), F.round(1 / mass, 6).alias("posterior"), "declared", "host")


def identify(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The language of every document and page. Labels are the documents' own ``lang``."""
    langs, logs = fit(docs.select("doc_id", "text", "lang"))
    items = scored(from_documents(docs), logs, False)
    if pages is not None:
        items = items.unionByName(scored(from_pages(pages), logs, True))
    return fuse(stored(items), langs)
