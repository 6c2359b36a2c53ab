"""Quality rules at the level of hosts.

Each document is measured inside its own row. Rule failures are counted by host, each host's rates
are shrunk towards the corpus with a beta prior fitted to all hosts, and the verdict on the host is
joined back to its documents. A document goes if it breaks a rule itself or if its host is refused.

Null text: no words, so it breaks the length rule. Null hosts form one host of their own. Repeated
rows are judged alike and all returned. An empty table gives an empty table. Extra columns, whatever
their names, are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.measure import let
from voxloom.llm.common import BLANK, fresh, stored, words_of

#: A host is refused where a shrunk failure rate is above this.
HOST_LIMIT = 0.5
RULES = ("short", "repeating", "symbols", "lines", "word_length")


def _repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the text holds at least twice.

    Windows are sorted with their positions, so that equal ones are neighbours: no pair lists.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")),
    )

    def covered(ordered: Column) -> Column:
        pairs = F.zip_with(
            ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"]))
        )
        starts = F.array_distinct(F.flatten(F.array_compact(pairs)))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the counts of one text, and one boolean per rule."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{BLANK}]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, f"[{BLANK}]+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeat_words(words).alias("n_repeat_words"),
        ),
    )


def broken(m: Column) -> dict[str, Column]:
    """Which rules a document breaks. The first two are the base; the others use its counts."""
    n = m["n_words"]
    return {
        "short": n < 50,
        "repeating": 100 * m["n_repeat_words"] > 50 * n,
        "symbols": m["n_symbols"] > n,
        "lines": 2 * m["lines"]["n_dup_lines"] > m["lines"]["n_lines"],
        "word_length": (m["word_chars"] > 15 * n) | (m["word_chars"] < 2 * n),
    }


def host_verdicts(measured: DataFrame, host: Column, m: Column) -> DataFrame:
    """One row per host: documents, shrunk rate of each rule, and whether the host is refused.

    Counts are partial sums, so a host with a third of all rows is no burden. The prior of a rule
    is beta(a, b) by the method of moments over hosts; hosts that all fail alike give strength 1e6.
    Only the two prior numbers of each rule come to the driver.
    """
    rules = broken(m)
    counts = measured.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(rules[r].cast("long")).alias(r) for r in RULES]
    )
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    spread = counts.agg(*[F.avg(rate[r]).alias(f"{r}_m") for r in RULES], *[F.var_pop(rate[r]).alias(f"{r}_v") for r in RULES]).first()
    shrunk = {}
    for r in RULES:
        mean, var = spread[f"{r}_m"] or 0.0, spread[f"{r}_v"] or 0.0
        strength = max(mean * (1 - mean) / var - 1, 0.0) if var > 1e-12 else 1e6
        shrunk[r] = (F.col(r) + F.lit(mean * min(strength, 1e6))) / (F.col("n_docs") + F.lit(min(strength, 1e6)))
    return counts.select(
        "host", "n_docs", *[F.round(shrunk[r], 6).alias(f"{r}_rate") for r in RULES],
        F.greatest(*shrunk.values()).__gt__(HOST_LIMIT).alias("host_refused"),
    )


def judged(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with two more columns, named by ``fresh``: the measures and the verdict.

    Measured rows are stored once; the host table is stored too, so that Spark broadcasts it only
    when its real size is small and otherwise sorts, splitting hot hosts.
    """
    m, verdict, key = fresh(docs, "measures"), fresh(docs, "verdict"), fresh(docs, "host_key")
    kept = stored(docs.withColumn(m, measures(docs[text])).withColumn(key, docs[host]))
    hosts = stored(host_verdicts(kept, kept[key], kept[m]))
    name, flag = fresh(kept, "host"), fresh(kept, "host_refused")
    refused = hosts.select(F.col("host").alias(name), F.col("host_refused").alias(flag))
    rules = broken(kept[m])
    own = F.array_compact(F.array(*[F.when(rules[r], F.lit(r)) for r in RULES]))
    # A null-safe key in two columns, so that the join stays an equality join.
    joined = kept.join(
        refused, (F.coalesce(kept[key], F.lit("")) == F.coalesce(refused[name], F.lit(""))) & (kept[key].isNull() == refused[name].isNull()), "left"
    )
    result = F.struct(
        own.alias("rules"), (rules["short"] | rules["repeating"]).alias("base_failed"),
        F.coalesce(F.col(flag), F.lit(False)).alias("host_refused"),
        ((F.size(own) == 0) & ~F.coalesce(F.col(flag), F.lit(False))).alias("kept"),
    )
    return joined.select(*[kept[c] for c in docs.columns], kept[m], result.alias(verdict))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    out = judged(docs, text, host)
    return out.where(out[out.columns[-1]]["kept"]).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document; texts are not carried along."""
    rows = docs.select("doc_id", F.col("source").alias("source"), "text")
    m = stored(rows.select("doc_id", "source", measures(F.col("text")).alias("m")))
    hosts = stored(host_verdicts(m, m["source"], m["m"]))
    rules = broken(m["m"])
    host = hosts.select(F.col("host"), "host_refused")
    joined = m.join(host, (F.coalesce(m["source"], F.lit("")) == F.coalesce(host["host"], F.lit(""))) & (m["source"].isNull() == host["host"].isNull()), "left")
    refused = F.coalesce(F.col("host_refused"), F.lit(False))
    own = F.array_compact(F.array(*[F.when(rules[r], F.lit(r)) for r in RULES]))
    x = m["m"]
    return joined.select(
        "doc_id", x["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"),
        x["lines"]["n_dup_lines"].alias("n_dup_lines"), x["n_repeat_words"].alias("n_repeat_words"),
        (rules["short"] | rules["repeating"]).alias("base_failed"), ((F.size(own) == 0) & ~refused).alias("kept"),
        refused.alias("host_refused"), F.concat_ws(",", own).alias("rules"),
    )
