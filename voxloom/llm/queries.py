"""The registered queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import alignment, cascade, chats, exact, languages, merkle, mixing, packing, personal, quality, recompression, simhash, suffixes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_documents(spark, sf_dir))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chats.report(rows.unionByName(more))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_documents(spark, sf_dir))


def op7_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(_documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.resolve(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_documents(spark, sf_dir))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return cascade.verdicts(pages, cascade.junk_list(pages))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_best_fit_packing, op3_quality_rules, op4_simhash_near_dedup, op5_chat_formatting,
        op6_mix_sources, op7_recompression_dedup, op8_personal_data, op9_language_id, op10_exact_dedup,
        op11_token_alignment, op12_merkle_manifest, op13_url_filters,
    )
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_EXACT = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d
"""

_SAID = "\\### Assistant: </turn> ok"
_CHATS = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + length(replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _quality() -> str:
    """Measures by unnesting words and lines; the prior of each rule from the host table."""
    rules = {
        "short": "n_words < 50", "repeating": "100 * n_repeat_words > 50 * n_words", "symbols": "n_symbols > n_words",
        "lines": "2 * n_dup_lines > n_lines", "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
    }
    flags = ", ".join(f"({sql}) AS {r}" for r, sql in rules.items())
    sums = ", ".join(f"sum(CAST({r} AS INTEGER)) AS {r}" for r in rules)
    priors = ", ".join(f"avg({r} / n) AS {r}_m, var_pop({r} / n) AS {r}_v" for r in rules)
    strength = {
        r: f"CASE WHEN {r}_v > 1e-12 THEN least(greatest({r}_m * (1 - {r}_m) / {r}_v - 1, 0), 1e6) ELSE 1e6 END" for r in rules
    }
    over = " OR ".join(f"({r} + {r}_m * {strength[r]}) / (n + {strength[r]}) > {quality.HOST_LIMIT}" for r in rules)
    failed = " OR ".join(rules)
    named = ", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
p AS (SELECT uid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT uid, i, word, lead(word) OVER q AS b, lead(word, 2) OVER q AS c FROM p WINDOW q AS (PARTITION BY uid ORDER BY i)),
r AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, word, b, c) AS n FROM g WHERE c IS NOT NULL),
covered AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY uid),
chars AS (SELECT uid, count(*) AS n_words, sum(length(word)) AS word_chars FROM p GROUP BY uid),
l AS (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY uid),
m AS (SELECT d.uid, doc_id, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN chars USING (uid) LEFT JOIN lines USING (uid) LEFT JOIN covered USING (uid)),
f AS (SELECT *, {flags} FROM m),
h AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, {sums} FROM f GROUP BY source),
prior AS (SELECT {priors} FROM h),
v AS (SELECT host, {over} AS host_refused FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeating AS base_failed,
       NOT ({failed}) AND NOT host_refused AS kept, host_refused, concat_ws(',', {named}) AS rules
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host
"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _rising(name: str, leaves: str) -> str:
    """A recursive table of all nodes above ``leaves`` (grp, pos, h, n)."""
    return f"""{name}(grp, level, pos, h, n) AS (
  SELECT grp, 0, pos, h, n FROM {leaves}
  UNION ALL SELECT grp, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 2, n)"""


def _beside(stage: int, leaves: str, nodes: str, at: str) -> str:
    """Siblings on the way up from position ``at`` of ``leaves``; null where a node is alone."""
    return f"""SELECT uid, {stage} AS stage, a.level, b.h, b.pos < a.pos AS before FROM {leaves} x
  JOIN {nodes} a ON a.grp = x.grp AND a.pos = x.{at} >> a.level AND a.n > 1
  LEFT JOIN {nodes} b ON b.grp = a.grp AND b.level = a.level AND b.pos = xor(a.pos, 1)"""


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS uid, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp, n_chars, {_CRC} % 7 = 0 AS hit,
         {_field("doc_id")} || {_field("source")} || {_field("lang")} AS head, {_field("text")} AS tail FROM documents),
l AS (SELECT *, sha256(head || {_field("n_chars")} || tail) AS h,
             CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(head || {_field("n_chars + 1")} || tail) END AS changed FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM l),
{_rising("inner_nodes", "leaves")},
subroots AS (SELECT grp AS lang, h, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
{_rising("upper_nodes", "subroots")},
placed AS (SELECT uid, s.grp, s.pos AS lang_pos, s.h AS subroot FROM leaves x JOIN subroots s ON s.lang = x.grp),
steps AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY stage, level) AS step FROM (
  {_beside(0, "leaves", "inner_nodes", "pos")} UNION ALL {_beside(1, "placed", "upper_nodes", "lang_pos")})),
proofs AS (SELECT uid, coalesce(string_agg(h, '' ORDER BY step), '') AS proof FROM steps GROUP BY uid),
fold(uid, step, h) AS (
  SELECT uid, 0, coalesce(changed, h) FROM leaves
  UNION ALL SELECT uid, s.step, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.before THEN s.h || f.h ELSE f.h || s.h END)
  FROM fold f JOIN steps s USING (uid) WHERE s.step = f.step + 1),
ends AS (SELECT uid, arg_max(h, step) AS folded_root FROM fold GROUP BY uid)
SELECT doc_id, leaves.h AS leaf, subroot, u.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = u.h AS verified
FROM leaves JOIN placed USING (uid) JOIN ends USING (uid) LEFT JOIN proofs USING (uid) JOIN (SELECT h FROM upper_nodes WHERE n = 1) u ON true
"""


def _urls() -> str:
    ordered = sorted(cascade.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"WHEN {fit} THEN '{h + p}'" for fit, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {fit} THEN '{v}'" for fit, (v, _, _) in zip(fits, ordered, strict=True))
    return f"""
WITH p AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             regexp_matches(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1), '%%%|[*][*][*]|###') AS junk FROM p),
listed AS (SELECT host || path AS key FROM q WHERE junk AND host <> ''
           UNION SELECT host FROM q WHERE host <> '' GROUP BY host HAVING avg(CAST(junk AS INTEGER)) >= 0.5),
j AS (SELECT *, host <> '' AND (host IN (FROM listed) OR host || path IN (FROM listed)) AS listed FROM q)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM j
"""


#: The other operators hash with functions SQL lacks, iterate or train; tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_quality_rules": _quality(), "op5_chat_formatting": _CHATS, "op10_exact_dedup": _EXACT,
                           "op12_merkle_manifest": _MERKLE, "op13_url_filters": _urls()}
