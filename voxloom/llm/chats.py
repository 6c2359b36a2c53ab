"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins double each message's pointer up its tree, a
round at a time, so that after about log2(depth) rounds every leaf knows its root, its length and its
score; leaves of a root are ranked by mean score and the best paths are spelled out by the same
pointers. Each chosen path becomes one text:

    ### role: text</turn>

``\\``, ``###`` and ``</turn>`` inside texts (and ``:`` and line ends inside roles) are escaped
reversibly, so a control string in the output is always the template's. The loss mask covers the texts
of the assistant.

Null text and null role are empty. Turns of equal number are ordered by role, then text; null turns
come first. A null conversation id is a conversation of its own. Repeated rows are turns of their own.
A message whose parent is missing is a root; messages in a cycle raise an error. Extra columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.llm.common import stored
from voxloom.session import ship_package

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
#: What stands for each control string behind a backslash.
ESCAPES = {"\\": "\\", "###": "h", "</turn>": "e", ":": "c", "\n": "n"}
_BACK = {v: k for k, v in ESCAPES.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: "\\" + ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of one conversation, and the spans under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, True)}{MIDDLE}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for turn in text.split(CLOSE)[:-1]:
        role, _, body = turn.removeprefix(OPEN).partition(MIDDLE)
        turns.append((unescape(role), unescape(body)))
    return turns


def linear(conversations: DataFrame) -> DataFrame:
    """Messages (conv_id, node, parent, score, role, text) of rows by turn: each answers the one before."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return stored(rows.select("conv_id", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, node, place): the messages of the best ``branches`` paths of each root, leaf at place 0.

    ``messages`` is stored and has conv_id, node (unique inside it), parent, score. Ties go to the
    smaller node.
    """
    key = F.struct(F.col("conv_id"), F.col("node"))
    nodes = messages.select(key.alias("node"), F.when(F.col("parent").isNotNull(), F.struct("conv_id", F.col("parent").alias("node"))).alias("up"), "score")
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))

    def on(table: DataFrame, other: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
        a, b = table[left], other[right]
        same = (a["node"] == b["node"]) & (F.coalesce(a["conv_id"], F.lit(0)) == F.coalesce(b["conv_id"], F.lit(0))) & (a["conv_id"].isNull() == b["conv_id"].isNull())
        return table.join(other, same, how)

    known = known.withColumnRenamed("up", "k")
    level = on(nodes, known, "up", "k", "left").select(
        "node", F.when(F.col("known"), F.col("up")).alias("up"), F.col("node").alias("top"), F.lit(1).cast("long").alias("length"), F.col("score").alias("total")
    )
    started = stored(level)
    first, active, resolved = started, started.where("up is not null"), [started.where("up is null")]
    levels, limit = [], started.count().bit_length() + 1
    while not active.isEmpty():
        if len(levels) == limit:
            raise ValueError("messages answer one another in a circle")
        levels.append(active)
        state = active  # every message as it stands; only those that have not reached their root go on
        for table in resolved:
            state = state.union(table)
        above = state.select(*[F.col(c).alias(f"a_{c}") for c in state.columns])
        met = stored(on(active, above, "up", "a_node").select(
            "node", F.col("a_up").alias("up"), F.col("a_top").alias("top"), (F.col("length") + F.col("a_length")).alias("length"), (F.col("total") + F.col("a_total")).alias("total")
        ))
        active = met.where("up is not null")
        resolved.append(met.where("up is null"))
    done = resolved[0]
    for table in resolved[1:]:
        done = done.union(table)
    answered = first.where("up is not null").select(F.col("up").alias("p")).distinct()
    leaves = on(done, answered, "node", "p", "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy((F.col("total") / F.col("length")).desc(), "node"))
    path = stored(leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("place")))
    for r in reversed(range(len(levels))):
        jump = levels[r].select(F.col("node").alias("from"), "up")
        path = stored(path.union(on(path, jump, "node", "from").select("leaf", "up", F.col("place") + (1 << r))))
    return path.select(F.col("leaf.conv_id").alias("conv_id"), F.col("leaf.node").alias("leaf"), F.col("node.node").alias("node"), "place")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, leaf, text, spans): one formatted conversation per chosen path."""
    ship_package(messages.sparkSession)
    m = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = (m["n"] == paths["node"]) & (F.coalesce(m["c"], F.lit(0)) == F.coalesce(paths["conv_id"], F.lit(0))) & (m["c"].isNull() == paths["conv_id"].isNull())
    turns = m.join(paths, same).groupBy("conv_id", "leaf").agg(F.collect_list(F.struct((-F.col("place")).alias("at"), "role", "text")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for row in b.column("turns"):
                ordered = sorted(row.as_py(), key=lambda t: t["at"])
                text, mask = render([(t["role"], t["text"]) for t in ordered])
                texts.append(text)
                spans.append([{"start": a, "end": z} for a, z in mask])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("leaf"), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "leaf", "text", "spans"])

    return turns.mapInArrow(run, f"conv_id {dict(messages.dtypes)['conv_id']}, leaf bigint, text string, spans array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and masks say: conv_id, n_turns, turns_sha256, loss_chars, ..."""
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text."""
    messages = linear(conversations)
    return read_back(format_paths(messages, best_paths(messages)))
